"""Queries that look realms and rosters up for tables of requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import lookups
from millrace.operators.checkpoints import new_folder
from millrace.plans.catalog import query
from millrace.sources.tables import table


@query("s24_realm_requests", """SELECT c_custkey AS request, n_name AS name, pos FROM (
  SELECT c_custkey, n_name, row_number() OVER (PARTITION BY c_custkey ORDER BY lower(n_name), n_nationkey) AS pos FROM customer JOIN nation ON n_regionkey = c_custkey % 6
  WHERE contains(lower(n_name), CASE WHEN c_custkey % 7 = 0 THEN '' ELSE lower('_' || c_custkey % 3) END)) WHERE pos <= 100""")
def realm_requests(spark, sf):
    """A search for every customer: blank, or for names with a number; one region in six is unknown."""
    path = new_folder(spark, "realms")
    lookups.store_realms(table(spark, sf, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("region"), F.lpad(F.col("n_nationkey").cast("string"), 4, "0").alias("slug"), F.col("n_name").alias("name")), path)
    lookups.realm_search(spark, path)
    key = F.col("c_custkey")
    asked = table(spark, sf, "customer").select(key.alias("request"), F.concat(F.lit("R"), (key % 6).cast("string")).alias("place"), F.when(key % 7 != 0, F.concat(F.lit(" _"), (key % 3).cast("string"))).alias("needle"))
    return spark.sql("SELECT q.request, f.name, f.pos FROM {asked} q, LATERAL realm_search(q.place, q.needle) f", asked=asked)


@query("s25_roster_requests", """WITH members AS (SELECT c_custkey AS char_id, c_name AS name, c_nationkey AS realm, c_custkey % 9 AS guild, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 80 END AS level, CASE WHEN c_custkey % 6 <> 5 THEN c_custkey % 6 END AS rank FROM customer),
placed AS (SELECT *, row_number() OVER (PARTITION BY realm, guild ORDER BY coalesce(rank, 99), -coalesce(level, 0), char_id) AS pos FROM members)
SELECT s_suppkey AS request, char_id, name, level, rank, pos FROM supplier JOIN placed ON realm = s_nationkey AND guild = s_suppkey % 11""")
def roster_requests(spark, sf):
    """A roster for every supplier, by names; two guilds in eleven are unknown."""
    key, path = F.col("c_custkey"), new_folder(spark, "members")
    members = table(spark, sf, "customer").select(
        F.concat(F.lit("Realm "), "c_nationkey").alias("realm"), F.concat(F.lit("The g'uild_"), (key % 9).cast("string")).alias("guild"), key.alias("char_id"), F.col("c_name").alias("name"),
        F.when(key % 4 != 0, key % 80).alias("level"), F.when(key % 6 != 5, key % 6).alias("rank"),
    )
    lookups.store_members(members, path)
    lookups.guild_roster(spark, path)
    asked = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("request"), F.concat(F.lit(" realm_"), "s_nationkey").alias("realm"), F.concat(F.lit("the-GUILD "), (F.col("s_suppkey") % 11).cast("string")).alias("guild"))
    return spark.sql("SELECT q.request, f.* FROM {asked} q, LATERAL guild_roster(q.realm, q.guild) f", asked=asked)
