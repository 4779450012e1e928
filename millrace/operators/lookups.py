"""Look-ups by parameter as SQL table functions over stored relations: callable for one request or, laterally, for a table of them.

A relation is stored in one folder per value of what is looked up first, so a request reads its folder, and a
table of requests those that it names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import relational as R

#: Realms a search gives at most.
MOST = 100


def store_realms(realms: DataFrame, path: str) -> None:
    """Write realms (region, slug, name) by region.  Those without a region or name are left out."""
    kept = realms.select("region", "slug", "name").where("region is not null and name is not null")
    kept.repartition("region").write.partitionBy("region").parquet(path)


def store_members(members: DataFrame, path: str) -> None:
    """Write members (realm, guild, char_id, name, level, rank) by the realm's slug, with the guild's slug and their place.

    Places in a guild: rank (0 first, null last as 99), level from high to low (null as 0), char_id, which must be unique
    for a fixed result.  They are made once, by ranges, so a guild may hold much of the table.  Members without a
    realm or guild are left out."""
    slug = lambda c: F.nullif(T.slug(F.col(c)), F.lit(""))
    slugged = members.select(slug("realm").alias("realm_slug"), slug("guild").alias("guild_slug"), F.col("char_id").cast("long").alias("char_id"), "name", F.col("level").cast("int").alias("level"), F.col("rank").cast("int").alias("rank"))
    kept = slugged.where("realm_slug is not null and guild_slug is not null")
    order = [F.coalesce("rank", F.lit(99)), F.negative(F.coalesce("level", F.lit(0))), F.col("char_id")]
    R.positions(kept, ["realm_slug", "guild_slug"], order).sortWithinPartitions("realm_slug", "guild_slug", "pos").write.partitionBy("realm_slug").parquet(path)


def realm_search(spark: SparkSession, path: str) -> None:
    """Define ``realm_search(region, needle)``: (slug, name, pos) of the realms of a region whose name holds the
    needle, in either case and without the blanks around it; the first hundred by name, then slug, which is the feature.

    A null region finds nothing; a null or blank needle finds every realm.  Regions are compared in lower case."""
    _view(spark, path, "stored_realms", "region STRING, slug STRING, name STRING")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION realm_search(place STRING, needle STRING) RETURNS TABLE (slug STRING, name STRING, pos INT)
        RETURN SELECT slug, name, pos FROM (SELECT r.slug, r.name, row_number() OVER (ORDER BY lower(r.name), r.slug) AS pos FROM stored_realms r
          WHERE r.region = lower(realm_search.place) AND contains(lower(r.name), lower(trim(coalesce(realm_search.needle, ''))))) WHERE pos <= {MOST}""")


def guild_roster(spark: SparkSession, path: str) -> None:
    """Define ``guild_roster(realm, guild)``: (char_id, name, level, rank, pos) of a guild, by names or slugs.

    What is not stored, and a null on either side, has no rows.  The slug of what is asked for is that of
    ``text.slug``; one request reads one folder and the row groups of its guild."""
    _view(spark, path, "stored_members", "guild_slug STRING, char_id BIGINT, name STRING, level INT, rank INT, pos BIGINT, realm_slug STRING")
    slug = lambda p: f"regexp_replace(replace(lower(trim(guild_roster.{p})), '\\'', ''), '[ _]+', '-')"
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION guild_roster(realm STRING, guild STRING) RETURNS TABLE (char_id BIGINT, name STRING, level INT, rank INT, pos BIGINT)
        RETURN SELECT m.char_id, m.name, m.level, m.rank, m.pos FROM stored_members m WHERE m.realm_slug = {slug('realm')} AND m.guild_slug = {slug('guild')}""")


def _view(spark: SparkSession, path: str, name: str, schema: str) -> None:
    spark.read.schema(schema).parquet(path).createOrReplaceTempView(name)
