"""Queries for scans, filters, joins, aggregates, windows, sorts and set operations over stored tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import relational as R
from millrace.plans.catalog import query
from millrace.sources.tables import CHARACTERS_SQL, COMPLETED_SQL, QUESTS_SQL, characters, completed, quests, table

AS_OF = "2024-01-20 00:00:00"
_TS = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


def _ts(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("s01_get_by_key", "SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey = 77")
def s01(spark, sf):
    return table(spark, sf, "customer").where("c_custkey = 77").select("c_custkey", "c_name", "c_nationkey")


@query("s02_paged_scan", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40")
def s02(spark, sf):
    building = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name", "c_acctbal")
    return R.page(building, [F.desc("c_acctbal"), F.asc("c_custkey")], 20, 40)


@query("s03_insert", "SELECT n_nationkey, n_name FROM nation UNION ALL VALUES (100, 'ATLANTIS'), (101, 'MU')")
def s03(spark, sf):
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return nation.unionByName(spark.createDataFrame([(100, "ATLANTIS"), (101, "MU")], "n_nationkey int, n_name string"))


@query("s04_update", "SELECT s_suppkey, s_name, CASE WHEN s_nationkey = 3 THEN round(s_acctbal * 2, 2) ELSE s_acctbal END AS s_acctbal FROM supplier")
def s04(spark, sf):
    supplier = table(spark, sf, "supplier")
    changes = supplier.where("s_nationkey = 3").select("s_suppkey", F.round(F.col("s_acctbal") * 2, 2).alias("s_acctbal"))
    return R.update_rows(supplier.select("s_suppkey", "s_name", "s_acctbal"), changes, ["s_suppkey"])


@query("s05_delete", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def s05(spark, sf):
    gone = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").join(gone, "o_custkey", "left_anti").select("o_orderkey", "o_orderstatus")


@query("s16_replace_chunks", """WITH new AS (SELECT conv_id, turn, 'again: ' || role AS role FROM conversations WHERE conv_id % 3 = 0 AND turn < 2)
SELECT conv_id, turn, role FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM new) UNION ALL SELECT * FROM new""")  # fmt: skip
def s16(spark, sf):
    old = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    new = old.where("conv_id % 3 = 0 and turn < 2").withColumn("role", F.concat(F.lit("again: "), F.col("role")))
    return R.replace_rows(old, new, ["conv_id"])


@query("s14_cache_keys", "SELECT event_id, sha256(event_type || '|' || props) AS cache_key, event_type = 'signup' AS user_scoped FROM events")
def s14(spark, sf):
    return table(spark, sf, "events").select("event_id", F.sha2(F.concat_ws("|", "event_type", "props"), 256).alias("cache_key"), (F.col("event_type") == "signup").alias("user_scoped"))


@query("s15_get_many", "SELECT k.i AS wanted, c_name FROM range(1, 60, 7) k(i) LEFT JOIN customer ON c_custkey = k.i AND c_acctbal > 0")
def s15(spark, sf):
    held = table(spark, sf, "customer").where("c_acctbal > 0")
    return spark.range(1, 60, 7).join(held, F.col("id") == F.col("c_custkey"), "left").select(F.col("id").alias("wanted"), "c_name")


@query("s17_drop_prefix", "SELECT p_partkey, p_name FROM part WHERE NOT starts_with(p_name, 'a') AND NOT starts_with(p_name, 's')")
def s17(spark, sf):
    name = F.col("p_name")
    return table(spark, sf, "part").where(~F.startswith(name, F.lit("a")) & ~F.startswith(name, F.lit("s"))).select("p_partkey", "p_name")


@query("s23_newest_four", f"SELECT user_id, event_type, event_id, {_TS.format('ts')} AS ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 4")
def s23(spark, sf):
    return R.top_per_group(table(spark, sf, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")], 4).select("user_id", "event_type", "event_id", _ts("ts").alias("ts"))


@query("s24_realm_search", "SELECT n_nationkey, n_name FROM nation WHERE contains(lower(n_name), '_1') ORDER BY lower(n_name) LIMIT 5")
def s24(spark, sf):
    return table(spark, sf, "nation").where(F.contains(F.lower("n_name"), F.lit("_1"))).orderBy(F.lower("n_name")).limit(5).select("n_nationkey", "n_name")


@query("s20_registry_conflicts", "SELECT n_nationkey, count(DISTINCT n_name) AS names FROM (SELECT n_nationkey, n_name FROM nation UNION ALL VALUES (3, 'OTHER'), (4, (SELECT n_name FROM nation WHERE n_nationkey = 4))) GROUP BY 1 HAVING count(DISTINCT n_name) > 1")
def s20(spark, sf):
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    more = spark.createDataFrame([(3, "OTHER")], "n_nationkey int, n_name string").unionByName(nation.where("n_nationkey = 4"))
    return nation.unionByName(more).groupBy("n_nationkey").agg(F.count_distinct("n_name").alias("names")).where("names > 1")


# ---------------------------------------------------------------- filters


@query("f01_equality_filters", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'")
def f01(spark, sf):
    return table(spark, sf, "orders").where((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "1-URGENT")).select("o_orderkey")


@query("f02_list_filters", "SELECT doc_id FROM documents WHERE source IN ('src1', 'src2') AND lang IN ('en', 'de')")
def f02(spark, sf):
    return table(spark, sf, "documents").where(R.in_list("source", ["src1", "src2"]) & R.in_list("lang", ["en", "de"]) & R.in_list("doc_id", None)).select("doc_id")


@query("f03_null_filters", f"WITH {QUESTS_SQL} SELECT count(*) FILTER (faction IS NULL) AS without, count(*) FILTER (faction IS NOT NULL) AS with_faction FROM quests")
def f03(spark, sf):
    q = quests(spark, sf)
    return q.agg(F.count_if(F.col("faction").isNull()).alias("without"), F.count_if(F.col("faction").isNotNull()).alias("with_faction"))


_LAST = "SELECT user_id, max(ts) AS last_sync FROM events GROUP BY user_id"


@query("f04_stale_cutoff", f"SELECT user_id FROM (SELECT c_custkey AS user_id, last_sync FROM customer LEFT JOIN ({_LAST}) e ON c_custkey = user_id) WHERE last_sync < TIMESTAMP '{AS_OF}' - INTERVAL 168 HOURS OR last_sync IS NULL")
def f04(spark, sf):
    last = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("last_sync"))
    all_users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id")).join(last, "user_id", "left")
    return all_users.where(F.expr(f"last_sync < timestamp'{AS_OF}' - interval 168 hours or last_sync is null")).select("user_id")


@query("f05_latest_open_job", "SELECT o_orderkey FROM orders WHERE o_custkey = 7 AND o_orderstatus IN ('O', 'P') ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def f05(spark, sf):
    mine = table(spark, sf, "orders").where("o_custkey = 7").where(F.col("o_orderstatus").isin("O", "P"))
    return mine.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(1).select("o_orderkey")


@query("f06_case_insensitive", "SELECT p_partkey FROM part WHERE lower(p_brand) = lower('BRAND#12') AND lower(p_type) = lower(p_type)")
def f06(spark, sf):
    return table(spark, sf, "part").where((F.lower("p_brand") == F.lower(F.lit("BRAND#12"))) & (F.lower("p_type") == F.lower("p_type"))).select("p_partkey")


@query("f07_either_key", "SELECT c_custkey FROM customer WHERE c_name = 'Customer#000000012' OR c_custkey = 19")
def f07(spark, sf):
    return table(spark, sf, "customer").where((F.col("c_name") == "Customer#000000012") | (F.col("c_custkey") == 19)).select("c_custkey")


@query("f08_owned_rows", "SELECT o_orderkey FROM orders WHERE o_custkey = 11 AND o_orderkey % 2 = 0")
def f08(spark, sf):
    return table(spark, sf, "orders").where("o_custkey = 11 and o_orderkey % 2 = 0").select("o_orderkey")


@query("f09_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def f09(spark, sf):
    some = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(some, "c_custkey", "left_semi").select("c_custkey")


@query("f10_zone_filter", "SELECT n_nationkey, n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE lower(r_name) = 'asia' AND contains(lower(n_name), 'i')")
def f10(spark, sf):
    zones = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return zones.where((F.lower("r_name") == "asia") & F.contains(F.lower("n_name"), F.lit("i"))).select("n_nationkey", "n_name")


_BANDS = [(k, 4 * k, 4 * k + 12) for k in range(20)]
_BANDS_SQL = "bands(zone, lo, hi) AS (VALUES " + ", ".join(map(str, _BANDS)) + ")"


@query("f11_level_band", f"WITH {CHARACTERS_SQL}, {_BANDS_SQL} SELECT char_id, zone FROM characters JOIN bands ON level BETWEEN lo AND hi")
def f11(spark, sf):
    bands = spark.createDataFrame(_BANDS, "zone long, lo int, hi int")
    return characters(spark, sf).join(F.broadcast(bands), F.col("level").between(F.col("lo"), F.col("hi"))).select("char_id", "zone")


@query("f13_quest_eligibility", f"WITH {CHARACTERS_SQL}, {QUESTS_SQL} SELECT char_id, count(*) AS n FROM characters c JOIN quests q ON (q.faction IS NULL OR q.faction = c.faction) AND q.required_level <= c.level AND q.campaign = 'Brand#1' || (char_id % 5 + 1) WHERE char_id <= 200 GROUP BY char_id")
def f13(spark, sf):
    c, q = characters(spark, sf).where("char_id <= 200"), quests(spark, sf)
    mine = c.withColumn("campaign", F.concat(F.lit("Brand#1"), (F.col("char_id") % 5 + 1).cast("string")))
    ok = (q["faction"].isNull() | (q["faction"] == mine["faction"])) & (q["required_level"] <= mine["level"])
    return mine.join(q, (mine["campaign"] == q["campaign"]) & ok).groupBy("char_id").agg(F.count("*").alias("n"))


@query("f13b_quest_eligibility_all", f"WITH {CHARACTERS_SQL}, {QUESTS_SQL} SELECT char_id, count(quest_id) AS n FROM characters c LEFT JOIN quests q ON (q.faction IS NULL OR c.faction IS NULL OR q.faction = c.faction) AND (q.required_level IS NULL OR c.level IS NULL OR q.required_level <= c.level) GROUP BY char_id")
def f13b(spark, sf):
    return R.eligible_counts(characters(spark, sf), quests(spark, sf)).select("char_id", "n")


@query("f19_roster_selection", """SELECT c_nationkey AS account, c_custkey AS char_id FROM (
  SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer WHERE c_custkey % 80 + 1 >= 10) WHERE rn <= 50""")  # fmt: skip
def f19(spark, sf):
    eligible = table(spark, sf, "customer").where("c_custkey % 80 + 1 >= 10")
    return R.top_per_group(eligible, ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")], 50).select(F.col("c_nationkey").alias("account"), F.col("c_custkey").alias("char_id"))


@query("f21_quest_filters", f"WITH {QUESTS_SQL} SELECT quest_id FROM quests WHERE campaign = 'Brand#11' AND quest_type <> 3 AND map_id IN (1, 2, 3, 4, 5)")
def f21(spark, sf):
    return quests(spark, sf).where(R.in_list("campaign", ["Brand#11"]) & (F.col("quest_type") != 3) & R.in_list("map_id", [1, 2, 3, 4, 5])).select("quest_id")


@query("f22_rounded_projection", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS revenue FROM lineitem")
def f22(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("revenue"))


@query("f23_citation_projection", "SELECT l_orderkey, l_linenumber, p_name, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R'")
def f23(spark, sf):
    part = table(spark, sf, "part")
    return table(spark, sf, "lineitem").where("l_returnflag = 'R'").join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "p_name", "p_brand")


# ---------------------------------------------------------------- joins


@query("j01_eager_load", "SELECT c_custkey, count(o_orderkey) AS n, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey), '') AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def j01(spark, sf):
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("o"))
    joined = table(spark, sf, "customer").join(orders, "c_custkey", "left")
    return joined.select("c_custkey", F.coalesce(F.size("o"), F.lit(0)).cast("long").alias("n"), F.coalesce(F.array_join(F.col("o").cast("array<string>"), ","), F.lit("")).alias("orders"))


@query("j02_full_outer_fusion", "SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS suppliers, coalesce(b.n, 0) AS rich_customers FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 8000 GROUP BY 1) a FULL OUTER JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9800 GROUP BY 1) b ON a.k = b.k")
def j02(spark, sf):
    a = table(spark, sf, "supplier").where("s_acctbal > 8000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("a"))
    b = table(spark, sf, "customer").where("c_acctbal > 9800").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("b"))
    return a.join(b, "k", "full_outer").select("k", F.coalesce("a", F.lit(0)).alias("suppliers"), F.coalesce("b", F.lit(0)).alias("rich_customers"))


@query("j04_zone_names", "SELECT c_custkey, coalesce(n_name, 'Map ' || (c_custkey % 40)) AS zone FROM customer LEFT JOIN nation ON n_nationkey = c_custkey % 40")
def j04(spark, sf):
    c = table(spark, sf, "customer").withColumn("map_id", F.col("c_custkey") % 40)
    nation = F.broadcast(table(spark, sf, "nation"))
    return c.join(nation, c["map_id"] == nation["n_nationkey"], "left").select("c_custkey", F.coalesce("n_name", F.concat(F.lit("Map "), F.col("map_id").cast("string"))).alias("zone"))


@query("j06_missing_references", f"WITH {QUESTS_SQL} SELECT DISTINCT pre AS missing FROM quest_edges WHERE pre NOT IN (SELECT quest_id FROM quests WHERE quest_type <> 0)")
def j06(spark, sf):
    edges = quests(spark, sf).select(F.explode("prerequisites").alias("pre"))
    return R.missing_references(edges, "pre", quests(spark, sf).where("quest_type <> 0"), "quest_id")


@query("j07_cross_faction_edges", f"WITH {QUESTS_SQL} SELECT pre, e.quest_id FROM quest_edges e JOIN quests a ON a.quest_id = pre JOIN quests b ON b.quest_id = e.quest_id WHERE a.faction <> b.faction")
def j07(spark, sf):
    q = quests(spark, sf)
    edges = q.select("quest_id", F.col("faction").alias("fb"), F.explode("prerequisites").alias("pre"))
    before = q.select(F.col("quest_id").alias("pre"), F.col("faction").alias("fa"))
    return edges.join(before, "pre").where("fa <> fb").select("pre", "quest_id")


@query("j09_campaign_semi_join", f"WITH {QUESTS_SQL}, {COMPLETED_SQL} SELECT DISTINCT char_id, campaign FROM completed JOIN quests USING (quest_id)")
def j09(spark, sf):
    done = completed(spark, sf)
    return done.join(quests(spark, sf).select("quest_id", "campaign"), "quest_id").select("char_id", "campaign").distinct()


@query("j14_region_match", "SELECT s_suppkey, count(*) AS n FROM supplier JOIN customer ON s_nationkey = c_nationkey GROUP BY s_suppkey")
def j14(spark, sf):
    per = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.count("*").alias("n"))
    return table(spark, sf, "supplier").join(per, "s_nationkey").select("s_suppkey", "n")


@query("j17_last_index_by_title", "SELECT p_name AS title, max(p_partkey) AS number FROM part GROUP BY p_name")
def j17(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_name").alias("title")).agg(F.max("p_partkey").alias("number"))


# ---------------------------------------------------------------- aggregates


@query("a01_filtered_count", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def a01(spark, sf):
    return table(spark, sf, "orders").where("o_orderstatus = 'F' and o_totalprice > 100000").agg(F.count("*").alias("n"))


@query("a03_conditional_count", "SELECT source, count(*) AS total, count(*) FILTER (n_chars > 1000) AS long_ones FROM documents GROUP BY source")
def a03(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("n_chars") > 1000).alias("long_ones"))


@query("a11_distinct_and_sum", "SELECT l_orderkey, count(DISTINCT l_suppkey) AS stops, round(sum(l_quantity), 2) AS seconds FROM lineitem GROUP BY l_orderkey")
def a11(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_suppkey").alias("stops"), F.round(F.sum("l_quantity"), 2).alias("seconds"))


@query("a12_ordered_groups", f"WITH {QUESTS_SQL} SELECT campaign, string_agg(CAST(quest_id AS VARCHAR), ',' ORDER BY required_level, quest_id) AS quests FROM quests GROUP BY campaign")
def a12(spark, sf):
    grouped = quests(spark, sf).groupBy("campaign").agg(F.array_sort(F.collect_list(F.struct("required_level", "quest_id"))).alias("q"))
    return grouped.select("campaign", F.array_join(F.transform("q", lambda x: x["quest_id"].cast("string")), ",").alias("quests"))


@query("a12_group_positions", f"WITH {QUESTS_SQL} SELECT campaign, quest_id, row_number() OVER (PARTITION BY campaign ORDER BY required_level, quest_id) AS pos FROM quests")
def a12_positions(spark, sf):
    """The same order as places of rows, for groups that grow with the table."""
    return R.positions(quests(spark, sf).select("campaign", "quest_id", "required_level"), ["campaign"], [F.col("required_level"), F.col("quest_id")]).drop("required_level")


@query("a13_duplicates", "SELECT p_name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def a13(spark, sf):
    return R.duplicates(table(spark, sf, "part"), ["p_name"])


@query("a21_health_rollup", "SELECT user_id, CASE WHEN bool_and(event_type <> 'error') THEN 'ok' ELSE 'degraded' END AS status FROM events GROUP BY user_id")
def a21(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.when(F.bool_and(F.col("event_type") != "error"), "ok").otherwise("degraded").alias("status"))


# ---------------------------------------------------------------- windows, sorts, sets


@query("w01_list_ranks", "SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer")
def w01(spark, sf):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, sf, "customer").select("c_custkey", "c_nationkey", F.row_number().over(w).cast("long").alias("rank"))


@query("w05_running_seconds", "SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING), 2) AS seconds FROM lineitem")
def w05(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.sum("l_quantity").over(w), 2).alias("seconds"))


_RUNS = """lagged AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
runs AS (SELECT *, sum(CASE WHEN before = event_type THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM lagged)"""


@query("w07_zone_runs", f"WITH {_RUNS} SELECT user_id, run::BIGINT AS run, event_type, count(*) AS n FROM runs GROUP BY ALL")
def w07(spark, sf):
    runs = R.islands(table(spark, sf, "events"), ["user_id"], [F.asc("ts"), F.asc("event_id")], "event_type")
    return runs.groupBy("user_id", "run", "event_type").agg(F.count("*").alias("n"))


@query("w08_without_repeats", f"WITH {_RUNS} SELECT user_id, event_id, event_type FROM runs WHERE before IS NULL OR before <> event_type")
def w08(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").withColumn("before", F.lag("event_type").over(w)).where("before is null or before <> event_type").select("user_id", "event_id", "event_type")


@query("w13_frame_sequence", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events")
def w13(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("seq"))


@query("w14_recent_hundred", "SELECT user_id, count(*) AS kept, min(event_id) AS any_first FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 30 GROUP BY user_id")
def w14(spark, sf):
    kept = R.top_per_group(table(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 30)
    return kept.groupBy("user_id").agg(F.count("*").alias("kept"), F.min("event_id").alias("any_first"))


@query("w06_section_ids", """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents),
e AS (SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS line FROM l)
SELECT doc_id, pos, sum(CASE WHEN pos % 7 = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS section FROM e""")  # fmt: skip
def w06(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return lines.select("doc_id", F.col("pos").cast("long").alias("pos"), F.sum(F.when(F.col("pos") % 7 == 3, 1).otherwise(0)).over(w).alias("section"))


@query("t01_roster_page", f"WITH {CHARACTERS_SQL} SELECT char_id, level, name FROM characters ORDER BY level DESC, name, char_id LIMIT 25 OFFSET 5")
def t01(spark, sf):
    return R.page(characters(spark, sf).select("char_id", "level", "name"), [F.desc("level"), F.asc("name"), F.asc("char_id")], 25, 5)


@query("t02_nulls_first", f"SELECT c_custkey AS user_id, {_TS.format('last_sync')} AS last_sync FROM customer LEFT JOIN ({_LAST}) ON c_custkey = user_id ORDER BY last_sync NULLS FIRST, c_custkey DESC LIMIT 25")
def t02(spark, sf):
    last = table(spark, sf, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max("ts").alias("last_sync"))
    users = table(spark, sf, "customer").select("c_custkey").join(last, "c_custkey", "left")
    return users.orderBy(F.asc_nulls_first("last_sync"), F.desc("c_custkey")).limit(25).select(F.col("c_custkey").alias("user_id"), _ts("last_sync").alias("last_sync"))


@query("t05_score_then_id", "SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 30")
def t05(spark, sf):
    return table(spark, sf, "part").orderBy(F.desc("p_size"), "p_partkey").limit(30).select("p_partkey", "p_size")


@query("t06_none_last", f"WITH {QUESTS_SQL} SELECT quest_id FROM quests ORDER BY faction IS NULL, coalesce(faction, ''), required_level, quest_id LIMIT 40")
def t06(spark, sf):
    return quests(spark, sf).orderBy(F.col("faction").isNull(), F.coalesce("faction", F.lit("")), "required_level", "quest_id").limit(40).select("quest_id")


@query("t12_recent_conversations", "SELECT conv_id, max(turn) AS last_turn FROM conversations GROUP BY conv_id ORDER BY last_turn DESC, conv_id LIMIT 10")
def t12(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn")).orderBy(F.desc("last_turn"), "conv_id").limit(10)


@query("x17_page_envelope", "SELECT least(20, greatest(0, count(*) - 40)) AS items, count(*) AS total, 20 AS \"limit\", 40 AS \"offset\", count(*) > 60 AS has_more FROM customer")
def x17(spark, sf):
    return R.page_envelope(table(spark, sf, "customer"), [F.asc("c_custkey")], 20, 40)


@query("e01_set_difference", f"""WITH {QUESTS_SQL}, {COMPLETED_SQL},
n AS (SELECT quest_id, count(*) AS n FROM quest_edges GROUP BY quest_id)
SELECT char_id, e.quest_id, n - count(*) AS missing FROM completed c JOIN quest_edges e ON e.pre = c.quest_id JOIN n ON n.quest_id = e.quest_id GROUP BY char_id, e.quest_id, n""")
def e01(spark, sf):
    edges = quests(spark, sf).select("quest_id", F.explode("prerequisites").alias("pre"))
    need = quests(spark, sf).select("quest_id", "prerequisites")
    mine = completed(spark, sf).select("char_id", F.col("quest_id").alias("pre")).join(edges, "pre").groupBy("char_id", "quest_id").agg(F.collect_set("pre").alias("done"))
    return mine.join(need, "quest_id").select("char_id", "quest_id", F.size(F.array_except("prerequisites", "done")).cast("long").alias("missing"))


@query("e02_set_intersection", "SELECT a.o_custkey AS one, b.o_custkey AS two, count(DISTINCT a.o_orderpriority) AS n FROM orders a JOIN orders b ON a.o_orderpriority = b.o_orderpriority AND b.o_custkey = a.o_custkey + 1 GROUP BY 1, 2")
def e02(spark, sf):
    sets = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"))
    one = sets.select(F.col("o_custkey").alias("one"), F.col("p").alias("p1"), (F.col("o_custkey") + 1).alias("two"))
    two = sets.select(F.col("o_custkey").alias("two"), F.col("p").alias("p2"))
    return one.join(two, "two").where(F.arrays_overlap("p1", "p2")).select("one", "two", F.size(F.array_intersect("p1", "p2")).cast("long").alias("n"))


@query("e03_union_of_candidates", "SELECT k, sum(n)::BIGINT AS n FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, count(*) FROM supplier GROUP BY 1) GROUP BY k")
def e03(spark, sf):
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n"))
    return c.unionByName(s).groupBy("k").agg(F.sum("n").alias("n"))


@query("e04_ordered_distinct", """WITH f AS (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY 1, 2) SELECT conv_id, string_agg(role, ',' ORDER BY t, role) AS roles FROM f GROUP BY conv_id""")
def e04(spark, sf):
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    return turns.select("conv_id", F.array_join(F.array_distinct(F.col("r.role")), ",").alias("roles"))


# ---------------------------------------------------------------- incremental and event processing


_STORED = "stored AS (SELECT doc_id AS k, md5(CASE WHEN doc_id % 11 = 0 THEN 'old' ELSE text END) AS h, 1 AS fetched FROM documents WHERE doc_id % 4 <> 3)"
_COMING = "coming AS (SELECT doc_id AS k, md5(text) AS h, 2 AS fetched FROM documents WHERE doc_id % 5 <> 0)"


def stored(spark, sf):
    return table(spark, sf, "documents").where("doc_id % 4 <> 3").select(F.col("doc_id").alias("k"), F.md5(F.when(F.col("doc_id") % 11 == 0, "old").otherwise(F.col("text"))).alias("h"), F.lit(1).alias("fetched"))


def coming(spark, sf):
    return table(spark, sf, "documents").where("doc_id % 5 <> 0").select(F.col("doc_id").alias("k"), F.md5("text").alias("h"), F.lit(2).alias("fetched"))


@query("j16_unchanged_detection", f"WITH {_STORED}, {_COMING} SELECT k, CASE WHEN s.k IS NULL THEN 'insert' WHEN s.h <> c.h THEN 'update' ELSE 'touch' END AS action FROM coming c LEFT JOIN stored s USING (k)")
def j16(spark, sf):
    return R.upsert_actions(stored(spark, sf), coming(spark, sf), "k", ["h"])


@query("m02_upsert", f"WITH {_STORED}, {_COMING} SELECT k, CASE WHEN c.h IS NULL THEN s.h ELSE c.h END AS h, CASE WHEN c.fetched IS NULL THEN s.fetched ELSE c.fetched END AS fetched FROM stored s FULL OUTER JOIN coming c USING (k)")
def m02(spark, sf):
    return R.upsert(stored(spark, sf), coming(spark, sf), "k", ["h"], "fetched")


ACTIONS_SQL = f"{_STORED}, {_COMING}, actions AS (SELECT CASE WHEN s.k IS NULL THEN 'insert' WHEN s.h <> c.h THEN 'update' ELSE 'touch' END AS action FROM coming c LEFT JOIN stored s USING (k))"


@query("a16_run_counters", f"WITH {ACTIONS_SQL} SELECT count(*) AS seen, count(*) FILTER (action <> 'touch') AS written, count(*) FILTER (action = 'touch') AS skipped, 'completed' AS status FROM actions")
def a16(spark, sf):
    a = R.upsert_actions(stored(spark, sf), coming(spark, sf), "k", ["h"])
    errors = F.lit(0)
    written = F.count_if(F.col("action") != "touch")
    status = F.when((errors > 0) & (written == 0), "failed").when(errors > 0, "partial").otherwise("completed")
    return a.agg(F.count("*").alias("seen"), written.alias("written"), F.count_if(F.col("action") == "touch").alias("skipped"), status.alias("status"))


@query("m03_dry_run", f"WITH {ACTIONS_SQL} SELECT action, count(*) AS n FROM actions GROUP BY action")
def m03(spark, sf):
    return R.upsert_actions(stored(spark, sf), coming(spark, sf), "k", ["h"]).groupBy("action").agg(F.count("*").alias("n"))


@query("m04_staleness_sweep", f"SELECT user_id FROM ({_LAST}) WHERE last_sync < TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 4 HOURS ORDER BY last_sync, user_id LIMIT 25")
def m04(spark, sf):
    last = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("last_sync"))
    return last.where(F.expr(f"last_sync < timestamp'2024-01-30 00:00:00' - interval 4 hours")).orderBy("last_sync", "user_id").limit(25).select("user_id")


@query("m06_rate_limit", """WITH b AS (SELECT event_id, user_id, ts, floor(epoch(ts))::BIGINT AS e, floor(epoch(ts))::BIGINT // 86400 AS bucket FROM events)
SELECT event_id, bucket, row_number() OVER w AS n, row_number() OVER w <= 5 AS allowed, CASE WHEN row_number() OVER w > 5 THEN 86400 - e % 86400 END AS retry_after FROM b WINDOW w AS (PARTITION BY user_id, bucket ORDER BY ts, event_id)""")  # fmt: skip
def m06(spark, sf):
    r = R.rate_limited(table(spark, sf, "events"), "user_id", "ts", 86400, 5, "event_id")
    return r.select("event_id", "bucket", F.col("n").cast("long").alias("n"), "allowed", "retry_after")


@query("m08_fan_out", "SELECT e.event_id, s.user_id AS subscriber FROM events e JOIN (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup') s ON s.user_id = e.user_id WHERE e.event_type = 'purchase'")
def m08(spark, sf):
    e = table(spark, sf, "events")
    subscribers = e.where("event_type = 'signup'").select("user_id").distinct()
    return e.where("event_type = 'purchase'").join(subscribers, "user_id").select("event_id", F.col("user_id").alias("subscriber"))


@query("m09_inbound_frames", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type IN ('click', 'view') AND CAST(json_extract(props, '$.k') AS BIGINT) >= 50")
def m09(spark, sf):
    frames = table(spark, sf, "events").where(F.col("event_type").isin("click", "view")).select("event_id", F.from_json("props", "k long")["k"].alias("k"))
    return frames.where("k >= 50")


@query("m12_roster_import", """SELECT coalesce(a.n, b.n) AS name, CASE WHEN a.n IS NULL THEN 'insert' WHEN b.n IS NULL THEN 'keep' ELSE 'update' END AS action, coalesce(a.goal, '') AS goal, coalesce(b.bal, a.bal) AS balance
FROM (SELECT lower(c_name) AS n, 'goal ' || c_custkey AS goal, c_acctbal AS bal FROM customer WHERE c_custkey % 3 <> 0) a
FULL OUTER JOIN (SELECT lower(c_name) AS n, round(c_acctbal + 1, 2) AS bal FROM customer WHERE c_custkey % 2 = 0) b ON a.n = b.n""")  # fmt: skip
def m12(spark, sf):
    c = table(spark, sf, "customer")
    a = c.where("c_custkey % 3 <> 0").select(F.lower("c_name").alias("name"), F.concat(F.lit("goal "), F.col("c_custkey").cast("string")).alias("goal"), F.col("c_acctbal").alias("old"), F.lit(1).alias("here"))
    b = c.where("c_custkey % 2 = 0").select(F.lower("c_name").alias("name"), F.round(F.col("c_acctbal") + 1, 2).alias("new"), F.lit(1).alias("there"))
    action = F.when(F.col("here").isNull(), "insert").when(F.col("there").isNull(), "keep").otherwise("update")
    return a.join(b, "name", "full_outer").select("name", action.alias("action"), F.coalesce("goal", F.lit("")).alias("goal"), F.coalesce("new", "old").alias("balance"))


@query("m11_partial_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 6 = 0 THEN 0.0::DOUBLE ELSE c_acctbal END AS c_acctbal FROM customer")
def m11(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    key = F.col("c_custkey")
    changes = c.where("c_custkey % 4 = 0 or c_custkey % 6 = 0").select("c_custkey", F.when(key % 4 == 0, "NEW").alias("c_mktsegment"), F.when(key % 6 == 0, 0.0).alias("c_acctbal"))
    return R.update_rows(c, changes, ["c_custkey"])


@query("m15_newest_frame", "SELECT user_id, event_type, max(event_id) AS seq FROM events GROUP BY 1, 2")
def m15(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("seq"))


@query("a17_sync_report", "SELECT user_id, count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed, CASE WHEN count(*) FILTER (event_type = 'error') = 0 THEN 'success' WHEN count(*) FILTER (event_type <> 'error') = 0 THEN 'failed' ELSE 'partial' END AS status FROM events GROUP BY user_id")
def a17(spark, sf):
    good, bad = F.count_if(F.col("event_type") != "error"), F.count_if(F.col("event_type") == "error")
    return table(spark, sf, "events").groupBy("user_id").agg(good.alias("succeeded"), bad.alias("failed"), F.when(bad == 0, "success").when(good == 0, "failed").otherwise("partial").alias("status"))


@query("x11_durations", "SELECT user_id, (floor(epoch(max(ts)))::BIGINT - floor(epoch(min(ts)))::BIGINT) AS seconds, max(ts) <= TIMESTAMP '2024-01-29 12:00:00' AS expired FROM events GROUP BY user_id")
def x11(spark, sf):
    seconds = F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))
    return table(spark, sf, "events").groupBy("user_id").agg(seconds.alias("seconds"), (F.max("ts") <= F.expr("timestamp'2024-01-29 12:00:00'")).alias("expired"))


@query("r17_conversation_titles", "SELECT conv_id, substr(first(text ORDER BY turn), 1, 80) AS title, count(*) AS turns FROM conversations GROUP BY conv_id")
def r17(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.substring(F.min_by("text", "turn"), 1, 80).alias("title"), F.count("*").alias("turns"))


@query("r20_question_fingerprint", "SELECT DISTINCT substr(sha256(lower(trim(text)) || '|' || role), 1, 32) AS fingerprint FROM conversations")
def r20(spark, sf):
    return table(spark, sf, "conversations").select(F.substring(F.sha2(F.concat_ws("|", F.lower(F.trim("text")), "role"), 256), 1, 32).alias("fingerprint")).distinct()


_INTENTS = [("rest", "the", 1.0, 0), ("rest", "heed", 2.0, 0), ("search", "ing", 1.5, 1), ("search", "that", 1.0, 1), ("praise", "of", 1.2, 2)]
_INTENTS_SQL = "intents(intent, token, weight, ordinal) AS (VALUES " + ", ".join(f"('{a}', '{b}', {c}::DOUBLE, {d})" for a, b, c, d in _INTENTS) + ")"


@query("a18_intents", f"""WITH {_INTENTS_SQL}, w AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS token FROM conversations WHERE role = 'user'),
h AS (SELECT conv_id, turn, intent, ordinal, round(sum(weight), 6) AS score FROM w JOIN intents USING (token) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, ordinal) AS rn FROM h)
SELECT conv_id, turn, coalesce(intent, 'open') AS intent, coalesce(score, 0.0::DOUBLE) AS score FROM conversations LEFT JOIN (SELECT * FROM r WHERE rn = 1) USING (conv_id, turn) WHERE role = 'user'""")
def a18(spark, sf):
    asked = table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    words = asked.select("conv_id", "turn", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9_]+)"), F.lit(1))).alias("token"))
    dim = spark.createDataFrame(_INTENTS, "intent string, token string, weight double, ordinal int")
    scores = words.join(F.broadcast(dim), "token").groupBy("conv_id", "turn", "intent", "ordinal").agg(F.round(F.sum("weight"), 6).alias("score"))
    best = R.latest(scores, ["conv_id", "turn"], [F.desc("score"), F.asc("ordinal")])
    return asked.select("conv_id", "turn").join(best, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("intent", F.lit("open")).alias("intent"), F.coalesce("score", F.lit(0.0)).alias("score"))
