"""Queries over payloads: JSON made from the tables, with gaps, and read back by the extraction operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import semistructured as S
from millrace.functions import text as T
from millrace.operators import records as P
from millrace.operators import relational as R
from millrace.plans.catalog import query
from millrace.sources.tables import table


def _json(*cols):
    return F.to_json(F.struct(*cols))


def _c():
    return F.col("c_custkey")


def character_payloads(spark, sf):
    """customer as character payloads: names in three shapes, every fifth without a guild, every seventh broken."""
    k = _c()
    class_ = F.when(k % 3 == 0, F.to_json(F.struct(F.struct(F.col("c_mktsegment").alias("en_US")).alias("name")))).when(k % 3 == 1, F.to_json(F.struct(F.col("c_mktsegment").alias("name")))).otherwise(F.concat(F.lit('"'), F.col("c_mktsegment"), F.lit('"')))
    base = F.concat(
        F.lit('{"id": '), k.cast("string"), F.lit(', "name": "'), F.col("c_name"), F.lit('", "level": '), (k % 80 + 1).cast("string"), F.lit(', "realm": {"slug": "realm-'), F.col("c_nationkey").cast("string"),
        F.lit('"}, "faction": {"type": "HORDE"}, "character_class": '), class_, F.when(k % 5 != 0, F.concat(F.lit(', "guild": {"name": "G'), (k % 9).cast("string"), F.lit('"}'))).otherwise(""),
        F.when(k % 4 == 0, ', "active_spec": {"name": "Guardian"}').otherwise(""), F.when(k % 2 == 0, ', "equipped_item_level": 400').otherwise(', "equipped_item_level": null'), F.lit(', "last_login_timestamp": '), F.when(k % 6 == 0, '"soon"').otherwise((k * 86_400_000).cast("string")), F.lit("}"),
    )
    return table(spark, sf, "customer").select(k.alias("char_id"), F.when(k % 7 == 0, "{not json").otherwise(base).alias("payload"))


@query("x04_character_summaries", """SELECT c_custkey AS char_id, CASE WHEN ok THEN c_custkey END AS id, CASE WHEN ok THEN c_name END AS name, CASE WHEN ok THEN 'realm-' || c_nationkey END AS realm, CASE WHEN ok THEN c_custkey % 80 + 1 END AS level, CASE WHEN ok THEN 'horde' END AS faction, CASE WHEN ok THEN c_mktsegment END AS class,
  CASE WHEN ok AND c_custkey % 4 = 0 THEN 'tank' ELSE 'damage' END AS role, CASE WHEN ok AND c_custkey % 2 = 0 THEN 400 ELSE 0 END AS item_level, CASE WHEN ok AND c_custkey % 5 <> 0 THEN 'G' || c_custkey % 9 END AS guild, CASE WHEN ok AND c_custkey % 6 <> 0 THEN c_custkey * 86400 END AS last_login
  FROM (SELECT *, c_custkey % 7 <> 0 AS ok FROM customer)""")
def x04(spark, sf):
    return P.summaries(character_payloads(spark, sf), "char_id").withColumn("last_login", F.unix_timestamp("last_login"))


_LOCAL = [(1, '"plain"'), (2, '{"name": "inner"}'), (3, '{"name": {"en_US": "us"}}'), (4, '{"en_GB": "gb", "de_DE": "de"}'), (5, '{"de_DE": "de"}'), (6, "17"), (7, "{}"), (8, None), (9, '{"name": {"en_GB": "gb", "en_US": "us"}}'), (10, "null"), (11, "{oops")]


@query("x01_localized", "SELECT * FROM (VALUES (1, 'plain'), (2, 'inner'), (3, 'us'), (4, 'gb'), (5, 'de'), (6, NULL), (7, NULL), (8, NULL), (9, 'us'), (10, NULL), (11, NULL)) v(id, text)")
def x01(spark, sf):
    return spark.createDataFrame(_LOCAL, "id int, payload string").select("id", S.localized(F.try_parse_json("payload")).alias("text"))


@query("x03_millis", "SELECT * FROM (VALUES (1, 1700000000), (2, NULL), (3, NULL), (4, 0), (5, NULL)) v(id, epoch)")
def x03(spark, sf):
    rows = spark.createDataFrame([(1, "1700000000123"), (2, '"soon"'), (3, None), (4, "0"), (5, "true")], "id int, payload string")
    return rows.select("id", F.unix_timestamp(S.millis(F.try_parse_json("payload"))).alias("epoch"))


def order_payloads(spark, sf):
    """orders with their lines as equipment payloads; every fourth line without enchantments, every ninth order without items."""
    k = F.col("l_orderkey")
    item = F.struct(
        F.struct(F.concat(F.lit("S"), F.col("l_linenumber").cast("string")).alias("type")).alias("slot"), F.struct(F.col("l_partkey").alias("id")).alias("item"), F.struct(F.col("l_returnflag").alias("en_US")).alias("name"),
        F.struct(F.col("l_quantity").cast("long").alias("value")).alias("level"), F.when(F.col("l_partkey") % 4 != 0, F.array(F.struct(F.col("l_linestatus").alias("display_string")), F.struct(F.lit("").alias("display_string")))).alias("enchantments"),
    )
    got = table(spark, sf, "lineitem").groupBy(k.alias("set_id")).agg(F.collect_list(item).alias("equipped_items"))
    return got.select("set_id", F.when(F.col("set_id") % 9 == 0, "{}").otherwise(_json("equipped_items")).alias("payload"))


@query("x05_equipment", "SELECT l_orderkey AS set_id, 'S' || l_linenumber AS slot, l_partkey AS item_id, l_returnflag AS name, CAST(l_quantity AS BIGINT) AS item_level, CASE WHEN l_partkey % 4 <> 0 THEN l_linestatus ELSE '' END AS enchantments FROM lineitem WHERE l_orderkey % 9 <> 0")
def x05(spark, sf):
    return P.equipment(order_payloads(spark, sf), "set_id").withColumn("enchantments", F.array_join("enchantments", ","))


def spec_payloads(spark, sf):
    k = _c()
    load = lambda i: F.struct((k % 3 == i).alias("is_active"), F.concat(F.lit(f"code{i}-"), k.cast("string")).alias("talent_loadout_code"), F.array(F.struct(F.struct(F.struct(F.concat(F.lit("t"), (k % (i + 2)).cast("string")).alias("name")).alias("talent")).alias("tooltip"))).alias("selected_class_talents"))
    specs = F.array(F.struct(F.struct(F.lit("Arms").alias("name")).alias("specialization"), F.array(load(0), load(1)).alias("loadouts")), F.struct(F.struct(F.lit("Fury").alias("name")).alias("specialization"), F.array(load(1), load(2)).alias("loadouts")))
    return table(spark, sf, "customer").select(k.alias("char_id"), F.when(k % 8 == 0, None).otherwise(_json(specs.alias("specializations"))).alias("payload"))


@query("x06_active_loadouts", "SELECT c_custkey AS char_id, CASE c_custkey % 3 WHEN 2 THEN 'Fury' ELSE 'Arms' END AS spec, 'code' || c_custkey % 3 || '-' || c_custkey AS code FROM customer WHERE c_custkey % 8 <> 0")
def x06(spark, sf):
    return P.active_loadouts(spec_payloads(spark, sf), "char_id")


@query("x06_loadouts", "SELECT c_custkey AS char_id, spec, pos, c_custkey % 3 = i AS is_active, 't' || c_custkey % (i + 2) AS talents FROM customer, (VALUES ('Arms', 0, 0), ('Arms', 1, 1), ('Fury', 0, 1), ('Fury', 1, 2)) v(spec, pos, i) WHERE c_custkey % 8 <> 0")
def x06_all(spark, sf):
    return P.loadouts(spec_payloads(spark, sf), "char_id").select("char_id", "spec", "pos", "is_active", F.array_join("talents", ",").alias("talents"))


def profession_payloads(spark, sf):
    k = _c()
    tier = lambda a: F.struct((k * a % 100).alias("skill_points"), F.sequence(F.lit(1), (k % a + 1).cast("int")).alias("known_recipes"))
    one = F.struct(F.struct(F.lit("Cooking").alias("name")).alias("profession"), F.array(tier(7), tier(13)).alias("tiers"))
    two = F.struct(F.struct(F.lit("Fishing").alias("name")).alias("profession"), F.filter(F.array(tier(3)), lambda x: F.lit(False)).alias("tiers"))
    return table(spark, sf, "customer").select(k.alias("char_id"), _json(F.array(one).alias("primaries"), F.when(k % 2 == 0, F.array(two)).alias("secondaries")).alias("payload"))


@query("a14_professions", "SELECT c_custkey AS char_id, 'primary' AS kind, 'Cooking' AS name, 2 AS n_tiers, greatest(c_custkey * 7 % 100, c_custkey * 13 % 100) AS max_skill, c_custkey % 7 + c_custkey % 13 + 2 AS recipes FROM customer UNION ALL SELECT c_custkey, 'secondary', 'Fishing', 0, 0, 0 FROM customer WHERE c_custkey % 2 = 0")
def a14(spark, sf):
    return P.professions(profession_payloads(spark, sf), "char_id")


@query("x07_reputations", "SELECT c_custkey AS char_id, 'F' || c_nationkey AS faction, (c_custkey * 10 % 1000)::DOUBLE AS value, CASE WHEN c_custkey % 5 <> 0 THEN round((c_custkey * 10 % 1000) / 1000 * 100, 1) END AS percent FROM customer")
def x07(spark, sf):
    k = _c()
    rep = F.struct(F.struct(F.concat(F.lit("F"), F.col("c_nationkey").cast("string")).alias("name")).alias("faction"), F.struct((k * 10 % 1000).alias("value"), F.when(k % 5 == 0, 0).otherwise(1000).alias("max")).alias("standing"))
    return P.reputations(table(spark, sf, "customer").select(k.alias("char_id"), _json(F.array(rep).alias("reputations")).alias("payload")), "char_id")


@query("w14_recent_achievements", "WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events WHERE event_type <> 'error') SELECT user_id, count(*) AS total, string_agg(event_id::VARCHAR, ',' ORDER BY rn) FILTER (rn <= 100) AS ids FROM r GROUP BY user_id")
def w14(spark, sf):
    entry = F.struct(F.col("event_id").alias("id"), F.when(F.col("event_type") != "error", F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("completed_timestamp"))
    rows = table(spark, sf, "events").groupBy("user_id").agg(F.collect_list(entry).alias("achievements")).select("user_id", _json("achievements").alias("payload"))
    return P.achievements(rows, "user_id").where("total > 0").withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query("a15_pets", "WITH p AS (SELECT o_custkey AS k, o_orderkey % 25 + 1 AS l, o_orderpriority || o_orderkey AS n FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY l DESC, n) AS rn FROM p) SELECT k AS char_id, count(*) AS total, max(l) AS max_level, count(*) FILTER (l = 25) AS at_25, string_agg(n, ',' ORDER BY rn) FILTER (rn <= 3) AS first FROM r GROUP BY k")
def a15(spark, sf):
    pet = F.struct((F.col("o_orderkey") % 25 + 1).alias("level"), F.struct(F.concat("o_orderpriority", F.col("o_orderkey").cast("string")).alias("name")).alias("species"))
    rows = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("char_id")).agg(F.collect_list(pet).alias("pets")).select("char_id", _json("pets").alias("payload"))
    return P.pets(rows, "char_id")


@query("j13_account_characters", "SELECT n_nationkey AS key, c_nationkey * 10 + c_custkey % 2 AS account, c_custkey AS character_id, c_name AS name, c_custkey % 80 + 1 AS level FROM customer JOIN nation ON n_nationkey = c_nationkey")
def j13(spark, sf):
    k = _c()
    per = table(spark, sf, "customer").groupBy("c_nationkey", (k % 2).alias("half")).agg(F.collect_list(F.struct(k.alias("id"), F.col("c_name").alias("name"), (k % 80 + 1).alias("level"))).alias("characters"))
    rows = per.groupBy(F.col("c_nationkey").alias("key")).agg(F.collect_list(F.struct((F.col("c_nationkey") * 10 + F.col("half")).alias("id"), "characters")).alias("accounts"))
    return P.accounts(rows.select("key", _json("accounts").alias("payload")), "key")


@query("t07_roster_order", "SELECT c_custkey AS char_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_custkey % 6 = 5 THEN 99 ELSE c_custkey % 6 END, -CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE c_custkey % 80 END, c_custkey) AS pos FROM customer")
def t07(spark, sf):
    from pyspark.sql import Window

    rank, level = F.when(_c() % 6 != 5, _c() % 6), F.when(_c() % 4 != 0, _c() % 80)
    w = Window.partitionBy("c_nationkey").orderBy(F.coalesce(rank, F.lit(99)), F.negative(F.coalesce(level, F.lit(0))), "c_custkey")
    return table(spark, sf, "customer").select(_c().alias("char_id"), F.row_number().over(w).cast("long").alias("pos"))


@query("s25_guild_rosters", "SELECT 'realm-' || c_nationkey AS realm, 'g' || c_custkey % 9 AS guild, count(*) AS members, max(c_custkey % 80 + 1) AS top_level FROM customer GROUP BY ALL")
def s25(spark, sf):
    c = table(spark, sf, "customer").select(F.concat(F.lit("realm-"), F.col("c_nationkey").cast("string")).alias("realm"), T.slug(F.concat(F.lit("G"), (_c() % 9).cast("string"))).alias("guild"), (_c() % 80 + 1).alias("level"))
    return c.groupBy("realm", "guild").agg(F.count("*").alias("members"), F.max("level").alias("top_level"))


@query("t08_ordered_names", "SELECT c_nationkey, string_agg(c_name, ',' ORDER BY lower(c_name), c_name) AS names FROM customer GROUP BY c_nationkey")
def t08(spark, sf):
    got = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct(F.lower("c_name").alias("l"), F.col("c_name").alias("n")))).alias("x"))
    return got.select("c_nationkey", F.array_join(F.col("x.n"), ",").alias("names"))


@query("t08_name_positions", "SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY lower(c_name), c_name, c_custkey) AS pos FROM customer")
def t08_positions(spark, sf):
    """The same order as places of rows, for groups that grow with the table."""
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_name")
    return R.positions(c, ["c_nationkey"], [F.lower("c_name"), F.col("c_name"), _c()]).drop("c_name")


@query("x08_slugs", "SELECT p_partkey, regexp_replace(replace(lower(trim('The ' || p_name || '''s_Hall ')), '''', ''), '[ _]+', '-', 'g') AS slug FROM part")
def x08(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.slug(F.concat(F.lit("The "), F.col("p_name"), F.lit("'s_Hall "))).alias("slug"))


@query("x09_namespaces", "SELECT * FROM (VALUES ('EU', 'static-eu', 'eu.api.example.com'), ('cn', 'static-cn', 'gateway.example.cn')) v(region, namespace, host)")
def x09(spark, sf):
    r = spark.createDataFrame([("EU",), ("cn",)], "region string")
    return r.select("region", S.namespace(F.lit("static"), F.col("region")).alias("namespace"), S.host(F.col("region")).alias("host"))


@query("x10_character_slugs", "SELECT c_custkey AS char_id, lower('eu-realm-' || c_nationkey || '-' || replace(c_name, ' ', '-')) AS slug FROM customer")
def x10(spark, sf):
    return table(spark, sf, "customer").select(_c().alias("char_id"), S.entity_slug(F.lit("EU"), F.concat(F.lit("realm "), F.col("c_nationkey").cast("string")), F.col("c_name")).alias("slug"))


@query("x12_scopes", "SELECT user_id, bool_or(event_type = 'click') AS clicks FROM events GROUP BY user_id")
def x12(spark, sf):
    scopes = table(spark, sf, "events").groupBy("user_id").agg(F.array_join(F.collect_set("event_type"), " ").alias("scopes"))
    return scopes.select("user_id", S.has_scope(F.col("scopes"), "click").alias("clicks"))


@query("x13_math", "SELECT l_orderkey, round(sum(sqrt(l_quantity)), 6) AS roots, round(sum(ln(l_quantity)), 6) AS logs, round(stddev_pop(l_discount), 6) AS spread, sum(CAST(l_quantity AS BIGINT) // 7)::BIGINT AS sevens FROM lineitem GROUP BY l_orderkey")
def x13(spark, sf):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum(F.sqrt(q)), 6).alias("roots"), F.round(F.sum(F.ln(q)), 6).alias("logs"), F.round(F.stddev_pop("l_discount"), 6).alias("spread"), F.sum(F.floor(q / 7)).alias("sevens"))


@query("x15_whole_words", r"SELECT doc_id, len(regexp_extract_all(lower(text), '\bthe\b')) AS n FROM documents")
def x15(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.regexp_count(F.lower("text"), F.lit(r"\bthe\b")).cast("long").alias("n"))


@query("x16_titles", "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') AS title FROM part")
def x16(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.initcap("p_name").alias("title"))


@query("r18_inferred_roles", "SELECT * FROM (VALUES (1, 'tank'), (2, 'healer'), (3, 'damage'), (4, 'damage')) v(id, role)")
def r18(spark, sf):
    return spark.createDataFrame([(1, "Blood"), (2, "HOLY"), (3, "fury"), (4, None)], "id int, spec string").select("id", S.role_of(F.col("spec")).alias("role"))


@query("k36_described_records", "SELECT p_partkey, p_name || ' is a ' || lower(p_type) || '.' || CASE WHEN p_size > 25 THEN ' It is large.' ELSE '' END || ' Made by ' || p_brand || '.' AS body FROM part")
def k36(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", _json("p_name", "p_type", "p_size", "p_brand").alias("payload"))
    v = p.withColumn("r", F.from_json("payload", "p_name string, p_type string, p_size int, p_brand string"))
    body = S.sentence(F.concat(F.col("r.p_name"), F.lit(" is a "), F.lower("r.p_type"), F.lit(".")), F.when(F.col("r.p_size") > 25, "It is large."), F.concat(F.lit("Made by "), F.col("r.p_brand"), F.lit(".")))
    return v.select("p_partkey", body.alias("body"))


@query("k37_pruned_facts", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'name,region' ELSE 'name' END AS keys FROM nation")
def k37(spark, sf):
    facts = F.create_map(F.lit("_links"), F.lit("x"), F.lit("name"), F.col("n_name"), F.lit("region"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey").cast("string")).otherwise(""), F.lit("list"), F.lit("[]"), F.lit("none"), F.lit(None).cast("string"))
    return table(spark, sf, "nation").select("n_nationkey", F.array_join(F.sort_array(F.map_keys(S.pruned(facts))), ",").alias("keys"))


@query("k38_refined_types", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN CASE WHEN p_partkey % 8 = 0 THEN 'dungeon' ELSE 'raid' END ELSE 'item' END AS entity_type FROM part")
def k38(spark, sf):
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select("p_partkey", F.when(k % 4 == 0, "raid").otherwise("item").alias("t"), F.when(k % 8 == 0, "Dungeon").alias("category"))
    return rows.select("p_partkey", F.when((F.col("t") == "raid") & F.coalesce(F.upper("category") == "DUNGEON", F.lit(False)), "dungeon").otherwise(F.col("t")).alias("entity_type"))


@query("s06_index_and_details", "SELECT p_partkey, p_name, CASE WHEN p_partkey % 5 <> 0 THEN p_size END AS level FROM part")
def s06(spark, sf):
    part = table(spark, sf, "part")
    index = part.select(_json(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")).alias("payload")).select(F.from_json("payload", "id long, name string").alias("i")).select("i.*")
    detail = part.where("p_partkey % 5 <> 0").select(_json(F.col("p_partkey").alias("id"), F.col("p_size").alias("level")).alias("payload")).select(F.from_json("payload", "id long, level int").alias("d")).select("d.*")
    return index.join(detail, "id", "left").select(F.col("id").alias("p_partkey"), F.col("name").alias("p_name"), "level")


@query("s08_sitemap_urls", "SELECT DISTINCT url FROM pages WHERE contains(url, '/en/') OR contains(url, '.html') ORDER BY url LIMIT 5000")
def s08(spark, sf):
    group = F.pmod(F.col("page_id"), F.lit(7))
    maps = table(spark, sf, "pages").groupBy(group.alias("g")).agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(F.concat(F.lit("<url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))), ""), F.lit("</urlset>")).alias("xml"))
    broken = spark.createDataFrame([("<urlset><url>",), ("",), (None,)], "xml string")
    return P.sitemap_urls(maps.select("xml").unionByName(broken), "xml", ["/en/", ".html"], 5000)


@query("s09_static_list", "SELECT * FROM (VALUES (0, 'beast'), (1, 'bird'), (2, 'fish')) v(id, family)")
def s09(spark, sf):
    return spark.createDataFrame(list(enumerate(("beast", "bird", "fish"))), "id int, family string")


@query("s10_structured_facts", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 <> 0 THEN nullif(p_partkey * 700 // 1000, 0) END AS seconds FROM part")
def s10(spark, sf):
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select(_json(k.alias("id"), F.when(k % 3 != 0, k * 700).alias("timer_ms")).alias("payload"))
    return rows.select(F.from_json("payload", "id long, timer_ms long").alias("r")).select("r.id", F.nullif(F.floor(F.coalesce("r.timer_ms", F.lit(0)) / 1000), F.lit(0).cast("long")).alias("seconds"))


@query("f20_character_validation", "SELECT c_custkey AS char_id, concat_ws(',', CASE WHEN NOT regexp_matches(c_name, '^[A-Za-z#0-9 ]{2,24}$') THEN 'name' END, CASE WHEN c_custkey % 100 NOT BETWEEN 1 AND 80 THEN 'level' END, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') THEN 'class' END) AS errors FROM customer")
def f20(spark, sf):
    checks = F.array_compact(
        F.array(F.when(~F.col("c_name").rlike("^[A-Za-z#0-9 ]{2,24}$"), "name"), F.when(~(_c() % 100).between(1, 80), "level"), F.when(~F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "AUTOMOBILE"), "class"))
    )
    return table(spark, sf, "customer").select(_c().alias("char_id"), F.array_join(checks, ",").alias("errors"))


@query("a22_collected_counts", "SELECT user_id, count(*) FILTER (event_type IN ('view', 'click')) AS items, count(DISTINCT event_type) AS categories FROM events GROUP BY user_id")
def a22(spark, sf):
    lists = table(spark, sf, "events").groupBy("user_id").agg(F.collect_list(F.when(F.col("event_type").isin("view", "click"), F.col("event_id"))).alias("items"), F.collect_set("event_type").alias("kinds"))
    return lists.select("user_id", F.size("items").cast("long").alias("items"), F.size("kinds").cast("long").alias("categories"))
