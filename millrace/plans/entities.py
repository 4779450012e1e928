"""Queries over the entities of a catalogue: part as records of eight kinds, with gaps, failures and broken payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import records as P
from millrace.plans.catalog import query
from millrace.sources import entities as E
from millrace.sources.tables import table

#: Keys of a page of an index.
PAGE = 10_000
_KINDS = [s.entity for s in E.SPECS]
_KIND_SQL = f"{_KINDS!r}[(p_partkey % 8)::INTEGER + 1]"


def _k():
    return F.col("p_partkey")


def _kind():
    return F.get(F.array(*[F.lit(k) for k in _KINDS]), (_k() % 8).cast("int"))


def index_payloads(spark, sf):
    """An index a kind in pages by ranges of PAGE keys, every 17th entry without an id."""
    entry = F.struct(F.when(_k() % 17 != 0, _k()).alias("id"), F.col("p_name").alias("name"))
    per = table(spark, sf, "part").groupBy(_kind().alias("entity"), F.floor(_k() / PAGE)).agg(F.collect_list(entry).alias("x"))
    key = F.create_map(*[F.lit(x) for s in E.SPECS for x in (s.entity, s.index_key)])
    return per.select("entity", F.to_json(F.map_from_arrays(F.array(F.element_at(key, F.col("entity"))), F.array("x"))).alias("payload"))


def detail_payloads(spark, sf):
    """Every field of every kind; the ninth ones failed, the 13th are no JSON, the 11th have no name."""
    k = _k()
    name = lambda c: F.struct(F.struct(c.alias("en_US")).alias("name"))
    many = lambda n, f: F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), f))
    part = lambda c, i: F.concat(F.lit(c), i.cast("string"))
    record = F.struct(
        k.alias("id"), F.when(k % 11 != 0, F.struct(F.col("p_name").alias("en_US"), F.lit("Teil").alias("de_DE"))).alias("name"), F.when(k % 4 != 0, F.col("p_type")).alias("description"),
        F.when(k % 3 != 0, name(F.col("p_name"))).alias("source"), F.when(k % 5 == 0, name(F.col("p_type"))).alias("faction"), (k % 7 == 0).alias("should_exclude_if_uncollected"),
        name(F.col("p_brand")).alias("battle_pet_type"), (k % 3 == 0).alias("is_capturable"), (k % 5 == 0).alias("is_tradable"),
        F.struct(F.col("p_brand").alias("name"), F.struct(F.when(k % 16 < 8, "dungeon").otherwise("RAID").alias("name")).alias("type")).alias("category"), F.when(k % 5 == 0, 0).otherwise(F.col("p_size")).alias("points"),
        F.struct(many(k % 15, lambda i: F.struct(F.when(i % 4 != 0, part("c", i)).alias("description"), i.alias("id"))).alias("child_criteria")).alias("criteria"),
        F.struct(F.col("p_size").alias("min_character_level")).alias("requirements"), F.when(k % 3 == 0, name(F.col("p_brand"))).alias("area"), F.struct(F.struct((k * 1700).alias("value")).alias("money"), (k % 6).alias("experience")).alias("rewards"),
        F.when(k % 3 != 1, name(F.col("p_brand"))).alias("instance"), many(k % 11, lambda i: F.struct(F.when(i % 2 == 0, part("t", i)).alias("title"), F.when(i % 5 != 0, part("b", i)).alias("body_text"), i.alias("id"))).alias("sections"),
        F.when(k % 3 == 0, name(F.col("p_name"))).alias("location"), name(F.col("p_type")).alias("expansion"), many(k % 3, lambda i: F.struct(F.struct(part("m", i).alias("name")).alias("mode"))).alias("modes"),
        many(k % 5, lambda i: F.struct(part("e", i).alias("name"))).alias("encounters"), name(F.col("p_type")).alias("type"), many(k % 4, lambda i: F.struct(part("s", i).alias("name"))).alias("skill_tiers"),
        F.when(k % 3 == 0, name(F.col("p_brand"))).alias("reputation_tiers"), (k % 5 < 2).alias("is_paragon"),
    )
    payload = F.when(k % 9 == 0, None).when(k % 13 == 0, "{oops").otherwise(F.to_json(record))
    return table(spark, sf, "part").select(_kind().alias("entity"), k.alias("id"), payload.alias("payload"))


_KNOWN = "known AS (SELECT *, p_partkey AS k, " + _KIND_SQL + " AS kind, p_partkey % 8 AS z FROM part WHERE p_partkey % 17 <> 0), told AS (SELECT *, CASE WHEN z = 5 AND k % 16 < 8 THEN 'dungeon' ELSE kind END AS entity FROM known WHERE k % 9 <> 0 AND k % 13 <> 0 AND k % 11 <> 0)"


def told(spark, sf):
    return E.documents(E.named_details(E.index_ids(index_payloads(spark, sf)), detail_payloads(spark, sf)))


@query("s06_windows", f"WITH {_KNOWN}, w AS (SELECT kind AS entity, k, (row_number() OVER (PARTITION BY kind ORDER BY k) - 1) // 96 AS batch FROM known) SELECT entity, batch, count(*) AS size, min(k) AS first_id FROM w GROUP BY ALL")
def windows(spark, sf):
    asked = E.windows(E.index_ids(index_payloads(spark, sf)))
    return asked.select("entity", "batch", F.size("ids").cast("long").alias("size"), F.get("ids", F.lit(0)).alias("first_id"))


@query("k36_entity_bodies", f"""WITH {_KNOWN} SELECT entity, k::VARCHAR AS source_id, concat_ws(' ', CASE WHEN k % 4 <> 0 THEN p_type END,
  CASE WHEN z = 1 THEN 'Battle pet type: ' || p_brand || '.' WHEN z = 2 THEN 'Category: ' || p_brand || '.' WHEN z = 3 THEN 'Type: ' || p_type || '.' WHEN z = 4 AND p_size <> 0 THEN 'Minimum level ' || p_size || '.' WHEN z = 5 AND k % 3 = 0 THEN 'Location: ' || p_name || '.' WHEN z = 6 AND k % 3 <> 1 THEN 'Found in ' || p_brand || '.' WHEN z = 7 AND k % 3 = 0 THEN 'Reputation tiers: ' || p_brand || '.' END,
  CASE WHEN z IN (0, 1) AND k % 3 <> 0 THEN 'Source: ' || p_name || '.' WHEN z = 2 AND k % 5 <> 0 AND p_size <> 0 THEN 'Worth ' || p_size || ' achievement points.' WHEN z = 4 AND k % 3 = 0 THEN 'Area: ' || p_brand || '.' WHEN z = 5 THEN 'Expansion: ' || p_type || '.' END,
  CASE WHEN z = 0 AND k % 5 = 0 THEN 'Faction: ' || p_type || '.' WHEN z = 1 AND k % 3 = 0 THEN 'Can be captured in the wild.' WHEN z = 4 THEN 'Rewards ' || (k * 1700 // 10000) || ' gold.' WHEN z = 5 AND k % 3 > 0 THEN 'Difficulties: ' || array_to_string(list_transform(range(1, k % 3 + 1), lambda i: 'm' || i), ', ') || '.' WHEN z = 7 AND k % 5 < 2 THEN 'Supports paragon reputation.'
    WHEN z = 2 AND k % 15 > 0 THEN 'Criteria: ' || array_to_string(list_transform(list_filter(range(1, least(k % 15, 12) + 1), lambda i: i % 4 <> 0), lambda i: 'c' || i), '; ') || '.' WHEN z = 3 AND k % 4 > 0 THEN 'Skill tiers: ' || array_to_string(list_transform(range(1, k % 4 + 1), lambda i: 's' || i), ', ') || '.' END,
  CASE WHEN z = 0 AND k % 7 = 0 THEN 'Not obtainable through normal play.' WHEN z = 1 AND k % 5 = 0 THEN 'Tradable.' WHEN z = 4 AND k % 6 > 0 THEN 'Rewards ' || k % 6 || ' experience.' WHEN z = 5 AND k % 5 > 0 THEN 'Encounters: ' || array_to_string(list_transform(range(1, k % 5 + 1), lambda i: 'e' || i), ', ') || '.'
    WHEN z = 6 AND k % 11 > 0 THEN array_to_string(list_transform(list_filter(range(1, least(k % 11, 8) + 1), lambda i: i % 5 <> 0), lambda i: CASE WHEN i % 2 = 0 THEN chr(10) || chr(10) || '== t' || i || ' ==' || chr(10) || 'b' || i ELSE 'b' || i END), ' ') END) AS body FROM told""")
def bodies(spark, sf):
    return told(spark, sf).select("entity", "source_id", "body")


@query("u07_entity_documents", f"""WITH {_KNOWN} SELECT entity, k::VARCHAR AS source_id, p_name AS title, p_brand AS category, concat_ws(',', 'battle_pet_type', 'category', 'expansion', CASE WHEN k % 5 = 0 THEN 'faction' END, 'id', 'is_capturable', 'is_tradable', CASE WHEN k % 3 = 0 THEN 'location' END, 'points', CASE WHEN k % 3 <> 0 THEN 'source' END, 'type') AS facts FROM told""")
def entity_documents(spark, sf):
    facts = F.array_join(F.sort_array(F.map_keys("facts")), ",")
    return told(spark, sf).select("entity", "source_id", "title", F.col("facts")["category"].alias("category"), facts.alias("facts"))


@query("s08_sitemap_index", "SELECT DISTINCT url FROM pages WHERE (contains(url, '/en/') OR contains(url, '.html')) AND page_id // 100 % 5 <> 4")
def sitemap_index(spark, sf):
    """Sitemaps of 100 pages, a fifth of them named by nobody, under indexes of 100 sitemaps; one more index is named by an index."""
    part, root = F.floor(F.col("page_id") / 100), lambda c: F.floor(c / 100)
    loc = lambda tag, c: F.concat(F.lit(f"<{tag}><loc>"), F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(f"</loc></{tag}>"))
    around = lambda tag, c: F.concat(F.lit(f"<{tag}>"), F.array_join(F.collect_list(c), ""), F.lit(f"</{tag}>"))
    maps = table(spark, sf, "pages").groupBy(part.alias("part")).agg(around("urlset", loc("url", F.col("url"))).alias("xml"))
    maps = maps.withColumn("url", F.concat(F.lit("https://example.com/map"), F.col("part").cast("string")))
    more = spark.createDataFrame([("https://example.com/nested", "<sitemapindex><sitemap><loc>https://example.com/map4</loc></sitemap></sitemapindex>"), ("https://example.com/broken", "<urlset><url>"), ("https://example.com/none", None)], "url string, xml string")
    named = maps.where("part % 5 <> 4").select("part", "url").unionByName(more.select(F.lit(0).cast("long").alias("part"), "url"))
    roots = named.groupBy(root(F.col("part")).alias("root")).agg(around("sitemapindex", loc("sitemap", F.col("url"))).alias("xml"))
    return P.sitemap_pages(roots.select("xml"), maps.select("url", "xml").unionByName(more), ["/en/", ".html"])
