"""Further queries: full-text matches, tops per query, overlays of maps, batches of a source."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import semistructured as S
from millrace.functions import text as T
from millrace.operators import retrieval as R
from millrace.plans import retrieval as Q
from millrace.plans.catalog import query
from millrace.sources import connectors
from millrace.sources.tables import KNOWLEDGE_SQL, knowledge_documents, policies, policies_sql, questions, table

_ASKED = [(1, ["the"], []), (2, ["the", "of"], ["and"]), (3, ["zzz"], []), (4, [], ["the"])]
_TOKENS = "regexp_extract_all(lower(body), '[a-z0-9'']+')"


@query("k17_full_text_match", f"WITH {KNOWLEDGE_SQL}, t AS (SELECT doc_id, {_TOKENS} AS t FROM knowledge) SELECT 1 AS query_id, doc_id FROM t WHERE list_contains(t, 'the') UNION ALL SELECT 2, doc_id FROM t WHERE list_contains(t, 'the') AND list_contains(t, 'of') AND NOT list_contains(t, 'and') UNION ALL SELECT 3, doc_id FROM t WHERE list_contains(t, 'zzz')")
def k17(spark, sf):
    asked = spark.createDataFrame(_ASKED, "query_id int, all_of array<string>, none_of array<string>")
    return R.matches(asked, knowledge_documents(spark, sf))


@query("t04_top_lexical", f"WITH {Q.LEXICAL_SQL}, {Q._top('x', 'lexical', 'lexical_score', 20)} SELECT query_id, doc_id, lexical_score, rank FROM x")
def t04(spark, sf):
    hits = R.lexical_hits(questions(spark, sf), knowledge_documents(spark, sf)).withColumn("lexical_score", F.round("lexical_score", 6))
    return R.top_per_query(hits, "lexical_score", 20).withColumn("rank", F.col("rank").cast("long"))


@query("w02_final_ranks", f"WITH {Q.HYBRID_SQL} SELECT query_id, count(*) AS n, max(rank) AS last FROM hits GROUP BY query_id")
def w02(spark, sf):
    return Q.hits(spark, sf).groupBy("query_id").agg(F.count("*").alias("n"), F.max("rank").cast("long").alias("last"))


@query("w03_first_hit_per_source", f"WITH {Q.HYBRID_SQL} SELECT query_id, source, min(rank) AS rank FROM hits JOIN knowledge USING (doc_id) GROUP BY query_id, source")
def w03(spark, sf):
    return Q.found(spark, sf).join(knowledge_documents(spark, sf).select("doc_id", "source"), "doc_id").groupBy("query_id", "source").agg(F.min("rank").cast("long").alias("rank"))


@query("j03_policy_lookup", f"WITH {KNOWLEDGE_SQL}, {policies_sql()} SELECT doc_id, tier, licence FROM knowledge JOIN policies USING (source)")
def j03(spark, sf):
    return knowledge_documents(spark, sf).join(F.broadcast(policies(spark)), "source").select("doc_id", "tier", "licence")


@query("k29_downgraded_levels", "SELECT * FROM (VALUES ('high', 0, 'medium'), ('medium', 0, 'low'), ('low', 0, 'low'), ('high', 1, 'high')) v(before, cited, level)")
def k29(spark, sf):
    rows = spark.createDataFrame([("high", []), ("medium", []), ("low", []), ("high", [3])], "before string, cited array<int>")
    return rows.select("before", F.size("cited").alias("cited"), R.downgraded(F.col("before"), F.col("cited")).alias("level"))


@query("e05_map_overlay", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'new' ELSE 'old' END AS a, 'kept' AS b, CASE WHEN n_nationkey % 2 = 0 THEN 'added' END AS c FROM nation")
def e05(spark, sf):
    old = F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.lit("kept"))
    new = F.when(F.col("n_nationkey") % 2 == 0, F.create_map(F.lit("a"), F.lit("new"), F.lit("c"), F.lit("added"))).otherwise(F.expr("cast(map() as map<string,string>)"))
    m = F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)
    return table(spark, sf, "nation").select("n_nationkey", m.alias("m")).select("n_nationkey", *[F.try_element_at("m", F.lit(k)).alias(k) for k in "abc"])


@query("x02_first_locale", "SELECT * FROM (VALUES (1, 'us'), (2, 'de'), (3, NULL)) v(id, text)")
def x02(spark, sf):
    rows = spark.createDataFrame([(1, '{"de_DE": "de", "en_US": "us"}'), (2, '{"de_DE": "de"}'), (3, "[]")], "id int, payload string")
    return rows.select("id", S.localized(F.try_parse_json("payload")).alias("text"))


@query("x14_digests", "SELECT doc_id, sha256(text) AS sha, ('0x' || substr(md5(text), 1, 15))::BIGINT % 1000 AS slot FROM documents")
def x14(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), T.bucket(F.col("text"), 1000).alias("slot"))


@query("s07_page_batches", "WITH r AS (SELECT substr(url, 1, 16) AS category, page_id, row_number() OVER (PARTITION BY substr(url, 1, 16) ORDER BY page_id) - 1 AS n FROM pages) SELECT category, n // 50 AS batch, count(*) AS size, min(page_id) AS first_id FROM r GROUP BY ALL")
def s07(spark, sf):
    pages = table(spark, sf, "pages").select(F.substring("url", 1, 16).alias("category"), "page_id")
    return connectors.batched(pages, "category", "page_id", 50).select("category", "batch", F.size("ids").cast("long").alias("size"), F.get("ids", F.lit(0)).alias("first_id"))


@query("u04_connected_pages", "SELECT page_id::VARCHAR AS source_id, length(html) AS n FROM pages")
def u04(spark, sf):
    return connectors.read(spark, "wiki", sf).select("source_id", F.length("body").cast("long").alias("n"))


@query("u04_metadata_only", "SELECT count(*) AS pages, 0 AS with_body FROM pages")
def metadata_only(spark, sf):
    return connectors.read(spark, "guides", sf).agg(F.count("*").alias("pages"), F.count_if(F.col("body") != "").alias("with_body"))


@query("m13_scope_results", "SELECT user_id, string_agg(event_type || ':' || n, ',' ORDER BY event_type) AS scopes FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY user_id")
def m13(spark, sf):
    per = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    got = per.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_type", "n"))).alias("s"))
    return got.select("user_id", F.array_join(F.transform("s", lambda x: F.concat(x["event_type"], F.lit(":"), x["n"].cast("string"))), ",").alias("scopes"))


@query("m14_idle_accounts", "SELECT c_custkey AS account FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def m14(spark, sf):
    running = table(spark, sf, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("account"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("account")).join(running, "account", "left_anti")
