"""Queries over tables that change by key, and answers in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import sync
from millrace.operators.checkpoints import new_folder
from millrace.operators.deltas import DeltaTable
from millrace.operators.vectors import VectorStore
from millrace.plans.catalog import query
from millrace.sources.tables import table


def changed(spark, sf: str, root: str, most_deltas: int) -> DeltaTable:
    """documents as a table of hashes that five commits have changed: written, put over, seen, deleted and put back."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("k"), "text")
    put = lambda which, text, seen: docs.where(which).select("k", F.md5(text).alias("h"), F.lit(seen).cast("long").alias("seen"))
    out = DeltaTable(spark, root, "k long, h string, seen long", "k", touched="seen", most_deltas=most_deltas)
    out.commit("load", 0, put("k % 4 <> 3", F.when(F.col("k") % 11 == 0, "old").otherwise(F.col("text")), 1))
    out.commit("load", 1, put("k % 10 = 1", "text", 2), touches=docs.where("k % 6 = 0").select("k", F.lit(2).cast("long").alias("seen")))
    out.commit("load", 2, deletes=docs.where("k % 7 = 3").select("k"))
    out.commit("load", 2, put("k % 2 = 0", F.lit("a commit that comes twice"), 9))
    out.commit("other", 0, put("k % 14 = 3", F.reverse("text"), 3))
    out.commit("other", 1, touches=docs.where("k % 9 = 0").select("k", F.lit(4).cast("long").alias("seen")))
    return out


_STATE = """WITH state AS (SELECT doc_id AS k, CASE WHEN doc_id % 14 = 3 THEN md5(reverse(text)) WHEN doc_id % 10 = 1 THEN md5(text) WHEN doc_id % 11 = 0 THEN md5('old') ELSE md5(text) END AS h,
  greatest(CASE WHEN doc_id % 14 = 3 THEN 3 WHEN doc_id % 10 = 1 THEN 2 ELSE 1 END, CASE WHEN doc_id % 9 = 0 THEN 4 WHEN doc_id % 6 = 0 THEN 2 ELSE 0 END)::BIGINT AS seen
  FROM documents WHERE doc_id % 14 = 3 OR (doc_id % 7 <> 3 AND (doc_id % 4 <> 3 OR doc_id % 10 = 1)))"""


@query("m01_delta_table", f"{_STATE} SELECT * FROM state")
def delta_table(spark, sf):
    return changed(spark, sf, new_folder(spark, "deltas"), 8).read()


@query("m01_folded_deltas", f"{_STATE} SELECT * FROM state")
def folded(spark, sf):
    """The same with deltas that are folded after every second commit."""
    return changed(spark, sf, new_folder(spark, "deltas"), 2).read()


@query("m01_looked_up_keys", f"{_STATE} SELECT k, h FROM state WHERE k IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def looked_up(spark, sf):
    """The hashes of some keys alone, as an ingestion asks for them."""
    asked = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"))
    return changed(spark, sf, new_folder(spark, "deltas"), 8).read(only=asked, columns=["k", "h"])


@query("s14_answers_in_time", """WITH e AS (SELECT event_id, user_id AS key, epoch(ts) AS t, event_type FROM events),
a AS (SELECT key, t, bool_or(event_type <> 'error') AS found FROM e WHERE event_id % 3 = 0 GROUP BY key, t)
SELECT event_id, coalesce(r.t - a.t < CASE WHEN found THEN 86400 ELSE 28800 END AND event_type <> 'signup', false) AS hit FROM (FROM e WHERE event_id % 3 <> 0) r ASOF LEFT JOIN a ON r.key = a.key AND r.t >= a.t""")
def answers_in_time(spark, sf):
    """Every third event is an answer, the others ask; they follow each other in time."""
    events = table(spark, sf, "events").select("event_id", F.col("user_id").alias("key"), F.col("ts").cast("timestamp").cast("double").alias("ts"), "event_type")
    answers = events.where("event_id % 3 = 0").select("key", "ts", (F.col("event_type") != "error").alias("found"))
    asked = events.where("event_id % 3 <> 0").select("event_id", "key", "ts", (F.col("event_type") == "signup").alias("user_scoped"))
    return sync.cached_answers(asked, answers, 86400, 28800).select("event_id", "hit")


# ---------------------------------------------------------------- vectors


def vector_store(spark, sf: str) -> VectorStore:
    """embeddings with their labels, after upserts that move some vectors, a deletion, and a commit that comes twice."""
    rows = table(spark, sf, "embeddings")
    turned = rows.where("vec_id % 9 = 4").withColumn("embedding", F.transform("embedding", lambda x: -x))
    out = VectorStore(spark, new_folder(spark, "vectors"), keep="label int").fit(rows)
    out.upsert(rows.where("vec_id % 3 <> 0"), number=0)
    out.upsert(rows.where("vec_id % 3 = 0").unionByName(turned.where("vec_id % 3 <> 0")), number=1)
    out.delete(rows.where("vec_id % 13 = 5").select("vec_id"), number=2)
    out.upsert(rows.where("vec_id % 13 = 5"), number=2)
    return out


def vector_queries(spark, sf: str):
    return table(spark, sf, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


_VECTORS = """v AS (SELECT vec_id, label, CASE WHEN vec_id % 9 = 4 AND vec_id % 3 <> 0 THEN list_transform(embedding, lambda x: -x) ELSE embedding END AS e FROM embeddings WHERE vec_id % 13 <> 5),
s AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, greatest(0.0::DOUBLE, round(list_cosine_similarity(q.embedding::DOUBLE[], e::DOUBLE[]), 6)) AS similarity FROM embeddings q, v WHERE q.vec_id % 50 = 0)"""


@query("u01_exact_search", f"WITH {_VECTORS} SELECT query_id, vec_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s QUALIFY rank <= 20")
def exact_search(spark, sf):
    return vector_store(spark, sf).search(vector_queries(spark, sf), exact=True).withColumn("rank", F.col("rank").cast("long"))


@query("u01_filtered_search", f"WITH {_VECTORS} SELECT query_id, vec_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s WHERE label IN (2, 3) QUALIFY rank <= 5")
def filtered_search(spark, sf):
    found = vector_store(spark, sf).search(vector_queries(spark, sf), k=5, where=F.col("label").isin(2, 3), exact=True)
    return found.withColumn("rank", F.col("rank").cast("long"))


@query("u01_coded_search")
def coded_search(spark, sf):
    """By codes, the best of which are scored again with their vectors."""
    return vector_store(spark, sf).search(vector_queries(spark, sf))
