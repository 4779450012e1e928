"""Benchmark decontamination by MinHash containment search, in DataFrame operations only.

A test item is a few dozen words, a document up to tens of thousands: their Jaccard similarity is near
zero even when the item stands in the document whole, so banded signatures of equal length would miss
it.  Containment is searched from the item's side instead.  Under one hash function an item of n
shingles keeps its k smallest hashes, where k follows from its size: k = n - ceil(t n) + 1.  A document that contains a share t of the item must hold one of these k (only
k - 1 may be missing), so the search loses nothing.  One threshold serves the items of all sizes: a
document looks up its shingles with a hash up to the largest kept value of any item of as many words a
shingle, so one short item with a high hash lets nearly all of them be looked up.

Candidates are then verified on the shingles themselves, not their hashes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import free_name, load, settled

WORDS = 5
PERCENT = 80
#: Sides of at most so many rows (of some tens of bytes each) are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 200_000
BROADCAST_IDS = 1_000_000


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits; a null text has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _runs(words: str, size: int, each: str) -> Column:
    """An expression of every run of ``size`` words; shorter documents have none."""
    at = [f"{words}[i + {k}]" for k in range(1, size)]
    made = f"{each}({', '.join(['x', *at])})" if each == "xxhash64" else f"concat_ws(' ', {', '.join(['x', *at])})"
    return F.expr(f"transform(slice({words}, 1, greatest(size({words}) - {size - 1}, 0)), (x, i) -> {made})")


def item_shingles(items: DataFrame, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """(item_id, m, n, shingle, h): the distinct shingles of each item of n; m words each, ``words`` or
    all of a shorter item's.  Items without words have none."""
    base = items.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("w")).where("size(w) > 0 and item_id is not null")
    long = base.where(F.size("w") >= words).select("item_id", F.lit(words).alias("m"), F.explode(_runs("w", words, "concat")).alias("shingle"))
    short = base.where(F.size("w") < words).select("item_id", F.size("w").alias("m"), F.concat_ws(" ", "w").alias("shingle"))
    distinct = long.unionByName(short).distinct()
    sizes = distinct.groupBy("item_id").agg(F.count("*").alias("n"))
    parts = F.split("shingle", " ")
    hashes = [F.when(F.col("m") == m, F.xxhash64(*[parts[k] for k in range(m)])) for m in range(1, words + 1)]
    return distinct.join(sizes, "item_id").withColumn("h", F.coalesce(*hashes))


def sketches(shingles: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The k smallest hashes of each item, with the power of two that its size falls in, which the search does not use."""
    k = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    kept = shingles.groupBy("item_id", "m", "n").agg(F.array_sort(F.collect_set("h")).alias("hs"))
    return kept.select("item_id", "m", F.floor(F.log2("n")).cast("int").alias("part"), F.explode(F.slice("hs", F.lit(1), k.cast("int"))).alias("h"))


def small(df: DataFrame, most: int) -> DataFrame:
    """df with a broadcast hint if it has at most ``most`` rows; else Spark shuffles it."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def contained_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared, containment) of every item of whose distinct shingles
    a document holds ``percent`` or more.

    Words are lower-cased runs of letters and digits.  Null and empty texts match nothing; items of
    fewer than ``words`` words are one shingle.  Rows that share a document id count as one document;
    rows without an id are left out.  Extra columns are not looked at."""
    shingles = settled(item_shingles(items, item_id, item_text, words))
    probes = settled(sketches(shingles, percent))
    bounds = probes.groupBy("m", "part").agg(F.max("h").alias("top")).collect()  # a row per size partition
    texts = docs.select(F.col(doc_id).alias("doc_id"), words_of(F.col(doc_text)).alias("w")).where("doc_id is not null")
    lengths = sorted({b["m"] for b in bounds}) or [words]
    looked_up = small(probes.select("h", "m", "item_id").distinct(), BROADCAST_ROWS)
    found = []
    for m in lengths:
        top = max((b["top"] for b in bounds if b["m"] == m), default=0)
        sketch = F.filter(_runs("w", m, "xxhash64"), lambda h: h <= top)  # noqa: B023
        found.append(texts.select("doc_id", F.explode(F.array_distinct(sketch)).alias("h")).join(looked_up.where(F.col("m") == m), "h").select("doc_id", "item_id"))
    pairs = settled(reduce(DataFrame.unionByName, found).distinct())
    ids = small(pairs.select("doc_id").distinct(), BROADCAST_IDS)
    held = texts.join(ids, "doc_id", "left_semi")
    whole = small(shingles.select("item_id", "m", "n", "shingle"), BROADCAST_ROWS)
    shared = [
        held.select("doc_id", F.explode(F.array_distinct(_runs("w", m, "concat"))).alias("shingle")).join(whole.where(F.col("m") == m), "shingle").select("doc_id", "item_id", "n", "shingle")
        for m in lengths
    ]
    counted = reduce(DataFrame.unionByName, shared).distinct().groupBy("doc_id", "item_id", "n").agg(F.count("*").alias("n_shared"))
    return (
        counted.where(F.col("n_shared") * 100 >= F.col("n") * percent)
        .join(pairs, ["doc_id", "item_id"], "left_semi")
        .select("doc_id", "item_id", F.col("n").alias("n_item_shingles"), "n_shared", (F.col("n_shared") / F.col("n")).alias("containment"))
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", **more) -> DataFrame:
    """The rows of docs, all columns, in which no item is contained.

    Rows are judged by a 64-bit hash of their text alone, so ids may be null or repeat and copies are
    judged once.  Null and empty texts stay."""
    text, name = F.xxhash64(doc_text), free_name(docs, "hash")
    keyed = docs.select(text.alias("hash"), F.col(doc_text).alias("text"))
    bad = settled(contained_items(keyed, items, "hash", "text", item_id, item_text, **more).select(F.col("doc_id").alias(name)).distinct())
    return docs.withColumn(name, text).join(small(bad, BROADCAST_IDS), name, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH item AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
sized AS (SELECT item_id, w, least(5, len(w)) AS m FROM item WHERE len(w) > 0),
item_shingle AS (
  SELECT DISTINCT item_id, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS s FROM sized),
item_size AS (SELECT item_id, count(*) AS n FROM item_shingle GROUP BY item_id),
doc AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL),
doc_shingle AS (
  SELECT DISTINCT doc_id, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS s
  FROM doc, (SELECT DISTINCT m FROM sized) WHERE len(w) >= m)
SELECT doc_id, item_id, n AS n_item_shingles, count(*) AS n_shared, count(*) / n AS containment
FROM doc_shingle JOIN item_shingle USING (m, s) JOIN item_size USING (item_id)
GROUP BY doc_id, item_id, n HAVING count(*) * 100 >= n * 80
"""
