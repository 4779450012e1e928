"""MinHash near-duplicates by bottom-k sketches of one hash function.

1. A document is its set of hashed word shingles; its sketch is the K smallest.  Documents of equal
   sets are one class from here on, so a group of copies costs one row.
2. Inverted lists of retained values generate overlaps.  Two linked sets share at least C of their K
   values (but for a chance below 1e-6; sets of fewer values are whole and share their exact bound), so
   they meet on one of the K - C + 1 values of each that are rarest in the corpus.  Only those are
   listed: a passage that many documents share is frequent, thus last, and lists nobody.
3. Each list names as its hub the member whose values are the most common: the copied document of a
   family of copies.  All lists of a hub make up its cluster, and every candidate pair is in a cluster.
4. In a cluster the members are compared with the hub first, then only pairs that links do not join
   yet: the estimate from the sketch of the union filters, the exact Jaccard on full sets verifies.
   Links that would close a circle are not emitted, so a cluster gives fewer links than members.
   Clusters above BLOCK members are split in blocks, to each of which the hub goes.  Members that
   their block joined with the hub are one component already; only those left apart go on to meet
   the other blocks, so the work grows with members times those apart, not with all pairs.
5. Connected components of the links, in DataFrame steps.

Classes are known by the number of their first row, not by an id, which may repeat or be null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import arrow_map, chunks, components, free_name, load, settled, shingle_hashes, word_hashes, words_of

K = 48
BLOCK = 256
BROADCAST_IDS = 1_000_000


def retained_shared(percent: int, k: int = K) -> int:
    """The C above: linked sets share so many of their k smallest values but for a chance below 1e-6."""
    p, term, total = percent / 100, (1 - percent / 100) ** k, 0.0
    for c in range(k + 1):
        total += term
        if total > 1e-6:
            return max(c, 1)
        term *= (k - c) / (c + 1) * p / (1 - p)
    return k


def _sets(keys: pa.Array, texts: pa.Array, words: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(keys, hashes, offsets) for runs of rows: each row's distinct shingle hashes in ascending order."""
    for ids, data, offsets in chunks(keys, texts):
        starts, ends, doc = words_of(data, offsets)
        doc, h = shingle_hashes(word_hashes(data, starts, ends), doc, words)
        by = np.argsort(h)
        by = by[np.argsort(doc[by].astype(np.uint16 if len(ids) < 65536 else np.int64), kind="stable")]
        doc, h = doc[by], h[by]
        new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])][: len(h)]
        doc, h = doc[new], h[new]
        yield ids, h, np.searchsorted(doc, np.arange(len(ids) + 1))


def _lists(h: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(h.view(np.int64))).cast(pa.list_(pa.int64()))


def _prints(h: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    """Two 64-bit sums over each set."""
    out = []
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = h * np.uint64(factor)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x9E3779B97F4A7C15)
        out.append(pa.array(np.diff(np.r_[np.uint64(0), np.cumsum(x ^ (x >> np.uint64(32)))][offsets]).view(np.int64)))
    return out


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and text of each row, with a hash of both that tells rows apart unless they repeat."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.select("id", "text", F.xxhash64("id", "text").alias("rid"))


def sketch(docs: DataFrame, id_col: str, text_col: str, words: int, k: int = K) -> DataFrame:
    """(id, rid, n, fp1, fp2, sketch): the set's size, a 128-bit print of it, and its k smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = pa.StructArray.from_arrays([b.column(0), b.column(2)], ["id", "rid"])
            for part, h, offsets in _sets(keys, b.column(1), words):
                n = np.diff(offsets)
                take = np.minimum(n, k)
                at = np.arange(int(take.sum())) - np.repeat(np.cumsum(take) - take - offsets[:-1], take)
                yield pa.RecordBatch.from_arrays([*part.flatten(), pa.array(n), *_prints(h, offsets), _lists(h[at], np.r_[0, np.cumsum(take)])], ["id", "rid", "n", "fp1", "fp2", "sketch"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _source(docs, id_col, text_col).transform(arrow_map, run, f"id {kind}, rid long, n long, fp1 long, fp2 long, sketch array<long>")


def full_sets(rows: DataFrame, words: int) -> DataFrame:
    """(n, fp1, fp2, hashes) from rows with a rid and a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, h, offsets in _sets(b.column(0), b.column(1), words):
                yield pa.RecordBatch.from_arrays([pa.array(np.diff(offsets)), *_prints(h, offsets), _lists(h, offsets)], ["n", "fp1", "fp2", "hashes"])

    return rows.select("rid", "text").transform(arrow_map, run, "n long, fp1 long, fp2 long, hashes array<long>")


def clusters(reps: DataFrame, percent: int, k: int = K) -> DataFrame:
    """(hub, key) from (key, n, sketch): every pair that may be linked is in one cluster at least."""
    c = retained_shared(percent, k)
    values = reps.select("key", "n", F.explode("sketch").alias("v"))
    often = values.groupBy("v").agg(F.count("*").alias("f")).where("f > 1")
    shared = values.join(often, "v").groupBy("key", "n").agg(F.sort_array(F.collect_list(F.struct("f", "v"))).alias("fv"), F.sum("f").alias("pop"))
    bound = F.when(F.col("n") <= k * percent // 100, F.ceil(F.col("n") * percent / 100)).otherwise(F.lit(c))
    size = F.least(F.col("n"), F.lit(k))
    alone = size - F.size("fv")  # values nobody else has come first
    listed = (size - bound + 1 - alone).cast("int")
    members = settled(
        shared.withColumn("listed", listed).where("listed > 0").select("key", "pop", F.explode(F.slice("fv", F.lit(1), F.col("listed"))).alias("x")).select("key", "pop", F.col("x.v").alias("v"))
    )
    hubs = members.groupBy("v").agg(F.max(F.struct("pop", F.negative("key").alias("minus"))).alias("h"), F.count("*").alias("m")).where("m > 1").select("v", F.negative("h.minus").alias("hub"))
    return members.join(hubs, "v").select("hub", "key").distinct()


def _linked(shared, n_one, n_two, percent: int):
    return 100 * shared >= percent * (n_one + n_two - shared)


class _Group:
    """Full sets that meet in one task, and which of them links join."""

    def __init__(self, pdf: pd.DataFrame, percent: int, k: int, c: int):
        self.percent, self.k, self.c = percent, k, c
        self.keys = pdf["key"].to_numpy()
        sets = [np.asarray(x, dtype=np.int64).view(np.uint64) for x in pdf["hashes"]]
        self.n = np.array([len(s) for s in sets])
        self.offsets = np.r_[0, np.cumsum(self.n)]
        vocabulary, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.flag = np.zeros(len(vocabulary), dtype=bool)
        self.root = np.arange(len(sets))
        self.heads = np.full((len(sets), k), np.uint64(0xFFFFFFFFFFFFFFFF))
        for i, s in enumerate(sets):
            self.heads[i, : min(k, len(s))] = s[:k]
        self.links: list[tuple[int, int]] = []

    def link(self, one: int, two: int) -> None:
        a, b = self.root[one], self.root[two]
        if a != b:
            self.root[self.root == max(a, b)] = min(a, b)
            self.links.append((self.keys[one], self.keys[two]))

    def verified(self, one: int, others: np.ndarray) -> np.ndarray:
        """The others whose exact Jaccard with one links them; all their values are looked up at once."""
        if not len(others):
            return others
        mine = self.flat[self.offsets[one] : self.offsets[one + 1]]
        self.flag[mine] = True
        size = self.n[others]
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - self.offsets[others], size)
        shared = np.add.reduceat(self.flag[self.flat[at]].astype(np.int64), np.cumsum(size) - size)
        self.flag[mine] = False
        return others[_linked(shared, self.n[one], size, self.percent)]

    def estimated(self, one: int, others: np.ndarray) -> np.ndarray:
        """The others that share C of the union's k smallest values with one (small unions pass: they are verified)."""
        n, k = self.n, self.k
        fits = others[100 * np.minimum(n[others], n[one]) >= self.percent * np.maximum(n[others], n[one])]
        if not len(fits):
            return fits
        both = np.sort(np.concatenate([np.broadcast_to(self.heads[one], (len(fits), k)), self.heads[fits]], axis=1), axis=1)
        twice = np.zeros(both.shape, dtype=bool)
        twice[:, 1:] = both[:, 1:] == both[:, :-1]
        in_union = np.cumsum(~twice, axis=1) <= k
        short = (n[fits] < k) | (n[one] < k)
        return fits[short | ((twice & in_union).sum(axis=1) >= self.c)]

    def compare(self, one: int, others: np.ndarray) -> None:
        for other in self.verified(one, self.estimated(one, others)):
            self.link(one, int(other))


def _in_block(pdf: pd.DataFrame, percent: int, k: int, c: int) -> pd.DataFrame:
    """Links in a block of a cluster, as a forest, and a row without a second key for each member that they do not join with the hub."""
    group, hub = _Group(pdf, percent, k, c), int(pdf["hub"].iloc[0])
    at_hub = int(np.flatnonzero(group.keys == hub)[0])
    for other in group.verified(at_hub, np.delete(np.arange(len(pdf)), at_hub)):
        group.link(at_hub, int(other))
    with_hub = group.root == group.root[at_hub]
    for one in np.flatnonzero(~with_hub):
        mates = np.flatnonzero(group.root != group.root[one])
        group.compare(int(one), mates[with_hub[mates] | (mates > one)])
    apart = np.flatnonzero(group.root != group.root[at_hub])
    a = [x for x, _ in group.links] + group.keys[apart].tolist()
    b = [y for _, y in group.links] + [None] * len(apart)
    return pd.DataFrame({"hub": np.full(len(a), hub, dtype=np.int64), "a": np.array(a, dtype=np.int64), "b": pd.array(b, dtype="Int64")})


def _across(pdf: pd.DataFrame, percent: int, k: int, c: int) -> pd.DataFrame:
    """Links between members apart from the hub and the members of another block, as a forest."""
    group = _Group(pdf, percent, k, c)
    block, apart, asks = pdf["block"].to_numpy(), pdf["apart"].to_numpy(), pdf["asks"].to_numpy()
    joined = np.flatnonzero(~apart)
    if len(joined):
        group.root[joined] = joined[0]  # with the hub
    for one in np.flatnonzero(asks):
        mates = np.flatnonzero((group.root != group.root[one]) & ~asks & (block != block[one]))
        group.compare(int(one), mates[~apart[mates] | (group.keys[mates] > group.keys[one])])
    return pd.DataFrame({"a": np.array([x for x, _ in group.links], dtype=np.int64), "b": np.array([y for _, y in group.links], dtype=np.int64)})


def _small(rows: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """rows of one or two numbers with a broadcast hint if they are at most ``most``; else they are shuffled."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def _links(member: DataFrame, sets: DataFrame, percent: int, k: int, block: int) -> DataFrame:
    """(a, b) keys of linked classes, from the members (hub, key, n, fp1, fp2) of clusters and the sets (n, fp1, fp2, hashes)."""
    c = retained_shared(percent, k)
    prints = ["n", "fp1", "fp2"]
    crowded = member.groupBy("hub").agg(F.count("*").alias("size")).where(F.col("size") > block).select("hub", F.ceil(F.col("size") / block).cast("int").alias("g"))
    placed = member.join(_small(crowded), "hub", "left").withColumn("g", F.coalesce("g", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("key"), F.col("g")).cast("int"))
    every = F.sequence(F.lit(0), F.col("g") - 1)
    dealt = placed.withColumn("block", F.explode(F.when(F.col("hub") == F.col("key"), every).otherwise(F.array("block"))))
    met = settled(
        dealt.join(sets, prints).select("hub", "block", "key", "hashes").groupBy("hub", "block")
        .applyInPandas(lambda pdf: _in_block(pdf, percent, k, c), "hub long, a long, b long")
    )
    links = met.where("b is not null").select("a", "b")
    left = settled(met.where("b is null").select("hub", F.col("a").alias("key")).join(_small(crowded.select("hub")), "hub", "left_semi"))
    if left.isEmpty():
        return links
    several = left.groupBy("hub").agg(F.ceil(F.count("*") / block).cast("int").alias("asking"))
    again = placed.where("hub <> key").join(_small(several), "hub").join(left.withColumn("apart", F.lit(True)), ["hub", "key"], "left").withColumn("apart", F.coalesce("apart", F.lit(False)))
    columns = ["hub", "key", "ask", "other", "block", "apart", "asks", *prints]
    asks = (
        again.where("apart").withColumn("ask", F.pmod(F.xxhash64(F.lit("ask"), "key"), F.col("asking")).cast("int"))
        .withColumn("other", F.explode(every)).withColumn("asks", F.lit(True)).select(columns)
    )
    asked = again.withColumn("ask", F.explode(F.sequence(F.lit(0), F.col("asking") - 1))).withColumn("other", F.col("block")).withColumn("asks", F.lit(False)).select(columns)
    more = (
        asks.unionByName(asked).join(sets, prints).drop(*prints).groupBy("hub", "ask", "other")
        .applyInPandas(lambda pdf: _across(pdf, percent, k, c), "a long, b long")
    )
    return links.unionByName(more)


def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, k: int, block: int) -> DataFrame:
    """(id, rid, row, n, head) for every row of docs: head is (none, id, row, rid) of the row that stands for
    its group, the one of the smallest id, rows without an id last; null for rows without shingles."""
    rows = settled(sketch(docs, id_col, text_col, words, k).withColumn("row", F.monotonically_increasing_id()))
    head = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row", "rid")).alias("head")
    classes = rows.where("n > 0").groupBy("n", "fp1", "fp2").agg(head, F.any_value("sketch").alias("sketch")).withColumn("key", F.col("head.row"))
    reps = settled(classes)
    member = settled(clusters(reps.select("key", "n", "sketch"), percent, k))
    member = member.join(reps.select("key", "n", "fp1", "fp2", F.col("head.rid").alias("rid")), "key")
    held = _source(docs, id_col, text_col).join(_small(member.select("rid").distinct()), "rid", "left_semi")
    sets = full_sets(held, words).dropDuplicates(["n", "fp1", "fp2"])
    found = settled(components(_links(member.drop("rid"), sets, percent, k, block), "a", "b").withColumnRenamed("node", "key"))
    heads = found.join(reps.select("key", "head"), "key").groupBy("component").agg(F.min("head").alias("first"))
    firsts = found.join(heads, "component").select("key", "first")
    named = reps.join(firsts, "key", "left").select("n", "fp1", "fp2", F.coalesce("first", "head").alias("head"))
    return rows.select("id", "rid", "row", "n", "fp1", "fp2").join(named, ["n", "fp1", "fp2"], "left").drop("fp1", "fp2")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, k: int = K, block: int = BLOCK) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of docs; ids are longs.

    Words are runs of characters other than ``[\\x20\\x09-\\x0D]``, A-Z lower-cased.  Sets of ``words``-word
    shingles whose Jaccard similarity is ``percent`` / 100 or more are linked; the component is the
    smallest id reachable.  Null, empty and blank texts have no shingles and link with nothing.  Rows
    that repeat an id are compared each by its own text, and each has its own component.  A row with
    a null id links like others and is never kept; a group of such rows alone has a null component.
    Extra columns are not looked at."""
    out = _grouped(docs, id_col, text_col, words, percent, k, block)
    component = F.coalesce(F.col("head.id"), F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, k: int = K, block: int = BLOCK) -> DataFrame:
    """The rows of docs, all columns, one of each group: that of the smallest id, rows without an id last.

    Ids that repeat or are null decide nothing else: a row goes only if another row of its own group
    stays.  Of rows with equal id and text one stays.  Texts without shingles all stay."""
    rows = _grouped(docs, id_col, text_col, words, percent, k, block).where("n > 0")
    judged = rows.groupBy("rid").agg(F.max(F.col("row") == F.col("head.row")).alias("stays"), F.count("*").alias("times"))
    row = free_name(docs, "row")
    marks = settled(judged.where("not stays or times > 1").select(F.col("rid").alias(row), "stays"))
    marked = docs.withColumn(row, F.xxhash64(id_col, text_col))
    kept = marked.join(_small(marks.select(row)), row, "left_anti")
    repeated = marks.where("stays").select(row)
    if not repeated.isEmpty():
        kept = kept.unionByName(marked.join(_small(repeated), row, "left_semi").dropDuplicates([row]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"), words=3, percent=85)


#: Every pair of documents that share a shingle, counted; for tables on which a self-join of all shingles is affordable.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM d),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
reach AS (SELECT DISTINCT a AS node, a AS other FROM link UNION SELECT r.node, l.b FROM reach r JOIN link l ON l.a = r.other),
least AS (SELECT node, min(other) AS component FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN size USING (doc_id) LEFT JOIN least ON node = d.doc_id
"""
