"""Hard-negative mining by blocks of inner products.

The anchors are a stated set of queries against all rows.  They are dealt into blocks of at most
``BLOCK_BYTES`` of vectors; each block is broadcast and multiplied, in float64, with every batch of rows.
Vectors are whole numbers (``scale`` times a component, floored), so a product is exact as long as no sum
can reach 2^53; a batch in which one could is multiplied in Python's integers.

Two passes a block.  The first keeps, per task, each anchor's best rows of its own label, and Spark merges
the tasks' lists; the second does so for each anchor and positive with the rows of other labels whose score
lies in the window that the positive's score spans.  A task's lists are of a fixed length, whatever it
reads, and a score below the worst on a full list is dropped at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import arrow_map, load, numbered, settled

#: Bytes of the vectors of a block of anchors; a block has at least one anchor.
BLOCK_BYTES = 16_000_000
#: Products of a matrix made at a time.
CELLS = 1_000_000
EXACT = 1 << 53
NONE = np.iinfo(np.int64).min

Block = dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def _list(column: pa.Array) -> pa.Array:
    return column if pa.types.is_list(column.type) or pa.types.is_large_list(column.type) else column.cast(pa.list_(pa.float64()))


def vectors(b: pa.RecordBatch, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, id, label, floored vectors) of a batch of (id, label, embedding), once per length of vectors.

    Rows in which anything is null or not finite are left out."""
    column = _list(b.column(2))
    ends = column.offsets.to_numpy().astype(np.int64)
    starts, ends = ends[:-1], ends[1:]
    flat = column.values
    values = np.floor(flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False) * scale)
    bad = np.r_[0, np.cumsum(~np.isfinite(values))]
    good = np.asarray(column.is_valid()) & np.asarray(b.column(0).is_valid()) & np.asarray(b.column(1).is_valid()) & (bad[ends] == bad[starts])
    ids, labels = (b.column(k).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
    size = ends - starts
    for d in np.unique(size[good]).tolist():
        at = np.flatnonzero(good & (size == d))
        yield at, ids[at], labels[at], values[starts[at][:, None] + np.arange(d)]


def products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The inner products of all rows of a with all of c, exactly, as 64-bit integers."""
    most = max(a.shape[1], 1) * float(np.abs(a).max(initial=0)) * float(np.abs(c).max(initial=0))
    if most < EXACT:
        return (a @ c.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    out = whole(a).dot(whole(c).T) if a.shape[1] else np.zeros((len(a), len(c)), dtype=object)
    if max(abs(int(out.max())), abs(int(out.min()))) >= 1 << 63:
        raise OverflowError("an inner product does not fit 64 bits")
    return out.astype(np.int64)


class Best:
    """Lists of the ``k`` best (score, id) of each of n, higher scores and then smaller ids first."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids, self.held = k, np.full((n, k), NONE), np.zeros((n, k), np.int64), np.zeros(n, np.int64)

    def least(self) -> np.ndarray:
        """Below this score nothing can enter a list any more."""
        return self.scores[:, -1]

    def add(self, which: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Put entries, each for the list ``which``, into the lists."""
        if not len(which):
            return
        lists = np.unique(which)
        old = np.arange(self.k)[None, :] < self.held[lists][:, None]
        owner = np.r_[np.repeat(lists, self.held[lists]), which]
        scores, ids = np.r_[self.scores[lists][old], scores], np.r_[self.ids[lists][old], ids]
        order = np.lexsort((ids, -scores, owner))
        owner, scores, ids = owner[order], scores[order], ids[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        kept = place < self.k
        owner, place = owner[kept], place[kept]
        self.scores[owner, place], self.ids[owner, place] = scores[kept], ids[kept]
        self.held[lists] = np.bincount(owner, minlength=len(self.held))[lists]

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, score, id) of all entries."""
        at, place = np.nonzero(np.arange(self.k)[None, :] < self.held[:, None])
        return at, self.scores[at, place], self.ids[at, place]


def _tiles(block: Block, b: pa.RecordBatch, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, its id, its label, row id, row label, products) of tiles of anchors and rows of equal length."""
    for _, ids, labels, rows in vectors(b, scale):
        if rows.shape[1] not in block:
            continue
        number, a_ids, a_labels, a = block[rows.shape[1]]
        step = 64  # a first narrow tile fills the lists, so that later ones have little to sort
        first = 0
        while first < len(ids):
            part = slice(first, first + step)
            high = max(1, CELLS // step)
            for k in range(0, len(number), high):
                at = slice(k, k + high)
                yield number[at], a_ids[at], a_labels[at], ids[part], labels[part], products(a[at], rows[part])
            first, step = first + step, min(step * 4, 4096)


def _positives(block: Broadcast, size: int, k: int, scale: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(size, k)
        for b in batches:
            for number, a_ids, a_labels, ids, labels, scores in _tiles(block.value, b, scale):
                hit = (a_labels[:, None] == labels[None, :]) & (a_ids[:, None] != ids[None, :]) & (scores >= best.least()[number][:, None])
                at, row = np.nonzero(hit)
                best.add(number[at], scores[at, row], ids[row])
        at, scores, ids = best.entries()
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(scores), pa.array(ids)], ["list", "score", "id"])

    return run


def _negatives(block: Broadcast, lists: Broadcast, k: int, scale: float, low: int, high: int) -> Callable:
    """lists: the place of each list's anchor, ascending, and the score of its positive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        positives, scores_of = lists.value
        best = Best(len(positives), k)
        at_least, at_most = -(-low * scores_of // 100), high * scores_of // 100
        for b in batches:
            for number, _, a_labels, ids, labels, scores in _tiles(block.value, b, scale):
                other = a_labels[:, None] != labels[None, :]
                first, last = np.searchsorted(positives, number), np.searchsorted(positives, number, side="right")
                for nth in range(int((last - first).max(initial=0))):
                    has = np.flatnonzero(first + nth < last)
                    of = first[has] + nth
                    least = np.maximum(at_least[of], best.least()[of])
                    some = scores[has]
                    at, row = np.nonzero(other[has] & (some >= least[:, None]) & (some <= at_most[of][:, None]))
                    best.add(of[at], some[at, row], ids[row])
        at, scores, ids = best.entries()
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(scores), pa.array(ids)], ["list", "score", "id"])

    return run


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The best k of each list, of all tasks' lists, with ``place`` from 1."""
    w = Window.partitionBy("list").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def _blocks(anchors: DataFrame, scale: float, block_bytes: int) -> Iterator[tuple[Block, np.ndarray]]:
    """The anchors in blocks of bounded size, each read by a job of its own, and the id of each anchor."""
    rows = numbered(settled(anchors), "nth")
    shape = rows.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    size = max(1, block_bytes // (8 * max(shape["d"] or 1, 1)))
    for k in range(0, shape["n"], size):
        got = rows.where((F.col("nth") >= k) & (F.col("nth") < k + size)).drop("nth").toArrow().combine_chunks()  # at most block_bytes of vectors
        block, ids, so_far = {}, [], 0
        for batch in got.to_batches():
            for _, own, labels, a in vectors(batch, scale):
                block.setdefault(a.shape[1], []).append((np.arange(so_far, so_far + len(own)), own, labels, a))
                ids.append(own)
                so_far += len(own)
        if so_far:
            yield {d: tuple(np.concatenate(x) for x in zip(*parts, strict=True)) for d, parts in block.items()}, np.concatenate(ids)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each anchor and each of its first ``positives`` other rows of its label, the first ``negatives`` rows of other
    labels with low * positive_score <= 100 * negative_score <= high * positive_score: anchor_id, positive_id,
    rank, negative_id, positive_score, negative_score.

    A score is the inner product of vectors floored after ``scale``; higher scores come first, then smaller
    ids.  rows and anchors have the three columns named, others are not read.  Rows with a null id, label or
    vector, or with a component that is null or, scaled, not finite, take no part; vectors of different lengths have no product.
    Rows with an anchor's id are that anchor, not its positives.  Repeated rows count as often as they stand
    there, repeated anchors give their rows each.  Empty tables give an empty result, as does an anchor
    without positives or without negatives in the window."""
    spark: SparkSession = rows.sparkSession
    named = lambda df: df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vec_col}`").alias("embedding"))
    all_rows, parts, shared = named(rows), [], spark.sparkContext.broadcast
    for own, ids in _blocks(named(anchors), scale, block_bytes):
        block = shared(own)
        found = all_rows.transform(arrow_map, _positives(block, len(ids), positives, scale), "list long, score long, id long")
        best = _merged(found, positives).orderBy("list", "place").toArrow()  # a few rows per anchor of the block
        of, score, positive = (best.column(c).to_numpy() for c in ("list", "score", "id"))
        if not len(of):
            continue
        got = _merged(all_rows.transform(arrow_map, _negatives(block, shared((of, score)), negatives, scale, low, high), "list long, score long, id long"), negatives)
        lists = spark.createDataFrame(pa.table({"n": np.arange(len(of)), "anchor_id": ids[of], "positive_id": positive, "positive_score": score}))
        parts.append(got.join(F.broadcast(lists), F.col("list") == F.col("n")).select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    if not parts:
        return spark.createDataFrame([], RESULT)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = load(spark, sf_dir, "embeddings").withColumn("label", label)
    return mine(rows, rows.where("vec_id % 100 = 0"))


ORACLE = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, list_inner_product(a.q, c.q)::BIGINT AS score FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.q) = len(c.q)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 10"""
