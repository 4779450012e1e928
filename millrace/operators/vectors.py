"""A vector store: an inverted file of cells with short codes beside the vectors, upserts, filters, exact re-ranking.

The cells are those of k-means by cosine, fitted on a bounded sample.  A vector lies in its cell's folder with a
code of two bits a component: a thirty-second of the bytes of doubles, a sixteenth of floats.  A search reads the
codes of the cells that it probes, all by default; the best ``rerank`` times k of each query by code are scored
again with their vectors, in doubles.  ``exact`` reads the vectors of the probed cells instead of the codes.

Changes are deltas (``deltas.DeltaTable``): an upsert writes its own rows, and a vector that moves to another cell
is found there alone."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators.broadcasts import small
from millrace.operators.deltas import DeltaTable
from millrace.operators.retrieval import top_per_query

#: Vectors from which cells and codes are fitted, about.
SAMPLE = 50_000
MOST_CELLS = 4096
#: A search is for a stated set of queries; more are searched in parts.
MOST_QUERIES = 10_000
#: The four levels with the least error for a normal variable, in its deviations.
LEVELS = np.array([-1.510, -0.4528, 0.4528, 1.510])
#: Products of a tile of queries and vectors.
CELLS_AT_ONCE = 2_000_000


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


class Codes:
    """Two bits a component of unit vectors, by each component's mean and deviation."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        self.mean, self.spread = mean, np.where(spread > 0, spread, 1.0)

    def pack(self, unit: np.ndarray) -> list[bytes]:
        level = np.searchsorted((LEVELS[1:] + LEVELS[:-1]) / 2, (unit - self.mean) / self.spread).astype(np.uint8)
        level = np.pad(level, ((0, 0), (0, -level.shape[1] % 4))).reshape(len(level), -1, 4)
        packed = level[:, :, 0] | level[:, :, 1] << 2 | level[:, :, 2] << 4 | level[:, :, 3] << 6
        return [row.tobytes() for row in packed]

    def unpack(self, codes: pa.Array) -> np.ndarray:
        """Unit vectors near to those packed."""
        packed = np.frombuffer(b"".join(codes.to_pylist()), dtype=np.uint8).reshape(len(codes), -1)
        level = np.stack([packed >> s & 3 for s in (0, 2, 4, 6)], axis=2).reshape(len(codes), -1)[:, : len(self.mean)]
        return _unit(LEVELS[level] * self.spread + self.mean)


class VectorStore:
    """Vectors of one length under an id, in a folder that driver and executors share, with columns to filter by."""

    def __init__(self, spark: SparkSession, root: str, id_kind: str = "long", keep: str = "", most_deltas: int = 8):
        self.spark, self.root = spark, root
        kept = f", {keep}" if keep else ""
        self.table = DeltaTable(spark, f"{root}/vectors", f"vec_id {id_kind}, cell int, code binary, embedding array<float>{kept}", "vec_id", place="cell", most_deltas=most_deltas)
        self.kept = self.table.columns[4:]
        self._model: tuple[np.ndarray, Codes] | None = None

    def fit(self, vectors: DataFrame, cells: int | None = None) -> VectorStore:
        """Cells and codes from a sample of vectors (vec_id, embedding), by a hash of the id; as many cells as the root of the
        number of vectors, unless said.  All later vectors have the length of these; zero and null ones do not count."""
        good = vectors.where("size(embedding) > 0 and exists(embedding, x -> x <> 0) and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
        n = good.count()
        if not n:
            raise ValueError("no vector to fit on")
        share = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(1 << 30)) < min(1.0, SAMPLE / n) * (1 << 30)
        sample = good.where(share).select(F.col("embedding").cast("array<double>").alias("x"))
        k = max(1, min(MOST_CELLS, cells or int(n**0.5)))
        rows = sample.select(array_to_vector("x").alias("features"))
        centres = KMeans(k=k, distanceMeasure="cosine", maxIter=10, seed=1, initSteps=2).fit(rows).clusterCenters() if k > 1 else [np.ones(len(sample.first()["x"]))]
        norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, x: s + x * x))
        each = sample.select(F.posexplode(F.transform("x", lambda x: x / norm)).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("spread"))
        self.spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/cells")
        each.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/components")
        self._model = None
        return self

    def model(self) -> tuple[np.ndarray, Codes]:
        """The centres of the cells and the codes, of bounded size: MOST_CELLS centres."""
        if self._model is None:
            centres = self.spark.read.parquet(f"{self.root}/cells").orderBy("cell").collect()
            parts = self.spark.read.parquet(f"{self.root}/components").orderBy("i").collect()
            self._model = _unit(np.array([r["centre"] for r in centres])), Codes(np.array([r["mean"] for r in parts]), np.array([r["spread"] for r in parts]))
        return self._model

    def _encoded(self, vectors: DataFrame) -> DataFrame:
        centres, codes = self.model()
        shared, d = self.spark.sparkContext.broadcast((centres, codes)), len(codes.mean)
        bad = f"size(embedding) = {d} and exists(embedding, x -> x <> 0) and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
        rows = vectors.where(bad).select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"), *self.kept)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                unit = _unit(_matrix(b.column(1), d))
                cell = (unit @ shared.value[0].T).argmax(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cell), pa.array(shared.value[1].pack(unit), pa.binary()), *b.columns[1:]], ["vec_id", "cell", "code", *b.schema.names[1:]])

        return rows.mapInArrow(run, self.table._kinds)

    def upsert(self, vectors: DataFrame, writer: str = "store", number: int | None = None) -> None:
        """Put vectors (vec_id, unique, embedding and the kept columns) over those of the same id.

        A vector that is null, zero, of another length or has a component that is null or not finite is not
        kept, and takes the old one of its id away.  A number that the writer has used is not written again."""
        good = self._encoded(vectors)
        self.table.commit(writer, self._next(writer) if number is None else number, puts=good, deletes=vectors.select("vec_id"))

    def delete(self, ids: DataFrame, writer: str = "store", number: int | None = None) -> None:
        self.table.commit(writer, self._next(writer) if number is None else number, deletes=ids)

    def _next(self, writer: str) -> int:
        return 1 + max((r["seq"] for r in self.table.folders() if r["kind"] == "writer" and r["folder"] == writer), default=-1)

    def search(self, asked: DataFrame, k: int = 20, probes: int | None = None, rerank: int = 20, where: Column | None = None, exact: bool = False) -> DataFrame:
        """(query_id, vec_id, similarity, rank): the k vectors nearest to each query by cosine, not below 0, ties by the smaller id.

        asked: query_id, unique, and embedding, MOST_QUERIES at most; queries that are null or of another length
        find nothing.  ``probes`` cells whose centres are nearest are looked at, all by default; ``where`` is a test of
        the kept columns and goes to the scan.  The queries go to every task; a task's list of a query has
        ``rerank`` times k entries whatever it reads, and no text or vector moves but those of the lists."""
        centres, codes = self.model()
        d = len(codes.mean)
        usable = asked.where(f"size(embedding) = {d} and forall(embedding, x -> x is not null)").select("query_id", F.col("embedding").cast("array<double>").alias("q"))
        got = usable.limit(MOST_QUERIES + 1).toArrow()
        if got.num_rows > MOST_QUERIES:
            raise ValueError(f"more than {MOST_QUERIES} queries: search in parts")
        kinds = f"query_id {asked.schema['query_id'].dataType.simpleString()}, vec_id {self.table.schema['vec_id'].dataType.simpleString()}"
        if not got.num_rows:
            return self.spark.createDataFrame([], f"{kinds}, similarity double, rank int")
        q = _unit(np.array(got.column("q").to_pylist(), dtype=np.float64))
        near = np.zeros((len(q), len(centres)), dtype=bool)
        np.put_along_axis(near, np.argsort(-(q @ centres.T), axis=1)[:, : len(centres) if probes is None else probes], True, axis=1)
        most = k if exact else rerank * k
        shared = self.spark.sparkContext.broadcast((q, near, None if exact else codes))
        column = "embedding" if exact else "code"
        rows = self.table.read(columns=["vec_id", "cell", column, *self.kept], places=None if near.any(axis=0).all() else np.flatnonzero(near.any(axis=0)).tolist())
        rows = (rows if where is None else rows.where(where)).select("vec_id", "cell", column)
        listed = rows.mapInArrow(_lists(shared, most, d), f"nth long, vec_id {self.table.schema['vec_id'].dataType.simpleString()}, near double")
        best = top_per_query(listed.withColumnRenamed("nth", "query_id"), "near", most, tie="vec_id").select(F.col("query_id").alias("nth"), "vec_id")
        numbers = self.spark.createDataFrame(pa.table({"nth": np.arange(len(q)), "query_id": got.column("query_id"), "q": got.column("q")}))
        candidates = best.join(F.broadcast(numbers), "nth")  # MOST_QUERIES rows at most
        full = self.table.read(only=best, columns=["vec_id", "embedding"])
        similarity = F.greatest(F.lit(0.0), F.round(T.cosine(F.col("q"), F.col("embedding")), 6))
        return top_per_query(candidates.join(full, "vec_id").select(F.col("query_id"), "vec_id", similarity.alias("similarity")), "similarity", k, tie="vec_id")


def _lists(shared, most: int, d: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(nth query, vec_id, similarity) of the best vectors of a task for each query, by code or, as they are ranked in the
    end, by vector; ties by the smaller id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, near, codes = shared.value
        step = max(1, CELLS_AT_ONCE // len(q))
        score, ids, kind = np.full((len(q), 0), -np.inf), None, None
        for b in batches:
            for first in range(0, b.num_rows, step):
                part = b.slice(first, step)
                unit = _unit(_matrix(part.column(2), d)) if codes is None else codes.unpack(part.column(2))
                own, kind = np.array(part.column(0).to_pylist()), part.column(0).type
                product = q @ unit.T
                product = np.maximum(0, np.round(product, 6)) if codes is None else product
                score = np.concatenate([score, np.where(near[:, part.column(1).to_numpy()], product, -np.inf)], axis=1)
                own = np.broadcast_to(own, (len(q), len(own)))
                ids = own if ids is None else np.concatenate([ids, own], axis=1)
                if score.shape[1] > most:
                    order = np.lexsort((ids, -score), axis=1)[:, :most]
                    score, ids = np.take_along_axis(score, order, axis=1), np.take_along_axis(ids, order, axis=1)
        if ids is not None:
            at, col = np.nonzero(score > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(ids[at, col].tolist(), kind), pa.array(score[at, col])], ["nth", "vec_id", "near"])

    return run
