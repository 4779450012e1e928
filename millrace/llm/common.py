"""Helpers that several operators of this subpackage share.

Texts reach Python in Arrow batches.  The numpy helpers work on the UTF-8 bytes of a few whole
documents at a time (``chunks``), so their memory follows ``CHUNK_BYTES`` and the longest single
document, never the partition.
"""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 2_000_000
#: Arrow batches end at this many bytes, so that a run of long texts does not fill a worker.
BATCH_BYTES = 8_000_000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_name(df: DataFrame, stem: str) -> str:
    """A name that no column of df has, in either case."""
    taken = {c.lower() for c in df.columns}
    return next(name for k in count() if (name := f"{stem}{k or ''}") not in taken)


def settled(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder, so that a lost executor costs no more
    than the tasks it ran.  The folder is the session's; one is made only on a local master, as a
    cluster's machines do not see each other's temporary folders."""
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _folder(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="millrace-checkpoint-"))


def stored(df: DataFrame) -> DataFrame:
    """As ``settled``, in a compressed table: for many rows of few columns that repeat along the rows."""
    spark = df.sparkSession
    _folder(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_map(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """rows.mapInArrow with batches bounded in bytes, unless the session bounds them more closely.

    Workers live on after a task, so each task gives the memory it has freed back to the machine."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    conf = rows.sparkSession.conf
    now = conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    if now is None or not now.strip().isdigit() or not 0 < int(now) < BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return rows.mapInArrow(task, schema)


def fresh(name: str, *frames: DataFrame) -> str:
    """name, with underscores put before it until no column of the frames is called so in either case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """rows, which must be settled, with their number from 0 in the order of their partitions and within them.

    What the driver sees is a count per partition; no row moves."""
    place, part, first, at = (fresh(n, rows) for n in ("place", "part", "first", "at"))
    placed = rows.withColumn(place, F.monotonically_increasing_id()).withColumn(part, F.shiftright(place, 33).cast("int"))
    counts = dict(placed.groupBy(part).count().collect())  # a row per partition
    starts, so_far = [], 0
    for p in sorted(counts):
        starts.append((p, so_far))
        so_far += counts[p]
    firsts = rows.sparkSession.createDataFrame(starts, f"{at} int, {first} long")
    joined = placed.join(F.broadcast(firsts), F.col(part) == F.col(at))
    inside = F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col(first) + inside).alias(name))


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def slices(b: pa.RecordBatch, column: int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of whole rows whose texts, in ``column``, have about ``limit`` bytes."""
    total = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < b.num_rows:
        end = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + limit, side="right")))
        yield b.slice(first, end - first)
        first = end


def chunks(ids: pa.Array, texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Split an Arrow batch into runs of whole documents of about ``limit`` bytes.

    Yields (ids, bytes, offsets); a null text has no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    if texts.null_count:
        lengths = np.diff(offsets)
        if lengths[np.asarray(texts.is_null())].any():  # a null that still has bytes: drop them
            texts = pa.array([t or "" for t in texts.to_pylist()], pa.large_string())
            offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[: n + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield ids.slice(start, end - start), data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
        start = end


# ---------------------------------------------------------------- hashing words of byte buffers

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.frombuffer(b"".join(hashlib.sha256(bytes([i])).digest()[:8] for i in range(256)), dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every run of bytes other than ``[\\x20\\x09-\\x0D]``, within documents."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = inside
    after = np.zeros(len(data) + 1, dtype=bool)
    after[:-1] = inside
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, A-Z taken as a-z: the same bytes give the same hash anywhere."""
    n = len(data)
    summed = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_RANDOM[_LOWER[data]] * _powers(_BASE, n), out=summed[1:])
    back = _powers(_UNBASE, n + 1)
    return mixed((summed[ends] - summed[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each run of ``size`` words; a shorter document is one shingle of all its words."""
    n = len(words)
    if n == 0:
        return doc[:0], words[:0]
    factor = _powers(0xD1342543DE82EF95, size)
    out = np.zeros(max(n - size + 1, 0), dtype=np.uint64)
    for k in range(size):
        out += words[k : k + len(out)] * factor[k]
    whole = doc[: len(out)] == doc[size - 1 :] if len(out) else np.zeros(0, bool)
    docs, hashes = doc[: len(out)][whole], out[whole]
    bounds = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1], True])
    short = np.flatnonzero(np.diff(bounds) < size)
    if len(short):
        extra = np.zeros(len(short), dtype=np.uint64)
        for k in range(size - 1):
            at = bounds[short] + k
            has = at < bounds[short + 1]
            extra[has] += words[at[has]] * factor[k]
        extra += np.uint64(0x5851F42D4C957F2D) * (bounds[short + 1] - bounds[short]).astype(np.uint64)
        docs, hashes = np.r_[docs, doc[bounds[short]]], np.r_[hashes, extra]
    return docs, mixed(hashes)


# ---------------------------------------------------------------- connected components


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable over ``links``, for every node with a link.

    Alternating large-star and small-star steps: each step is a min per node over its neighbours,
    so a hub's neighbours are combined before the shuffle and no node's list is ever collected.
    Rounds grow with the logarithm of the longest chain.  State lives in checkpoints."""
    edges = settled(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    )
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least2, "u")
            .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        after = settled(small)
        if _same(edges, after):
            return after.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.col("m").alias("component")).unionByName(
                after.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        edges = after


def _same(one: DataFrame, two: DataFrame) -> bool:
    mark = lambda df: df.select(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
    return mark(one) == mark(two)
