"""Near-duplicate embeddings by lattice hashing.

Each of several tables projects a unit vector at random onto eight-dimensional blocks, scales it and
decodes every block to the nearest point of the E8 lattice; the points together are its cell.  A vector
is listed in its home cell and in the PROBES neighbouring cells that it lies nearest to, so that vectors
on two sides of a border meet.  In a cell every pair with a home there is verified by its cosine in
double precision.

A block more makes the chance that two unrelated vectors meet in a table about 30 times smaller, and
that of two with cosine 0.9 about 2.4 times.  So blocks grow with the logarithm of the number of
vectors, to keep the cells' size, and tables with the blocks, to keep the recall (``plan``): the share
of all pairs that is verified falls as the table grows, the listings of a vector grow.

Equal vectors are one class with a multiplicity, known by a number of its own, as ids may repeat or be
null.  Links are counted inside the cells, none is listed: a pair counts in the first table in which
both have the same home, or, if there is none, in the first in which one has a probe at the other's
home.  A cell with many members is split into blocks that meet pairwise in tasks of their own.
Components come from one edge per linked vector and cell.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import arrow_map, components, load, mixed, settled

PROBES = 3
SCALE = 0.3  # of a cell, for 64 dimensions
BLOCK = 512
FEWEST_BLOCKS = 2
#: Up to so many vectors there are no more blocks, and BLOCK_FACTOR times as many for each further one.
FIRST_STEP = 100_000
BLOCK_FACTOR = 30
#: The chance of a pair with cosine 0.9 to meet in a table of two blocks, and its factor for each further one.
MEETS, MEETS_FACTOR = 0.41, 0.42
MISSED = 5e-4


def plan(rows: int) -> tuple[int, int]:
    """(tables, blocks) for so many vectors."""
    blocks = FEWEST_BLOCKS
    while rows > FIRST_STEP * BLOCK_FACTOR ** (blocks - FEWEST_BLOCKS):
        blocks += 1
    return math.ceil(math.log(MISSED) / math.log1p(-MEETS * MEETS_FACTOR ** (blocks - FEWEST_BLOCKS))), blocks


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8: the neighbours of any of its points."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


ROOTS = _roots()


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: the nearer of the nearest points of D8 and of D8 + 1/2."""

    def d8(y: np.ndarray) -> np.ndarray:
        near = np.rint(y)
        rest = y - near
        odd = np.flatnonzero(near.sum(axis=1).astype(np.int64) & 1)
        worst = np.abs(rest[odd]).argmax(axis=1)
        near[odd, worst] += np.where(rest[odd, worst] >= 0, 1.0, -1.0)
        return near

    one, two = d8(x), d8(x - 0.5) + 0.5
    nearer = ((x - one) ** 2).sum(axis=1) <= ((x - two) ** 2).sum(axis=1)
    return np.where(nearer[:, None], one, two)


def unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cells(x: np.ndarray, tables: int, blocks: int, probes: int = PROBES, scale: float = SCALE) -> np.ndarray:
    """(rows, tables, 1 + probes) keys of the home cell and the nearest neighbouring cells."""
    n, d = x.shape
    out = np.empty((n, tables, 1 + probes), dtype=np.int64)
    for t in range(tables):
        rng = np.random.default_rng([d, t])
        project = rng.normal(size=(d, 8 * blocks))
        project /= np.linalg.norm(project, axis=0) * scale * np.sqrt(64 / d)
        seed = mixed(mixed(np.array([d])) + np.uint64(t))  # vectors of two lengths share no cell, the origin neither
        weights = rng.integers(1, 2**63, size=8 * blocks, dtype=np.uint64) | np.uint64(1)
        y = x @ project
        home = np.concatenate([nearest_e8(y[:, 8 * b : 8 * b + 8]) for b in range(blocks)], axis=1)
        rest = y - home
        toward = np.concatenate([rest[:, 8 * b : 8 * b + 8] @ ROOTS.T for b in range(blocks)], axis=1)
        best = np.argpartition(-toward, probes, axis=1)[:, :probes]
        points = [home]
        for k in range(probes):
            step = np.zeros_like(home)
            block, root = np.divmod(best[:, k], len(ROOTS))
            step[np.arange(n)[:, None], 8 * block[:, None] + np.arange(8)] = ROOTS[root]
            points.append(home + step)
        for k, p in enumerate(points):
            whole = np.rint(2 * p).astype(np.int64).view(np.uint64)
            out[:, t, k] = mixed((whole * weights).sum(axis=1, dtype=np.uint64) + seed).view(np.int64)
    return out


def _listed(tables: int, blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                part = b.slice(k, 2000)
                vectors = part.column(part.num_columns - 1).to_pylist()
                sizes = np.array([len(v) for v in vectors])
                n, keys = len(vectors), np.empty((len(vectors), tables, 1 + PROBES), dtype=np.int64)
                for d in np.unique(sizes):
                    at = np.flatnonzero(sizes == d)
                    keys[at] = cells(unit([vectors[i] for i in at]), tables, blocks)
                homes = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * tables), pa.array(keys[:, :, 0].ravel()))
                near = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * tables * PROBES), pa.array(keys[:, :, 1:].ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, homes.cast(pa.list_(pa.int64())), near.cast(pa.list_(pa.int64()))], [*part.schema.names, "homes", "near"])

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of whole groups (equal cell, bi, bj) of batches sorted by them."""
    kept: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        kept = t if kept is None else pa.concat_tables([kept, t])
        last = [kept.column(c)[-1].as_py() for c in ("cell", "bi", "bj")]
        same = np.logical_and.reduce([kept.column(c).to_numpy() == v for c, v in zip(("cell", "bi", "bj"), last, strict=True)])
        cut = int(np.argmax(same))
        if cut:
            yield kept.slice(0, cut)
            kept = kept.slice(cut)
    if kept is not None and kept.num_rows:
        yield kept


def _counted_here(cell: int, homes_a: np.ndarray, homes_b: np.ndarray, near_a: np.ndarray, near_b: np.ndarray) -> np.ndarray:
    """Whether ``cell`` is where pairs that share no home count: the home of the pair's first vector in the first
    table in which one has a probe at the other's home, or else that of its second."""
    at_a, at_b = (near_b == homes_a[:, :, None]).any(axis=2), (near_a == homes_b[:, :, None]).any(axis=2)
    first = (at_a | at_b).argmax(axis=1)
    pair = np.arange(len(first))
    return np.where(at_a[pair, first], homes_a[pair, first], homes_b[pair, first]) == cell


def _verify(threshold: float, blocks: int):
    """(key, n, other): in each cell the links of every vector that count there, and one vector it is linked with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            cell, bi, bj = (t.column(c).to_numpy() for c in ("cell", "bi", "bj"))
            keys, m, block, home = (t.column(c).to_numpy() for c in ("key", "m", "block", "home"))
            homes = t.column("homes").combine_chunks().flatten().to_numpy().reshape(len(keys), -1)
            vectors = t.column("vector").combine_chunks()
            sizes = np.diff(vectors.offsets.to_numpy())
            flat, at = vectors.flatten().to_numpy(), np.r_[0, np.cumsum(sizes)]
            edge = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1]), True])
            rows: list[tuple[np.ndarray, ...]] = []
            for lo, hi in itertools.pairwise(edge):
                if hi - lo < 2 or not home[lo:hi].any():
                    continue
                near = np.zeros((hi - lo, hi - lo), dtype=bool)
                for d in np.unique(sizes[lo:hi]):  # one but for keys of two lengths that happen to be equal
                    of = np.flatnonzero(sizes[lo:hi] == d)
                    x = unit([flat[at[lo + i] : at[lo + i + 1]] for i in of])
                    near[np.ix_(of, of)] = x @ x.T >= threshold
                near &= home[lo:hi, None] | home[None, lo:hi]
                if bi[lo] != bj[lo]:
                    near &= block[lo:hi, None] != block[None, lo:hi]
                a, b = np.nonzero(np.triu(near, 1))
                if not len(a):
                    continue
                a, b = a + lo, b + lo  # rows are sorted by key, so a's is the smaller
                same = homes[a] == homes[b]
                both = same.any(axis=1)
                counted = both & (homes[a, same.argmax(axis=1)] == cell[lo])
                probed = np.flatnonzero(~both)
                if len(probed):
                    ends, places = np.unique(np.r_[a[probed], b[probed]], return_inverse=True)
                    seen = np.empty((len(ends), homes.shape[1], PROBES), dtype=np.int64)
                    for d in np.unique(sizes[ends]):
                        of = np.flatnonzero(sizes[ends] == d)
                        seen[of] = cells(unit([flat[at[ends[i]] : at[ends[i] + 1]] for i in of]), homes.shape[1], blocks)[:, :, 1:]
                    one, two = places[: len(probed)], places[len(probed) :]
                    for k in range(0, len(probed), 4096):
                        p, i, j = probed[k : k + 4096], one[k : k + 4096], two[k : k + 4096]
                        counted[p] = _counted_here(cell[lo], homes[a[p]], homes[b[p]], seen[i], seen[j])
                if not counted.any():
                    continue
                c, d = a[counted] - lo, b[counted] - lo
                n = np.bincount(np.r_[c, d], weights=np.r_[m[lo + d], m[lo + c]], minlength=hi - lo).astype(np.int64)
                root = np.arange(hi - lo)
                for i, j in zip(c, d, strict=True) if len(c) < 64 else _spanning(c, d, hi - lo):
                    r, s = root[i], root[j]
                    if r != s:
                        root[root == max(r, s)] = min(r, s)
                some = np.flatnonzero(n)
                rows.append((keys[lo + some], n[some], keys[lo + root[some]]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows, strict=True)], ["key", "n", "other"])

    return run


def _spanning(c: np.ndarray, d: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    """A few of many pairs that join the same vertices: each vertex with its smallest partner, until that says no more."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, c, label[d])
        np.minimum.at(low, d, label[c])
        low = low[low]
        if (low == label).all():
            return iter([(int(i), int(r)) for i, r in enumerate(label) if i != r])
        label = low


def near_duplicate_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, tables: int | None = None, blocks: int | None = None) -> DataFrame:
    """(id, n_links, component_id, kept) for every row; ids are longs.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and
    vectors of different lengths do not link.  Rows that repeat an id each have the links and the
    component of their own vector.  A row with a null id counts as a link and joins components but is
    never kept; a component of such rows alone is null.  Extra columns are not looked at."""
    if tables is None or blocks is None:
        tables, blocks = plan(rows.count())
    base = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    fit = F.expr("vector is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vector, x -> x <> 0)")
    keyed = base.withColumn("fit", F.coalesce(fit, F.lit(False))).withColumn("p1", F.xxhash64("vector")).withColumn("p2", F.xxhash64(F.lit("second"), "vector"))
    classes = keyed.where("fit").groupBy("p1", "p2").agg(F.min("id").alias("id"), F.count("*").alias("m"), F.any_value("vector").alias("vector"))
    kind = rows.schema[vector_col].dataType.simpleString()
    reps = settled(
        classes.withColumn("key", F.monotonically_increasing_id()).select("key", "p1", "p2", "id", "m", "vector")
        .transform(arrow_map, _listed(tables, blocks), f"key long, p1 long, p2 long, id long, m long, vector {kind}, homes array<long>, near array<long>")
    )
    listed = reps.select("key", F.explode(F.concat(F.transform("homes", lambda c: F.struct(c.alias("cell"), F.lit(True).alias("home"))), F.transform("near", lambda c: F.struct(c.alias("cell"), F.lit(False).alias("home"))))).alias("c")).select("key", "c.cell", "c.home")
    crowded = listed.groupBy("cell").agg(F.count("*").alias("size"), F.max("home").alias("any")).where("size > 1 and any").select("cell", F.ceil(F.col("size") / BLOCK).cast("int").alias("g"))
    placed = listed.join(crowded, "cell").withColumn("block", F.pmod(F.xxhash64("key"), F.col("g")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda j: F.struct(F.least("block", j).alias("bi"), F.greatest("block", j).alias("bj")))
    dealt = placed.select("key", "cell", "home", "block", F.explode(pairs).alias("p")).select("key", "cell", "home", "block", "p.bi", "p.bj")
    met = settled(
        dealt.join(reps.select("key", "m", "vector", "homes"), "key").repartition("cell", "bi", "bj").sortWithinPartitions("cell", "bi", "bj", "key")
        .transform(arrow_map, _verify(threshold, blocks), "key long, n long, other long")
    )
    counts = met.groupBy("key").agg(F.sum("n").alias("links"))
    found = settled(components(met.select(F.col("key").alias("a"), F.col("other").alias("b")), "a", "b").withColumnRenamed("node", "key"))
    firsts = found.join(reps.select("key", "id"), "key").groupBy("component").agg(F.min("id").alias("first"))
    named = (
        reps.select("p1", "p2", "key", "id", "m").join(counts, "key", "left").join(found.join(firsts, "component").select("key", "first"), "key", "left")
        .select("p1", "p2", F.lit(True).alias("fit"), (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("first", "id").alias("component"))
    )
    out = keyed.select("id", "fit", "p1", "p2").join(named, ["p1", "p2", "fit"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def op1_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(load(spark, sf_dir, "embeddings"))


#: Every pair of vectors compared; for tables of some thousands.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id <> q.vec_id AND len(p.e) = len(q.e) AND list_cosine_similarity(p.e, q.e) >= 0.9),
reach AS (SELECT DISTINCT a AS node, a AS other FROM link UNION SELECT r.node, l.b FROM reach r JOIN link l ON l.a = r.other),
least AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
counts AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN counts ON a = vec_id LEFT JOIN least ON node = vec_id
"""
