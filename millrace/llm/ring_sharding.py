"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every key has a place on a ring; every shard has ``vnodes`` places.  A key belongs to the shard of
the next virtual node clockwise.  A shard takes at most its capacity; the keys of an arc that its
owner can no longer take go on clockwise, in ring order, to the next shard with room.

The ring is cut into ``ticks`` equal cells, so what the driver sees is a count per cell: a table of
bounded size however many rows there are.  From it the driver lays out, per cell, which run of the
cell's rows goes to which shard.  The rows themselves are shuffled once, by ranges of the ring's order
(the query has a few numbers per row there, no text), and numbered where they are; a cell that holds
many rows, such as a hot key's, is several tasks' work.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import settled

TICKS = 8192


def ring(shards: int, vnodes: int, ticks: int = TICKS) -> list[int]:
    """The owner of each cell of the ring: the shard of the next virtual node clockwise.

    Virtual nodes that meet in a cell step on to the next free one."""
    if shards * vnodes > ticks:
        raise ValueError("more virtual nodes than cells of the ring")
    at: dict[int, int] = {}
    for shard in range(shards):
        for k in range(vnodes):
            tick = int.from_bytes(hashlib.sha256(f"{shard}#{k}".encode()).digest()[:8], "big") % ticks
            while tick in at:
                tick = (tick + 1) % ticks
            at[tick] = shard
    owner, nxt = [0] * ticks, at[min(at)]
    for tick in range(ticks - 1, -1, -1):
        nxt = at.get(tick, nxt)
        owner[tick] = nxt
    return owner


def capacities(rows: int, shards: int, epsilon: float) -> list[int]:
    """With epsilon 0 the capacities add up to the rows exactly, so counts are at most one apart."""
    if epsilon > 0:
        return [-int(-rows * (1 + epsilon) // shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def layout(counts: list[int], owner: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(tick, first, end, shard, slot of first): runs of each cell's rows, numbered from 0 in ring order.

    First every shard fills with keys of its own arcs, clockwise; then what is left goes on clockwise."""
    ticks, room, runs, left = len(counts), list(room), [], []
    for tick, n in enumerate(counts):
        take = min(n, room[owner[tick]])
        room[owner[tick]] -= take
        if take:
            runs.append((tick, 0, take, owner[tick]))
        if take < n:
            left.append((tick, take, n))
    for tick, first, end in left:
        at = tick
        while first < end:
            at = (at + 1) % ticks
            take = min(end - first, room[owner[at]])
            if take:
                room[owner[at]] -= take
                runs.append((tick, first, first + take, owner[at]))
                first += take
    used: dict[int, int] = {}
    out = []
    for tick, first, end, shard in sorted(runs):
        out.append((tick, first, end, shard, used.get(shard, 0)))
        used[shard] = used.get(shard, 0) + end - first
    return out


def ring_position(keys: list[Column]) -> Column:
    return F.xxhash64(F.lit("ring"), *keys)


def pieces(cells: list[tuple[int, int, int, int]], runs: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(tick, part, from, to, shard, slot of from): what of each task's share of a cell goes to which shard.

    cells: (tick, part, number of the first row in the part, rows), where parts hold a cell's rows in ring order."""
    by_tick: dict[int, list[tuple[int, int, int, int]]] = {}
    for tick, first, end, shard, slot in runs:
        by_tick.setdefault(tick, []).append((first, end, shard, slot))
    out, before, last = [], 0, None
    for tick, part, at, n in sorted(cells):
        before = before if tick == last else 0
        for first, end, shard, slot in by_tick[tick]:
            lo, hi = max(first, before), min(end, before + n)
            if lo < hi:
                out.append((tick, part, at + lo - before, at + hi - before, shard, slot + lo - first))
        before, last = before + n, tick
    return out


def assign_shards(df: DataFrame, key: str, shards: int = 16, vnodes: int = 32, epsilon: float = 0.0, order: list[str] | None = None, ticks: int = TICKS) -> DataFrame:
    """Add ``shard`` int and ``slot`` long (from 0, without gaps in each shard) to every row.

    df's columns named ``shard`` or ``slot`` are replaced, all others stay, whatever their names.  A null key has a
    place on the ring like any other.  Rows of equal keys keep together up to the bound on loads; ``order``
    breaks their ties (rows equal in it are interchangeable), and a key that holds much of the table is spread
    over tasks by it.  An empty table gives an empty result."""
    spark: SparkSession = df.sparkSession
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in ("shard", "slot")]).alias("row")
    placed = df.select(ring_position([F.col(f"`{key}`")]).alias("pos"), row)
    placed = placed.withColumn("tick", F.shiftrightunsigned("pos", 64 - (ticks.bit_length() - 1)).cast("int"))
    by = [F.col("tick"), F.col("pos"), *[F.col("row").getField(c) for c in [key, *(order or [])]]]
    dealt = settled(placed.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("id", F.monotonically_increasing_id()))
    # Such an id is the number of the task, and below 33 bits the row's number in it.
    numbered = dealt.select("row", "tick", F.shiftright("id", 33).cast("int").alias("part"), F.col("id").bitwiseAND((1 << 33) - 1).alias("nth"))
    cells = [tuple(r) for r in numbered.groupBy("tick", "part").agg(F.min("nth"), F.count("*")).collect()]  # at most a row per cell and one more per task
    counts = [0] * ticks
    for tick, _, _, n in cells:
        counts[tick] += n
    runs = layout(counts, ring(shards, vnodes, ticks), capacities(sum(counts), shards, epsilon))
    plan = spark.createDataFrame(pieces(cells, runs), "t int, p int, lo long, hi long, shard int, slot long")
    joined = numbered.join(F.broadcast(plan), (F.col("tick") == F.col("t")) & (F.col("part") == F.col("p")) & (F.col("nth") >= F.col("lo")) & (F.col("nth") < F.col("hi")))
    return joined.select("row.*", "shard", (F.col("slot") + F.col("nth") - F.col("lo")).alias("slot"))


def op10_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 under the law `rows`: counts at most one apart."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = assign_shards(rows, "doc_id", shards=16, order=["text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
