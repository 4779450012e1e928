"""Schemas of the stored tables, and their changes in numbered steps that go up and down."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructField, StructType

_TEXTS = ("stable_key", "source", "entity_type", "title", "body", "content_hash")
DOCUMENTS = StructType([StructField(c, T.StringType()) for c in _TEXTS]).add("fetched_at", T.TimestampType())
CHUNKS = (
    StructType().add("chunk_key", T.StringType()).add("stable_key", T.StringType()).add("ordinal", T.IntegerType())
    .add("heading_path", T.ArrayType(T.StringType())).add("text", T.StringType()).add("embedding", T.ArrayType(T.FloatType())).add("model", T.StringType())
)
RUNS = StructType([StructField("run_id", T.StringType()), StructField("source", T.StringType()), *[StructField(c, T.LongType()) for c in ("seen", "written", "skipped")]])
RUNS = RUNS.add("status", T.StringType()).add("started_at", T.TimestampType()).add("finished_at", T.TimestampType())


@dataclass(frozen=True)
class Step:
    """One change of a table: ``down`` undoes ``up``, as far as what it dropped can be made again."""

    number: int
    up: Callable[[DataFrame], DataFrame]
    down: Callable[[DataFrame], DataFrame]


def added(number: int, name: str, kind: str, default: str = "NULL") -> Step:
    return Step(number, lambda df: df.withColumn(name, F.expr(default).cast(kind)), lambda df: df.drop(name))


def renamed(number: int, old: str, new: str) -> Step:
    return Step(number, lambda df: df.withColumnRenamed(old, new), lambda df: df.withColumnRenamed(new, old))


def migrated(df: DataFrame, steps: list[Step], now: int, to: int) -> DataFrame:
    """df, which is at step ``now``, brought to step ``to``: upward in order, downward in reverse order."""
    if sorted({s.number for s in steps}) != list(range(1, len(steps) + 1)) or not (0 <= now <= len(steps) and 0 <= to <= len(steps)):
        raise ValueError("steps are numbered from 1 without gaps")
    by = {s.number: s for s in steps}
    for n in range(now + 1, to + 1):
        df = by[n].up(df)
    for n in range(now, to, -1):
        df = by[n].down(df)
    return df


def fits(df: DataFrame, schema: StructType) -> list[str]:
    """The columns of schema that df lacks or has in another type."""
    have = {f.name: f.dataType for f in df.schema}
    return [f.name for f in schema if have.get(f.name) != f.dataType]
