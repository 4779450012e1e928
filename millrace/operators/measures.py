"""Measures that come out of the jobs that run anyway: counters observed beside a write, and the health of streams."""

from __future__ import annotations

import threading
import time
from collections import deque

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

HEALTH = "stream string, batch long, rows long, rows_per_second double, millis long, state_rows long, status string"


def observed(df: DataFrame, **measures: Column) -> tuple[DataFrame, Observation]:
    """df, and what its first action counts in passing: ``observation.get`` waits for that action and gives a dict.

    Use it where df ends in a write or a checkpoint, so that each row passes once; a stage before a shuffle that a
    lost executor has computed again would count again."""
    seen = Observation()
    return df.observe(seen, *[c.alias(name) for name, c in measures.items()]), seen


def action_counters() -> dict[str, Column]:
    """seen, written and skipped of rows with an ``action``, as a run reports them."""
    touched = F.col("action").eqNullSafe("touch")
    return {"seen": F.count(F.lit(1)), "written": F.count_if(~touched), "skipped": F.count_if(touched)}


def run_status(counters: dict, errors: int = 0) -> str:
    """``completed``; with errors ``partial``, or ``failed`` if nothing was written either."""
    return "completed" if not errors else "partial" if counters["written"] else "failed"


class StreamHealth(StreamingQueryListener):
    """The last batches of every stream of a session, from the progress that Spark reports anyway.

    A batch is ``late`` if it took longer than ``slow_ms``; a stream that ended with an error is ``failed``.  The
    listener keeps ``last`` records and no more."""

    def __init__(self, slow_ms: int = 60_000, last: int = 1000):
        self.slow_ms = slow_ms
        self._records: deque[tuple] = deque(maxlen=last)
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:  # noqa: N802  names of the interface
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        held = sum(s.numRowsTotal for s in p.stateOperators)
        self._put((str(p.id), p.batchId, p.numInputRows, float(p.processedRowsPerSecond or 0), p.batchDuration, held, "late" if p.batchDuration > self.slow_ms else "ok"))

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if event.exception:
            self._put((str(event.id), None, None, None, None, None, "failed"))

    def _put(self, record: tuple) -> None:
        with self._lock:
            self._records.append(record)

    def records(self) -> list[tuple]:
        with self._lock:
            return list(self._records)

    def rows(self, spark: SparkSession) -> DataFrame:
        """stream, batch, rows, rows_per_second, millis, state_rows, status of the batches kept."""
        return spark.createDataFrame(self.records(), HEALTH)


def wait_for(listener: StreamHealth, query: StreamingQuery, seconds: float = 30.0) -> None:
    """Wait until the listener, which is told a little later, has the last batch of a query that has ended."""
    last, until = query.lastProgress, time.monotonic() + seconds
    while last is not None and not any(r[0] == query.id and r[1] == last.batchId for r in listener.records()):
        if time.monotonic() > until:
            raise TimeoutError(f"no progress of {query.id} was heard")
        time.sleep(0.05)


def health(rows: DataFrame) -> DataFrame:
    """(stream, batches, rows, status): ``failed`` if it failed, else ``degraded`` if its last batch was late, else ``ok``."""
    last = F.max_by("status", F.coalesce("batch", F.lit(-1)))
    grouped = rows.groupBy("stream").agg(F.count("batch").alias("batches"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.bool_or(F.col("status") == "failed").alias("bad"), last.alias("last"))
    return grouped.select("stream", "batches", "rows", F.when(F.col("bad"), "failed").when(F.col("last") == "late", "degraded").otherwise("ok").alias("status"))
