"""Frames in order across micro-batches: they wait in state until the watermark has passed them.

Order holds within a key, so a key's frames are one task's work in a micro-batch; the frames themselves wait
in the state store (RocksDB), and what a task holds is what one batch lets go."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

FRAME = "user_id long, event_id long, ts timestamp, payload string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which these processors need."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def _millis(micros: int) -> int:
    """The first millisecond at which a watermark has passed the instant."""
    return -(-micros // 1000)


class InOrder(StatefulProcessor):
    """Holds frames as (time, id) -> payload and numbers them as the watermark passes."""

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "at long, event_id long", "payload string")
        self.last = handle.getValueState("last", "seq long, at long, event_id long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803  names of the interface
        last = tuple(self.last.get()) if self.last.exists() else None
        first = None
        for part in rows:
            for at, event, payload in zip(part["at"].tolist(), part["event_id"].tolist(), part["payload"].tolist(), strict=True):
                if last is None or (at, event) > (last[1], last[2]):
                    self.pending.updateValue((at, event), (payload,))
                    first = at if first is None else min(first, at)
        if first is not None and all(t > _millis(first) for t in self.handle.listTimers()):
            self.handle.registerTimer(_millis(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        import pandas as pd

        passed, ready, ahead = timerValues.getCurrentWatermarkInMs(), [], None
        for (at, event), (payload,) in self.pending.iterator():
            if _millis(at) <= passed:
                ready.append((at, event, payload))
            else:
                ahead = at if ahead is None else min(ahead, at)
        if ahead is not None:
            self.handle.registerTimer(_millis(ahead))
        if ready:
            ready.sort(key=lambda r: r[:2])
            seq = self.last.get()[0] if self.last.exists() else 0
            for at, event, _ in ready:
                self.pending.removeKey((at, event))
            self.last.update((seq + len(ready), *ready[-1][:2]))
            out = pd.DataFrame(ready, columns=["at", "event_id", "payload"])
            yield out.assign(user_id=key[0], seq=range(seq + 1, seq + 1 + len(ready)))[["user_id", "event_id", "at", "payload", "seq"]]

    def close(self) -> None:
        pass


def in_order(frames: DataFrame, late: str) -> DataFrame:
    """(user_id, event_id, ts, payload, seq): each user's frames of a stream by time and id, numbered from 1
    without gaps however they arrive.

    A frame is given out once the watermark, the newest time seen less ``late``, has reached its time; what the
    stream's last ``late`` holds waits for newer frames.  A frame that comes after the watermark of the batch
    before has passed it is dropped, and so is one at or before the last that its user was given.  Of frames with
    one user, time and id one is given out.  Frames without a user, id or time are dropped."""
    known = frames.where("user_id is not null and event_id is not null and ts is not null").withWatermark("ts", late)
    held = known.select("user_id", "event_id", "ts", F.unix_micros("ts").alias("at"), "payload")
    given = held.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=InOrder(), outputStructType="user_id long, event_id long, at long, payload string, seq long", outputMode="Append", timeMode="EventTime"
    )
    return given.select("user_id", "event_id", F.timestamp_micros("at").alias("ts"), "payload", "seq")


class NewestOnly(StatefulProcessor):
    """Remembers the highest number of its key."""

    def init(self, handle) -> None:
        self.top = handle.getValueState("top", "event_id long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        top = self.top.get()[0] if self.top.exists() else None
        best = top
        for part in rows:
            new = part if top is None else part[part["event_id"] > top]
            if len(new):
                best = max(int(new["event_id"].max()), best if best is not None else int(new["event_id"].iloc[0]))
                yield new[["user_id", "kind", "event_id"]]
        if best is not None and best != top:
            self.top.update((best,))

    def close(self) -> None:
        pass


def newest_only(frames: DataFrame) -> DataFrame:
    """(user_id, kind, event_id) of a stream without the frames that an earlier micro-batch had overtaken: those
    at or below the highest event_id of their user and kind.  Frames of one batch are not judged by each other,
    as they have no order among them.  Frames without an id are dropped."""
    numbered = frames.where("event_id is not null").select("user_id", "kind", "event_id")
    return numbered.groupBy("user_id", "kind").transformWithStateInPandas(statefulProcessor=NewestOnly(), outputStructType="user_id long, kind string, event_id long", outputMode="Append", timeMode="None")
