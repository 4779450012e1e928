"""Queries over frames that arrive out of order, in several micro-batches, and over what runs measure in passing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import measures
from millrace.operators import relational as R
from millrace.operators.checkpoints import new_folder
from millrace.plans.catalog import query
from millrace.plans.relational import ACTIONS_SQL, coming, stored
from millrace.sources.tables import table
from millrace.streaming import order

BATCHES = 4
LATE_SECONDS = 86_400


def arrivals(spark, sf: str) -> DataFrame:
    """events as frames, each up to a day late, dealt to batches by when they arrive."""
    events = table(spark, sf, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("payload"))
    arrives = F.unix_micros("ts") + F.col("event_id") * 7919 % LATE_SECONDS * 1_000_000
    lo, hi = events.agg(F.coalesce(F.min(arrives), F.lit(0)), F.coalesce(F.max(arrives), F.lit(0))).first()
    return events.withColumn("batch", F.floor((arrives - lo) * BATCHES / (hi - lo + 1)))


def streamed(spark, sf: str, schema: str, frames: DataFrame, work) -> DataFrame:
    """What ``work`` makes of frames that come in batches; the stream ends after each and goes on from its checkpoint."""
    source, out, checkpoint = (new_folder(spark, n) for n in ("frames", "given", "stream"))
    with order.keyed_state(spark):
        for batch in range(BATCHES):
            frames.where(F.col("batch") == batch).drop("batch").write.mode("append").parquet(source)
            given = work(spark.readStream.schema(schema).parquet(source))
            given.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(given.schema).parquet(out)


@query("w13_ordered_stream", f"""SELECT user_id, event_id, payload, seq FROM (
  SELECT user_id, event_id, event_type AS payload, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)
WHERE epoch_us(ts) <= (SELECT epoch_ms(max(ts)) - {LATE_SECONDS * 1000} FROM events) * 1000""")
def ordered(spark, sf):
    """All frames but those of the last day, for which newer ones would have to come."""
    return streamed(spark, sf, order.FRAME, arrivals(spark, sf), lambda s: order.in_order(s, f"{LATE_SECONDS} seconds")).drop("ts")


@query("m15_newest_stream", f"""WITH span AS (SELECT min(epoch_us(ts) + event_id * 7919 % {LATE_SECONDS} * 1000000) AS lo, max(epoch_us(ts) + event_id * 7919 % {LATE_SECONDS} * 1000000) AS hi FROM events),
dealt AS (SELECT user_id, event_type AS kind, event_id, floor((epoch_us(ts) + event_id * 7919 % {LATE_SECONDS} * 1000000 - lo) * {BATCHES} / (hi - lo + 1)) AS batch FROM events, span)
SELECT user_id, kind, event_id FROM (SELECT *, max(event_id) OVER (PARTITION BY user_id, kind ORDER BY batch RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM dealt) WHERE top IS NULL OR event_id > top""")
def newest(spark, sf):
    frames = arrivals(spark, sf).select("user_id", F.col("payload").alias("kind"), "event_id", "batch")
    return streamed(spark, sf, "user_id long, kind string, event_id long", frames, order.newest_only)


@query("a16_observed_counters", f"WITH {ACTIONS_SQL} SELECT count(*) AS seen, count(*) FILTER (action <> 'touch') AS written, count(*) FILTER (action = 'touch') AS skipped, 'completed' AS status FROM actions")
def observed_counters(spark, sf):
    """The counters of a run, taken while its actions are written."""
    actions, passed = measures.observed(R.upsert_actions(stored(spark, sf), coming(spark, sf), "k", ["h"]), **measures.action_counters())
    actions.write.parquet(new_folder(spark, "actions"))
    counters = passed.get
    return spark.createDataFrame([(*[counters[c] for c in ("seen", "written", "skipped")], measures.run_status(counters))], "seen long, written long, skipped long, status string")


@query("u05_stream_health", "SELECT count(*) AS rows, 'ok' AS status FROM events")
def stream_health(spark, sf):
    """The health of a stream over events, as its listener has it."""
    listener = measures.StreamHealth(slow_ms=3_600_000)
    spark.streams.addListener(listener)
    try:
        source, out, checkpoint = (new_folder(spark, n) for n in ("frames", "given", "stream"))
        table(spark, sf, "events").select("event_id").write.parquet(source)
        copied = spark.readStream.schema("event_id long").parquet(source).writeStream.format("parquet").option("path", out)
        started = copied.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        started.awaitTermination()
        measures.wait_for(listener, started)
    finally:
        spark.streams.removeListener(listener)
    return measures.health(listener.rows(spark).where(F.col("stream") == started.id)).select("rows", "status")
