"""Measures taken in passing equal counts, start no job, and tell streams that fail or are slow from others."""

from __future__ import annotations

import json

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from millrace.operators import measures
from millrace.operators.checkpoints import settled


def jobs(spark, tag, work):
    spark.sparkContext.setJobGroup(tag, tag)
    try:
        work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(tag))


def test_observed(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 4 == 0, "touch").when(F.col("id") % 7 == 0, None).otherwise("insert").alias("action")).repartition(5)
    got = {}

    def plain():
        settled(rows)

    def counting():
        df, seen = measures.observed(rows, **measures.action_counters())
        settled(df)
        got.update(seen.get)

    assert jobs(spark, "plain", plain) == jobs(spark, "counting", counting)
    assert got == {"seen": 1000, "written": 750, "skipped": 250}
    df, seen = measures.observed(rows.where("false"), **measures.action_counters())
    settled(df)
    assert seen.get == {"seen": 0, "written": 0, "skipped": 0}
    assert [measures.run_status({"written": w}, e) for w, e in ((0, 0), (1, 2), (0, 2))] == ["completed", "partial", "failed"]


def test_stream_health(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps({"k": k * 10 + i}) for i in range(10)))
    fast, slow = measures.StreamHealth(), measures.StreamHealth(slow_ms=-1, last=2)
    for listener in (fast, slow):
        spark.streams.addListener(listener)
    try:

        def run(name, work):
            stream = spark.readStream.schema("k int").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
            return work(stream).writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()

        good = run("good", lambda s: s)
        good.awaitTermination()
        for listener in (fast, slow):
            measures.wait_for(listener, good)
        bad = run("bad", lambda s: s.select(F.raise_error(F.lit("no")).cast("int").alias("k")))
        with pytest.raises(StreamingQueryException):
            bad.awaitTermination()
        for _ in range(200):
            if any(r[-1] == "failed" for r in fast.records()):
                break
            measures.time.sleep(0.05)
    finally:
        for listener in (fast, slow):
            spark.streams.removeListener(listener)
    got = {r["stream"]: r for r in measures.health(fast.rows(spark)).collect()}
    assert (got[good.id]["batches"], got[good.id]["rows"], got[good.id]["status"]) == (3, 30, "ok") and got[bad.id]["status"] == "failed"
    assert len(slow.records()) <= 2 and any(r[0] == good.id and r[-1] == "late" for r in slow.records())
    assert {r["status"] for r in measures.health(slow.rows(spark).where(F.col("stream") == good.id)).collect()} == {"degraded"}
    assert measures.health(fast.rows(spark).where("false")).count() == 0
