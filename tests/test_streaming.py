"""Incremental ingestion and stateful streams: a second run writes nothing, and streams equal the batch result."""

from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F

from millrace.streaming import ingest


def put(folder, name, docs):
    keys = ("source", "source_id", "entity_type", "title", "body", "game_version")
    (folder / name).write_text("\n".join(json.dumps(dict(zip(keys, d, strict=True))) for d in docs))


def test_ingest(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    one = ("wiki", "1", "npc", "One", "Body. " * 400, "retail")
    two = ("wiki", "2", "npc", "Two", "short", "retail")
    put(source, "a.json", [one, two, ("wiki", "3", "npc", "  ", "no title", "retail")])
    store, seen = ingest.Store(spark, str(tmp_path / "store")), {}

    def run():
        ingest.ingest_files(spark, str(source), store, str(tmp_path / "cp"), done=seen.__setitem__).awaitTermination()

    run()
    assert seen == {0: {"seen": 2, "written": 2, "skipped": 0}}
    put(source, "b.json", [one, (*two[:4], "changed", "retail")])
    run()
    assert seen[1] == {"seen": 2, "written": 1, "skipped": 1}
    run()
    assert len(seen) == 2
    docs = {r["document_key"]: (r["body"], r["batch"]) for r in store.read("documents", 1, ingest.STORED).collect()}
    assert set(docs) == {"wiki:retail:1", "wiki:retail:2"} and docs["wiki:retail:2"] == ("changed", 1) and docs["wiki:retail:1"][1] == 1
    chunks = store.read("chunks", 1, ingest.CHUNKS)
    assert chunks.where("document_key = 'wiki:retail:2'").first()["text"] == "Two (npc)\nchanged"
    assert chunks.where("document_key = 'wiki:retail:1'").count() == store.read("chunks", 0, ingest.CHUNKS).where("document_key = 'wiki:retail:1'").count() > 1


@pytest.fixture
def events(spark, tmp_path):
    rows = [(k, k % 3, f"2024-01-01 00:{k % 60:02d}:00") for k in range(90)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.repartition(3).write.parquet(str(tmp_path / "events"))
    return df, spark.readStream.schema(df.schema).parquet(str(tmp_path / "events"))


def drained(spark, stream, tmp_path, mode):
    q = stream.writeStream.format("memory").queryName("drained").outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table("drained")


def test_rate_counts(spark, events, tmp_path):
    batch, stream = events
    got = {(r["user_id"], r["start"]): (r["n"], r["rejected"]) for r in drained(spark, ingest.rate_counts(stream, 600, 4), tmp_path, "complete").collect()}
    want = {(r["user_id"], r["start"]): (r["n"], r["rejected"]) for r in ingest.rate_counts(batch, 600, 4).collect()}
    assert got == want and any(r for _, r in got.values())


def test_fan_out(spark, events, tmp_path):
    batch, stream = events
    subscriptions = spark.createDataFrame([(0, "a"), (0, "b"), (2, "c")], "user_id long, subscriber string")
    assert drained(spark, ingest.fanned_out(stream, subscriptions), tmp_path, "append").count() == 30 * 2 + 30 == ingest.fanned_out(batch, subscriptions).count()


def test_numbered(spark, events, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = drained(spark, ingest.numbered(events[1]), tmp_path, "append").collect()
    for user in range(3):
        assert sorted(r["seq"] for r in rows if r["user_id"] == user) == list(range(1, 31))


def test_once_within(spark, events, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = ingest.once_within(events[1], 3_600_000)  # timers keep such a query going, so it is stopped from here
    q = stream.writeStream.format("memory").queryName("once").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for _ in range(60):
            time.sleep(1)
            if q.exception() or spark.table("once").count() >= 3:
                break
    finally:
        q.stop()
    assert sorted(r["user_id"] for r in spark.table("once").collect()) == [0, 1, 2]
