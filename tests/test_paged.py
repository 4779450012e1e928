"""The paged source in batch and as a stream, and the outbox: retries, pace, pushed filters, restarts."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from millrace.sources import paged
from millrace.streaming import outbox


@pytest.fixture
def site(spark, tmp_path):
    docs = spark.range(95).select("id", F.concat(F.lit("title "), "id").alias("title"), F.repeat(F.lit("x"), F.col("id").cast("int")).alias("body"))
    return docs, paged.publish(docs, str(tmp_path / "site"), 20)


def asked(site: str) -> list[str]:
    return sorted(os.listdir(f"{site}/asked"))


def test_same_rows_though_the_site_is_busy(spark, site):
    docs, where = site
    got = paged.paged(spark, where, ask="tests.flaky:ask")
    assert got.rdd.getNumPartitions() == 5
    assert sorted((int(r["source_id"]), r["title"], r["body"]) for r in got.collect()) == sorted(map(tuple, docs.collect()))


def test_windows_that_are_not_wanted_are_not_asked_for(spark, site):
    _, where = site
    got = paged.paged(spark, where, ask="tests.flaky:ask").where("window in (1, 3) and window < 3 and body is not null")
    assert sorted(int(r["source_id"]) for r in got.collect()) == list(range(20, 40))
    assert {n.split("-")[0] for n in asked(where)} == {"None", "1"}


def test_the_pace_is_shared(spark, site):
    _, where = site
    open(os.path.join(os.makedirs(f"{where}/asked") or f"{where}/asked", "None-x"), "w").close()
    assert paged.paged(spark, where, ask="tests.flaky:ask", interval="0.05", parallel="4").where("window < 4").count() == 80
    times: dict = {}
    for n in asked(where):
        window, token, at, *_ = [*n.split("-"), ""]
        if window != "None" and token != "None":
            times.setdefault(window, []).append(float(at))
    assert all(b - a >= 0.19 for some in times.values() for a, b in zip(sorted(some), sorted(some)[1:]))


def test_a_site_that_stays_busy_is_an_error(spark, site):
    _, where = site
    with pytest.raises(Exception, match="429"):
        paged.paged(spark, where, ask="tests.flaky:ask", tries="1").collect()


def test_stream_of_windows(spark, site, tmp_path):
    docs, where = site
    spark.dataSource.register(paged.PagedSource)

    def run(more: int) -> None:
        stream = spark.readStream.format("paged").options(site=where).load()
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        assert spark.read.schema(paged.SCHEMA).parquet(str(tmp_path / "out")).count() == more

    run(95)
    run(95)


def frames(spark, folder, rows):
    spark.createDataFrame(rows, outbox.FRAME).coalesce(1).write.mode("append").json(folder)
    return spark.readStream.schema(outbox.FRAME).option("maxFilesPerTrigger", 1).json(folder)


def test_each_frame_once_over_restarts(spark, tmp_path):
    folder, path, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    first = [(u, s, f"{u}.{s}") for u in range(5) for s in range(4)]
    outbox.deliver(frames(spark, folder, [*first, first[3]]), path, checkpoint).awaitTermination()
    second = [(u, s, f"{u}.{s}") for u in range(5) for s in range(4, 6)]
    outbox.deliver(frames(spark, folder, second), path, checkpoint).awaitTermination()
    got = outbox.delivered(spark, path).collect()
    assert sorted((r["user_id"], r["seq"], r["payload"]) for r in got) == sorted(first + second) and {r["batch"] for r in got} == {0, 1}
    # the last batch was delivered, but Spark did not come to note it: it runs again
    os.remove(f"{checkpoint}/commits/1")
    (os.path.exists(crc := f"{checkpoint}/commits/.1.crc")) and os.remove(crc)
    outbox.deliver(spark.readStream.schema(outbox.FRAME).option("maxFilesPerTrigger", 1).json(folder), path, checkpoint).awaitTermination()
    assert outbox.delivered(spark, path).count() == len(got)


def test_an_aborted_batch_leaves_nothing(tmp_path):
    from pyspark.sql import Row

    w = outbox.OutboxWriter(str(tmp_path))
    message = w.write(iter([Row(user_id=1, seq=1, payload="a")]))
    w.abort([message, None], 3)
    assert os.listdir(tmp_path / "frames") == [] and not os.path.exists(tmp_path / "commits")
