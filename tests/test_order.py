"""Frames that arrive late and shuffled: in order across batches and restarts, late ones dropped, against a simulation."""

from __future__ import annotations

import random
from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from millrace.streaming import order

START = datetime(2024, 1, 1, tzinfo=UTC)


def streamed(spark, tmp_path, batches, schema, work):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    with order.keyed_state(spark):
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(2).write.mode("append").parquet(source)
            given = work(spark.readStream.schema(schema).parquet(source))
            given.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(given.schema).parquet(out)


def simulated(batches, late):
    """{user: ids in order}: what waits is given out as the watermark of each batch passes it."""
    newest, passed, waiting, given = None, None, {}, {}
    for rows in batches:
        for user, event, ts, _ in rows:
            if user is None or event is None or ts is None or (passed is not None and ts <= passed):
                continue
            waiting[user, ts, event] = True
        newest = max([ts for u, e, ts, _ in rows if None not in (u, e, ts)] + ([newest] if newest else []))
        passed = newest - late
        for key in sorted(k for k in waiting if k[1] <= passed):
            del waiting[key]
            given.setdefault(key[0], []).append(key[2])
    return given


def test_in_order(spark, tmp_path):
    r = random.Random(3)
    at = lambda s: START + timedelta(milliseconds=s)
    rows = [(None if k == 9 else 1 if r.random() < 0.5 else k % 5, k, None if k == 17 else at(k * 1000 + r.randrange(3)), f"p{k}") for k in range(200)]
    rows.sort(key=lambda x: (x[2] or START) + timedelta(seconds=r.randrange(15)))
    batches = [rows[:60], rows[60:61], rows[61:130], rows[130:]]
    batches[3] = [*batches[3], (1, 1000, at(5000), "far too late"), (77, 1001, at(1), "a new user's, too late"), *rows[100:103], (2, 1002, at(190_000), "tie"), (2, 1003, at(190_000), "tie")]
    got = streamed(spark, tmp_path, batches, order.FRAME, lambda s: order.in_order(s, "20 seconds")).orderBy("user_id", "seq").collect()
    by_user = {}
    for x in got:
        by_user.setdefault(x["user_id"], []).append(x)
    want = simulated(batches, timedelta(seconds=20))
    assert {u: [x["event_id"] for x in xs] for u, xs in by_user.items()} == want and len(want) == 5
    assert all([x["seq"] for x in xs] == list(range(1, len(xs) + 1)) for xs in by_user.values())
    known = {e: (ts, p) for _, e, ts, p in rows if ts}
    assert all((x["ts"].replace(tzinfo=UTC), x["payload"]) == known[x["event_id"]] for x in got)
    assert not {1000, 1001, 1002, 9, 17} & {x["event_id"] for x in got} and sum(len(x) for x in want.values()) > 150


def test_newest_only(spark, tmp_path):
    batches = [[(1, "a", 5), (1, "a", 3), (1, None, 2), (2, "a", 1)], [(1, "a", 4), (1, "a", 9), (1, None, 2), (None, "a", 7)], [(1, "a", 8), (1, None, 3), (2, "a", None), (2, "a", -1)], [(1, "a", 10), (3, "z", -5)]]
    got = streamed(spark, tmp_path, batches, "user_id long, kind string, event_id long", order.newest_only)
    assert sorted(map(str, got.collect())) == sorted(
        f"Row(user_id={u}, kind={k!r}, event_id={e})"
        for u, k, e in [(1, "a", 5), (1, "a", 3), (1, None, 2), (2, "a", 1), (1, "a", 9), (None, "a", 7), (1, None, 3), (1, "a", 10), (3, "z", -5)]
    )
    assert got.groupBy("user_id", "kind").agg(F.max("event_id").alias("top")).where("user_id = 1 and kind = 'a'").first()["top"] == 10
