"""As-of joins against a search in plain Python, with a key that holds most rows."""

from __future__ import annotations

import random

from millrace.operators import sync
from millrace.operators.asof import last_before


def test_same_as_a_search(spark):
    r = random.Random(4)
    key = lambda: r.choice(["hot"] * 8 + ["a", "b", "c", None])
    rows = [(i, key(), r.choice([None, *range(40)])) for i in range(700)]
    values = [(key(), r.choice([None, *range(40)]), r.randrange(5)) for _ in range(60)]
    conf, before = "spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(conf, "9")
    try:
        got = last_before(spark.createDataFrame(rows, "id int, key string, ts int"), spark.createDataFrame(values, "key string, ts int, v int"), "key", "ts")
        found = {x["id"]: None if x["last"] is None else (x["last"]["ts"], x["last"]["v"]) for x in got.collect()}
    finally:
        spark.conf.set(conf, before)
    wanted = {i: max(((t, v) for k2, t, v in values if k2 == k and t is not None and t <= ts), default=None) if k is not None and ts is not None else None for i, k, ts in rows}
    assert found == wanted and len(found) == 700 and sum(x is not None for x in found.values()) > 300


def test_answers_between_requests(spark):
    asked = spark.createDataFrame([(1, "a", 20.0, False), (2, "a", 99.0, False), (3, "a", 105.0, False), (4, "a", 105.0, True), (5, "b", 1.0, False), (6, "a", 130.0, False)], "id int, key string, ts double, user_scoped boolean")
    answers = spark.createDataFrame([("a", 10.0, True), ("a", 100.0, False)], "key string, ts double, found boolean")
    got = {r["id"]: r["hit"] for r in sync.cached_answers(asked, answers, 30, 10).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: False, 6: False}


def test_no_rows_and_no_values(spark):
    rows, values = spark.createDataFrame([(1, "a", 1)], "id int, key string, ts int"), spark.createDataFrame([("a", 1, 1)], "key string, ts int, v int")
    assert last_before(rows.where("false"), values, "key", "ts").count() == 0
    assert [r["last"] for r in last_before(rows, values.where("false"), "key", "ts").collect()] == [None]
