"""Written searches, sources that ask to wait, plans in order, schemas that go up and down."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from millrace.operators import chunking, fulltext, sync
from millrace.operators import routing as N
from millrace.plans import registry
from millrace.sources import connectors, schemas

SF = "/root/testdata/sf0.001"


def test_written_queries(spark):
    asked = spark.createDataFrame([(1, 'red "old mill" -"the old"'), (2, "a or b -c"), (3, '  "" - or'), (4, None), (5, "don't")], "query_id int, query string")
    got = {(r["query_id"], r["alternative"]): (r["must"], r["must_not"]) for r in fulltext.alternatives(asked).collect()}
    assert got == {(1, 0): (["old mill", "red"], ["the old"]), (2, 0): (["a"], []), (2, 1): (["b"], ["c"]), (5, 0): (["don't"], [])}
    docs = spark.createDataFrame([(1, "Red", "old mill by the sea"), (2, "red", "the old mill"), (3, None, None), (4, "B", "b c"), (5, "", "A b")], "doc_id int, title string, body string")
    found = {(r["query_id"], r["doc_id"]): r["score"] for r in fulltext.search(asked, docs).collect()}
    assert found == {(1, 1): 0.7, (2, 5): 0.4}


def test_patience():
    waits, times = [], iter([0.0, 1.0, 5.0, 5.0])

    def failing(errors):
        left = list(errors)

        def call():
            if left:
                raise left.pop(0)
            return "done"

        return call

    assert connectors.patiently(failing([connectors.Busy(429, 90.0), connectors.Busy(503)]), 3, waits.append) == "done" and waits == [60.0, 2.0]
    with pytest.raises(ConnectionError):
        connectors.patiently(failing([ConnectionError()] * 9), 4, waits.append)
    assert waits[2:] == [1.0, 2.0, 4.0]
    waits.clear()
    call = connectors.spaced(lambda x: x, 3.0, lambda: next(times), waits.append)
    assert [call(1), call(2)] == [1, 2] and waits == [2.0]


def test_continuation():
    parts = {None: ([1, 2], "a"), "a": ([], "b"), "b": ([3], None)}
    assert list(connectors.continued(parts.__getitem__)) == [1, 2, 3]
    with pytest.raises(ValueError, match="parts"):
        list(connectors.continued(lambda t: ([0], "again"), 5))


def test_answers(spark):
    df = spark.createDataFrame([(1, "a"), (2, " "), (3, None), (None, "b")], "id long, prompt string")
    got = {r["id"]: r["answer"] for r in connectors.answered(df, "id", "prompt", lambda ps: [p.upper() for p in ps]).collect()}
    assert got == {1: "A", 2: None, 3: None, None: "B"}
    assert {r["answer"] for r in connectors.answered(df, "id", "prompt").collect()} == {None}


def test_sync_edges(spark):
    fetched = spark.createDataFrame([(1, "a", "{}", None), (1, "b", None, None), (1, "c", "{}", "timeout"), (2, "a", None, "x")], "char_id long, scope string, payload string, error string")
    out = sync.scope_outcomes(fetched)
    assert {(r["char_id"], r["scope"]): r["reason"] for r in out.collect()} == {(1, "a"): None, (1, "b"): "no data", (1, "c"): "timeout", (2, "a"): "x"}
    assert {r["char_id"]: (r["synced"], r["failed"], r["status"]) for r in sync.character_reports(out).collect()} == {1: (["a"], ["b", "c"], "partial"), 2: ([], ["a"], "failed")}
    payload = lambda rows: spark.createDataFrame(rows, "account_id long, payload string")
    accounts = spark.createDataFrame([(1,), (2,), (3,)], "account_id long")
    got = sync.account_collections(accounts, payload([(1, '{"mounts": [{"id": 5}, {"id": 3}, {}]}'), (2, "junk")]), payload([(1, '{"pets": null}')]))
    assert {r["account_id"]: (r["mounts"], r["pets"]) for r in got.collect()} == {1: ([3, 5], []), 2: ([], []), 3: ([], [])}


def test_skipped_without_a_place(spark):
    quests = spark.createDataFrame([(1, [], 5), (2, [1, 9], 5), (3, [], None)], "quest_id long, prerequisites array<long>, map_id int")
    chosen = spark.createDataFrame([(7, 2), (7, 3), (8, 1), (8, 2)], "char_id long, quest_id long")
    done = spark.createDataFrame([(8, 9)], "char_id long, quest_id long")
    assert {(r["char_id"], r["quest_id"]): r["reason"] for r in N.skipped(chosen, done, quests).collect()} == {(7, 2): "requires 1, 9", (7, 3): "no known place"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
def test_quest_order(spark):
    from millrace.sources.tables import completed, in_progress, quests

    rows = registry.QUERIES["n13_quest_order"](spark, SF).orderBy("char_id", "step").collect()
    left_out = {(r["char_id"], r["quest_id"]) for r in registry.QUERIES["n13_skipped_quests"](spark, SF).collect()}
    want = {(r["char_id"], r["quest_id"]) for r in in_progress(spark, SF).collect()} - left_out
    assert {(r["char_id"], r["quest_id"]) for r in rows} == want and len(rows) == len(want)
    before = {r["quest_id"]: r["prerequisites"] for r in quests(spark, SF).collect()}
    done = {(r["char_id"], r["quest_id"]) for r in completed(spark, SF).collect()}
    place = {(r["char_id"], r["quest_id"]): (r["leg"], r["step"]) for r in rows}
    for (char, quest), (leg, step) in place.items():
        for pre in before[quest]:
            if (char, pre) in place and place[char, pre][0] == leg:
                assert place[char, pre][1] < step
            assert (char, pre) in place or (char, pre) in done or (char, pre) in left_out
    legs = {}
    for r in rows:
        legs.setdefault((r["char_id"], r["map_id"]), set()).add(r["leg"])
    assert all(len(x) == 1 for x in legs.values())


def test_split_texts(spark):
    df = spark.createDataFrame([(1, "One. Two two. " + "x" * 30), (2, None), (3, "  ")], "k long, body string")
    got = [(r["k"], r["pos"], r["piece"]) for r in chunking.split_texts(df, "k", "body", 12).orderBy("k", "pos").collect()]
    assert all(len(p) <= 12 for _, _, p in got) and "".join(p for _, _, p in got).replace(" ", "") == "One.Twotwo." + "x" * 30 and {k for k, _, _ in got} == {1}


def test_schema_steps(spark):
    df = spark.createDataFrame([(1, "a")], "k long, old string")
    steps = [schemas.renamed(1, "old", "new"), schemas.added(2, "n", "int", "7")]
    up = schemas.migrated(df, steps, 0, 2)
    assert up.columns == ["k", "new", "n"] and up.first()["n"] == 7
    assert schemas.migrated(up, steps, 2, 0).columns == ["k", "old"]
    with pytest.raises(ValueError, match="gaps"):
        schemas.migrated(df, steps[1:], 0, 1)
    assert schemas.fits(df, schemas.RUNS) == schemas.RUNS.names and schemas.fits(df.select(F.lit("x").alias("run_id")), schemas.RUNS)[0] == "source"
