"""Delta tables against a dictionary, replays, folding, what a commit writes, and ingestion on them."""

from __future__ import annotations

import json
import os
import random

import pytest

from millrace.operators.deltas import DeltaTable
from millrace.streaming import ingest

SCHEMA = "k string, v int, seen long"


def size(folder) -> int:
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


@pytest.fixture
def table(spark, tmp_path):
    return DeltaTable(spark, str(tmp_path / "t"), SCHEMA, "k", touched="seen", buckets=4, most_deltas=3)


def rows_of(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()))


def test_same_as_writing_all_anew(spark, table):
    r, model, kinds = random.Random(1), {}, set()
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    for n in range(9):
        keys = r.sample(range(30), r.choice([2, 12]))
        puts = {f"k{k}": [(f"k{k}", r.randrange(9), n) for _ in range(r.randint(1, 3))] for k in keys[::2]}
        gone, seen = {f"k{k}" for k in keys[1:3]} | {next(iter(puts))}, [f"k{k}" for k in range(30) if r.random() < 0.2 and f"k{k}" in model]
        table.commit("w", n, frame([x for rows in puts.values() for x in rows], SCHEMA), frame([(k,) for k in gone], "k string"), frame([(k, n) for k in seen], "k string, seen long"))
        for k in seen:
            model[k] = [(a, b, n) for a, b, _ in model[k]]
        model |= puts
        for k in gone - puts.keys():
            model.pop(k, None)
        wanted = sorted(x for rows in model.values() for x in rows)
        assert rows_of(table.read()) == wanted
        some = frame([("k3",), ("k7",), ("none",)], "k string")
        assert rows_of(table.read(only=some)) == [x for x in wanted if x[0] in ("k3", "k7")]
        kinds |= {x["kind"] for x in table.folders()}
        assert sum(x["kind"] in ("delta", "touch") for x in table.folders()) <= 4
    assert kinds == {"base", "delta", "touch", "writer"}
    before = rows_of(table.read())
    table.compact(whole=True)
    assert rows_of(table.read()) == before and {x["kind"] for x in table.folders()} == {"base", "writer"}


def test_replays_other_writers_and_old_versions(spark, table):
    put = lambda k, v: spark.createDataFrame([(k, v, 0)], SCHEMA)
    assert table.version() == -1 and table.read().count() == 0
    assert table.commit("a", 0, put("x", 1), note={"n": 1}) == {"n": 1}
    assert table.commit("a", 0, put("x", 2), note={"n": 2}) == {"n": 1} and rows_of(table.read()) == [("x", 1, 0)] and table.version() == 0
    table.commit("b", 0, put("y", 5))
    assert rows_of(table.read()) == [("x", 1, 0), ("y", 5, 0)] and rows_of(table.read(0)) == [("x", 1, 0)]
    os.makedirs(f"{table.root}/log/v={2:012d}")  # begun and broken off
    assert table.version() == 1


def test_a_commit_that_breaks_off_is_not_seen(spark, table, monkeypatch):
    table.commit("a", 0, spark.createDataFrame([("x", 1, 0)], SCHEMA))
    with monkeypatch.context() as m:
        m.setattr(table, "_log", lambda rows: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.commit("a", 1, spark.createDataFrame([("x", 2, 0), ("y", 2, 0)], SCHEMA))
    assert rows_of(table.read()) == [("x", 1, 0)]
    table.commit("a", 1, spark.createDataFrame([("x", 2, 0)], SCHEMA))
    assert rows_of(table.read()) == [("x", 2, 0)]


def test_a_commit_writes_what_it_changes(spark, tmp_path):
    table = DeltaTable(spark, str(tmp_path / "t"), "k string, text string", "k", buckets=4)
    long = "select concat('k', id) as k, concat_ws(' ', transform(sequence(1, 60), x -> sha2(concat(id, ':', x), 256))) as text from range(800)"
    table.commit("w", 0, spark.sql(long))
    before = size(tmp_path)
    table.commit("w", 1, spark.sql(f"{long} where id < 4"))
    assert 0 < size(tmp_path) - before < before / 20


def test_a_new_checkpoint_over_an_old_store(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    keys = ("source", "source_id", "entity_type", "title", "body", "game_version")
    docs = [("wiki", str(k), "npc", f"Title {k}", f"Body {k}", "retail") for k in range(6)]
    bad = [("wiki", None, "npc", "No id", "x", "retail"), ("wiki", "9", "npc", " ", "x", "retail")]
    (source / "a.json").write_text("\n".join(json.dumps(dict(zip(keys, d, strict=True))) for d in docs + bad))
    store, said = ingest.Store(spark, str(tmp_path / "store")), []
    for checkpoint in ("one", "two"):
        ingest.ingest_files(spark, str(source), store, str(tmp_path / checkpoint), done=lambda k, c: said.append((k, c))).awaitTermination()
    assert said == [(0, {"seen": 6, "written": 6, "skipped": 0}), (0, {"seen": 6, "written": 0, "skipped": 6})]
    assert store.read("documents").count() == 6 and store.read("chunks").count() == 6
    assert sorted((r["message"], r["source_id"]) for r in store.read("errors", 0).collect()) == [("no key", None), ("no title", "9")]
    batch = spark.read.schema(ingest.DOCUMENT).json(str(source))
    first = ingest.ingest_batch(store, batch, 7, writer="again")
    assert ingest.ingest_batch(store, batch.where("source_id = '1'"), 7, writer="again") == first and store.documents.version() == 2
