"""The vector store: recall of codes and cells against all pairs, upserts that move vectors, filters, and what is read."""

from __future__ import annotations

import os

import numpy as np
import pytest

from millrace.operators.vectors import Codes, VectorStore
from millrace.plans import stores

SF = "/root/testdata/sf0.01"


def exact(vectors: dict, queries: dict, k: int) -> dict:
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i, q in queries.items():
        s = np.maximum(0, np.round(x @ (np.array(q) / np.linalg.norm(q)), 6))
        out[i] = [ids[j] for j in np.lexsort((ids, -s))[:k]]
    return out


def found(df) -> dict:
    out: dict = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


def recall(got: dict, wanted: dict) -> float:
    return float(np.mean([len(set(got.get(i, [])) & set(w)) / len(w) for i, w in wanted.items()]))


@pytest.fixture(scope="module")
def clustered():
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 30))
    return {i: (centres[r.integers(40)] + 0.35 * r.normal(size=30)).astype(np.float32).tolist() for i in range(3000)}


@pytest.fixture(scope="module")
def store(spark, clustered, tmp_path_factory):
    df = spark.createDataFrame([(i, v, i % 4) for i, v in clustered.items()], "vec_id long, embedding array<float>, kind int")
    out = VectorStore(spark, str(tmp_path_factory.mktemp("store")), keep="kind int").fit(df, cells=30)
    out.upsert(df)
    return out


def test_a_tenth_of_the_vectors_and_nearly_all_neighbours(spark, store, clustered):
    queries = {i: clustered[i] for i in range(0, 3000, 75)}
    asked = spark.createDataFrame([(i, q) for i, q in queries.items()], "query_id long, embedding array<float>")
    wanted = exact(clustered, queries, 20)
    assert recall(found(store.search(asked, exact=True)), wanted) == 1
    assert recall(found(store.search(asked)), wanted) >= 0.98
    probed = store.search(asked, probes=3)
    assert recall(found(probed), wanted) >= 0.95
    rows = {r["cell"]: r["count"] for r in store.table.read().groupBy("cell").count().collect()}
    centres, _ = store.model()
    q = np.array(list(queries.values()))
    near = np.argsort(-(q @ centres.T), axis=1)[:, :3]
    assert np.mean([sum(rows.get(int(c), 0) for c in n) for n in near]) / 3000 <= 0.13


def test_one_query_reads_its_cells(spark, store, clustered):
    plan = store.table.read(columns=["vec_id", "cell", "code"], places=[3, 7])._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in plan and "IN (3,7)" in plan and "embedding" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_changes_and_vectors_that_cannot_be_found(spark, clustered, tmp_path):
    some = {i: clustered[i] for i in range(200)}
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>, kind int")
    made = VectorStore(spark, str(tmp_path), keep="kind int").fit(frame([(i, v, 0) for i, v in some.items()]), cells=8)
    made.upsert(frame([(i, v, i % 2) for i, v in some.items()] + [(900, None, 0), (901, [0.0] * 30, 0), (902, [1.0], 0), (903, [float("nan")] * 30, 0)]), number=0)
    moved = {5: clustered[2000], 6: clustered[2001]}
    made.upsert(frame([(i, v, 1) for i, v in moved.items()] + [(7, None, 0)]), number=1)
    made.upsert(frame([(8, clustered[2500], 0)]), number=1)
    made.delete(frame([(9, None, 0)]).select("vec_id"))
    now = {i: v for i, v in (some | moved).items() if i not in (7, 9)}
    asked = spark.createDataFrame([(i, clustered[i]) for i in (5, 2000, 9)] + [(-1, None), (-2, [1.0])], "query_id long, embedding array<float>")
    wanted = exact(now, {i: clustered[i] for i in (5, 2000, 9)}, 10)
    assert found(made.search(asked, k=10, exact=True)) == wanted and found(made.search(asked, k=10)) == wanted
    odd = found(made.search(asked, k=4, where="kind = 1", exact=True))
    assert all(i % 2 or i == 6 for ids in odd.values() for i in ids) and len(odd) == 3
    assert made.search(asked.where("query_id = -1")).count() == 0


def test_codes_keep_the_direction():
    x = np.random.default_rng(1).normal(size=(500, 13))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes = Codes(x.mean(axis=0), x.std(axis=0))
    import pyarrow as pa

    packed = codes.pack(x)
    near = codes.unpack(pa.array(packed, pa.binary()))
    assert {len(c) for c in packed} == {4} and near.shape == x.shape and np.mean((near * x).sum(axis=1)) > 0.9


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
def test_recall_on_the_tables(spark):
    store, asked = stores.vector_store(spark, SF), stores.vector_queries(spark, SF)
    assert recall(found(store.search(asked, rerank=10)), found(store.search(asked, exact=True))) >= 0.95
