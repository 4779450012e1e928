from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import lattice_dedup as L


def test_nearest_point():
    r = np.random.default_rng(0)
    x = r.normal(size=(200, 8)) * 2
    got = L.nearest_e8(x)
    near = ((x[:, None, :] - (got[:, None, :] + L.ROOTS[None])) ** 2).sum(axis=2).min(axis=1)
    assert (((x - got) ** 2).sum(axis=1) <= near + 1e-9).all()
    assert len(L.ROOTS) == 240 and np.allclose((L.ROOTS**2).sum(axis=1), 2)


def vectors():
    r = np.random.default_rng(2)
    base = r.normal(size=(12, 24))
    out = []
    for k in range(200):
        v = base[k % 12] + r.normal(size=24) * r.choice([0.05, 0.2, 0.35])
        out.append((k, v.tolist()))
    out += [(300, out[0][1]), (301, [2 * x for x in out[0][1]]), (302, None), (303, [0.0] * 24), (304, [None, *([1.0] * 23)]), (305, [float("nan")] * 24), (306, [float("inf"), *([1.0] * 23)]), (307, []), (308, [1.0, 2.0]), (309, [2.0, 4.0])]
    return out


def brute(rows, threshold):
    ok = {k: np.array(v, dtype=float) for k, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links, root = {k: 0 for k, _ in rows}, {k: k for k, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(ok, 2):
        x, y = ok[a], ok[b]
        if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
            links[a] += 1
            links[b] += 1
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {k: (links[k], find(k)) for k in links}


def test_like_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame([(k, v, 1, k % 3) for k, v in rows], "vec_id long, embedding array<double>, m int, label int").repartition(4)
    out = L.near_duplicate_vectors(df).collect()
    want = brute(rows, 0.9)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out}
    right = sum(min(got[k][0], want[k][0]) for k in want) / sum(n for n, _ in want.values())
    assert right >= 0.99 and all(got[k][0] <= want[k][0] for k in want)
    assert sum(got[k][1] == want[k][1] for k in want) >= len(want) - 2
    assert got[302] == (0, 302) and got[303] == (0, 303) and got[307] == (0, 307) and got[308] == (1, 308)


def test_crowded_cells(spark, monkeypatch):
    r = np.random.default_rng(4)
    centre = r.normal(size=16)
    rows = [(k, (centre + 0.05 * r.normal(size=16)).tolist()) for k in range(120)] + [(500, centre.tolist()), (501, centre.tolist())]
    monkeypatch.setattr(L, "BLOCK", 16)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {x["vec_id"]: (x["n_links"], x["component_id"], x["kept"]) for x in L.near_duplicate_vectors(df).collect()}
    want = brute(rows, 0.9)
    assert {k: v[:2] for k, v in got.items()} == want
    assert got[0][2] and not got[501][2]


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert L.near_duplicate_vectors(df).count() == 0


def test_lengths_share_the_origin(spark):
    """Vectors whose home in the first table is the origin, in near copies, of three lengths: all links count."""
    r, rows = np.random.default_rng(6), []
    for d in (24, 48, 64):
        project = np.random.default_rng([d, 0]).normal(size=(d, 8 * L.FEWEST_BLOCKS))
        q, _ = np.linalg.qr(project)
        for _ in range(3):
            v = r.normal(size=d)
            v -= q @ (q.T @ v)
            rows += [(len(rows) + k, (v + 1e-3 * r.normal(size=d)).tolist()) for k in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in L.near_duplicate_vectors(df).collect()}
    want = brute(rows, 0.9)
    assert got == want and min(n for n, _ in want.values()) == 3


def test_one_cell_of_two_lengths():
    vectors = [[1.0, 2.0], [1.0, 2.0, 3.0], [1.0, 2.001], [1.0, 2.0, 3.001], [5.0, -1.0]]
    n = len(vectors)
    batch = pa.RecordBatch.from_pydict(
        {"key": list(range(n)), "cell": [7] * n, "home": [True] * n, "block": pa.array([0] * n, pa.int32()), "bi": pa.array([0] * n, pa.int32()), "bj": pa.array([0] * n, pa.int32()), "m": [1] * n, "vector": vectors, "homes": [[7]] * n}
    )
    out = [x for b in L._verify(0.9, 2)(iter([batch])) for x in b.to_pylist()]
    assert [(x["key"], x["n"], x["other"]) for x in out] == [(0, 1, 0), (1, 1, 1), (2, 1, 0), (3, 1, 1)]


def test_ids_that_repeat_or_are_null(spark):
    a, b, c = [1.0, 0.1, 0.0], [0.0, 1.0, 0.1], [0.1, 0.0, 1.0]
    near = lambda v: [x + 0.01 for x in v]
    rows = [(1, a), (1, b), (2, near(a)), (None, c), (None, c), (5, near(c)), (None, [-1.0, 0.0, 0.0]), (None, None), (7, b)]
    df = spark.createDataFrame([(k, v, n, n) for n, (k, v) in enumerate(rows)], "vec_id long, embedding array<double>, key int, m int").repartition(3)
    got = sorted(((x["vec_id"], x["n_links"], x["component_id"], x["kept"]) for x in L.near_duplicate_vectors(df).collect()), key=str)
    want = [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (None, 2, 5, False), (None, 2, 5, False), (5, 2, 5, True), (None, 0, None, False), (None, 0, None, False), (7, 1, 1, False)]
    assert got == sorted(want, key=str)


@pytest.mark.parametrize(("rows", "size"), [(50_000, 64), (1_000_000, 24), (1_000_000, 384)])
def test_recall_of_planned_tables(rows, size):
    """Pairs with a cosine of just 0.9 meet in at least one table, whatever the number of blocks."""
    r = np.random.default_rng(size)
    x = L.unit(r.normal(size=(1500, size)))
    y = r.normal(size=x.shape)
    y = L.unit(y - (x * y).sum(axis=1, keepdims=True) * x)
    y = 0.9 * x + np.sqrt(1 - 0.81) * y
    tables, blocks = L.plan(rows)
    one, two = L.cells(x, tables, blocks), L.cells(y, tables, blocks)
    meet = (one[:, :, :1] == two).any(axis=2) | (two[:, :, :1] == one).any(axis=2)
    assert meet.any(axis=1).mean() >= 0.99


def test_plan_grows_with_the_table(spark):
    assert L.plan(0)[1] == L.plan(100_000)[1] == 2 and L.plan(100_001)[1] == 3 and L.plan(10**9)[1] > 4
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    tables, blocks = L.plan(1_000_000)
    got = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in L.near_duplicate_vectors(df, tables=tables, blocks=blocks).collect()}
    want = brute(rows, 0.9)
    assert sum(min(got[k][0], want[k][0]) for k in want) >= 0.99 * sum(n for n, _ in want.values()) and all(got[k][0] <= want[k][0] for k in want)
