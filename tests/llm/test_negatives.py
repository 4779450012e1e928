"""Hard negatives against all pairs in plain Python."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from millrace.llm import hard_negatives as H

SCHEMA = "vec_id long, label int, embedding array<float>, nth long, list string"


def brute(rows: list[tuple], anchors: list[tuple], positives=5, negatives=10, low=30, high=90) -> Counter:
    def clean(some):
        return [(i, y, [math.floor(256 * x) for x in v]) for i, y, v, *_ in some if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]

    out: Counter = Counter()
    for a, ya, va in clean(anchors):
        scored = [(-sum(p * q for p, q in zip(va, v, strict=True)), i, y) for i, y, v in clean(rows) if len(v) == len(va)]
        for ps, p, _ in sorted(x for x in scored if x[2] == ya and x[1] != a)[:positives]:
            found = sorted(x for x in scored if x[2] != ya and low * -ps <= 100 * -x[0] <= high * -ps)[:negatives]
            out.update((a, p, k + 1, n, -ps, -ns) for k, (ns, n, _) in enumerate(found))
    return out


def made(seed: int, n: int = 400, d: int = 6) -> list[tuple]:
    r = random.Random(seed)
    rows = []
    for k in range(n):
        z = r.random()
        v = list(rows[-1][2]) if z < 0.2 and rows and rows[-1][2] else [round(r.gauss(0.3, 0.5), 1) for _ in range(d if z < 0.9 else 3)]
        rows.append((k, r.randrange(3), v, 1, "x"))
    return [*rows, rows[7], rows[50], (1001, None, [1.0] * d, 1, "x"), (1002, 1, None, 1, "x"), (None, 1, [1.0] * d, 1, "x"), (1050, 1, [1.0, None] + [1.0] * (d - 2), 1, "x"),
            (1100, 1, [math.nan] * d, 1, "x"), (1150, 1, [math.inf] * d, 1, "x"), (1200, 2, [], 1, "x"), (1201, 2, [], 1, "x"), (1202, 0, [], 1, "x"), (1250, 7, [0.5] * d, 1, "x")]


@pytest.mark.parametrize("block_bytes", [H.BLOCK_BYTES, 300])
def test_same_as_all_pairs(spark, block_bytes):
    rows = made(5)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = H.mine(df, df.where("vec_id % 50 = 0"), block_bytes=block_bytes)
    exact = [(i, y, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, y, v, *_ in rows]
    wanted = brute(exact, [x for x in exact if x[0] is not None and x[0] % 50 == 0])
    assert Counter(map(tuple, got.collect())) == wanted and len(wanted) > 300
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_lists_merge_in_any_order():
    r = random.Random(2)
    entries = [(r.randrange(4), r.randrange(5), r.randrange(50)) for _ in range(300)]
    best = H.Best(4, 6)
    for k in range(0, 300, 37):
        best.add(*(np.array(x) for x in zip(*entries[k : k + 37], strict=True)))
    at, scores, ids = best.entries()
    wanted = [(w, s, i) for w in range(4) for s, i in sorted(((s, i) for v, s, i in entries if v == w), key=lambda x: (-x[0], x[1]))[:6]]
    assert list(zip(at.tolist(), scores.tolist(), ids.tolist(), strict=True)) == wanted


def test_products_beyond_doubles_are_exact():
    a, c = np.array([[2.0**30, 1.0, 3.0]]), np.array([[2.0**31, 1.0, 1.0], [-(2.0**31), 0.0, 1.0]])
    assert H.products(a, c).tolist() == [[2**61 + 4, -(2**61) + 3]]
    with pytest.raises(OverflowError):
        H.products(np.array([[2.0**40]]), np.array([[2.0**40]]))


def test_empty_tables_and_no_anchor(spark):
    rows = spark.createDataFrame(made(6, 60), SCHEMA)
    none = rows.where("false")
    assert H.mine(none, none).count() == 0 and H.mine(rows, none).count() == 0 and H.mine(none, rows).count() == 0


def test_a_hot_vector_and_a_hot_label(spark):
    rows = [(k, 0 if k % 3 else 1, [1.0, 0.5] if k % 2 else [0.5, k / 1000], 1, "x") for k in range(600)]
    exact = [(i, y, [float(np.float32(x)) for x in v]) for i, y, v, *_ in rows]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = H.mine(df, df.where("vec_id % 100 = 0"))
    assert Counter(map(tuple, got.collect())) == brute(exact, [x for x in exact if x[0] % 100 == 0])
