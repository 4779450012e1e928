from __future__ import annotations

import itertools

import pytest

from millrace.llm import minhash_dedup as M


def shingles(text, size):
    w = text.encode().lower().split() if text else []
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute(rows, size, percent):
    sets = {d: shingles(t, size) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        i = len(sets[a] & sets[b])
        if i and 100 * i >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize(("size", "percent", "block"), [(3, 85, 256), (5, 80, 256), (2, 60, 8)])
def test_like_brute_force(docs, rows, size, percent, block):
    out = M.near_duplicates(docs, words=size, percent=percent, block=block).collect()
    assert len(out) == len(rows) + 1
    want = brute(rows, size, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def test_one_large_family(spark):
    base = [f"w{i}" for i in range(150)]
    rows = []
    for k in range(300):
        w = list(base)
        for j in range(k % 9):
            w[(k * 7 + j * 13) % 150] = f"n{k}x{j}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in M.near_duplicates(df, words=3, percent=85, block=32).collect()}
    assert got == {d: c for d, (_, c) in brute(rows, 3, 85).items()}


def apart(words, changes, start=0, step=13):
    w = list(words)
    for j in range(changes):
        w[(start + j * step) % len(w)] = f"n{start}x{j}"
    return " ".join(w)


def test_members_apart_from_the_hub_meet_other_blocks(spark):
    """Chains: each text is linked with the next few only, so most are not linked with any one hub."""
    w = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(w[:k] + [f"z{i}" for i in range(k, 400)])) for k in range(0, 400, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in M.near_duplicates(df, words=3, percent=85, block=8).collect()}
    assert got == {d: c for d, (_, c) in brute(rows, 3, 85).items()}


def test_ids_that_repeat_or_are_null(spark):
    """Every row counts by its own text: no link is lost, and of each group one row stays."""
    r = [f"a{i}" for i in range(80)], [f"b{i}" for i in range(80)], [f"c{i}" for i in range(80)], [f"d{i}" for i in range(80)]
    x, y, u, v = (" ".join(w) for w in r)
    x2, y2, u2 = (apart(w, 1) for w in r[:3])
    rows = [(5, x), (5, y), (6, y2), (7, x2), (None, u), (None, u), (None, u2), (8, v), (8, v), (9, u2 + " e"), (None, None), (None, ""), (4, None)]
    df = spark.createDataFrame([(d, t, k, "s") for k, (d, t) in enumerate(rows)], "doc_id long, text string, row long, id string").repartition(3)
    got = sorted(((o["doc_id"], o["component_id"], o["kept"]) for o in M.near_duplicates(df).collect()), key=str)
    want = [(5, 5, True), (5, 5, True), (6, 5, False), (7, 5, False), (None, 9, False), (None, 9, False), (None, 9, False), (8, 8, True), (8, 8, True), (9, 9, True), (None, None, False), (None, None, False), (4, 4, True)]
    assert got == sorted(want, key=str)
    kept = M.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(((o["doc_id"], o["text"]) for o in kept.collect()), key=str) == sorted([(5, x), (5, y), (8, v), (9, u2 + " e"), (None, None), (None, ""), (4, None)], key=str)
    nameless = df.where("doc_id is null and text is not null and text <> ''")
    assert M.drop_near_duplicates(nameless).count() == 1


def test_edges(spark, empty, docs):
    assert M.near_duplicates(empty).count() == 0
    one = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (5, "a B c d e F"), (7, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in M.near_duplicates(one).collect()}
    assert got == {None: (3, False), 3: (3, True), 5: (3, False), 7: (7, True)}
    assert M.drop_near_duplicates(docs).columns == docs.columns


def test_retained_bound():
    assert M.retained_shared(85) == 27 and M.retained_shared(80) == 24


def test_clashing_columns_stay(spark):
    names = ["__row", "__rid", "row", "ROW1", "stays", "hash", "Hash1", "__text", "__bad", "a.b"]
    some = spark.createDataFrame([(k, f"text {k} has words of its own like w{k} x{k} y{k}", *[f"{c}{k}" for c in names]) for k in range(4)] * 2, ["doc_id", "text", *names])
    out = M.drop_near_duplicates(some)
    assert out.columns == some.columns and {tuple(r) for r in out.collect()} == {tuple(r) for r in some.collect()}
