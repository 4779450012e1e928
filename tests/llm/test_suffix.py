from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from millrace.llm import suffix_dedup as X


def test_suffix_arrays_and_prefixes():
    r = np.random.default_rng(1)
    for _ in range(200):
        t = np.r_[r.integers(1, 2 + r.integers(0, 4), size=r.integers(1, 60)), 0].astype(np.uint16)
        items = t.tolist()
        want = sorted(range(len(items)), key=lambda i: items[i:])
        sa = X.suffix_array(t)
        assert sa.tolist() == want
        phi, plcp = X.common_prefixes(t, sa)
        for i, j in zip(want[1:], want, strict=False):
            n = 0
            while max(i, j) + n < len(items) and items[i + n] == items[j + n]:
                n += 1
            assert phi[i] == j and plcp[i] == n


def brute(rows, span):
    raw = [(k, (t or "").encode()) for k, t in rows]
    seen = Counter(x[i : i + span] for _, x in raw for i in range(len(x) - span + 1))
    out = {}
    for k, x in raw:
        gone = np.zeros(len(x), dtype=bool)
        for i in range(len(x) - span + 1):
            if seen[x[i : i + span]] > 1:
                gone[i : i + span] = True
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(x) else 0
        out[k] = (len(x), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(x, np.uint8)[~gone])).hexdigest())
    return out


def pieces(seed=5, n=200):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        parts = []
        for _ in range(r.randint(0, 6)):
            z = r.random()
            if z < 0.3:
                parts.append("x" * r.randint(1, 150))
            elif z < 0.6 and rows:
                y = r.choice(rows)[1]
                i = r.randint(0, max(0, len(y) - 1))
                parts.append(y[i : i + r.randint(1, 200)])
            elif z < 0.7:
                parts.append("ab" * r.randint(1, 90))
            else:
                parts.append("".join(r.choice("abcdé ") for _ in range(r.randint(1, 150))))
        rows.append((k, "".join(parts)))
    return [*rows, (1000, None), (1001, ""), (1002, "y" * 50), (1003, "y" * 50), (1004, "y" * 49)]


@pytest.mark.parametrize("span", [33, 50, 120])
def test_like_brute_force(spark, span):
    rows = pieces()
    df = spark.createDataFrame([(k, t, k) for k, t in rows], "doc_id long, text string, anchor long").repartition(5)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in X.remove_repeats(df, span=span).collect()}
    assert got == brute(rows, span)


def test_small_shards(spark, monkeypatch):
    monkeypatch.setattr(X, "SHARD_BYTES", 500)
    rows = pieces(7, 80)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in X.remove_repeats(df, span=40).collect()}
    assert got == brute(rows, 40)


def test_repeated_rows_and_empty(spark, empty):
    df = spark.createDataFrame([(1, "z" * 39 + "abc"), (1, "z" * 39 + "abc"), (None, "q" * 45)], "doc_id long, text string")
    out = X.remove_repeats(df, span=40).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"], r["kept_text"]) for r in out) == [(0, 45, ""), (1, 42, ""), (1, 42, "")]
    assert X.remove_repeats(empty).count() == 0
    with pytest.raises(ValueError):
        X.remove_repeats(df, span=10)


def test_shared_passages(spark, rows):
    """Every document with a passage of 51 words that another has is reported, none without a run of PASSAGE_GRAM words that another has."""
    r = random.Random(9)
    base = [w for _, t in rows if t for w in t.split()] or ["w"]
    passage = [r.choice(base) + str(k) for k in range(60)]
    docs = [(d, t) for d, t in rows]
    docs += [(2000 + k, " ".join([f"a{k}x{j}" for j in range(30)] + passage[k % 3 : 55] + [f"b{k}x{j}" for j in range(20)])) for k in range(6)]
    docs += [(3000, " ".join([f"c{j}" for j in range(80)])), (3001, " ".join([f"c{j}" for j in range(25)] + [f"d{j}" for j in range(80)]))]
    docs += [(4000, " ".join(passage[55:60] * 40)), (5000, " ".join(f"e{j}" for j in range(60)))] + [(5001, " ".join(f"e{j}" for j in range(60)))] * 2

    def shared(size):
        seen, out = {}, set()
        for k, (_, t) in enumerate(docs):
            w = (t or "").lower().split()
            for i in range(len(w) - size + 1):
                first = seen.setdefault(tuple(w[i : i + size]), k)
                if first != k:
                    out |= {first, k}
        return {docs[k][0] for k in out}

    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {x["doc_id"]: x["n_shared_passages"] for x in X.remove_repeats(df).collect()}
    found = {d for d, n in got.items() if n}
    assert shared(51) <= found <= shared(X.PASSAGE_GRAM) and {2000, 2003, 5000, 5001} <= found and 3000 not in found
