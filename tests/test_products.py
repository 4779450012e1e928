"""Products of batches of documents with a few queries give what the joins of many give."""

from __future__ import annotations

import random

from millrace.operators import products
from millrace.operators import retrieval as R


def _texts(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["Red", "blue", "it's", "a", "b", "c1", "--"]) for _ in range(n))
    docs = [(k, text(k % 9)) for k in range(70)] + [(k, "red blue a") for k in range(70, 140)] + [(200, None), (201, ""), (202, "a a a a b a b")]
    asked = [(f"q{k}", text(1 + k % 5)) for k in range(12)] + [("none", "--"), ("null", None), ("same", "red blue a")]
    return spark.createDataFrame(asked, "query_id string, question string"), spark.createDataFrame(docs, "doc_id long, body string")


def _rows(df, name):
    return {(r["query_id"], r["doc_id"]): round(r[name], 6) for r in df.collect()}


def test_same_as_joins(spark, monkeypatch):
    asked, docs = _texts(spark)
    monkeypatch.setattr(products, "SLICE", 16)
    dense, lexical = _rows(R.dense_hits(asked, docs), "vector_score"), _rows(R.lexical_hits(asked, docs), "lexical_score")
    assert len(dense) > 500 and len(lexical) > 500 and dense["same", 70] == 1.0
    first = [_rows(df, name) for df, name in zip(R.first_hits(asked, docs, 5), ("vector_score", "lexical_score"), strict=True)]
    monkeypatch.setattr(R, "FEW_QUERIES", 0)
    assert _rows(R.dense_hits(asked, docs), "vector_score") == dense
    assert _rows(R.lexical_hits(asked, docs), "lexical_score") == lexical
    assert [_rows(df, name) for df, name in zip(R.first_hits(asked, docs, 5), ("vector_score", "lexical_score"), strict=True)] == first


def test_no_pair_is_shuffled(spark):
    asked, docs = _texts(spark)
    plan = R.dense_hits(asked, docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan


def _nearest_by_hand(rows, asked, k):
    def cosine(a, b):
        if a is None or len(a) != len(b) or None in a or None in b:
            return 0.0
        norm = sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5
        return max(0.0, round(sum(x * y for x, y in zip(a, b, strict=True)) / norm, 6)) if norm else 0.0

    out = set()
    for q, a in asked:
        hits = sorted((-cosine(a, b), v) for v, b in rows if b is not None)[:k]
        out |= {(q, v, -s, i) for i, (s, v) in enumerate(hits, 1)}
    return out


def test_nearest_in_blocks(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(k, [rng.randint(-4, 4) * 1.0 for _ in range(3)]) for k in range(150)] + [(k, [1.0, 2.0, 3.0]) for k in range(200, 230)]
    rows += [(300, None), (301, [0.0, 0.0, 0.0]), (302, [1.0, None, 2.0]), (303, []), (304, [1.0, 2.0])]
    asked = rows[:20] + rows[-6:]
    vectors, queries = (spark.createDataFrame(x, "vec_id long, embedding array<double>") for x in (rows, asked))
    expected = _nearest_by_hand(rows, asked, 4)
    for block, tile in ((products.BLOCK_BYTES, products.TILE), (200, 60)):
        monkeypatch.setattr(products, "BLOCK_BYTES", block)
        monkeypatch.setattr(products, "TILE", tile)
        got = R.nearest(queries, vectors, 4)
        assert {tuple(r) for r in got.collect()} == expected
        assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_slices_are_bounded_by_values(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(products, "VALUES", 10)
    lists = [[0] * n for n in (3, 3, 3, 3, 40, 0, 9, 1, 1)] + [None]
    got = [(ids.to_pylist(), rows.tolist()) for ids, rows, _ in products._slices(iter([pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array(lists)], ["id", "x"])]))]
    assert [i for ids, _ in got for i in ids] == list(range(10)) and all(len(rows) <= 10 or len(ids) == 1 for ids, rows in got) and len(got) == 5


def test_sums_are_kept_and_forgotten(monkeypatch):
    import hashlib

    import numpy as np

    known = products._Sums()
    sums = lambda terms: [int(hashlib.md5(t.encode()).hexdigest()[:16], 16) for t in terms]
    for most in (100, 0):
        monkeypatch.setattr(products, "KNOWN", most)
        for words in (["a", "b"], ["c", "b", "a"], ["b"]):
            first = np.arange(len(words))
            got = known.of(words, first, first[::-1], lambda at, w=words: [f"{w[i]} {w[len(w) - 1 - i]}" for i in at])
            assert got.tolist() == sums(words + [f"{x} {y}" for x, y in zip(words, words[::-1], strict=True)])


def test_term_counts_without_grouping(spark):
    from collections import Counter

    docs = [(1, "b a b a"), (2, None), (3, "x"), (4, "")]
    df = spark.createDataFrame(docs, "doc_id long, body string")
    tf = R.term_counts(df, "doc_id", "body")
    assert "Aggregate" not in tf._jdf.queryExecution().optimizedPlan().toString()
    assert Counter(map(tuple, tf.collect())) == Counter([(1, "a", 2), (1, "b", 2), (1, "b a", 2), (1, "a b", 1), (3, "x", 1)])
    twice = df.unionByName(spark.createDataFrame([(1, "a c"), (None, "q"), (None, "q")], "doc_id long, body string"))
    assert Counter(map(tuple, R.term_counts(twice, "doc_id", "body").collect())) == Counter([(1, "a", 3), (1, "b", 2), (1, "b a", 2), (1, "a b", 1), (1, "c", 1), (1, "a c", 1), (3, "x", 1), (None, "q", 2)])


def test_words_and_sums_are_made_together(monkeypatch):
    import hashlib
    import re

    import pyarrow as pa

    rng = random.Random(2)
    texts = [None, "", "a", "it's é1é x", "--", *("".join(rng.choice("ab 1'-é日") for _ in range(rng.randint(0, 90))) for _ in range(300)), None]
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(["zz", *texts]).slice(1)], ["id", "text"])
    for most in (1, 60, 10**6):
        monkeypatch.setattr(products, "BYTES", most)
        got = [x for b in products._words(iter([rows])) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        assert got == [(i, re.findall("[a-z0-9']+", t or "")) for i, t in enumerate(texts)]
    terms = ["x" * n for n in (54, 55, 56, 63, 64, 200)] + ["é" * 27, "é" * 28] + [t or "" for t in texts]
    monkeypatch.setattr(products, "LANES", 100)
    assert products._sums(pa.array(["", *terms]).slice(1)).tolist() == [int(hashlib.md5(t.encode()).hexdigest()[:16], 16) for t in terms]


def test_one_pass_scores_both_ways(spark):
    asked, docs = _texts(spark)
    for df in R.first_hits(asked, docs, 5):
        assert df.count() and "Arrow" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_stay_where_they_are(spark):
    from millrace.plans import retrieval as Q

    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = Q.blocks(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "SortMergeJoin" not in plan.split("Arrow")[0] and "hashpartitioning(doc_id" not in plan and "BroadcastHashJoin" in plan
