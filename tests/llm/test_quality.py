"""The quality classifier: tokens and pooling in plain Python, held-out rows, calibration, odd rows."""

from __future__ import annotations

import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import quality_classifier as Q
from tests.llm.conftest import words

SF = "/root/testdata/sf0.01"


def packed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def plain(text: str) -> list[str]:
    """The tokens of an ASCII text; marks of capitals and of repeats as <C> and <A>."""
    out: list[str] = []
    base = [m.group() for m in re.finditer(r"[A-Za-z0-9]+|([^A-Za-z0-9\s])\1*", text)]
    low = [x.lower() if x[0].isalnum() else x[:3] for x in base]
    for k, (raw, x) in enumerate(zip(base, low, strict=True)):
        out.append(x)
        if len(raw) > 1 and any(map(str.isalpha, raw)) and raw == raw.upper() and raw[0].isalnum():
            out.append("<C>")
        if raw[0].isalnum() and x in low[max(k - 2, 0) : k]:
            out.append("<A>")
    return out


def test_tokens():
    r = random.Random(4)
    texts = ["".join(r.choice(["a", "B", "CD", "x1", " ", " ", "!", "!!!!", "?", "\n", "-"]) for _ in range(r.randint(0, 40))) for _ in range(60)]
    doc, hashes = Q.tokens(*packed(texts))
    names: dict[int, str] = {}
    for k, text in enumerate(texts):
        got, wanted = hashes[doc == k].tolist(), plain(text)
        assert len(got) == len(wanted), text
        for h, name in zip(got, wanted, strict=True):
            assert names.setdefault(h, name) == name
    assert len(set(names.values())) == len(names)


def test_pooling_is_the_mean_of_the_vectors():
    texts = [" ".join(words(random.Random(k), 30)) for k in range(20)]
    vectors = Q.random_indexing(pa.array(texts * 3, pa.large_string()))
    data, offsets = packed([*texts, ""])
    pooled, (doc, hashes) = vectors.pooled(data, offsets), Q.tokens(data, offsets)
    for k in range(len(texts)):
        rows = vectors.rows[vectors.places(hashes[doc == k])].astype(float)
        assert np.allclose(pooled[k, : Q.DIM], rows.mean(axis=0), atol=1e-5)
        assert pooled[k, Q.DIM] == pytest.approx(np.log1p(len(rows)))
    assert not pooled[-1].any()


def test_words_of_like_surroundings_are_near():
    r = random.Random(9)
    texts = [" ".join(f"{r.choice(['red', 'blue'])} car {r.choice(['sour', 'sweet'])} fruit" for _ in range(20)) for _ in range(30)]
    v = Q.random_indexing(pa.array(texts, pa.large_string()))
    around = lambda w: (lambda h: v.rows[v.places(h)][0] - Q.index_vectors(h)[0])(Q.tokens(*packed([w]))[1])
    cos = lambda a, b: float(around(a) @ around(b) / np.linalg.norm(around(a)) / np.linalg.norm(around(b)))
    assert cos("red", "blue") > 0.9 > 0.5 > cos("red", "sour")


def test_temperature_mends_logits_that_are_too_sure():
    r = np.random.default_rng(1)
    logits = r.normal(0, 2, 4000)
    y = (r.random(4000) < 1 / (1 + np.exp(-logits))).astype(float)
    assert Q.temperature(logits * 3, y, np.ones(4000)) == pytest.approx(3, rel=0.1)
    assert Q.temperature(logits, y, np.ones(4000)) == pytest.approx(1, rel=0.1)


def made(r: random.Random, good: bool) -> str:
    w = words(r, r.randint(20, 90))
    return " ".join(w) if good else " | ".join(w) if r.random() < 0.5 else " ".join(x for x in w[:8] for _ in range(15))


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(11)
    rows = [(k, made(r, k % 4 > 0), 0.5, "t") for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, text_ string").repartition(5)
    labels = spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(600)] + [(5, None), (None, 1), (7, 1), (7, 1), (10**9, 0)], "doc_id long, quality int")
    return docs, labels


def test_rows_not_learned_from(labelled):
    docs, labels = labelled
    model = Q.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in Q.score(docs, model).collect()}
    unseen = [(k % 4 > 0, got[k]) for k in range(600, 900)]
    assert all(0 <= s <= 1 for _, s in unseen) and np.mean([good == (s >= 0.5) for good, s in unseen]) >= 0.97
    again = Q.fit(docs.repartition(3), labels.unionByName(labels))
    assert {r["doc_id"]: r["score"] for r in Q.score(docs, again).collect()} == pytest.approx(got, abs=1e-9)


def test_odd_rows(spark, labelled, docs, empty):
    model = Q.fit(*labelled)
    got = Q.score(docs, model, keep=["doc_id", "v", "h"])
    assert got.columns == ["doc_id", "v", "h", "score"] and got.count() == docs.count()
    scores = {r["doc_id"]: r["score"] for r in got.collect()}
    assert scores[1000] == scores[1001] == scores[1002] and all(0 <= s <= 1 for s in scores.values())
    assert Q.score(empty, model).count() == 0
    assert Q.score(labelled[0], model).columns == ["doc_id", "text", "text_", "score"]
    none = labelled[1].where("false")
    assert {r["score"] for r in Q.score(docs, Q.fit(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert {r["score"] for r in Q.score(docs, Q.fit(docs, one)).collect()} == {1.0}


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
def test_held_out_rows_of_the_tables(spark):
    got = Q.op12_quality_classifier(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality is not null")
    rows = got.join(labels, "doc_id").where("held_out").select("quality", "predicted").collect()
    bad = [r for r in rows if r["quality"] == 0]
    assert np.mean([r["quality"] == r["predicted"] for r in rows]) >= 0.97 and np.mean([r["predicted"] == 0 for r in bad]) >= 0.9
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
