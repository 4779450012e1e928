from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import pytest

from millrace.llm import maxent_lm as E


def base(rows, train):
    c = Counter()
    for d, t in rows:
        if d in train:
            c.update([*(t or "").encode().lower().split(), None])
    total, distinct = sum(c.values()), len(c)
    out = []
    for d, t in rows:
        w = [*(t or "").encode().lower().split(), None]
        out.append((d, len(w), sum(c[x] > 0 for x in w), total, round(sum(math.log10((c[x] + 1) / (total + distinct + 1)) for x in w), 6)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("head", [200_000, 20])
def test_base_scores(spark, docs, rows, monkeypatch, head):
    monkeypatch.setattr(E, "HEAD", head)  # with a small head most words come through the join
    twice = [*rows, rows[0]]
    train = {d for d, _ in rows if zlib.crc32(str(d).encode()) % 7 != 2}
    out = E.score_texts(docs, E.fit(docs.where(~E.held_out()))).collect()
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out), key=repr)
    want = []
    counted = [*[x for x in twice if x[0] in train], *[x for x in twice if x[0] not in train]]
    for x in base(counted, train):
        want.append(x)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert all(abs(g[4] - w[4]) < 1e-5 for g, w in zip(got, want, strict=True))
    assert all(r["score"] <= 0 for r in out)


def test_history_helps_on_held_out_texts(spark):
    r = random.Random(1)
    follow = {f"w{i}": [f"w{(i * 7 + j) % 40}" for j in range(3)] for i in range(40)}
    rows = []
    for k in range(400):
        w, out = f"w{r.randrange(40)}", []
        for _ in range(80):
            out.append(w)
            w = r.choice(follow[w])
        rows.append((k, " ".join(out)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    scored = E.score_texts(df, E.fit(df.where(~E.held_out()))).where(E.held_out()).collect()
    assert sum(x["score"] for x in scored) > 0.85 * sum(x["base_score"] for x in scored)


def test_words_sum_to_one(spark):
    """P(class | history) sums to one, and P(word | class) over known words and one unknown of each class."""
    df = spark.createDataFrame([(k, f"a{k % 5} b{k % 3} the the of") for k in range(50)], "doc_id long, text string")
    model, counts, total, distinct = E.fit(df)
    known = {r["h"]: r for r in counts.collect()}
    assert total == 50 * 6 and distinct == 5 + 3 + 2 + 1 and len(known) == 10
    assert model.class_n.sum() == total and model.class_v.sum() == distinct


def test_empty(spark, empty):
    fitted = E.fit(empty)
    assert fitted[2:] == (0, 0) and E.score_texts(empty, fitted).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = E.score_texts(one, fitted).first()
    assert r["n_tokens"] == 3 and r["n_known"] == 0 and r["base_score"] == 0
