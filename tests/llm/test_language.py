from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from millrace.llm import language_id as G

SOUNDS = {
    "aa": ["ka", "to", "mi", "ru"], "bb": ["schl", "eng", "ung", "ver"], "cc": ["eau", "ou", "ille", "ç"], "dd": ["dzh", "ryk", "nov", "ost"],
    "ee": ["iya", "awe", "lan", "uhu"], "ff": ["qar", "ibn", "alw", "sah"], "gg": ["tti", "kku", "nnee", "lla"], "hh": ["pfe", "zwa", "tsch", "nge"],
    "ii": ["oão", "nha", "lhe", "ção"], "jj": ["ngu", "mba", "ndi", "kwe"], "kk": ["yev", "ska", "oye", "zhd"], "ll": ["tza", "xek", "ari", "etx"],
}


def sentence(r, lang, most=60):
    return " ".join("".join(r.choice(SOUNDS[lang]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(3, most)))


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(0)
    rows = []
    for k in range(300):
        lang = ["aa", "bb", "cc"][k % 3]
        rows.append((k, sentence(r, lang), None if k % 50 == 49 else lang, "x"))
    rows += [(900, None, "aa", "x"), (901, "", "bb", "x"), (902, "123 !? _ ²", "aa", "x"), (903, "zzz qqq", None, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string").repartition(3)


def brute(train, texts):
    """(language, score) of each text, from dictionaries of whole words and n-grams."""
    word = re.compile(r"[^\W\d_]+")
    langs = sorted({lang for t, lang in train if t is not None and lang is not None})
    tables = [{lang: Counter() for lang in langs} for _ in range(5)]

    def grams(w, n):
        return list(w) if n == 1 else [f"<{w}>"[i : i + n] for i in range(len(w) + 3 - n)]

    for t, lang in train:
        for w in word.findall((t or "").lower()) if lang else []:
            tables[0][lang][w] += 1
            for n in range(1, 5):
                tables[n][lang].update(grams(w, n))
    keys = [set().union(*t.values()) for t in tables]

    def logs(n, key):
        return np.array([math.log((tables[n][x][key] + 0.5) / (sum(tables[n][x].values()) + 0.5 * (len(keys[n]) + 1))) for x in langs])

    def row(w):
        if w in keys[0]:
            return logs(0, w)
        for n in range(4, 0, -1):
            known = [logs(n, g) for g in grams(w, n) if g in keys[n]]
            if known:
                return np.mean(known, axis=0)
        return np.zeros(len(langs))

    out = []
    for t in texts:
        rows = [row(w) for w in word.findall((t or "").lower()) if any(map(str.isalpha, w))]
        if not rows:
            out.append(("und", 0.0))
            continue
        best = int(np.argmax(np.sum(rows, axis=0)))
        out.append((langs[best], float(np.mean([(np.exp(x - x.max()) / np.exp(x - x.max()).sum())[best] for x in rows]))))
    return out


def test_like_brute_force(labelled, monkeypatch):
    r = random.Random(4)
    rows = [(x["text"], x["lang"]) for x in labelled.collect()]
    texts = [t for t, _ in rows] + ["Kato", "KATOMI veréng xyz", "w", "ç", "katoxx 12 engver ünge", sentence(r, "aa", 4000) + " x" * 5]
    model = G.fit(labelled)
    monkeypatch.setattr(G, "PIECE", 500)  # long texts are cut
    langs, scores, _ = model.predict(texts)
    for text, lang, score, want in zip(texts, langs, scores, brute(rows, texts), strict=True):
        assert lang == want[0] and score == pytest.approx(want[1], abs=1e-4), text


def test_held_out_accuracy(labelled):
    model = G.fit(labelled.where(~G.held_out()))
    out = {r["doc_id"]: r for r in G.identify(labelled, model).collect()}
    truth = {r["doc_id"]: r["lang"] for r in labelled.where(G.held_out()).collect() if r["lang"] and r["doc_id"] < 900}
    assert sum(out[k]["lang_pred"] == v for k, v in truth.items()) / len(truth) > 0.97
    for k in (900, 901, 902):
        assert out[k]["lang_pred"] == "und" and out[k]["lang_score"] == 0
    assert out[903]["lang_pred"] in ("aa", "bb", "cc") and all(0 <= r["lang_score"] <= 1 for r in out.values())


def test_unseen_words_fall_back(labelled):
    assert G.fit(labelled).predict(["schlungverengungverschl"])[0] == ["bb"]


def test_bounds_and_edges(spark, labelled):
    whole, small = G.fit(labelled), G.fit(labelled, max_rows=30)
    assert 0 < len(small.keys) < len(whole.keys)
    assert len(G.fit(labelled, max_bytes=3000).keys) < len(whole.keys)
    none = G.fit(labelled.where("false"))
    assert none.languages == [] and none.predict(["abc", None])[0] == ["und", "und"]
    assert G.identify(labelled.where("false"), small).count() == 0
    # a tie goes to the first language by name; repeated rows get equal results
    tie = G.fit(spark.createDataFrame([(1, "same words", "bb"), (2, "same words", "aa")], "doc_id long, text string, lang string"))
    twice = spark.createDataFrame([(5, "same"), (5, "same"), (None, "same")], "doc_id long, text string")
    assert {(r["lang_pred"], r["lang_score"]) for r in G.identify(twice, tie).collect()} == {("aa", 0.5)}


def test_filter_keeps_columns(labelled):
    kept = G.filter_languages(labelled, G.fit(labelled))
    assert kept.columns == labelled.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert not ids & {900, 901, 902, 903} and ids == set(range(300))
    plain = G.filter_languages(labelled, G.fit(labelled.where("false")))
    assert plain.count() == 301


@pytest.mark.parametrize("size", [1, 2, 4, 12])
def test_filter_at_several_sizes(spark, size):
    """Clean texts stay and junk goes, whatever the number of languages."""
    r = random.Random(size)
    langs = sorted(SOUNDS)[:size]
    train = spark.createDataFrame([(k, sentence(r, langs[k % size]), langs[k % size]) for k in range(60 * size)], "doc_id long, text string, lang string")
    clean = [(k, sentence(r, langs[k % size], 40)) for k in range(100)]
    junk = [(1000 + k, " ".join("".join(chr(0x4E00 + r.randrange(5000)) for _ in range(5)) for _ in range(10))) for k in range(20)]
    docs = spark.createDataFrame(clean + junk, "doc_id long, text string")
    assert {x["doc_id"] for x in G.filter_languages(docs, G.fit(train)).collect()} == set(range(100))
