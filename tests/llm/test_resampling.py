"""Importance resampling against CRCs of joined strings and a draw in plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from millrace.llm import importance_resampling as I

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text: str | None, n: int) -> list[bytes]:
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return [" ".join(w[j : j + k]).encode() for k in range(1, n + 1) for j in range(len(w) - k + 1)]


def brute(docs: list[tuple], target: list[str | None], percent: int, min_words: int, n: int, buckets: int, seed: int) -> list[tuple]:
    """(id, n_features, weight, score, rank) of each row, ranks of equal rows in any order."""
    of = lambda texts: Counter(zlib.crc32(g) % buckets for x in texts for g in grams(x, n))
    s, t = of([d[1] for d in docs]), of(target)
    big_s, big_t = sum(s.values()), sum(t.values())
    rows = []
    for k, (i, text) in enumerate(docs):
        g = [zlib.crc32(x) % buckets for x in grams(text, n)]
        gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in g]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), k])
    may = [r for r in rows if len(grams(docs[r[4]][1], 1)) >= min_words]
    drawn = sorted(may, key=lambda r: (-r[3], r[0] is None, r[0] or 0))[: percent * len(may) // 100]
    rank = {r[4]: k + 1 for k, r in enumerate(drawn)}
    return [(*r[:4], rank.get(r[4])) for r in rows]


def test_crcs_of_joined_words():
    r = random.Random(3)
    texts = [" ".join("".join(r.choice("abZé9ü") for _ in range(r.choice([1, 3, 7, 48, 49, 300]))) for _ in range(r.randint(0, 9))) + r.choice(["", "-x", "!"]) for _ in range(120)] + [""]
    raw = [x.encode() for x in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    for n in (1, 2, 4):
        got = Counter((int(d), int(c)) for docs, crcs in I.features(data, offsets, n) for d, c in zip(docs, crcs, strict=True))
        assert got == Counter((k, zlib.crc32(g)) for k, x in enumerate(texts) for g in grams(x, n))


def test_moving_over_zero_bytes():
    for length in (0, 1, 5, 1000, 123_456):
        assert int(I.combined(np.array([zlib.crc32(b"head")]), np.array([zlib.crc32(bytes(length))]), np.array([length]))[0]) == zlib.crc32(b"head" + bytes(length))


@pytest.mark.parametrize("n", [1, 3])
def test_same_draw_as_plain_python(spark, docs, rows, n):
    target = [rows[3][1], rows[8][1], None, ""]
    wanted = brute([*rows, rows[0], (None, "null " * 30), (None, "null " * 30)], target, 40, 5, n, 500, 7)
    more = docs.unionByName(spark.createDataFrame([(None, "null " * 30, 0, "v", 1.0, [1])] * 2, docs.schema))
    got = I.resample(more, spark.createDataFrame([(x,) for x in target], "words string"), 40, 5, n, 500, 7, target_col="words")
    assert Counter(map(tuple, got.select("doc_id", "n_features", "weight", "score", "rank").collect())) == Counter(wanted)
    assert got.columns == [*docs.columns, "n_words", "n_features", "weight", "score", "rank"]
    assert {r["doc_id"]: r["text"] for r in got.where("doc_id is not null").collect()} == dict(rows)


def test_clashing_columns_are_kept_or_replaced(spark):
    data = spark.createDataFrame([(1, "a b c", "x", "y", "z", 9, 8), (2, "c d e", "x", "y", "z", 9, 8)], "doc_id long, text string, made string, key string, nth string, score int, Rank int")
    got = I.resample(data, data, percent=50, min_words=1)
    assert sorted(got.columns) == sorted(["doc_id", "text", "made", "key", "nth", "n_words", "n_features", "weight", "score", "rank"])
    assert sorted((r["made"], r["key"], r["nth"]) for r in got.collect()) == [("x", "y", "z")] * 2
    assert sorted(str(r["rank"]) for r in got.collect()) == ["1", "None"]


def test_a_third_of_all_rows_with_one_id(spark):
    data = spark.range(3000).selectExpr("case when id % 3 = 0 then 7 else id end as doc_id", "'same words over and over' as text").repartition(12)
    got = I.resample(data, data, percent=50, min_words=2).where("rank is not null").select("rank").collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 1501))


def test_empty_tables(spark, empty, docs):
    assert I.resample(empty, docs).count() == 0
    got = I.resample(docs, empty, min_words=1)
    assert got.count() == docs.count() and got.where("rank is not null").count() == docs.where("text rlike '[a-zA-Z]'").count() // 10
    assert I.resample(docs, docs, min_words=10**9).where("rank is not null").count() == 0
