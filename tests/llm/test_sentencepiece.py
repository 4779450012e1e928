from __future__ import annotations

import random

import pytest

from millrace.llm import sentencepiece_codec as C

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=C.MODEL)


def strings():
    r = random.Random(3)
    bits = ["a", "b", "the", " ", "  ", "\n", "é", "漢", "\U0001f600", "\t", "▁", "▁▁", "aaaa", "    " * 9, "ing", "0", "\x00", "ß", ".", ",", "of"]
    return ["".join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(1500)] + ["a" * 300, "", "\n", "\n\n", " ", "  ", "ab" * 2000]


def test_like_the_library(library, rows):
    p = C.pieces_at(C.MODEL)
    encoder = C.Encoder(p)
    some = strings() + [t or "" for _, t in rows]
    for _ in range(2):  # the second time from the kept words
        flat, offsets = encoder.encode(some)
        assert [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == library.encode(some)
    assert all(C.decode_ids(p, ids) == library.decode(ids) for ids in library.encode(some))


def test_suffix_order():
    import numpy as np

    r = np.random.default_rng(0)
    for _ in range(50):
        codes = r.integers(1, 4, size=r.integers(1, 40)).astype(np.int32)
        padded = [tuple(codes[i : i + 16]) for i in range(len(codes))]
        got = C.suffix_order(codes, 16, 5, 12)
        assert [padded[i] for i in got] == sorted(padded)


def test_round_trip(docs, empty, rows):
    out = {r["doc_id"]: r for r in C.encode_checked(docs).collect()}
    assert all(r["round_trip"] for r in out.values())
    assert out[1000]["ids"] is None and out[1000]["n_tokens"] == 0 and out[1001]["ids"] == []
    back = {r["doc_id"]: r["text"] for r in C.decode(C.encode(docs)).collect()}
    assert back == dict(rows)
    assert C.encode(empty).count() == 0 and C.decode(C.encode(empty)).count() == 0


def test_marks_in_the_text(spark):
    one = spark.createDataFrame([(1, "a▁b")], "doc_id long, text string")
    assert C.encode_checked(one).first()["round_trip"] is False


def test_long_words(library, monkeypatch):
    import base64
    import time

    r = random.Random(7)
    p = C.pieces_at(C.MODEL)
    some = [
        base64.b64encode(r.randbytes(300_000)).decode(), r.randbytes(100_000).hex(), "".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(50_000)),
        "".join(r.choice(["ing", "the", "ab", "Zq", "\U0001f600", "é"]) for _ in range(50_000)), "a" * 3000, "two words", "",
    ]
    want = library.encode(some)
    for most in (C.INDEX_CHARS, 1000, 7):
        monkeypatch.setattr(C, "INDEX_CHARS", most)
        texts = some if most > 7 else [t[:2000] for t in some]
        flat, offsets = C.Encoder(p).encode(texts)
        assert [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == (want if most > 7 else library.encode(texts))
        assert all("".join(p.parts(t, most)) == t for t in texts)
    monkeypatch.undo()
    assert max(map(len, p.parts(some[0], 1000))) <= 1000 and p.parts("a" * 3000, 1000) == ["a" * 3000]
    began = time.monotonic()
    C.Encoder(p).encode([base64.b64encode(r.randbytes(1_500_000)).decode()])
    assert time.monotonic() - began < 20


def test_kept_words_are_bounded_in_characters(monkeypatch):
    monkeypatch.setattr(C, "CACHE_CHARS", 10)
    e = C.Encoder(C.pieces_at(C.MODEL))
    first = e.encode(["one two three four"])[0].tolist()
    assert e.chars > 10 and e.encode(["one two three four"])[0].tolist() == first
    assert e.chars == sum(map(len, e.index))
