from __future__ import annotations

import random
import re

from millrace.llm import license_scan as L

PHRASES = {("gnu", "general", "public", "license"): "gpl", ("apache", "license"): "apache", ("cc", "by"): "cc-by", ("mit", "license"): "mit"}


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    places = [(i, label) for i in range(len(words)) for p, label in PHRASES.items() if tuple(words[i : i + len(p)]) == p]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


TEXTS = [
    "Licensed under the Apache License, Version 2.0.", "THE MIT LICENSE mit-license MIT\nLicense", "GNU General\tPublic License, version 3. cc by-nc 4.0 CC BY", "café by CC BY-SA 4.0", None, "",
    "gnu general public", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", "é" * 10, "cc cc by by",
]


def test_base_counts(spark):
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, words int").repartition(3)
    out = {r["doc_id"]: r for r in L.scan_licenses(df).collect()}
    for i, t in enumerate(TEXTS):
        r = out[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(t), t
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))


def test_labels(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    labels = {r["doc_id"]: r["labels"] for r in L.scan_licenses(df).collect()}
    assert labels[0] == "apache,apache-2.0" and "gpl-3.0" in labels[2] and "cc-by-nc" in labels[2] and "cc-by-sa" in labels[3]
    assert labels[7] == "mit-notice" and labels[8] == "" and labels[6] == ""


def test_mandatory_phrase_and_coverage():
    index = L.Index({}, 10)
    near = L.words_of("redistribution and use in source and binary forms with or without changes are permitted provided that the following conditions are met")
    assert "bsd" in index.scan(near)["labels"]
    far = L.words_of("redistribution of binary forms; use in source and other forms with or without modification are permitted provided that")
    assert "bsd" not in index.scan(far)["labels"]


def test_whole_licence_texts_like_brute_force(spark):
    """Every template inside other words, with a name put in, in copies and with extra columns: the same labels
    as a search of every offset of every template gives."""
    r, rows = random.Random(1), []
    filler = lambda n: " ".join("w" + str(r.randrange(10**6)) for _ in range(n))
    for label, (text, _) in sorted(L.TEMPLATES.items()):
        w = text.split()
        middle = len(w) // 2
        rows += [(label, f"{filler(30)} {text.upper()} {filler(30)}"), (label, f"{filler(5)} {' '.join(w[:middle])} by john doe {' '.join(w[middle:])}")]
        rows += [(None, f"{filler(9)} {' '.join(w[: len(w) // 3])} {filler(40)}")]
    rows += [rows[0], rows[0], (None, None)]
    df = spark.createDataFrame([(k, t, "x", 1) for k, (_, t) in enumerate(rows)], "doc_id long, text string, labels string, n_words int").repartition(4)
    got = {x["doc_id"]: set(filter(None, x["labels"].split(","))) for x in L.scan_licenses(df).collect()}
    index = L.Index({}, 1)

    def searched(text):
        words, out = L.words_of(text), set()
        for label, (template, _) in index.templates.items():
            for first in range(-8, len(words)):
                if index.verified(words, label, list(range(first, first + L.SHIFT + 1))) >= L.COVERAGE:
                    out.add(label)
        return out

    for k, (label, text) in enumerate(rows):
        own = got[k] - set(L.BASE.values())
        assert own <= searched(text), text
        if label is not None and k % 3 != 1:
            assert label in own, (label, own)
    long = [label for label, (text, _) in L.TEMPLATES.items() if len(text.split()) > 40]
    assert len(long) >= 10 and all(label in got[k] for k, (label, _) in enumerate(rows) if label in long)


def test_frequencies(docs, empty, rows):
    frequency, n = L.document_frequencies(docs)
    assert n == len(rows) + 1 and L.document_frequencies(empty) == ({}, 0)
    assert L.scan_licenses(empty).count() == 0 and L.scan_licenses(docs).count() == n
