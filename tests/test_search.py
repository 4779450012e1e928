"""Full-text search over stored positions: stems, covers against all runs of places, and the files that a search reads."""

from __future__ import annotations

import random
import re
from itertools import product

import pytest

from millrace.functions.stems import STOP_WORDS, Stems, stem
from millrace.operators import postings

SCHEMA = "doc_id long, title string, body string, source string"
VOCABULARY = ["running", "runs", "runner", "the", "of", "connected", "connection", "happy", "happily", "dogs", "dog", "ties", "skies"]


def made(seed: int, n: int) -> list[tuple]:
    r = random.Random(seed)
    text = lambda most: " ".join(r.choice(VOCABULARY) for _ in range(r.randint(0, most)))
    return [(k, text(4), text(25), f"s{k % 3}") for k in range(n)] + [(1000, None, "running dogs", "s0"), (1001, "Running, DOGS!", None, "s0"), (1002, None, None, "s0"), (1003, "", "", "s1")]


#: query, and its alternatives: wanted and unwanted phrases in words.
SEARCHES = [
    ("running dog", [([["running"], ["dog"]], [])]),
    ('"running dogs" or happy', [([["running", "dogs"]], []), ([["happy"]], [])]),
    ("connection -ties", [([["connection"]], [["ties"]])]),
    ('"dogs of the runners"', [([["dogs", "of", "the", "runners"]], [])]),
    ("-running", [([], [["running"]])]),
    ("the of", []),
    ('happily runner or "skies ties" -"the dog"', [([["happily"], ["runner"]], []), ([["skies", "ties"]], [["the", "dog"]])]),
]


def brute(title: str | None, body: str | None, alternatives: list, config: str) -> float | None:
    """The score from all runs of places, of which the shortest are kept by comparing each with each."""
    analyse = Stems().__getitem__ if config == "english" else str
    words = [(analyse(w.strip(",!")), 1.0) for w in (title or "").lower().split()] + [(analyse(w), 0.4) for w in (body or "").lower().split()]
    phrase = lambda p: [(i, analyse(w)) for i, w in enumerate(p) if analyse(w)]
    clauses = [([phrase(p) for p in must if phrase(p)], [phrase(p) for p in no if phrase(p)]) for must, no in alternatives]
    clauses = [c for c in clauses if c[0] or c[1]]

    def spans(p: list) -> list[tuple[int, int]]:
        lead = p[0][0]
        return [(s, s + p[-1][0] - lead) for s in range(len(words)) if all(s + i - lead < len(words) and words[s + i - lead][0] == t for i, t in p)]

    good = [must for must, no in clauses if all(spans(p) for p in must) and not any(spans(p) for p in no)]
    if not good:
        return None
    runs = {(min(s for s, _ in choice), max(e for _, e in choice)) for must in good if must for choice in product(*[spans(p) for p in must])}
    covers = [x for x in runs if not any(y != x and x[0] <= y[0] and y[1] <= x[1] for y in runs)]
    terms = {t for must, _ in clauses for p in must for _, t in p}
    total = 0.0
    for a, b in covers:
        inside = [w for t, w in words[a : b + 1] if t in terms]
        total += len(inside) / sum(1 / w for w in inside) / (1 + b - a + 1 - len(inside))
    return round(total, 6)


@pytest.fixture(scope="module")
def rows():
    return made(8, 150)


@pytest.mark.parametrize("config", ["english", "simple"])
def test_scores_by_all_runs(spark, rows, tmp_path_factory, config):
    index = postings.Index(spark, str(tmp_path_factory.mktemp(config)), config, buckets=8).write(spark.createDataFrame(rows, SCHEMA), keep=["source"])
    asked = spark.createDataFrame([(k, q) for k, (q, _) in enumerate(SEARCHES)], "query_id int, query string")
    simple_the = [([["the"], ["of"]], [])] if config == "simple" else []
    wanted = {}
    for k, (_, alternatives) in enumerate(SEARCHES):
        for doc_id, title, body, _source in rows:
            score = brute(title, body, alternatives or simple_the, config)
            if score is not None:
                wanted[k, doc_id] = score
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in postings.search(index, asked).collect()}
    assert got.keys() == wanted.keys() and got == pytest.approx(wanted, abs=2e-6) and len({k for k, _ in got}) >= 6
    for r in postings.search(index, asked, limit=5, where="source = 's1'").collect():
        assert r["doc_id"] in {x[0] for x in rows if x[3] == "s1"} and r["rank"] <= 5 and 0 <= r["lexical_score"] <= 1
    ranked = [r for r in postings.search(index, asked, limit=7).orderBy("query_id", "rank").collect() if r["query_id"] == 0]
    best = sorted(((-s, d) for (q, d), s in got.items() if q == 0))[:7]
    assert [(r["doc_id"], r["rank"]) for r in ranked] == [(d, i + 1) for i, (_, d) in enumerate(best)] and ranked[0]["lexical_score"] == 1.0


def test_only_the_folders_and_rows_of_the_terms_are_read(spark, rows, tmp_path):
    index = postings.Index(spark, str(tmp_path), "english", buckets=16).write(spark.createDataFrame(rows, SCHEMA))
    one, all_of = (df._jdf.queryExecution().executedPlan().toString() for df in (index.postings(["dog"]), index.postings()))
    assert re.search(r"PartitionFilters: \[bucket#\d+ = \d+|PartitionFilters: \[[^]]*\(bucket#\d+ = \d+\)", one) and "EqualTo(term,dog)" in one and "PartitionFilters: []" in all_of
    assert {r["term"] for r in index.postings(["dog"]).collect()} == {"dog"}


def test_empty_index_and_no_searches(spark, tmp_path):
    index = postings.Index(spark, str(tmp_path)).write(spark.createDataFrame([], SCHEMA))
    asked = spark.createDataFrame([(1, "dog"), (2, "-dog"), (3, None), (4, "")], "query_id int, query string")
    assert postings.search(index, asked).count() == 0 and postings.search(index, asked.where("false"), limit=3).count() == 0


def test_stems():
    pairs = "consigned consign consistency consist consolingly consol conspicuously conspicu knackeries knackeri knightly knight generous generous communication communic skies sky dying die running run hopping hop hoping hope ties tie cries cri gas gas kiwis kiwi happily happili agreed agre nationally nation relational relat controlling control boy boy enjoy enjoy succeed succeed analogies analog sensitivity sensit".split()
    assert [stem(w) for w in pairs[::2]] == pairs[1::2]
    kept = Stems(most=2)
    assert [kept[w] for w in ("running", "the", "runs", "dogs")] == ["run", "", "run", "dog"] and len(kept) <= 2 and len(STOP_WORDS) == 127


def test_a_query_is_read_once_and_a_word_analysed_once(spark, rows, tmp_path, monkeypatch):
    import pyarrow as pa

    asked = []
    monkeypatch.setattr(postings, "_analyser", lambda config: lambda word: asked.append(word) or word)
    monkeypatch.setattr(spark.createDataFrame([(1,)], "doc_id long").__class__, "mapInArrow", lambda df, run, schema: (run, schema))
    run, _ = postings.postings(spark.createDataFrame([], "doc_id long, title string, body string"), "simple")
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8, 9, 10]), pa.array(["a b", None, "", "b"]), pa.array(["b c b", "c a", None, "é a"])], ["doc_id", "t", "b"])
    got = [tuple(r.values()) for b in run(iter([batch])) for r in b.to_pylist()]
    assert sorted(got) == [("a", 7, [1], []), ("a", 8, [], [2]), ("a", 10, [], [2]), ("b", 7, [2], [3, 5]), ("b", 10, [1], []), ("c", 7, [], [4]), ("c", 8, [], [1])]
    assert sorted(asked) == ["a", "b", "c"]
