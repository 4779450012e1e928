"""License scans by a positional index of rare licence words.

The index holds, for each licence template, its words of highest inverse document frequency (counted
over all documents) with their positions.  A file's occurrences of those words vote for (template,
offset); neighbouring offsets on which enough votes meet are verified: the template's mandatory phrases
must stand there, and enough of its words at their relative positions, which names and years put into a
text may shift by up to SHIFT words.  Four base phrases are always counted.

The statistics are one small table (a count per licence word); both passes are maps over Arrow batches.
"""

from __future__ import annotations

import importlib.resources
import json
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import arrow_map, slices

# The base phrases of the contract and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Words of a template that are looked up, at least, and one for so many of its words.
RARE = 6
WORDS_PER_RARE = 8
COVERAGE = 0.8
SHIFT = 8

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of a-z (A-Z too), 0-9 and characters beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


#: label: (template, mandatory phrases), from the data file beside this module: public licence texts and notices.
def _templates() -> dict[str, tuple[str, list[str]]]:
    found = json.loads(importlib.resources.files("millrace.llm").joinpath("license_templates.json").read_text(encoding="utf-8"))
    return {label: (normalised(entry["text"]), [normalised(p) for p in entry["phrases"]]) for label, entry in found.items()}


def normalised(text: str) -> str:
    return b" ".join(words_of(text)).decode()


TEMPLATES = _templates()


class Index:
    """The templates' rarest words, by their document frequency in the corpus."""

    def __init__(self, frequency: dict[bytes, int], documents: int, templates: dict = TEMPLATES, rare: int = RARE):
        self.templates = {label: (text.encode().split(), [p.encode().split() for p in phrases]) for label, (text, phrases) in templates.items()}
        self.idf = {w: math.log((documents + 1) / (frequency.get(w, 0) + 1)) for ws, _ in self.templates.values() for w in ws}
        self.postings: dict[bytes, list[tuple[str, int]]] = defaultdict(list)
        self.votes = {}
        for label, (ws, _) in self.templates.items():
            at = sorted(range(len(ws)), key=lambda i: (-self.idf[ws[i]], i))[: max(rare, len(ws) // WORDS_PER_RARE)]
            self.votes[label] = max(1, math.ceil(len(at) / 2))
            for i in at:
                self.postings[ws[i]].append((label, i))
        self.keys = frozenset(self.postings)
        self.base = [(phrase.encode().split(), label) for phrase, label in BASE.items()]

    def scan(self, words: list[bytes]) -> dict:
        """Base places, labels and the best coverage of a file's words."""
        distinct = set(words)
        places, base = [], set()
        for phrase, label in self.base:
            if distinct.issuperset(phrase):
                found = places_of(words, phrase)
                places += found
                base |= {label} if found else set()
        labels, score = set(base), 1.0 if base else 0.0
        hits = self.keys & distinct
        if hits:
            votes: dict[str, Counter] = defaultdict(Counter)
            for i, w in enumerate(words):
                if w in hits:
                    for label, at in self.postings[w]:
                        votes[label][i - at] += 1
            for label, offsets in votes.items():
                for group in near_runs(sorted(offsets), SHIFT):
                    if sum(offsets[o] for o in group) >= self.votes[label]:
                        coverage = self.verified(words, label, group)
                        if coverage >= COVERAGE:
                            labels.add(label)
                            score = max(score, coverage)
        return {"places": places, "base": base, "labels": labels, "score": score}

    def verified(self, words: list[bytes], label: str, offsets: list[int]) -> float:
        """The share of the template's words that stand at their places, counted from any of the offsets; 0
        without a mandatory phrase there."""
        template, phrases = self.templates[label]
        near = words[max(0, offsets[0] - 2) : offsets[-1] + len(template) + 2]
        if not all(places_of(near, p) for p in phrases):
            return 0.0
        return sum(any(0 <= o + i < len(words) and words[o + i] == w for o in offsets) for i, w in enumerate(template)) / len(template)


def near_runs(numbers: list[int], gap: int) -> Iterator[list[int]]:
    """Runs of ascending numbers that lie within ``gap`` of the first."""
    run: list[int] = []
    for n in numbers:
        if run and n - run[0] > gap:
            yield run
            run = []
        run.append(n)
    if run:
        yield run


def places_of(words: list[bytes], phrase: list[bytes]) -> list[int]:
    out, at, n = [], -1, len(phrase)
    try:
        while True:
            at = words.index(phrase[0], at + 1)
            if words[at : at + n] == phrase:
                out.append(at)
    except ValueError:
        return out


def document_frequencies(docs: DataFrame, text_col: str = "text", templates: dict = TEMPLATES) -> tuple[dict[bytes, int], int]:
    """({licence word: documents that hold it}, documents), over all rows."""
    vocabulary = frozenset(w for text, _ in templates.values() for w in text.encode().split())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in (part for whole in batches for part in slices(whole, 0)):
            for t in b.column(0).to_pylist():
                counts.update(vocabulary.intersection(words_of(t)))
            counts[b""] += b.num_rows
        yield pa.RecordBatch.from_pydict({"word": pa.array([w.decode() for w in counts], pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    counted = docs.select(F.col(text_col).alias("text")).transform(arrow_map, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r["word"].encode(): r["n"] for r in counted.collect()}  # at most a row per licence word
    return found, found.pop(b"", 0)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict = TEMPLATES) -> DataFrame:
    """One row per row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A null or empty text has no words; its labels are empty strings and its score is 0.  Repeated rows get
    equal results each; of equally good labels all are given; extra columns are not looked at.  Idf
    is counted over all rows, so what the index looks up depends on the table, not on its partitions."""
    index = Index(*document_frequencies(docs, text_col, templates), templates)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, 1)):
            rows = []
            for t in b.column(1).to_pylist():
                words = words_of(t)
                found = index.scan(words)
                places = found["places"]
                rows.append((len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(found["base"])), ",".join(sorted(found["labels"])), found["score"]))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.transform(arrow_map, run, f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
    return out.withColumnRenamed("id", id_col)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def license_base_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op6 that SQL can express: the base phrases' places."""
    return op6_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


BASE_ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w
  FROM documents),
phrase(p, label) AS (VALUES ('gnu general public license', 'gpl'), ('apache license', 'apache'), ('cc by', 'cc-by'), ('mit license', 'mit')),
place AS (
  SELECT doc_id, i - 1 AS pos, label FROM w, phrase, unnest(range(1, len(w) + 1)) AS u(i)
  WHERE w[i] = split_part(p, ' ', 1) AND array_to_string(w[i:i + len(string_split(p, ' ')) - 1], ' ') = p)
SELECT w.doc_id, len(w.w) AS n_words, count(pos) AS n_base, min(pos) AS first_word, max(pos) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
FROM w LEFT JOIN place USING (doc_id) GROUP BY w.doc_id, len(w.w)
"""
