"""Language identification, word first with character back-off.

Known words score by their log frequency in each language.  An unseen word falls back to its character
n-grams, longest first: the longest length at which the language model knows any of them decides.

The classifier is fitted on a bounded sample of labelled rows: at most about ``MAX_ROWS`` rows and
``MAX_BYTES`` of text, spread evenly over the languages by a hash of the row.  All words and n-grams of
the sample are kept, as 64-bit hashes in one sorted array beside one matrix of log probabilities, so
the model has at most a few entries per sampled byte.  Prediction reads every whole text, in a map;
long texts are cut at blanks, which no word crosses.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import _BASE, _UNBASE, _powers, arrow_map, mixed, slices

MAX_ROWS = 20_000
MAX_BYTES = 64_000_000
LONGEST = 4
SMOOTHING = 0.5
PIECE = 500_000
TALLY = 100_000
LETTER, MARK, OTHER, UNSEEN = 1, 2, 0, -1

_KINDS = np.full(0x110000, UNSEEN, dtype=np.int8)  # of code points, filled as they are met


def _kinds(points: np.ndarray) -> np.ndarray:
    out = _KINDS[points]
    if (out == UNSEEN).any():
        for p in np.unique(points[out == UNSEEN]):
            of = unicodedata.category(chr(p))[0]
            _KINDS[p] = LETTER if of == "L" else MARK if of == "M" else OTHER
        out = _KINDS[points]
    return out


def pieces(texts: list[str | None], most: int = PIECE) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(documents, lower-cased pieces) in runs of about ``most`` characters; longer texts are cut at blanks."""
    docs, parts, size = [], [], 0
    for k, text in enumerate(texts):
        at = 0
        while text and at < len(text):
            end = at + most
            if end < len(text):
                end = text.find(" ", end)
                end = len(text) if end < 0 else end
            docs.append(k)
            parts.append(text[at:end].lower())
            size += end - at
            at = end
            if size >= most:
                yield np.array(docs), parts
                docs, parts, size = [], [], 0
    if parts:
        yield np.array(docs), parts


class Words:
    """The words of some pieces: runs of letters and the marks on them.  ``part`` is a word's piece."""

    def __init__(self, parts: list[str]):
        self.points = np.frombuffer("\n".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kinds = _kinds(self.points)
        inside = np.r_[False, kinds > 0, False]
        starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
        letters = np.r_[0, np.cumsum(kinds == LETTER)]
        real = letters[ends] > letters[starts]
        self.starts, self.ends = starts[real], ends[real]
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1
        self.part = np.searchsorted(np.cumsum(sizes), self.starts, side="right")
        n = len(self.points)
        summed = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(mixed(self.points) * _powers(_BASE, n), out=summed[1:])
        back = _powers(_UNBASE, n + 1)
        self.hashes = mixed((summed[self.ends] - summed[self.starts]) * back[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def grams(self, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(place in which, hash) of the character n-grams of some words between marks of their ends; for n = 1
        of the words alone."""
        starts, size = self.starts[which], self.ends[which] - self.starts[which]
        begin = np.cumsum(size + 2) - size - 2
        marked = np.empty(int((size + 2).sum()), dtype=np.uint64)
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        marked[np.repeat(begin + 1, size) + at] = mixed(self.points[np.repeat(starts, size) + at])
        marked[begin], marked[begin + size + 1] = mixed(np.array([ord("<")]))[0], mixed(np.array([ord(">")]))[0]
        count = size if n == 1 else np.maximum(size + 3 - n, 0)
        first = np.repeat(begin + (n == 1), count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        factor = _powers(0xD1342543DE82EF95, LONGEST)
        out = np.full(len(first), np.uint64(n) << np.uint64(56), dtype=np.uint64)
        for k in range(n):
            out += marked[first + k] * factor[k]
        return np.repeat(np.arange(len(which)), count), mixed(out)


class Model:
    """languages; sorted hashes of words and n-grams, and their log probabilities in each language."""

    def __init__(self, languages: list[str], keys: np.ndarray, logs: np.ndarray):
        self.languages, self.keys, self.logs = languages, keys, logs

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each hash, -1 for those not known."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, -1)

    def rows(self, words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log probabilities of each word, whether it or an n-gram of 3 or more of it is known)."""
        at = self.places(words.hashes[which])
        out = np.zeros((len(which), len(self.languages)))
        known = at >= 0
        out[known] = self.logs[at[known]]
        left = np.flatnonzero(~known)
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            of, hashes = words.grams(which[left], n)
            at = self.places(hashes)
            of, at = of[at >= 0], at[at >= 0]
            if not len(of):
                continue
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            out[left[of[first]]] = np.add.reduceat(self.logs[at], first, axis=0, dtype=np.float64) / np.diff(np.r_[first, len(of)])[:, None]
            known[left[of[first]]] = n >= 3
            left = np.delete(left, of[first])
        return out, known

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, share of known words) per text.

        The score is the predicted language's share, averaged over the words; of equal languages the
        first by name is taken.  A text that is null or has no letter is ``und`` with score 0, as is
        all without a model.  A word counts as known if it or a part of it of 3 or more letters is."""
        size = len(self.languages)
        if not size:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        total, share, knows, n_words = np.zeros((len(texts), size)), np.zeros((len(texts), size)), np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
        for docs, parts in pieces(texts):
            words = Words(parts)
            if not len(words.starts):
                continue
            _, first, use = np.unique(words.hashes, return_index=True, return_inverse=True)
            logs, known = self.rows(words, first)
            p = np.exp(logs - logs.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            doc = docs[words.part]
            step = max(1, 4_000_000 // size)
            for k in range(0, len(use), step):
                of, at = doc[k : k + step], use[k : k + step]
                edge = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                total[of[edge]] += np.add.reduceat(logs[at], edge, axis=0)
                share[of[edge]] += np.add.reduceat(p[at], edge, axis=0)
                knows[of[edge]] += np.add.reduceat(known[at].astype(np.float64), edge)
                n_words[of[edge]] += np.diff(np.r_[edge, len(of)])
        best = total.argmax(axis=1)
        times = np.maximum(n_words, 1)
        scores = np.where(n_words > 0, np.minimum(share[np.arange(len(texts)), best] / times, 1.0), 0.0)
        return [self.languages[b] if n else "und" for b, n in zip(best, n_words, strict=True)], scores, knows / times


def _count(size: int):
    """(h, tag, n) of all words and n-grams of some texts; the tag is order * languages + language."""

    def rows(kept: dict[int, dict[str, int]]) -> Iterator[pa.RecordBatch]:
        for lang, counts in kept.items():
            n, words = np.fromiter(counts.values(), dtype=np.int64, count=len(counts)), Words(list(counts))
            for order in range(LONGEST + 1):
                of, h = (np.arange(len(n)), words.hashes) if order == 0 else words.grams(np.arange(len(n)), order)
                keys, at = np.unique(h, return_inverse=True)
                sums = np.bincount(at, weights=n[of], minlength=len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), lang + order * size, np.int32)), pa.array(sums)], ["h", "tag", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, dict[str, int]] = {}
        for b in batches:
            for part in slices(b, 1):
                langs = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                for docs, texts in pieces(part.column(1).to_pylist()):
                    words, joined = Words(texts), "\n".join(texts)
                    _, first, use = np.unique(words.hashes, return_index=True, return_inverse=True)
                    strings = [joined[s:e] for s, e in zip(words.starts[first].tolist(), words.ends[first].tolist(), strict=True)]
                    pair, n = np.unique(langs[docs[words.part]] * len(first) + use, return_counts=True)
                    for p, k in zip(pair.tolist(), n.tolist(), strict=True):
                        counts, w = kept.setdefault(p // len(first), {}), strings[p % len(first)]
                        counts[w] = counts.get(w, 0) + k
                if sum(map(len, kept.values())) > TALLY:
                    yield from rows(kept)
                    kept = {}
        yield from rows(kept)

    return run


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """The model of a table of texts and languages; rows in which either is null teach nothing, repeated
    rows teach as often as they stand there.

    Rows are sampled evenly over the languages, up to about ``max_rows`` rows and ``max_bytes`` of text."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    per = {r["lang"]: r for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()}  # a row per language
    languages = sorted(per)
    if not languages:
        return Model([], np.zeros(0, np.uint64), np.zeros((0, 0), np.float32))
    # the rows of a language are thinned by a hash of id and text, so that its share keeps to the quota
    share = {lang: min(1.0, max_rows / len(languages) / r["n"], max_bytes / len(languages) / max(r["bytes"], 1)) for lang, r in per.items()}
    keep = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(share[lang]))])
    number = F.create_map(*[x for k, lang in enumerate(languages) for x in (F.lit(lang), F.lit(k))])
    sample = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < keep[F.col("lang")] * float(1 << 30))
    counted = sample.select(number[F.col("lang")].alias("lang"), "text").transform(arrow_map, _count(len(languages)), "h long, tag int, n long")
    found = counted.groupBy("h", "tag").agg(F.sum("n").alias("n")).toArrow()  # of the sample, which is bounded
    h, tag, n = found.column("h").to_numpy().view(np.uint64), found.column("tag").to_numpy(), found.column("n").to_numpy()
    keys, at = np.unique(h, return_inverse=True)
    order, lang = np.divmod(tag, len(languages))
    orders = np.zeros(len(keys), dtype=np.int64)
    orders[at] = order
    sums = np.zeros((LONGEST + 1, len(languages)))
    np.add.at(sums, (order, lang), n)
    totals = np.log(sums + SMOOTHING * (np.bincount(orders, minlength=LONGEST + 1) + 1)[:, None])
    counts = np.zeros((len(keys), len(languages)), dtype=np.float32)
    counts[at, lang] = n
    return Model(languages, keys, (np.log(counts + np.float32(SMOOTHING)) - totals[orders]).astype(np.float32))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, ``lang_pred`` string, ``lang_score`` double.  Only the text is read, so
    repeated rows get equal results and extra columns do not matter; see ``Model.predict`` for null
    and letterless texts and for ties."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 1):
                langs, scores, _ = shared.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores)], ["id", "lang_pred", "lang_score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.transform(arrow_map, run, f"id {kind}, lang_pred string, lang_score double").withColumnRenamed("id", id_col)


def filter_languages(docs: DataFrame, model: Model, text_col: str = "text", min_margin: float = 0.1, min_known: float = 0.2) -> DataFrame:
    """The rows of docs, all columns, whose text has a language.

    A text goes if it is ``und``; if fewer than ``min_known`` of its words are known to the model; or if its
    score is not ``min_margin`` of the way from chance, which is 1 / languages, to 1.  With one language
    there is no chance level.  Without a model only texts that are null or have no letter go."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text_col)
            for part in slices(b, at):
                texts = part.column(at).to_pylist()
                size = len(shared.value.languages)
                if size:
                    langs, scores, known = shared.value.predict(texts)
                    margin = (scores * size - 1) / (size - 1) if size > 1 else np.ones(len(texts))
                    keep = (np.array(langs, dtype=object) != "und") & (known >= min_known) & (margin >= min_margin)
                else:
                    keep = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], dtype=bool)
                yield part.filter(pa.array(keep.astype(bool), pa.bool_()))

    return docs.transform(arrow_map, run, docs.schema)


def held_out(id_col: str = "doc_id", parts: int = 4, part: int = 2):
    """Whether crc32 of the id as text leaves ``part``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % parts == part


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
