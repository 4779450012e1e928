"""Removal of repeated byte strings by suffix arrays.

Every string of SPAN bytes is owned by one anchor, the smallest hashed GRAM-byte gram inside it, at the
same place in it wherever it occurs.  So the corpus splits into segments, one per anchor (the strings
it owns), and equal strings are always in segments of equal anchors:

1. A map lists each text's anchors with a print of the segment's bytes.  Equal segments are counted
   before anything moves: what is in a segment that occurs twice is repeated, whatever its group's size.
2. For anchors that have several different segments, the bytes of one occurrence of each are fetched.
   They are dealt by anchor; each task concatenates them to shards of about SHARD_BYTES.
3. A shard's suffix array is made by induced sorting: suffixes are classified, leftmost-smaller (LMS)
   substrings sorted by induction and named, the string of their names ordered, and the array induced
   from it, bucket by bucket with numpy.  Common prefixes are computed in text order: only those not
   implied by the position before are compared.  Prefixes of SPAN bytes mark repeated strings.
4. The marks go back to all occurrences and are joined with the texts.

The names' string is ordered by rank doubling (its alphabet is as large as itself, so bucket passes
would be one per symbol).  Texts move twice at most, whatever their number of repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import _BASE, _RANDOM, _UNBASE, _powers, arrow_map, chunks, load, mixed, slices, stored, word_hashes, words_of

SPAN = 400
GRAM = 32
SHARD_BYTES = 1_500_000
PASSAGE_WORDS = 51
PASSAGE_GRAM = 20


# ---------------------------------------------------------------- suffix arrays by induced sorting


def _types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; t ends with a unique smallest symbol."""
    n = len(t)
    differs = np.flatnonzero(t[1:] != t[:-1])
    at = differs[np.searchsorted(differs, np.arange(n - 1))]
    return np.r_[t[at] < t[at + 1], True]


def _place(sa: np.ndarray, room: np.ndarray, symbols: np.ndarray, suffixes: np.ndarray, step: int) -> None:
    """Put the suffixes, in their order, at their symbols' next free places (step 1: from the head; -1: from the tail)."""
    by = np.argsort(symbols, kind="stable")
    ordered = symbols[by]
    first = np.r_[0, np.flatnonzero(ordered[1:] != ordered[:-1]) + 1]
    size = np.diff(np.r_[first, len(ordered)])
    nth = np.arange(len(ordered)) - np.repeat(first, size)
    sa[room[ordered] + step * nth] = suffixes[by]
    room[ordered[first]] += step * size


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The suffix array that the LMS suffixes, given in order, induce."""
    n, sigma = len(t), len(bounds) - 1
    sa = np.full(n, -1, dtype=np.int32)
    of = t[lms]
    starts = np.searchsorted(of, np.arange(sigma + 1)) if (of[1:] >= of[:-1]).all() else None
    if starts is None:
        lms = lms[np.argsort(of, kind="stable")]
        starts = np.searchsorted(t[lms], np.arange(sigma + 1))
    head = bounds[:-1].copy()
    for c in range(sigma):  # larger suffixes, from the left
        at = bounds[c]
        while at < head[c]:
            batch = sa[at : head[c]]
            at = head[c]
            before = batch[batch > 0] - 1
            before = before[~small[before]]
            if len(before):
                _place(sa, head, t[before], before, 1)
        batch = lms[starts[c] : starts[c + 1]]
        before = batch[batch > 0] - 1
        if len(before):
            _place(sa, head, t[before], before, 1)
    tail = bounds[1:] - 1
    for c in range(sigma - 1, -1, -1):  # smaller suffixes, from the right
        at = bounds[c + 1] - 1
        while at > tail[c]:
            batch = sa[tail[c] + 1 : at + 1][::-1]
            at = tail[c]
            before = batch[batch > 0] - 1
            before = before[small[before]]
            if len(before):
                _place(sa, tail, t[before], before, -1)
        batch = sa[bounds[c] : head[c]][::-1]
        before = batch[batch > 0] - 1
        before = before[small[before]]
        if len(before):
            _place(sa, tail, t[before], before, -1)
    sa[0] = n - 1
    return sa


def _order_of_names(names: np.ndarray) -> np.ndarray:
    """The suffixes of a string of names, in order."""
    rank, step = names.astype(np.int64), 1
    while True:
        key = rank * (len(rank) + 1)
        key[:-step] += rank[step:] + 1
        order = np.argsort(key)
        ordered = key[order]
        new = np.r_[True, ordered[1:] != ordered[:-1]]
        if new.all():
            return order
        rank = np.empty(len(names), dtype=np.int64)
        rank[order] = np.cumsum(new) - 1
        step *= 2
        if step >= len(names):
            return np.argsort(rank, kind="stable")


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The suffix array of symbols t (uint16), of which the last is 0 and unique."""
    n = len(t)
    if n == 1:
        return np.zeros(1, dtype=np.int32)
    small = _types(t)
    bounds = np.r_[0, np.cumsum(np.bincount(t))]
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    sa = _induce(t, small, lms, bounds)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    by_substring = sa[is_lms[sa]]
    # name LMS substrings: equal ones have equal prints and lengths
    ends = np.minimum(np.r_[lms[1:], n - 1] + 1, n)
    table = np.r_[_RANDOM, mixed(np.arange(1, 3, dtype=np.uint64))]
    summed = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(table[t] * _powers(_BASE, n), out=summed[1:])
    prints = mixed((summed[ends] - summed[lms]) * _powers(_UNBASE, n)[lms] + (ends - lms).astype(np.uint64))
    nth = np.empty(n, dtype=np.int32)
    nth[lms] = np.arange(len(lms))
    ordered = prints[nth[by_substring]]
    names = np.empty(len(lms), dtype=np.int64)
    names[nth[by_substring]] = np.r_[0, np.cumsum(ordered[1:] != ordered[:-1])]
    order = by_substring if len(lms) and names.max() == len(lms) - 1 else lms[_order_of_names(names)]
    return _induce(t, small, order, bounds)


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phi, plcp): each suffix's predecessor in the array and their common prefix, in text order.

    Where the symbols before a suffix and its predecessor are equal, the value is one less than that
    of the position before; only the others are compared, eight symbols at a time."""
    n = len(t)
    phi = np.empty(n, dtype=np.int64)
    phi[sa[1:]] = sa[:-1]
    phi[sa[0]] = -1
    at = np.arange(n)
    implied = np.zeros(n, dtype=bool)
    fit = np.flatnonzero((at > 0) & (phi > 0))
    implied[fit] = (t[fit - 1] == t[phi[fit] - 1])
    fresh = np.flatnonzero(~implied & (phi >= 0))
    padded = np.r_[t, np.zeros(8, dtype=t.dtype)]
    length = np.zeros(len(fresh), dtype=np.int64)
    live = np.arange(len(fresh))
    other = phi[fresh]
    while len(live):
        here, there = fresh[live] + length[live], other[live] + length[live]
        same = np.ones(len(live), dtype=bool)
        for k in range(8):
            inside = np.maximum(here, there) + k < n
            same &= inside & (padded[np.minimum(here + k, n)] == padded[np.minimum(there + k, n)])
            length[live] += same
        live = live[same]
    plcp = np.zeros(n, dtype=np.int64)
    known = np.full(n, -1, dtype=np.int64)
    known[fresh] = fresh
    if phi[0] < 0:
        known[0] = 0
    starts = np.flatnonzero(phi < 0)
    known[starts] = starts
    last = np.maximum.accumulate(known)
    plcp[fresh] = length
    plcp = np.maximum(plcp[last] - (at - last), 0)
    plcp[phi < 0] = 0
    return phi, plcp


def repeated_starts(segments: list[bytes], span: int = SPAN) -> list[np.ndarray]:
    """For each segment, the starts of its span-byte strings that occur elsewhere in the segments."""
    joined = np.frombuffer(b"\0".join(segments) + b"\0\0", dtype=np.uint8)
    t = joined.astype(np.uint16) + 2
    ends = np.cumsum([len(s) + 1 for s in segments]) - 1
    t[ends] = 1
    t[-1] = 0
    phi, plcp = common_prefixes(t, suffix_array(t))
    rest = ends[np.minimum(np.searchsorted(ends, np.arange(len(t))), len(ends) - 1)] - np.arange(len(t))
    hit = np.flatnonzero((plcp >= span) & (rest >= span))
    mark = np.zeros(len(t), dtype=bool)
    mark[hit] = True
    mark[phi[hit]] = True
    begins = np.r_[0, ends[:-1] + 1]
    return [np.flatnonzero(mark[b:e]) for b, e in zip(begins, ends, strict=True)]


# ---------------------------------------------------------------- anchors and segments


def _least(keys: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each run of w keys."""
    blocks = -(-len(keys) // w)
    padded = np.full(blocks * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(keys)] = keys
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = len(keys) - w + 1
    return np.minimum(behind[:starts], ahead[w - 1 : w - 1 + starts])


def anchors(data: np.ndarray, offsets: np.ndarray, span: int = SPAN, gram: int = GRAM) -> dict[str, np.ndarray]:
    """The segments of some texts: document, anchor and segment prints, start, number of strings, lead of the anchor."""
    n, w = len(data), span - gram + 1
    empty = {k: np.zeros(0, np.int64) for k in ("doc", "anchor", "print", "start", "count", "lead")}
    if n < span:
        return empty
    summed = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_RANDOM[data] * _powers(_BASE, n), out=summed[1:])
    back = _powers(_UNBASE, n)
    grams = mixed((summed[gram:] - summed[:-gram]) * back[: n - gram + 1])
    low = np.uint64((1 << 30) - 1)
    keys = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    starts = n - span + 1
    least = (_least(keys, w) & low).astype(np.int64)
    whole = np.zeros(starts + 1, dtype=np.int64)  # strings that lie within a document
    sizes = np.diff(offsets)
    for b, s in zip(offsets[:-1][sizes >= span], sizes[sizes >= span], strict=True):
        whole[b] += 1
        whole[b + s - span + 1] -= 1
    inside = np.cumsum(whole[:-1]) > 0
    at = np.flatnonzero(inside)
    if not len(at):
        return empty
    doc = np.searchsorted(offsets, at, side="right") - 1
    new = np.flatnonzero(np.r_[True, (least[at[1:]] != least[at[:-1]]) | (doc[1:] != doc[:-1])])
    first = at[new]
    count = np.diff(np.r_[new, len(at)])
    pos = least[first]
    end = first + count - 1 + span
    prints = mixed((summed[end] - summed[first]) * back[first] + ((count << 16) + pos - first).astype(np.uint64))
    return {"doc": doc[new], "anchor": grams[pos].view(np.int64), "print": prints.view(np.int64), "start": first - offsets[doc[new]], "count": count, "lead": pos - first}


def passage_marks(data: np.ndarray, offsets: np.ndarray, words: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct marks of some texts: of every run of ``words`` words the smallest hashed
    run of PASSAGE_GRAM words in it.  Equal runs of ``words`` words have an equal mark."""
    starts, ends, doc = words_of(data, offsets)
    n = len(starts)
    if n < words:
        return doc[:0], np.zeros(0, np.uint64)
    summed = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(word_hashes(data, starts, ends) * _powers(_BASE, n), out=summed[1:])
    grams = mixed((summed[PASSAGE_GRAM:] - summed[:-PASSAGE_GRAM]) * _powers(_UNBASE, n - PASSAGE_GRAM + 1))
    low = np.uint64((1 << 32) - 1)
    least = (_least((grams & ~low) | np.arange(len(grams), dtype=np.uint64), words - PASSAGE_GRAM + 1) & low).astype(np.int64)
    at = np.unique(least[doc[: n - words + 1] == doc[words - 1 :]])
    by = np.lexsort((grams[at], doc[at]))
    doc, grams = doc[at][by], grams[at][by]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])][: len(doc)]
    return doc[new], grams[new]


def _mark_rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = pa.StructArray.from_arrays([b.column(0), b.column(1)], ["id", "th"])
            for part, data, offsets in chunks(keys, b.column(2)):
                doc, h = passage_marks(data, offsets, words)
                if len(doc):
                    yield pa.RecordBatch.from_arrays([*part.take(pa.array(doc)).flatten(), pa.array(h.view(np.int64))], ["id", "th", "h"])

    return run


def shared_passages(texts: DataFrame, words: int = PASSAGE_WORDS) -> DataFrame:
    """(id, th, n): how many marks of texts (id, th, text) stand in another row too; rows without any are left out.

    A passage of ``words`` words that two rows share has a mark that both have.  A mark is a run of
    PASSAGE_GRAM words, so shorter shared runs are not found and those between may be.  Rows that
    are equal in id and text are summed."""
    kind = texts.schema["id"].dataType.simpleString()
    marks = texts.transform(arrow_map, _mark_rows(words), f"id {kind}, th long, h long")
    often = marks.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")  # a row has a mark once
    return marks.join(often, "h").groupBy("id", "th").agg(F.count("*").alias("n"))


def _anchor_rows(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = pa.StructArray.from_arrays([b.column(0), b.column(1)], ["id", "th"])
            for part, data, offsets in chunks(keys, b.column(2)):
                a = anchors(data, offsets, span)
                if len(a["doc"]):
                    at = pa.array(a["doc"])
                    yield pa.RecordBatch.from_arrays([part.field(0).take(at), part.field(1).take(at), *(pa.array(a[k]) for k in ("anchor", "print", "start", "count"))], ["id", "th", "anchor", "print", "start", "count"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, [(anchor, print, start, end)] to (anchor, print, bytes)."""
    for b in batches:
        for text, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            yield pa.RecordBatch.from_arrays(
                [pa.array([w["anchor"] for w in wanted], pa.int64()), pa.array([w["print"] for w in wanted], pa.int64()), pa.array([raw[w["start"] : w["end"]] for w in wanted], pa.binary())],
                ["anchor", "print", "segment"],
            )


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """[first, last] of the runs of consecutive starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), starts[np.r_[cut, len(starts) - 1]].tolist(), strict=True))


def _shards(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[tuple[int, int]] = []
        parts: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            rows = [(a, p, lo, hi) for (a, p), s in zip(keys, repeated_starts(parts, span), strict=True) for lo, hi in _runs(s)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["anchor", "print", "lo", "hi"])

        for b in batches:  # sorted by anchor: a shard ends where an anchor's segments end
            for a, p, s in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if size >= SHARD_BYTES and a != keys[-1][0]:
                    yield flush()
                    keys, parts, size = [], [], 0
                keys.append((a, p))
                parts.append(s)
                size += len(s)
        if parts:
            yield flush()

    return run


def _remove(span: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, 1)):
            out: list[list] = [[], [], [], [], [], []]
            for text, runs, marks in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                removed = []
                for r in sorted((r["lo"], r["hi"]) for r in runs or []):
                    if removed and r[0] <= removed[-1][1]:
                        removed[-1][1] = max(removed[-1][1], r[1] + span)
                    else:
                        removed.append([r[0], r[1] + span])
                kept, at = [], 0
                for lo, hi in removed:
                    kept.append(raw[at:lo])
                    at = hi
                left = b"".join([*kept, raw[at:]])
                values = (len(raw), len(raw) - len(left), len(removed), hashlib.sha256(left).hexdigest(), marks or 0, None if text is None or not with_text else left.decode("utf-8", "replace"))
                for c, v in zip(out, values, strict=True):
                    c.append(v)
            kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared_passages", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, with_text: bool = True, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, n_shared_passages, kept_text) for every row of docs.

    Every byte is removed that lies in a string of ``span`` bytes (at least GRAM) which also starts
    elsewhere in docs.  Rows that repeat an id, or a whole row, are documents of their own, so a row
    given twice is repeated.  A null text is empty and its kept_text null; shorter texts lose nothing.
    Where removal cuts a character, kept_text has replacement characters; kept_sha256 is of the bytes.
    n_shared_passages reports, and removes nothing: the marks of passages that another row has too.  It
    is above 0 wherever ``passage_words`` words (A-Z lower-cased, blanks alike) stand in another row,
    which may well be fewer than ``span`` bytes, and 0 where no PASSAGE_GRAM words do.
    Extra columns are not looked at."""
    if not GRAM < span < 65536:
        raise ValueError(f"span must be above {GRAM} and below 65536")
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    found = stored(texts.transform(arrow_map, _anchor_rows(span), f"id {kind}, th long, anchor long, print long, start long, count long"))
    spot = F.shiftleft("start", 16) + F.col("count")  # a segment has at most span strings
    segments = stored(
        found.groupBy("anchor", "print").agg(F.count("*").alias("n"), F.min(F.struct("id", "th", spot.alias("spot"))).alias("at"))
        .select("anchor", "print", "n", F.struct("at.id", "at.th", F.shiftright("at.spot", 16).alias("start")).alias("at"), F.col("at.spot").bitwiseAND(65535).alias("count"))
    )
    several = segments.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor")
    wanted = (
        segments.join(several, "anchor", "left_semi")
        .groupBy(F.col("at.id").alias("id"), F.col("at.th").alias("th"))
        .agg(F.collect_list(F.struct("anchor", "print", F.col("at.start").alias("start"), (F.col("at.start") + F.col("count") - 1 + span).alias("end"))).alias("wanted"))
    )
    fetched = texts.join(wanted, texts["id"].eqNullSafe(wanted["id"]) & (texts["th"] == wanted["th"])).select("text", "wanted").transform(arrow_map, _cut, "anchor long, print long, segment binary")
    marks = (
        fetched.dropDuplicates(["anchor", "print"]).repartition("anchor").sortWithinPartitions("anchor", "print")
        .transform(arrow_map, _shards(span), "anchor long, print long, lo long, hi long")
    )
    copies = segments.where("n > 1").select("anchor", "print", F.lit(0).cast("long").alias("lo"), (F.col("count") - 1).alias("hi"))
    single = segments.where("n = 1").select("anchor", "print")
    marked = copies.unionByName(marks.join(single, ["anchor", "print"], "left_semi"))
    repeats = found.join(marked, ["anchor", "print"]).select("id", "th", F.struct((F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi")).alias("run"))
    runs = (
        repeats.unionByName(shared_passages(texts, passage_words), allowMissingColumns=True)
        .groupBy("id", "th").agg(F.collect_list("run").alias("runs"), F.max("n").alias("marks"))
        .withColumnsRenamed({"id": "rid", "th": "rth"})
    )
    joined = texts.join(runs, F.col("id").eqNullSafe(F.col("rid")) & (F.col("th") == F.col("rth")), "left")
    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared_passages long, kept_text string"
    return joined.select("id", "text", "runs", "marks").transform(arrow_map, _remove(span, with_text), schema).withColumnRenamed("id", id_col)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(load(spark, sf_dir, "documents"), with_text=False).drop("kept_text")
