"""SentencePiece encoding and decoding by suffix-array matching.

A batch's distinct words are concatenated and indexed by a suffix array (sorted only as deep as the
longest piece).  Every piece is binary-searched for its range of occurrences; each occurrence is an
edge between two positions.  The edges are sorted by position and relaxed from left to right: a
position's last piece is the one whose edge starts at a reached position and may stand beside that
position's last piece.

The model is byte-pair: pieces merge best score first, leftmost first, so of all paths over the edges
exactly one is the encoding, the one whose neighbouring pieces would not have merged across their
common border (``Pieces.stable``).  Pieces never cross from other characters into a space mark, so
words can be encoded apart, and so can the segments of a word between borders that no occurrence of a
piece crosses; all segments of a batch are relaxed at once, so a long word takes as many steps as its
longest segment has characters.  Words beyond ``INDEX_CHARS`` are indexed in parts, cut where two
characters meet that stand side by side in no piece.  Characters outside the vocabulary fall back to their bytes.

The vocabulary file is a parameter.  It is read on the driver and reaches the tasks with the code;
its size is that of a vocabulary whatever the data.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import arrow_map, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NEVER = np.iinfo(np.int32).max
INDEX_CHARS = 600_000
CACHE_WORDS = 700_000
CACHE_CHARS = 16_000_000


class Pieces:
    """The tables of a byte-pair model: ids, pieces, ranks, and the last merge of each piece."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces):
            raise ValueError("only byte-pair models with the identity normalizer are known here")
        self.size = len(model.pieces)
        self.bytes_ids = np.full(256, -1, dtype=np.int32)
        self.decoded: list[bytes] = []
        text: dict[str, int] = {}
        scores = {}
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                self.bytes_ids[int(p.piece[3:5], 16)] = i
                self.decoded.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == 1:
                text[p.piece], scores[p.piece] = i, p.score
                self.decoded.append(p.piece.replace(MARK, " ").encode())
            else:
                self.decoded.append(b" \xe2\x81\x87 " if p.type == 2 else b"")
        if any(MARK in p.lstrip(MARK) for p in text):
            raise ValueError("a piece goes across a space mark")
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        rank = {p: order[s] for p, s in scores.items()}
        left, right, self.rank = (np.full(self.size, x, dtype=np.int32) for x in (-1, -1, NEVER))
        self.pieces: list[str] = []
        ids: list[int] = []
        joins = []
        for p, i in text.items():
            if len(p) > 1:
                if (last := _last_merge(p, rank)) is None:
                    continue  # merging never makes this piece
                left[i], right[i], self.rank[i] = text[last[0]], text[last[1]], rank[p]
                joins.append((text[last[0]] * self.size + text[last[1]], rank[p]))
            self.pieces.append(p)
            ids.append(i)
        self.ids, self.left, self.right = np.array(ids, dtype=np.int32), left, right
        joins.sort()
        self.join_key, self.join_rank = np.array([k for k, _ in joins], dtype=np.int64), np.array([r for _, r in joins], dtype=np.int32)
        letters = sorted({c for p in self.pieces for c in p})
        self.letter = np.zeros(0x110000, dtype=np.int32)  # 0: not in the vocabulary
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.n_letters = len(letters)
        self.per_key = 62 // (len(letters) + 2).bit_length()  # characters that one sort key holds
        self.width = max(map(len, self.pieces))
        self.lengths = np.array([len(p) for p in self.pieces], dtype=np.int32)
        self.codes = np.zeros((len(self.pieces), self.width), dtype=np.int32)  # 0: past the end
        of = {c: k + 1 for k, c in enumerate(letters)}
        for row, p in enumerate(self.pieces):
            self.codes[row, : len(p)] = [of[c] for c in p]
        inside = self.codes[:, 1:] > 0
        self.beside = np.unique(self._pair(self.codes[:, :-1][inside], self.codes[:, 1:][inside]))  # letters side by side in a piece
        self.by_line = not any("\n" in p for p in self.pieces)

    def _pair(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return one.astype(np.int64) * (self.n_letters + 2) + two

    def parts(self, word: str, most: int) -> list[str]:
        """The word in parts of at most ``most`` characters, if there are borders for that which no piece can cross."""
        if len(word) <= most:
            return [word]
        codes = self.letter[np.frombuffer(word.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        key = self._pair(codes[:-1], codes[1:])
        at = np.minimum(np.searchsorted(self.beside, key), len(self.beside) - 1)
        free = np.r_[np.flatnonzero(self.beside[at] != key) + 1, len(word)]
        out, begin = [], 0
        while begin < len(word):
            k = max(int(np.searchsorted(free, begin + most, side="right")) - 1, 0)
            end = int(free[k]) if free[k] > begin else int(free[np.searchsorted(free, begin, side="right")])
            out.append(word[begin:end])
            begin = end
        return out

    def stable(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether pieces one and two stay apart when they stand side by side.

        Walks back through the symbols that met at their border while they were being made: they would
        have merged if their join ranks before the next merge on either side; of equal ranks the left
        one is made first.  A negative piece (bytes, or a border of the text) merges with nothing."""
        out = np.ones(len(one), dtype=bool)
        live = np.flatnonzero((one >= 0) & (two >= 0))
        a, b = one[live].astype(np.int64), two[live].astype(np.int64)
        end_a, end_b = np.full(len(live), NEVER), np.full(len(live), NEVER)
        while len(live):
            key = a * self.size + b
            at = np.minimum(np.searchsorted(self.join_key, key), len(self.join_key) - 1)
            joins = np.where(self.join_key[at] == key, self.join_rank[at], NEVER)
            merged = (joins < NEVER) & (joins < end_a) & (joins <= end_b)
            out[live[merged]] = False
            rank_a, rank_b = self.rank[a], self.rank[b]
            # go back over the later of the two merges; a single character has none
            made_a, made_b = np.where(rank_a == NEVER, -1, rank_a), np.where(rank_b == NEVER, -1, rank_b)
            back_b = made_b >= made_a
            end_b = np.where(back_b, made_b, end_b)
            end_a = np.where(back_b, end_a, made_a)
            go = ~merged & (np.maximum(made_a, made_b) >= 0)
            b = np.where(back_b, self.left[b], b)
            a = np.where(back_b, a, self.right[a])
            live, a, b, end_a, end_b = live[go], a[go], b[go], end_a[go], end_b[go]
        return out


def _last_merge(piece: str, rank: dict[str, int]) -> tuple[str, str] | None:
    parts = list(piece)
    while len(parts) > 2:
        best = min(((rank[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in rank), default=None)
        if best is None:
            return None
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 and parts[0] in rank and parts[1] in rank else None


@lru_cache(maxsize=2)
def pieces_at(path: str) -> Pieces:
    return Pieces(path)


def suffix_order(codes: np.ndarray, depth: int, at_once: int, bits: int) -> np.ndarray:
    """Positions of codes in the order of their suffixes, compared to ``depth`` at least.

    The first key packs ``at_once`` codes; after that each sort doubles the depth through the ranks."""
    n = len(codes)
    key = np.zeros(n, dtype=np.int64)
    for k in range(at_once):
        key <<= bits
        key[: max(n - k, 0)] |= codes[k:]
    step = at_once
    while True:
        order = np.argsort(key)
        if step >= depth or n < 2:
            return order
        ordered = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.r_[0, np.cumsum(ordered[1:] != ordered[:-1])]
        key = rank * (n + 1)
        key[: max(n - step, 0)] += rank[step:] + 1
        step *= 2


def _occurrences(p: Pieces, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, row of piece) of every occurrence of every piece."""
    order = suffix_order(codes, p.width, p.per_key, 62 // p.per_key).astype(np.int32)
    padded = np.r_[codes, np.zeros(p.width, dtype=codes.dtype)]
    ranges = []
    for upper in (False, True):
        lo, hi = np.zeros(len(p.pieces), dtype=np.int32), np.full(len(p.pieces), len(order), dtype=np.int32)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) // 2
            suffix = padded[order[mid][:, None] + np.arange(p.width)]
            piece = p.codes[open_]
            diff = np.where(piece > 0, suffix - piece, 0)  # a longer suffix that begins with the piece counts as equal
            first = np.argmax(diff != 0, axis=1)
            sign = diff[np.arange(len(open_)), first]
            go = (sign <= 0) if upper else (sign < 0)
            lo[open_] = np.where(go, mid + 1, lo[open_])
            hi[open_] = np.where(go, hi[open_], mid)
        ranges.append(lo)
    count = ranges[1] - ranges[0]
    row = np.repeat(np.arange(len(p.pieces), dtype=np.int32), count)
    at = order[np.arange(len(row), dtype=np.int32) + np.repeat(ranges[0] - (np.cumsum(count) - count).astype(np.int32), count)]
    return at, row


def encode_words(p: Pieces, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets): the ids of each word, one after another."""
    if not words:
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    begin = np.cumsum(size + 1) - size - 1  # a 0 stands after each word
    points = np.frombuffer(("\0".join(words) + "\0").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = begin + size
    codes = p.letter[points]
    codes[ends] = 0
    known = codes > 0
    codes[~known] = p.n_letters + 1
    pos, row = _occurrences(p, codes)
    foreign = np.ones(len(points), dtype=bool)
    foreign[ends] = False
    foreign = np.flatnonzero(foreign & ~known)
    start = np.r_[pos, foreign.astype(np.int32)]
    token = np.r_[p.ids[row], (-2 - foreign).astype(np.int32)]
    stop = np.r_[pos + p.lengths[row], (foreign + 1).astype(np.int32)]
    # How many occurrences cross the border before each character; none does at either side of a word.
    crossed = np.cumsum(np.bincount(start + 1, minlength=len(points) + 2)[: len(points)] - np.bincount(stop, minlength=len(points) + 2)[: len(points)])
    free = np.flatnonzero(crossed == 0)
    segment = np.ones(len(points), dtype=bool)
    segment[ends] = False
    segment = segment[free]
    first, after = free[segment], np.r_[free[1:], len(points)][segment]
    home = np.zeros(len(points), dtype=np.int32)
    home[free] = free
    home = np.maximum.accumulate(home)
    longest = int((after - first).max(initial=0))
    offset = (start - home[start]).astype(np.uint16 if longest < 65536 else np.int32)
    by = np.argsort(offset, kind="stable")  # edges by their position in the segment
    start, token, stop = start[by], token[by], stop[by]
    cuts = np.searchsorted(offset[by], np.arange(longest + 1))
    last = np.full(len(points) + 1, NEVER, dtype=np.int32)  # NEVER: not reached
    back = np.zeros(len(points) + 1, dtype=np.int32)
    for k, (lo, hi) in enumerate(zip(cuts, np.r_[cuts[1:], len(start)], strict=True)):  # all segments at once, by the place in them
        s, t, e = start[lo:hi], token[lo:hi], stop[lo:hi]
        if k:
            reached = last[s] != NEVER
            s, t, e = s[reached], t[reached], e[reached]
            ok = p.stable(last[s], t)
            s, t, e = s[ok], t[ok], e[ok]
        last[e], back[e] = t, s
    which, cur = np.arange(len(first)), after.copy()
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while len(which):
        found.append((which, last[cur]))
        cur = back[cur]
        going = cur > first[which]
        which, cur = which[going], cur[going]
    if not found:
        return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
    word = np.concatenate([w for w, _ in found][::-1])
    token = np.concatenate([t for _, t in found][::-1])
    by = np.argsort(word, kind="stable")
    word, token = (np.searchsorted(begin, first, side="right") - 1)[word[by]], token[by]
    if (token < 0).any():  # bytes instead of a character
        raw = [chr(points[-2 - t]).encode("utf-8", "surrogatepass") if t < 0 else None for t in token]
        reps = np.array([1 if r is None else len(r) for r in raw])
        word = np.repeat(word, reps)
        token = np.concatenate([[t] if r is None else p.bytes_ids[list(r)] for t, r in zip(token, raw, strict=True)])
    return token.astype(np.int32), np.r_[0, np.cumsum(np.bincount(word, minlength=len(words)))]


class Encoder:
    """Encodes texts through their distinct words; keeps the words' ids for later batches, up to a bound."""

    kept: Encoder | None = None

    @classmethod
    def of(cls, p: Pieces) -> Encoder:
        """The encoder of this process: a worker's later tasks go on with the words of its earlier ones."""
        if cls.kept is None or cls.kept.p is not p:
            cls.kept = cls(p)
        return cls.kept

    def __init__(self, p: Pieces):
        self.p = p
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.chars = 0
        self.flat, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def words(self, text: str) -> list[str]:
        out: list[str] = []
        lines = text.split("\n") if self.p.by_line else [text]
        for k, line in enumerate(lines):
            if k:
                out.append("\n")
            elif not text:
                return out
            else:
                line = " " + line
            if "  " in line or MARK in line:
                out += re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", line.replace(" ", MARK))
            else:
                some = line.replace(" ", " " + MARK).split(" ")
                out += some if some[0] else some[1:]
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts; a null or empty text has no ids."""
        if len(self.index) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self.clear()
        index, fresh = self.index, []
        split = [self.words(t) if t else [] for t in texts]
        for words in split:
            for w in set(words).difference(index):
                index[w] = len(index)
                fresh.append(w)
        flats, counts, part, chars = [self.flat], [np.diff(self.offsets)], [], 0

        def flush(words: list[str]) -> None:
            ids, offsets = encode_words(self.p, words)
            flats.append(ids)
            counts.append(np.diff(offsets))

        for w in fresh:
            self.chars += len(w)
            if len(w) > INDEX_CHARS:
                flush(part)
                pieces = [encode_words(self.p, [x])[0] for x in self.p.parts(w, INDEX_CHARS)]
                flats += pieces
                counts.append(np.array([sum(map(len, pieces))]))
                part, chars = [], 0
                continue
            part.append(w)
            chars += len(w) + 1
            if chars >= INDEX_CHARS:
                flush(part)
                part, chars = [], 0
        flush(part)
        self.flat = np.concatenate(flats)
        self.offsets = np.r_[0, np.cumsum(np.concatenate(counts))]
        n_words = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        use = np.fromiter(map(index.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=int(n_words.sum()))
        size = self.offsets[use + 1] - self.offsets[use]
        total = np.cumsum(size)
        at = np.arange(int(size.sum())) - np.repeat(total - size - self.offsets[use], size)
        bounds = np.r_[0, np.cumsum(n_words)]
        return self.flat[at], np.r_[0, total][bounds]


def decode_ids(p: Pieces, ids: list[int] | None) -> str | None:
    """The text of the ids, without the space that encoding put first; null stays null."""
    if ids is None:
        return None
    raw = b"".join(map(p.decoded.__getitem__, ids))
    if ids and p.decoded[ids[0]][:1] == b" ":
        raw = raw[1:]
    return raw.decode("utf-8", "replace")


_LIST = pa.list_(pa.int32())


def _map(docs: DataFrame, id_col: str, text_col: str, model: str, columns: str, make) -> DataFrame:
    p = pieces_at(model)
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(p)  # a vocabulary, of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(shared.value)
        for b in batches:
            for part in slices(b, 1, 4_000_000):
                yield make(encoder, part)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.transform(arrow_map, run, f"id {kind}, {columns}").withColumnRenamed("id", id_col)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """One row per row of docs: id, ``ids`` array<int>.  A null text has null ids, an empty one none."""

    def make(encoder: Encoder, b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column(1).to_pylist()
        flat, offsets = encoder.encode(texts)
        ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat), mask=pa.array([t is None for t in texts]))
        return pa.RecordBatch.from_arrays([b.column(0), ids.cast(_LIST)], ["id", "ids"])

    return _map(docs, id_col, text_col, model, "ids array<int>", make)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """One row per row of encoded: id, ``text``.  Null ids give a null text; an unknown id is an error."""
    p = pieces_at(model)
    shared = encoded.sparkSession.sparkContext.broadcast(p)
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([decode_ids(shared.value, x) for x in b.column(1).to_pylist()], pa.string())], ["id", "text"])

    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).transform(arrow_map, run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def encode_checked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """encode(), and in the same map decode and compare: id, n_tokens long, ids array<int>, round_trip boolean.

    A null text has null ids, 0 tokens and a true round trip.  A space mark in a text comes back as a
    space, so such a text's round trip is false, as the model has it."""

    def make(encoder: Encoder, b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column(1).to_pylist()
        flat, offsets = encoder.encode(texts)
        same = []
        for t, lo, hi in zip(texts, offsets, offsets[1:], strict=False):
            same.append(t is None or decode_ids(encoder.p, flat[lo:hi].tolist()) == t)
        ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat), mask=pa.array([t is None for t in texts]))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offsets)), ids.cast(_LIST), pa.array(same)], ["id", "n_tokens", "ids", "round_trip"])

    return _map(docs, id_col, text_col, model, "n_tokens long, ids array<int>, round_trip boolean", make)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_checked(spark.read.parquet(f"{sf_dir}/documents.parquet"))
