"""Language-model scoring with a hashed maximum-entropy model.

P(word | history) = P(class | history) P(word | class).  The class of a frequent word is its place in
bins of equal mass, that of other words a hash of their ending; the end of a text is a class.  The
class softmax has hashed features of the history: the last word, the last two words, and the words
two and three back (skips).  In a class only the unigram feature is used, whose maximum-entropy
solution is the (add-one) relative frequency, so no softmax over the words is needed.

Training goes over every training document once, in disjoint slices, one a round.  In a round each task
takes AdaGrad steps from the common weights over its documents, in sparse numpy batches; the tasks'
changes are averaged, each row of weights by how often the tasks used it, and become the common
weights.  A task's steps start anew each round, which costs; averaging late costs more the more tasks
there are.  So there is one round for one task and half as many as tasks for several, up to ROUNDS.
Changes are summed in a stream, a block of rows at a time; the driver gets one sum per block.

Word counts are exact over all training documents.  Words are known by 64-bit hashes of their bytes.
The most frequent words, up to HEAD, are looked up in the map; the others are few per document and get their
counts by a shuffle join, in which no key can be hot because the hot words are in the head.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import arrow_map, _LOWER, chunks, load, mixed, settled, word_hashes, words_of

HEAD = 200_000
HEAD_CLASSES = 23
RARE_CLASSES = 8
CLASSES = HEAD_CLASSES + RARE_CLASSES + 1
END = CLASSES - 1
BUCKETS = 4096
FEATURES = 4
BLOCK_ROWS = 64
BATCH = 32_768
ROUNDS = 8
RATE = 0.3
KEPT_WORDS = 400_000


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, word hash, rare class) of each word; without the ends of texts."""
    starts, ends, doc = words_of(data, offsets)
    h = word_hashes(data, starts, ends)
    low, tail = _LOWER[data], np.zeros(len(starts), dtype=np.uint64)
    for k in range(1, 4):
        at = ends - k
        tail = tail * np.uint64(257) + np.where(at >= starts, low[np.maximum(at, 0)], 0).astype(np.uint64) + np.uint64(1)
    return doc, h, (HEAD_CLASSES + mixed(tail) % np.uint64(RARE_CLASSES)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: tuple[np.ndarray, ...] = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def rows(x: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1]), pa.array(x[2])], ["h", "cls", "n"])

    for b in batches:
        for _, data, offsets in chunks(b.column(0), b.column(1)):
            _, h, rare = tokens(data, offsets)
            all_h, all_c, all_n = np.r_[kept[0], h], np.r_[kept[1], rare], np.r_[kept[2], np.ones(len(h), np.int64)]
            by = np.argsort(all_h)
            first = np.flatnonzero(np.r_[True, all_h[by][1:] != all_h[by][:-1]][: len(by)])
            kept = (all_h[by][first], all_c[by][first], np.add.reduceat(all_n[by], first) if len(first) else all_n)
            if len(kept[0]) > KEPT_WORDS:
                yield rows(kept)
                kept = tuple(x[:0] for x in kept)
    yield rows(kept)


class Model:
    """Bounded by its parameters: HEAD words, CLASSES classes, FEATURES * BUCKETS rows of weights."""

    def __init__(self, head_h: np.ndarray, head_n: np.ndarray, texts: int):
        by = np.argsort(-head_n, kind="stable")
        mass = np.cumsum(head_n[by]) - head_n[by]
        cls = np.empty(len(by), dtype=np.int64)
        cls[by] = np.minimum(mass * HEAD_CLASSES // max(int(head_n.sum()), 1), HEAD_CLASSES - 1)
        order = np.argsort(head_h)
        self.head, self.head_n, self.head_cls = head_h[order], head_n[order], cls[order]
        self.texts = texts
        self.class_n, self.class_v = np.zeros(CLASSES), np.zeros(CLASSES)
        self.bias = np.zeros(CLASSES, dtype=np.float32)
        self.weights = np.zeros((FEATURES * BUCKETS, CLASSES), dtype=np.float32)

    def found(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the head, whether it is there) of each hash."""
        if not len(self.head):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.head, h), len(self.head) - 1)
        return at, self.head[at] == h

    def with_ends(self, doc: np.ndarray, h: np.ndarray, cls: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class of each token, the end of each text included, its document, and the rows of its features."""
        sizes = np.bincount(doc, minlength=docs)
        ends = np.cumsum(sizes + 1) - 1
        n = len(h) + docs
        is_end = np.zeros(n, dtype=bool)
        is_end[ends] = True
        y, word = np.full(n, END, dtype=np.int64), np.zeros(n, dtype=np.uint64)
        y[~is_end], word[~is_end] = cls, h
        of = np.repeat(np.arange(docs), sizes + 1)
        nth = np.arange(n) - np.repeat(ends - sizes, sizes + 1)
        back = []
        for k in (1, 2, 3):
            w = np.full(n, np.uint64(0xA0761D6478BD642F + k))
            w[k:] = np.where(nth[k:] >= k, word[:-k], w[k:]) if n > k else w[k:]
            back.append(w)
        both = mixed(back[0] * np.uint64(3) + back[1])
        rows = np.stack([(mixed(x + np.uint64(f)) % np.uint64(BUCKETS)).astype(np.int32) + f * BUCKETS for f, x in enumerate((back[0], both, back[1], back[2]))])
        return y, of, rows

    def shares(self, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        z = weights[rows[0]] + self.bias
        for f in range(1, FEATURES):
            z += weights[rows[f]]
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        return z


def _train(shared) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        w = model.weights.copy()
        squares, uses = np.full_like(w, 1e-2), np.zeros(len(w), dtype=np.float32)
        for b in batches:
            for _, data, offsets in chunks(b.column(0), b.column(1)):
                doc, h, cls = tokens(data, offsets)
                at, known = model.found(h)
                y, _, rows = model.with_ends(doc, h, np.where(known, model.head_cls[at] if len(model.head) else 0, cls), len(offsets) - 1)
                for k in range(0, len(y), BATCH):
                    part, target = rows[:, k : k + BATCH], y[k : k + BATCH]
                    g = model.shares(part, w)
                    g[np.arange(len(target)), target] -= 1
                    for f in range(FEATURES):
                        row = (part[f] - f * BUCKETS).astype(np.uint16)
                        by = np.argsort(row, kind="stable")
                        first = np.flatnonzero(np.r_[True, row[by][1:] != row[by][:-1]])
                        n = np.diff(np.r_[first, len(by)]).astype(np.float32)
                        mean = np.add.reduceat(g[by], first, axis=0) / n[:, None]
                        touched = part[f][by[first]]
                        squares[touched] += mean * mean
                        w[touched] -= RATE * mean / np.sqrt(squares[touched]) * np.minimum(1, n / 8)[:, None]
                        uses[touched] += n
        delta = (w - model.weights) * uses[:, None]
        blocks = np.flatnonzero(uses.reshape(-1, BLOCK_ROWS).any(axis=1))
        if len(blocks):
            cube, used = delta.reshape(-1, BLOCK_ROWS * CLASSES), uses.reshape(-1, BLOCK_ROWS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks.astype(np.int32)), pa.array([cube[i].tobytes() for i in blocks], pa.binary()), pa.array([used[i].tobytes() for i in blocks], pa.binary())], ["block", "delta", "uses"]
            )

    return run


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, list[np.ndarray]] = {}
    for b in batches:
        for block, delta, uses in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            one = [np.frombuffer(delta, np.float32).astype(np.float64), np.frombuffer(uses, np.float32).astype(np.float64)]
            sums[block] = [x + y for x, y in zip(sums[block], one, strict=True)] if block in sums else one
    if sums:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([x[0].tobytes() for x in sums.values()], pa.binary()), pa.array([x[1].tobytes() for x in sums.values()], pa.binary())], ["block", "delta", "uses"]
        )


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows of counts with the largest n, at most ``most``, without those that share the last one's step
    of n.  Steps are sixteenths of an octave, single numbers up to 22; the driver sees one row per step, and
    no task sends more than what is kept in the end."""
    step = F.floor(F.log2("n") * 16)
    taken, lowest = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("k"), F.min("n").alias("n")).collect(), key=lambda r: -r["step"]):
        if (taken := taken + r["k"]) > most:
            break
        lowest = r["n"]
    return counts.where("false") if lowest is None else counts.where(F.col("n") >= lowest)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int | None = None) -> tuple[Model, DataFrame, int, int]:
    """(model, counts (h, cls, n) of all training words, N, V) of a table of training texts.

    Null texts are empty ones.  N and V count the end of a text as a token.  Without documents all is 0."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    counts = settled(texts.transform(arrow_map, _count, "h long, cls long, n long").groupBy("h").agg(F.min("cls").alias("cls"), F.sum("n").alias("n")))
    n_texts = docs.count()
    head = frequent(counts, HEAD).select("h", "cls", "n").toArrow().to_pandas()  # HEAD rows at most
    model = Model(head["h"].to_numpy(np.int64).view(np.uint64), head["n"].to_numpy(np.int64), n_texts)
    sums = counts.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()  # a row per rare class
    for r in sums:
        model.class_n[r["cls"]], model.class_v[r["cls"]] = r["n"], r["v"]
    total, distinct = int(model.class_n.sum()) + n_texts, int(model.class_v.sum()) + (n_texts > 0)
    # words of the head leave the rare class of their ending
    model.class_n -= np.bincount(head["cls"], weights=head["n"], minlength=CLASSES)
    model.class_v -= np.bincount(head["cls"], minlength=CLASSES)
    model.class_n[:HEAD_CLASSES] = np.bincount(model.head_cls, weights=model.head_n, minlength=HEAD_CLASSES)
    model.class_v[:HEAD_CLASSES] = np.bincount(model.head_cls, minlength=HEAD_CLASSES)
    model.class_n[END], model.class_v[END] = n_texts, n_texts > 0
    model.bias = np.log((model.class_n + 1) / (model.class_n + 1).sum()).astype(np.float32)
    rounds = rounds or max(1, min(ROUNDS, texts.rdd.getNumPartitions() // 2))
    for r in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        part = texts.where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == r)
        changes = part.transform(arrow_map, _train(shared), "block int, delta binary, uses binary").repartition("block").transform(arrow_map, _sum_blocks, "block int, delta binary, uses binary").collect()
        model.weights = model.weights.copy()
        cube = model.weights.reshape(-1, BLOCK_ROWS, CLASSES)
        for c in changes:  # one row per block at most
            uses = np.frombuffer(c["uses"], np.float64)
            cube[c["block"]] += (np.frombuffer(c["delta"], np.float64).reshape(BLOCK_ROWS, CLASSES) / np.maximum(uses, 1)[:, None]).astype(np.float32)
    return model, counts, total, distinct


def _score(shared) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        normal = np.log10(model.class_n + model.class_v + 1)
        logs = np.log10(model.head_n + 1.0)
        for b in batches:
            for ids, data, offsets in chunks(b.column(0), b.column(1)):
                docs = len(offsets) - 1
                doc, h, cls = tokens(data, offsets)
                at, known = model.found(h)
                y, of, rows = model.with_ends(doc, h, np.where(known, model.head_cls[at] if len(model.head) else 0, cls), docs)
                classes = np.zeros(docs)
                for k in range(0, len(y), BATCH):
                    target = y[k : k + BATCH]
                    p = model.shares(rows[:, k : k + BATCH], model.weights)[np.arange(len(target)), target]
                    classes += np.bincount(of[k : k + BATCH], weights=np.log10(np.maximum(p, 1e-30)) - normal[target], minlength=docs)
                end = np.log10(model.texts + 1.0)
                seen = np.bincount(doc[known], weights=logs[at[known]], minlength=docs) + end
                n_known = np.bincount(doc[known], minlength=docs) + (model.texts > 0)
                d, t = doc[~known], h[~known]
                by = np.lexsort((t, d))
                d, t = d[by], t[by]
                first = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (d[1:] != d[:-1])][: len(t)])
                times = np.diff(np.r_[first, len(t)]).astype(np.int32)
                item = pa.StructArray.from_arrays([pa.array(t[first].view(np.int64)), pa.array(times)], ["h", "times"])
                rest = pa.ListArray.from_arrays(pa.array(np.searchsorted(d[first], np.arange(docs + 1)).astype(np.int32)), item)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.bincount(of, minlength=docs)), pa.array(n_known.astype(np.int64)), pa.array(seen), pa.array(classes), rest], ["id", "n_tokens", "n_known", "seen", "classes", "rest"]
                )

    return run


def score_texts(docs: DataFrame, fitted: tuple[Model, DataFrame, int, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for every row of docs, scores in log10.

    Words are runs of characters other than ``[\\x20\\x09-\\x0D]``, A-Z lower-cased; each text has an end
    token, so a null or empty one has one token.  Rows that repeat an id are scored apart.  Extra
    columns are not looked at."""
    model, counts, total, distinct = fitted
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    scored = settled(
        texts.transform(arrow_map, _score(shared), f"id {kind}, n_tokens long, n_known long, seen double, classes double, rest array<struct<h:long,times:int>>").withColumn("row", F.monotonically_increasing_id())
    )
    rest = scored.select("row", F.explode("rest").alias("r")).select("row", "r.h", "r.times")
    more = rest.join(counts.select("h", "n"), "h").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"), F.sum("times").alias("known"))
    out = scored.drop("rest").join(more, "row", "left")
    seen = F.col("seen") + F.coalesce("more", F.lit(0.0))
    return out.select(
        F.col("id").alias(id_col), "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (seen - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))).alias("base_score"), (F.col("classes") + seen).alias("score"),
    )


def held_out(id_col: str = "doc_id", parts: int = 7, part: int = 2):
    """Whether crc32 of the id as text leaves ``part``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % parts == part


def op7_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    fitted = fit(docs.where(~held_out()))
    return score_texts(docs, fitted).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
