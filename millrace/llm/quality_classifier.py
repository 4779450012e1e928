"""Quality of texts: random-indexing word vectors, pooled, and a small calibrated network.

A token is a run of letters and digits, A-Z taken as a-z, or a run of one other sign, of which up to three
count; a word in capitals, and one that also stands one or two tokens before, give one more token that says so.
Every token has a sparse random index vector,
drawn from its hash: ``NONZERO`` entries of +1 and -1 in ``DIM`` places.  Its word vector is its own index vector plus
the unit vector of the sum of the index vectors that stood within ``WINDOW`` tokens of it in the training
texts, which is centred on the mean of all words.  Tokens that training met fewer than ``MIN_COUNT`` times
share the vector of the unseen token.  A text is the mean of its tokens' vectors, with its size and how much
of it is unseen beside it; a network of two layers gives a logit, and a temperature, fitted on training
rows that the network has not learned from, turns it into a probability.

The classifier is fitted on a bounded sample of labelled texts: about ``MAX_ROWS`` distinct texts and
``MAX_BYTES`` at most, spread evenly over both labels by a hash of the text and weighted back to the labels'
true shares.  Its vocabulary is bounded by the sample's tokens and by ``MAX_WORDS``.  Scoring reads every
whole text, in a map.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import _LOWER, _SPACE, arrow_map, chunks, fresh, load, mixed, slices, word_hashes

DIM = 128
NONZERO = 8
WINDOW = 2
MIN_COUNT = 3
MAX_ROWS = 10_000
MAX_BYTES = 8_000_000
MAX_WORDS = 25_000
HIDDEN = 24
STEPS = 400
#: Of the sampled texts this share, by their hash, fits the temperature and not the network.
CALIBRATION = 0.2
#: Tokens gathered at a time.
RUN = 50_000

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[0x41:0x5B] = True
_CAPITALS, _AGAIN, _UNSEEN = (int(x) for x in mixed(np.array([0xC0FFEE, 0xA9A1, 0xBEEF], dtype=np.uint64)))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each token of some documents, in order."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    kind = np.where(_WORD[data], np.int16(256), _LOWER[data].astype(np.int16))
    edge = np.r_[True, kind[1:] != kind[:-1]]
    edge[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(edge)
    ends = np.r_[starts[1:], n]
    real = ~_SPACE[data[starts]]
    starts, ends = starts[real], ends[real]
    doc = np.searchsorted(offsets, starts, side="right") - 1
    word = _WORD[data[starts]]
    hashes = word_hashes(data, starts, np.where(word, ends, np.minimum(ends, starts + 3)))
    letters, upper = np.r_[0, np.cumsum(_LETTER[data])], np.r_[0, np.cumsum(_UPPER[data])]
    capital = word & (ends - starts > 1) & (letters[ends] > letters[starts]) & (upper[ends] - upper[starts] == letters[ends] - letters[starts])
    again = np.zeros(len(hashes), dtype=bool)
    for back in (1, 2):
        again[back:] |= word[back:] & (hashes[back:] == hashes[:-back]) & (doc[back:] == doc[:-back])
    times = 1 + capital + again
    out, last = np.repeat(hashes, times), np.cumsum(times) - 1
    out[last[again]] = np.uint64(_AGAIN)
    out[last[capital] - again[capital]] = np.uint64(_CAPITALS)
    return np.repeat(doc, times), out


def index_places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the entries of the index vectors, NONZERO per token."""
    draws = np.stack([mixed(hashes + np.uint64(0x9E3779B97F4A7C15 * (j + 1) % (1 << 64))) for j in range(NONZERO)], axis=1)
    return (draws % np.uint64(DIM)).astype(np.int64), np.where(draws >> np.uint64(63), 1.0, -1.0)


def index_vectors(hashes: np.ndarray) -> np.ndarray:
    places, signs = index_places(hashes)
    out = np.zeros((len(hashes), DIM))
    np.add.at(out, (np.repeat(np.arange(len(hashes)), NONZERO), places.ravel()), signs.ravel())
    return out / np.sqrt(NONZERO)


class Vectors:
    """Sorted hashes of the known tokens, the unseen one last in ``rows``, and their vectors."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        self.keys, self.rows = keys, rows.astype(np.float32)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(hashes), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, len(self.keys))

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """DIM means of the tokens' vectors, ln(1 + tokens), share of unseen tokens, per document; zeros without tokens."""
        size = len(offsets) - 1
        total, seen, n = np.zeros((size, DIM)), np.zeros(size), np.zeros(size)
        doc, hashes = tokens(data, offsets)
        at = self.places(hashes)
        for k in range(0, len(at), RUN):
            of, rows = doc[k : k + RUN], at[k : k + RUN]
            edge = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            total[of[edge]] += np.add.reduceat(self.rows[rows], edge, axis=0, dtype=np.float64)
            n[of[edge]] += np.diff(np.r_[edge, len(of)])
            seen[of[edge]] += np.add.reduceat((rows < len(self.keys)).astype(np.float64), edge)
        times = np.maximum(n, 1)[:, None]
        return np.concatenate([total / times, np.log1p(n)[:, None], np.where(n > 0, n - seen, 0)[:, None] / times], axis=1)


def random_indexing(texts: pa.Array) -> Vectors:
    """The vectors of the tokens of the texts."""
    parts = [tokens(data, offsets) for _, data, offsets in chunks(texts, texts)]
    hashes = np.concatenate([np.zeros(0, np.uint64), *(h for _, h in parts)])
    doc, so_far = [], 0
    for d, _ in parts:
        doc.append(d + so_far)
        so_far += int(d.max(initial=-1)) + 1
    doc = np.concatenate([np.zeros(0, np.int64), *doc])
    keys, use, count = np.unique(hashes, return_inverse=True, return_counts=True)
    often = np.flatnonzero(count >= MIN_COUNT)
    if len(often) > MAX_WORDS:
        often = np.sort(often[np.lexsort((keys[often], -count[often]))[:MAX_WORDS]])
    number = np.full(len(keys), len(often))
    number[often] = np.arange(len(often))
    keys, at = keys[often], number[use]
    own = index_vectors(np.r_[keys, np.uint64(_UNSEEN)])
    places, signs = index_places(np.r_[keys, np.uint64(_UNSEEN)])
    around = np.zeros((len(keys) + 1) * DIM)
    for far in range(1, WINDOW + 1):
        near = doc[far:] == doc[:-far]
        left, right = at[:-far][near], at[far:][near]
        for a, b in ((left, right), (right, left)):
            for j in range(NONZERO):
                around += np.bincount(a * DIM + places[b, j], weights=signs[b, j], minlength=len(around))
    around = around.reshape(-1, DIM)
    around /= np.maximum(np.linalg.norm(around, axis=1, keepdims=True), 1e-12)
    return Vectors(keys, own + around - around.mean(axis=0))


class Network:
    """Two layers over standardised inputs: tanh, then one logit."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = STEPS, decay: float = 1e-4, seed: int = 1):
        r = np.random.default_rng(seed)
        self.mean, self.spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        x = (x - self.mean) / self.spread
        self.layers = [r.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), r.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        first, second = [np.zeros_like(p) for p in self.layers], [np.zeros_like(p) for p in self.layers]
        weight = weight / weight.sum()
        for step in range(1, steps + 1):
            a, b, c, d = self.layers
            h = np.tanh(x @ a + b)
            out = (1 / (1 + np.exp(-np.clip(h @ c + d[0], -30, 30))) - y) * weight
            back = out[:, None] * c * (1 - h * h)
            grads = [x.T @ back + decay * a, back.sum(axis=0), h.T @ out + decay * c, np.array([out.sum()])]
            for p, g, m, v in zip(self.layers, grads, first, second, strict=True):
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                p -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.tanh(((x - self.mean) / self.spread) @ a + b) @ c + d[0]


def temperature(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The divisor of the logits, from 1/2 to 20, with the least weighted log loss, by golden section over its
    logarithm.  Rows that are all told apart would ask for none, and for scores of 0 and 1 alone: hence the 1/2."""

    def loss(t: float) -> float:
        z = logits / np.exp(t)
        return float((weight * (np.logaddexp(0, z) - y * z)).sum())

    low, high, ratio = np.log(0.5), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


class Model:
    """vectors, network and temperature; without a network every score is ``base``."""

    def __init__(self, vectors: Vectors | None, network: Network | None, heat: float, base: float):
        self.vectors, self.network, self.heat, self.base = vectors, network, heat, base

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.network is None:
            return np.full(len(offsets) - 1, self.base)
        return 1 / (1 + np.exp(-np.clip(self.network.logits(self.vectors.pooled(data, offsets)) / self.heat, -700, 700)))


def fitted(texts: pa.Array, good: np.ndarray, weight: np.ndarray, held: np.ndarray) -> Model:
    """The model of sampled texts; ``held`` marks those that only fit the temperature."""
    if not len(good) or good.all() or not good.any():
        return Model(None, None, 1.0, float((good * weight).sum() / weight.sum()) if len(good) else 0.5)
    vectors = random_indexing(texts)
    x = np.concatenate([vectors.pooled(data, offsets) for _, data, offsets in chunks(texts, texts)])
    y, own = good.astype(np.float64), ~held
    if len(np.unique(good[own])) < 2 or len(np.unique(good[held])) < 2:
        return Model(vectors, Network(x, y, weight), 1.0, 0.5)
    network = Network(x[own], y[own], weight[own])
    return Model(vectors, network, temperature(network.logits(x[held]), y[held], weight[held]), 0.5)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """The model of the documents that labels names; label 1 is good, any other is not, a null teaches nothing.

    A text teaches once for each label it has, however often it or its label is repeated; null texts
    teach nothing.  First only ids, labels and prints of texts meet; the texts of the sample come after."""
    said = labels.select(F.col(f"`{id_col}`").alias("id"), (F.col(f"`{label_col}`") == 1).alias("good")).where("id is not null and good is not null").distinct()
    text = F.col(f"`{text_col}`")
    prints = docs.where(text.isNotNull()).select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("print"), F.octet_length(text).alias("bytes")).distinct()
    taught = prints.join(said, "id").groupBy("print", "good").agg(F.max("bytes").alias("bytes"))
    per = {r["good"]: r for r in taught.groupBy("good").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).collect()}  # two rows at most
    share = {g: min(1.0, max_rows / 2 / r["n"], max_bytes / 2 / max(r["bytes"], 1)) for g, r in per.items()}
    keep = F.when(F.col("good"), share.get(True, 0.0)).otherwise(share.get(False, 0.0))
    chance = F.pmod(F.xxhash64("print"), F.lit(1 << 30)) / float(1 << 30)
    sample = F.broadcast(taught.where(chance < keep).select("print", "good"))  # max_rows or so
    texts = docs.where(text.isNotNull()).select(F.xxhash64(text).alias("print"), text.alias("text")).join(sample, "print")
    got = texts.groupBy("print", "good").agg(F.first("text").alias("text")).orderBy("print", "good").toArrow().combine_chunks()
    good = got.column("good").to_numpy().astype(bool)
    prints_of = got.column("print").to_numpy().view(np.uint64)
    weight = np.where(good, 1 / share.get(True, 1.0), 1 / share.get(False, 1.0))
    held = (mixed(prints_of) % np.uint64(1000)).astype(np.int64) < int(CALIBRATION * 1000)
    column = got.column("text").combine_chunks() if got.num_rows else pa.array([], pa.string())
    return fitted(column, good, weight, held)


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns ``keep`` of every row of docs, all by default, and the probability that its label is 1.

    Only the text is read, so repeated rows get equal scores; a null text is empty, and texts without a token
    share one score.  A column of docs called like the score is replaced."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != name.lower()]
    text = fresh("text_", docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            last = b.num_columns - 1
            for part in slices(b, last):
                found = [shared.value.scores(data, offsets) for _, data, offsets in chunks(part.column(last), part.column(last))]
                yield pa.RecordBatch.from_arrays([*part.columns[:last], pa.array(np.concatenate([np.zeros(0), *found]))], [*b.schema.names[:last], name])

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias(text))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop(text).schema), f"`{name}` double"])
    return rows.transform(arrow_map, run, schema)


def held_out(id_col: str = "doc_id", parts: int = 3, part: int = 1) -> Column:
    """Whether crc32 of the id as text leaves ``part``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % parts == part


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    model = fit(docs.where(~held_out()), labels.where(~held_out()))
    return score(docs, model, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
