"""Importance resampling towards a target distribution, on hashed n-grams whose CRCs are composed.

A feature is a run of 1 to ``n`` words joined by one space, and its bucket the CRC-32 of its bytes modulo
``buckets``.  CRC-32 is linear over GF(2): the CRC of ``a + b`` is the CRC of ``a`` moved over as many zero
bytes as ``b`` has, xored with the CRC of ``b``, and moving over 2^j bytes is a fixed 32 x 32 matrix.  So the
bytes of a text are read once, for the CRCs of its words, and an n-gram's CRC comes from the (n-1)-gram's
and the word's by at most one matrix for each bit of the word's length; no n-gram is ever a string.

Corpus and target are counted by bucket in one map each, with a row per bucket and task to be summed.  The
buckets' gains are a table of ``buckets`` integers, which goes to every task of the map that scores the
texts.  Drawing sorts only the rows that reach the lowest drawn score; how many rows have each score is a
table with a row per score, of which there are as many as the gains' range and the noise's allow.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import _LOWER, arrow_map, chunks, fresh, load, numbered, settled, slices, stored

POLYNOMIAL = 0xEDB88320
#: Words of more bytes than this are given to zlib one by one.
LONG = 48
SCORED = "n_words long, n_features long, weight long"


def _byte_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, np.uint32(POLYNOMIAL) ^ (out >> 1), out >> 1).astype(np.uint32)
    return out


_BYTE = _byte_table()


def _times(matrix: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Each value, as a vector of 32 bits, times a matrix given by its images of the four bytes' 256 values."""
    v = values.astype(np.uint32)
    out = matrix[0][v & 255]
    for k in range(1, 4):
        out = out ^ matrix[k][(v >> np.uint32(8 * k)) & 255]
    return out


def _images(columns: np.ndarray) -> np.ndarray:
    """4 x 256: the images of every value of each byte, from those of the 32 bits."""
    values, out = np.arange(256), np.zeros((4, 256), dtype=np.uint32)
    for k in range(4):
        for bit in range(8):
            out[k] ^= np.where(values >> bit & 1, columns[8 * k + bit], np.uint32(0)).astype(np.uint32)
    return out


def _shifts(bits: int = 32) -> list[np.ndarray]:
    """The matrices that move a CRC over 2^j zero bytes, each the square of the one before."""
    unit = np.uint32(1) << np.arange(32, dtype=np.uint32)
    columns, out = _BYTE[unit & 255] ^ (unit >> np.uint32(8)), []
    for _ in range(bits):
        out.append(_images(columns))
        columns = _times(out[-1], columns)
    return out


_SHIFT = _shifts()


def shifted(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRCs moved over ``lengths`` zero bytes."""
    out = crcs.astype(np.uint32, copy=True)
    lengths = np.broadcast_to(lengths, out.shape)
    for j in range(int(lengths.max(initial=0)).bit_length()):
        at = np.flatnonzero(lengths >> j & 1)
        out[at] = _times(_SHIFT[j], out[at])
    return out


def combined(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRCs of texts put together, from the CRCs of both and the length of the second."""
    return shifted(first, length) ^ second.astype(np.uint32)


_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of the words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of lower-cased documents."""
    inside = np.r_[False, _INSIDE[data], False]
    border = np.zeros(len(data) + 1, dtype=bool)
    border[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | border))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | border))
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each word, A-Z taken as a-z: a byte of all words of up to LONG bytes at a time."""
    size = ends - starts
    order = np.argsort(-np.minimum(size, LONG + 1), kind="stable")
    lengths, begin = size[order], starts[order]
    out = np.full(len(starts), 0xFFFFFFFF, dtype=np.uint32)
    many = int(np.searchsorted(-lengths, -LONG, side="left"))
    for k in range(many):
        out[k] = zlib.crc32(_LOWER[data[begin[k] : begin[k] + lengths[k]]].tobytes())
    left = np.searchsorted(-lengths[many:], -np.arange(1, LONG + 1), side="right")
    for k in range(LONG):
        if not left[k]:
            break
        at = slice(many, many + int(left[k]))
        out[at] = _BYTE[(out[at] ^ _LOWER[data[begin[at] + k]]) & 255] ^ (out[at] >> np.uint32(8))
    out[many:] ^= np.uint32(0xFFFFFFFF)
    back = np.empty_like(out)
    back[order] = out
    return back


def features(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, CRC) of all runs of 1 word, then of 2, up to n; documents ascend in each."""
    starts, ends, doc = words(data, offsets)
    single = word_crcs(data, starts, ends)
    yield doc, single
    if n < 2:
        return
    size = ends - starts
    spaced = combined(np.full(len(single), zlib.crc32(b" "), dtype=np.uint32), single, size)
    run = single
    for k in range(2, n + 1):
        if len(run) < 2:
            return
        run = combined(run[:-1], spaced[k - 1 :], size[k - 1 :] + 1)
        whole = doc[: len(run)] == doc[k - 1 :]
        yield doc[: len(run)][whole], run[whole]


def bucket_counts(docs: DataFrame, text_col: str = "text", n: int = 1, buckets: int = 10_000) -> np.ndarray:
    """How many features of all texts fall into each bucket; repeats count, null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for part in slices(b, 0):
                for _, data, offsets in chunks(part.column(0), part.column(0)):
                    for _, crcs in features(data, offsets, n):
                        total += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    counted = docs.select(F.col(f"`{text_col}`").alias("text")).transform(arrow_map, run, "bucket int, n long")
    out = np.zeros(buckets, dtype=np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each of the B buckets, in doubles."""
    s, t, size = corpus.astype(np.float64), target.astype(np.float64), len(corpus)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size)))).astype(np.int64)


def weighed(docs: DataFrame, table: np.ndarray, text_col: str = "text", n: int = 1, keep: list[str] | None = None, name: str = "weighed") -> DataFrame:
    """The columns ``keep`` of every row of docs, all by default, and a struct of n_words, n_features and weight:
    the floored mean of the gains of the text's features, 0 without any."""
    keep = docs.columns if keep is None else keep
    text = fresh("text_", docs)
    shared = docs.sparkSession.sparkContext.broadcast(table)  # an integer for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for b in batches:
            last = b.num_columns - 1
            for part in slices(b, last):
                n_words, n_features, total = ([] for _ in range(3))
                for ids, data, offsets in chunks(part.column(last), part.column(last)):
                    size = len(ids)
                    count, summed, first = np.zeros(size, np.int64), np.zeros(size, np.int64), None
                    for doc, crcs in features(data, offsets, n):
                        edge = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else doc
                        if len(edge):
                            summed[doc[edge]] += np.add.reduceat(gain[crcs % np.uint32(len(gain))], edge)
                            count[doc[edge]] += np.diff(np.r_[edge, len(doc)])
                        first = count.copy() if first is None else first
                    n_words.append(first)
                    n_features.append(count)
                    total.append(summed)
                words_, count, summed = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (n_words, n_features, total))
                weight = np.floor_divide(summed, np.maximum(count, 1))
                made = pa.StructArray.from_arrays([pa.array(words_), pa.array(count), pa.array(weight)], ["n_words", "n_features", "weight"])
                yield pa.RecordBatch.from_arrays([*part.columns[:last], made], [*b.schema.names[:last], name])

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias(text))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop(text).schema), f"`{name}` struct<{SCORED.replace(' long', ': long')}>"])
    return rows.transform(arrow_map, run, schema)


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, n: int = 1, buckets: int = 10_000, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Every row of docs with its columns ``keep``, all by default, and n_words, n_features, weight, score and rank, all long.

    score is the weight plus Gumbel noise of the id and the seed, so the floor(percent * N / 100) highest scores
    of the N rows with at least ``min_words`` words are a draw without replacement by weight; those have a rank
    from 1, ties in score by the smaller id, nulls last, the others null.  Columns of docs by the five names are
    replaced.  A null text has no features; a null id has the noise of an empty one; repeated rows have equal
    scores and ranks of their own, in any order.  An empty target leaves weights that favour rare features;
    an empty table gives an empty result.  The rows kept are written once, compressed."""
    ours = {"n_words", "n_features", "weight", "score", "rank"}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ours]
    table = gains(bucket_counts(docs, text_col, n, buckets), bucket_counts(target, target_col, n, buckets))
    made, noise, key = fresh("made", docs), fresh("noise", docs), fresh("key", docs)
    again = docs.withColumn(key, F.col(f"`{id_col}`"))
    hashed = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    drawn_noise = F.floor(-1000 * F.ln(-F.ln((hashed + 0.5) / F.lit(4294967296.0))))
    rows = stored(
        weighed(again, table, text_col, n, [*keep, key], made)
        .withColumn(noise, drawn_noise)
        .select(*[F.col(f"`{c}`") for c in keep], key, *[F.col(f"{made}.{c}").alias(c) for c in ("n_words", "n_features", "weight")], (F.col(f"{made}.weight") + F.col(noise)).alias("score"))
    )
    may = F.col("n_words") >= min_words
    counts = dict(rows.where(may).groupBy("score").count().collect())  # a row per score; scores are whole numbers within the gains' and the noise's range
    want, above, cut = percent * sum(counts.values()) // 100, 0, None
    for score in sorted(counts, reverse=True):
        if above >= want:
            break
        above, cut = above + counts[score], score
    none = F.lit(None).cast("long")
    if cut is None:
        return rows.drop(key).withColumn("rank", none)
    reach = may & (F.col("score") >= cut)
    same = fresh("same", rows)  # parts what is equal in score and id, so that no range is larger than others
    order = [F.desc("score"), F.asc_nulls_last(key), F.asc(same)]
    sorted_rows = settled(rows.where(reach).withColumn(same, F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order))
    place = fresh("nth", sorted_rows)
    ranked = numbered(sorted_rows, place).withColumn("rank", F.when(F.col(place) < want, F.col(place) + 1)).drop(place, same, key)
    return ranked.unionByName(rows.where(~reach).drop(key).withColumn("rank", none))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of all documents, drawn towards the words of the benchmark's texts."""
    docs = load(spark, sf_dir, "documents")
    return resample(docs, load(spark, sf_dir, "benchmark"), keep=["doc_id"]).select("doc_id", "n_features", "weight", "score", "rank")


#: The CRC of each distinct word by bytes, from a table made by the polynomial's rule.
ORACLE = """WITH crc_table AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
doc_words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
s_word AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM doc_words) GROUP BY word),
t_word AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM benchmark) GROUP BY word),
hexed AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM s_word UNION SELECT word FROM t_word)),
bytes AS (SELECT word, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS b FROM hexed),
bucketed AS (SELECT word, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM bytes, crc_table),
s AS (SELECT bucket, sum(n) AS s FROM s_word JOIN bucketed USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM t_word JOIN bucketed USING (word) GROUP BY bucket),
total AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS big_s, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS big_t),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (big_s + 10000) / ((s + 1)::DOUBLE * (big_t + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), total),
weights AS (SELECT doc_id, count(*) AS n, floor(sum(gain) / count(*)::DOUBLE)::BIGINT AS weight FROM (SELECT doc_id, unnest(w) AS word FROM doc_words) JOIN bucketed USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM documents d LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS nth FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN nth <= (SELECT 10 * count(*) // 100 FROM ranked) THEN nth END AS rank FROM scored LEFT JOIN ranked USING (doc_id)"""
