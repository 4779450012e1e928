"""Full-text search over a stored table of positions, ranked by how close the words of a query stand.

``write`` tokenises the documents once.  A posting is (term, doc_id, title, body): the places of a term in the
title, which count as weight A, and in the body, weight B, whose places go on after the title's.  Postings lie
in folders by a hash of the term, sorted by term; Spark splits a folder that a frequent term makes large into
many files.  A search reads the folders and row groups of its own terms, and no text.

A query is written as in ``fulltext``: words, quoted phrases, ``or``, and ``-`` before what must not be there.  A
cover is a shortest run of places that holds all phrases of one alternative, and it counts

    (entries / sum over entries of 1 / weight) / (1 + places of the run that are no entries)

where the entries are the places of the query's wanted words in it.  A document's score is the sum over its
covers; close words and words in the title count more.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.stems import Stems
from millrace.operators.broadcasts import small
from millrace.operators.checkpoints import settled
from millrace.operators.fulltext import BODY, TITLE, alternatives
from millrace.operators.products import BYTES, cut, runs

BUCKETS = 64
#: Up to this many distinct words of all queries are named in the scan's filter; more are joined.
NAMED = 2000
PHRASE = "array<struct<term: string, at: int>>"
PARSED = f"query_id {{kind}}, clauses array<struct<must: array<{PHRASE}>, must_not: array<{PHRASE}>>>"


def _analyser(config: str) -> Callable[[str], str]:
    """A word's term, "" for one that is left out: ``english`` stems, ``simple`` keeps words as they are."""
    if config == "english":
        return Stems().__getitem__
    if config == "simple":
        return lambda word: word
    raise ValueError(f"no configuration {config}")


def postings(docs: DataFrame, config: str = "english", title_col: str = "title", body_col: str = "body", keep: list[str] | None = None) -> DataFrame:
    """(term, doc_id, title array<int>, body array<int>) and the columns ``keep`` of docs: the places of each term, from 1.

    A word that is left out has a place all the same.  Null titles and bodies are empty.  Some documents are
    one batch: their words are coded once, and a term's analysis is made once a distinct word."""
    keep = keep or []

    def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values.astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term_of = _analyser(config)
        for b in batches:
            parts = [pc.fill_null(b.column(i), "") for i in (1, 2)]
            sizes = sum(pc.binary_length(p).to_numpy(zero_copy_only=False).astype(np.int64) for p in parts)
            for lo, n in runs(sizes, BYTES):
                (title_at, title), (body_at, body) = (cut(p.slice(lo, n)) for p in parts)
                in_title, in_body = np.diff(title_at), np.diff(body_at)
                row = np.r_[np.repeat(np.arange(n), in_title), np.repeat(np.arange(n), in_body)]
                place = 1 + np.arange(len(row)) - np.r_[np.repeat(title_at[:-1], in_title), len(title) + np.repeat(body_at[:-1] - in_title, in_body)]
                coded = pa.concat_arrays([title, body]).dictionary_encode()
                made = pa.array([term_of(w) for w in coded.dictionary.to_pylist()], pa.string()).dictionary_encode()
                term = made.indices.to_numpy(zero_copy_only=False)[coded.indices.to_numpy(zero_copy_only=False)].astype(np.int64)
                key = np.where(np.array([bool(t) for t in made.dictionary.to_pylist()], bool)[term], term * n + row, -1)
                order = np.argsort(key, kind="stable")  # a term's rows stand together, places of a row stay in order
                order = order[np.count_nonzero(key < 0) :]
                starts = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0]) if len(order) else np.zeros(0, np.int64)
                of_title = order < len(title)
                before = np.r_[0, np.cumsum(of_title)][np.r_[starts, len(order)]]
                n_title = np.diff(before)
                n_body = np.diff(np.r_[starts, len(order)]) - n_title
                terms, rows = pa.array(key[order][starts] // n), pa.array(lo + key[order][starts] % n)
                yield pa.RecordBatch.from_arrays([made.dictionary.take(terms), b.column(0).take(rows), lists(place[order][of_title], n_title), lists(place[order][~of_title], n_body), *(b.column(3 + i).take(rows) for i in range(len(keep)))], ["term", "doc_id", "title", "body", *keep])

    rows = docs.select("doc_id", F.lower(title_col).alias("t"), F.lower(body_col).alias("b"), *keep)
    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"term string, doc_id {docs.schema['doc_id'].dataType.simpleString()}, title array<int>, body array<int>{kinds}")


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


class Index:
    """An index in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, config: str = "english", buckets: int = BUCKETS):
        self.spark, self.root, self.config, self.buckets = spark, root, config, buckets

    def write(self, docs: DataFrame, title_col: str = "title", body_col: str = "body", keep: list[str] | None = None) -> Index:
        """Index docs, whose ``doc_id`` is unique, with the columns ``keep`` to filter by; what was there is replaced."""
        made = postings(docs, self.config, title_col, body_col, keep).withColumn("bucket", _bucket(F.col("term"), self.buckets))
        dealt = made.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "doc_id")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/postings")
        docs.select("doc_id", *(keep or [])).write.mode("overwrite").parquet(f"{self.root}/documents")
        return self

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """The stored postings; of some terms, only their folders and row groups are read."""
        of_docs = self.documents().schema  # said here, as an index of nothing has no file to tell
        kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in of_docs if f.name != "doc_id")
        rows = self.spark.read.schema(f"term string, doc_id {of_docs['doc_id'].dataType.simpleString()}, title array<int>, body array<int>{kinds}, bucket int").parquet(f"{self.root}/postings")
        if terms is None:
            return rows
        literal = self.spark.createDataFrame([(t,) for t in terms], "term string")
        folders = [r[0] for r in literal.select(_bucket(F.col("term"), self.buckets)).distinct().collect()]  # of NAMED terms at most
        return rows.where(F.col("bucket").isin(folders) & F.col("term").isin(terms))

    def documents(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/documents")


def parsed(asked: DataFrame, config: str, text_col: str = "query") -> DataFrame:
    """(query_id, clauses) of written queries: of each alternative the wanted and the unwanted phrases, as terms with their
    places in the phrase.  Words that are left out ask for nothing; alternatives of nothing are dropped."""
    kind = asked.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term_of = _analyser(config)

        def phrases(some: list[str]) -> list[list[dict]]:
            made = [[{"term": term_of(w), "at": i} for i, w in enumerate(p.split(" ")) if term_of(w)] for p in some]
            return [p for p in made if p]

        for b in batches:
            rows = b.to_pylist()
            clauses = [[c for c in ({"must": phrases(x["must"]), "must_not": phrases(x["must_not"])} for x in r["alternatives"]) if c["must"] or c["must_not"]] for r in rows]
            phrase = pa.list_(pa.list_(pa.struct([("term", pa.string()), ("at", pa.int32())])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(clauses, pa.list_(pa.struct([("must", phrase), ("must_not", phrase)])))], ["query_id", "clauses"])

    grouped = alternatives(asked, text_col).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("alternative", "must", "must_not"))).alias("alternatives"))
    return grouped.mapInArrow(run, PARSED.format(kind=kind)).where(F.size("clauses") > 0)


def _occurrences(phrase: list[dict], places: dict[str, list[int]]) -> list[tuple[int, int]]:
    """(first, last place) of each occurrence of the phrase, in order."""
    head, rest = phrase[0], phrase[1:]
    sets = [(set(places.get(p["term"], ())), p["at"] - head["at"]) for p in rest]
    far = rest[-1]["at"] - head["at"] if rest else 0
    return [(s, s + far) for s in places.get(head["term"], ()) if all(s + d in some for some, d in sets)]


def cover_score(clauses: list[dict], title: dict[str, list[int]], body: dict[str, list[int]]) -> float | None:
    """The score of a document by the places of its terms, ascending; None if no alternative matches."""
    places = {t: [*title.get(t, ()), *body.get(t, ())] for t in {*title, *body}}
    wanted = []
    for c in clauses:
        found = [_occurrences(p, places) for p in c["must"]]
        if all(found) and not any(_occurrences(p, places) for p in c["must_not"]):
            wanted.append(found)
    if not wanted:
        return None
    ends = {}  # of each run: its last place, and the latest first place with which it is complete
    for first in sorted({o[0] for found in wanted for some in found for o in some}):
        last = None
        for found in wanted:
            at = [bisect_left(some, (first,)) for some in found]
            if found and all(i < len(some) for i, some in zip(at, found, strict=True)):
                far = max(some[i][1] for i, some in zip(at, found, strict=True))
                last = far if last is None else min(last, far)
        if last is not None:
            ends[last] = first
    terms = {t["term"] for c in clauses for p in c["must"] for t in p}
    weighed = sorted({(p, w) for some, w in ((title, TITLE), (body, BODY)) for t in terms for p in some.get(t, ())})
    spots, summed = [p for p, _ in weighed], [0.0]
    for _, w in weighed:
        summed.append(summed[-1] + 1 / w)
    total = 0.0
    for last, first in ends.items():
        a, b = bisect_left(spots, first), bisect_right(spots, last)
        total += (b - a) / (summed[b] - summed[a]) / (1 + last - first + 1 - (b - a))
    return total


def _flat(places: pa.Array) -> tuple[list, list, tuple[list, list], tuple[list, list]]:
    """Of lists of (term, title, body): where each list begins, the terms, and the bounds and places of all titles and bodies."""
    some = places.flatten()

    def lists(part: pa.Array) -> tuple[list, list]:
        sizes = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)
        return np.r_[0, np.cumsum(sizes)].tolist(), part.flatten().to_numpy(zero_copy_only=False).tolist()

    bounds = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(places), 0).to_numpy(zero_copy_only=False))].tolist()
    return bounds, pc.struct_field(some, "term").to_pylist(), lists(pc.struct_field(some, "title")), lists(pc.struct_field(some, "body"))


def search(index: Index, asked: DataFrame, limit: int | None = None, text_col: str = "query", where: Column | None = None) -> DataFrame:
    """(query_id, doc_id, score, lexical_score) of the documents that each written query finds; with a limit, the first of each
    query and their rank, ties by id.

    asked: query_id, unique, and the query; ``where`` is a test of the columns kept with the documents.  lexical_score
    is the score as a share of the query's best.  An alternative that only excludes finds every document without
    its phrases, with score 0; a query without words finds nothing.  The postings of a query meet by document,
    so no term and no query gathers its documents in one task; each task ranks its own first before all are."""
    queries = settled(parsed(asked, index.config, text_col))
    terms = queries.select("query_id", F.explode("clauses").alias("c")).select("query_id", F.explode(F.flatten(F.concat("c.must", "c.must_not"))).alias("t")).select("query_id", "t.term").distinct()
    names = [r["term"] for r in terms.select("term").distinct().limit(NAMED + 1).collect()]
    stored = index.postings(names if len(names) <= NAMED else None)
    of_docs = index.documents()
    if where is not None:
        stored, of_docs = stored.where(where), of_docs.where(where)
    places = stored.select("term", "doc_id", "title", "body").join(small(terms), "term").select("query_id", "doc_id", F.struct("term", "title", "body").alias("p"))
    excluding = queries.where(F.exists("clauses", lambda c: F.size(c["must"]) == 0)).select("query_id")
    every = of_docs.select("doc_id").join(small(excluding)).select("query_id", "doc_id", F.lit(None).alias("p"))  # a stated query that asks for all documents
    met = places.unionByName(every).groupBy("query_id", "doc_id").agg(F.collect_list("p").alias("places"))  # of one document's query words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clauses: dict = {}  # of each query that the task has met
        for b in batches:
            bounds, terms, *parts = _flat(b.column(2))
            scores = []
            for k, query in enumerate(b.column(0).to_pylist()):
                if query not in clauses:
                    clauses[query] = b.column(3)[k].as_py()
                at = range(bounds[k], bounds[k + 1])
                title, body = ({terms[i]: values[ends[i] : ends[i + 1]] for i in at} for ends, values in parts)
                scores.append(cover_score(clauses[query], title, body))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64())], ["query_id", "doc_id", "score"])

    kinds = f"query_id {asked.schema['query_id'].dataType.simpleString()}, doc_id {of_docs.schema['doc_id'].dataType.simpleString()}, score double"
    scored = met.join(small(queries), "query_id").select("query_id", "doc_id", "places", "clauses").mapInArrow(run, kinds).where("score is not null").withColumn("score", F.round("score", 6))
    share = F.round(F.coalesce(F.col("score") / F.nullif("most", F.lit(0.0)), F.lit(0.0)), 6).alias("lexical_score")
    if limit is None:
        most = scored.groupBy("query_id").agg(F.max("score").alias("most"))
        return scored.join(small(most), "query_id").select("query_id", "doc_id", "score", share)
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= limit)
    return best.withColumn("most", F.max("score").over(Window.partitionBy("query_id"))).select("query_id", "doc_id", "score", share, "rank")
