"""Hybrid retrieval over many queries at once: lexical overlap, hashed embeddings, fusion, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import products
from millrace.operators.broadcasts import few, small
from millrace.operators.checkpoints import settled

RRF_K = 60
BOOST = 1.15
FLOOR = 0.35
#: (at least, level): the bands of confidence.
BANDS = [(0.72, "high"), (0.50, "medium"), (0.28, "low")]
WEIGHTS = {"strength": 0.45, "corroboration": 0.25, "authority": 0.20, "agreement": 0.10}
CONTEXT_CHARS = 24_000
#: Queries that are scored by one product with a batch of documents.
FEW_QUERIES = 2000


def together(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and text dealt by id.  Texts move once, and whatever is counted per text afterwards, of its many
    times larger lists of terms and pairs, is counted where it is made."""
    return df.select(id_col, text_col).repartition(id_col)


def terms(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term): each distinct token of each text, as an inverted index has it."""
    return df.select(id_col, F.explode(F.array_distinct(T.tokens(F.col(text_col)))).alias("term"))


def lexical_hits(queries: DataFrame, docs: DataFrame, query_text: str = "question", doc_text: str = "body", depth: int | None = None) -> DataFrame:
    """(query_id, doc_id, lexical_score): share of the query's distinct tokens that the document has.

    A few queries go to the documents and are scored a batch of documents at once; many meet them term by
    term.  With a depth, hits that are not among a query's first by score and doc_id may be left out."""
    wanted = terms(queries, "query_id", query_text)
    if few(queries, FEW_QUERIES):
        return products.shares(wanted, together(docs, "doc_id", doc_text), doc_text, depth)
    size = wanted.groupBy("query_id").agg(F.count("*").alias("n_terms"))
    hits = terms(together(docs, "doc_id", doc_text), "doc_id", doc_text).join(small(wanted), "term").groupBy("query_id", "doc_id").agg(F.count("*").alias("n_hits"))
    return hits.join(small(size), "query_id").select("query_id", "doc_id", (F.col("n_hits") / F.col("n_terms")).alias("lexical_score"))


def term_counts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf) of each text's tokens and pairs of neighbouring tokens.

    Terms are counted where their text is; only those of ids that several rows have are put together."""
    counted = products.counts(together(df, id_col, text_col), id_col, text_col)
    twice = df.groupBy(F.col(id_col).alias("__id")).agg(F.count("*").alias("__n")).where("__n > 1").select("__id")
    if few(twice, 0):
        return counted
    same, twice = F.col(id_col).eqNullSafe(F.col("__id")), small(settled(twice))
    return counted.join(twice, same, "left_anti").unionByName(counted.join(twice, same, "left_semi").groupBy(id_col, "term").agg(F.sum("tf").alias("tf")))


def hashed_embedding(df: DataFrame, id_col: str, text_col: str, dim: int = 512) -> DataFrame:
    """(id, bucket, w): sparse unit vectors of signed hash buckets of tokens and token pairs, 1 + ln(tf) each.

    id is a key; a text's terms are counted within its row."""
    return products.embedded(together(df, id_col, text_col), id_col, text_col, dim)


def dense_hits(queries: DataFrame, docs: DataFrame, query_text: str = "question", doc_text: str = "body", dim: int = 512, depth: int | None = None) -> DataFrame:
    """(query_id, doc_id, vector_score): cosine of hashed embeddings, not below 0.

    A few queries go to the documents and are scored a batch of documents at once; many meet them bucket by
    bucket.  With a depth, hits that are not among a query's first by score and doc_id may be left out."""
    q = hashed_embedding(queries, "query_id", query_text, dim)
    if few(queries, FEW_QUERIES):
        return products.cosines(q, together(docs, "doc_id", doc_text), doc_text, dim, depth)
    d = hashed_embedding(docs, "doc_id", doc_text, dim).withColumnRenamed("w", "dw")
    dot = d.join(small(q.withColumnRenamed("w", "qw")), "bucket").groupBy("query_id", "doc_id").agg(F.sum(F.col("qw") * F.col("dw")).alias("dot"))
    return dot.select("query_id", "doc_id", F.greatest(F.lit(0.0), F.round("dot", 6)).alias("vector_score"))


def first_hits(queries: DataFrame, docs: DataFrame, depth: int, query_text: str = "question", doc_text: str = "body", dim: int = 512) -> tuple[DataFrame, DataFrame]:
    """The first ``depth`` dense and lexical hits of each query, ranked.

    A few queries are scored both ways in one pass over the documents."""
    if not few(queries, FEW_QUERIES):
        lexical = lexical_hits(queries, docs, query_text, doc_text, depth).withColumn("lexical_score", F.round("lexical_score", 6))
        return top_per_query(dense_hits(queries, docs, query_text, doc_text, dim, depth), "vector_score", depth), top_per_query(lexical, "lexical_score", depth)
    hits = products.both(hashed_embedding(queries, "query_id", query_text, dim), terms(queries, "query_id", query_text), together(docs, "doc_id", doc_text), doc_text, dim, depth)
    w = Window.partitionBy("kind", "query_id").orderBy(F.desc("score"), "doc_id")
    first = settled(hits.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= depth))
    of = lambda kind, name: first.where(F.col("kind") == kind).select("query_id", "doc_id", F.col("score").alias(name), "rank")
    return of("dense", "vector_score"), of("lexical", "lexical_score")


def top_per_query(hits: DataFrame, score: str, depth: int, rank: str = "rank", tie: str = "doc_id") -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(score), tie)
    return hits.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= depth)


def fuse(dense: DataFrame, lexical: DataFrame, limit: int) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists by (query_id, doc_id)."""
    d = dense.select("query_id", "doc_id", "vector_score", F.col("rank").alias("vector_rank"))
    x = lexical.select("query_id", "doc_id", "lexical_score", F.col("rank").alias("lexical_rank"))
    part = lambda c: F.coalesce(1 / (RRF_K + F.col(c)), F.lit(0.0))
    both = d.join(x, ["query_id", "doc_id"], "full_outer").select(
        "query_id", "doc_id", F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"), F.coalesce("lexical_score", F.lit(0.0)).alias("lexical_score"),
        F.round(part("vector_rank") + part("lexical_rank"), 9).alias("score"),
    )
    return top_per_query(both, "score", limit)


def hybrid_search(queries: DataFrame, docs: DataFrame, limit: int = 8) -> DataFrame:
    """Ranked hits (query_id, doc_id, vector_score, lexical_score, score, rank) of each query."""
    depth = max(4 * limit, 20)
    return fuse(*first_hits(queries, docs, depth), limit)


def boosted(hits: DataFrame, matches: Column) -> DataFrame:
    """Hits whose entity matches a hint of the query score BOOST times as much; ranks anew, old rank on ties."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "old_rank")
    return (
        hits.withColumnRenamed("rank", "old_rank").withColumn("score", F.round(F.when(matches, F.col("score") * BOOST).otherwise(F.col("score")), 9))
        .withColumn("rank", F.row_number().over(w)).drop("old_rank")
    )


def band(score: Column) -> Column:
    out = F.lit("insufficient")
    for least, level in reversed(BANDS):
        out = F.when(score >= least, level).otherwise(out)
    return out


def confidence(hits: DataFrame) -> DataFrame:
    """Per query: strength of the best hit, corroborating sources, authority, agreement of the first five, level.

    hits: query_id, rank, vector_score, lexical_score, source, authority.  Hits below FLOOR count for
    nothing but agreement; a query whose best hit is below it is insufficient."""
    absolute = F.greatest("vector_score", "lexical_score")
    seen = hits.withColumn("absolute", absolute).groupBy("query_id").agg(
        F.max("absolute").alias("strength"),
        F.count_distinct(F.when(F.col("absolute") >= FLOOR, F.col("source"))).alias("n_sources"),
        F.coalesce(F.bool_or(F.when(F.col("absolute") >= FLOOR, F.col("authority"))), F.lit(False)).alias("authoritative"),
        F.count(F.when(F.col("rank") <= 5, 1)).alias("n_first"),
        F.stddev_pop(F.when(F.col("rank") <= 5, F.col("absolute"))).alias("spread"),
    )
    agreement = F.when(F.col("n_first") < 2, 0.5).otherwise(F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), 2.5 * F.col("spread"))))
    total = (
        WEIGHTS["strength"] * F.col("strength") + WEIGHTS["corroboration"] * F.least(F.lit(1.0), F.col("n_sources") / 3)
        + WEIGHTS["authority"] * F.when(F.col("authoritative"), 1.0).otherwise(0.45) + WEIGHTS["agreement"] * agreement
    )
    score = F.round(F.when(F.col("strength") >= FLOOR, total).otherwise(F.lit(0.0)), 6)
    return seen.select("query_id", F.round("strength", 6).alias("strength"), "n_sources", "authoritative", score.alias("confidence"), band(score).alias("level"))


def reasons(judged: DataFrame) -> DataFrame:
    """The reasons of each level, strength first, then authority, then a warning for high without authority."""
    lines = F.array_compact(
        F.array(
            F.when(F.col("strength") >= 0.7, "strong match").when(F.col("strength") >= FLOOR, "partial match").otherwise("no match above the floor"),
            F.when(F.col("authoritative"), "an authoritative source agrees"),
            F.when(~F.col("authoritative") & (F.col("level") == "high"), "no authoritative source; may be out of date"),
        )
    )
    return judged.withColumn("reasons", lines)


def citations(hits: DataFrame, limit: int = 320) -> DataFrame:
    """The first hit of each document is its citation, numbered by first appearance.

    hits: query_id, rank, document_key, title, text, tier; only tiers that may be quoted have an excerpt."""
    first = hits.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "document_key").orderBy("rank"))).where("nth = 1")
    may = F.col("tier").isin("full_text", "quotation")
    numbered = first.withColumn("number", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    return numbered.select("query_id", "number", "document_key", "title", F.when(may, T.excerpt(F.col("text"), limit)).alias("excerpt"))


def within_budget(blocks: DataFrame, budget: int = CONTEXT_CHARS) -> DataFrame:
    """The leading blocks of each query up to the first that overflows the budget; the first block always.

    blocks: query_id, rank, block."""
    total = F.sum(F.length("block")).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    over = blocks.withColumn("total", total).withColumn("over", (F.col("total") > budget) & (F.col("rank") > 1))
    first_over = F.min(F.when(F.col("over"), F.col("rank"))).over(Window.partitionBy("query_id"))
    return over.withColumn("cut", first_over).where(F.col("cut").isNull() | (F.col("rank") < F.col("cut"))).drop("over", "cut")


def context(blocks: DataFrame, budget: int = CONTEXT_CHARS) -> DataFrame:
    """One text per query of the blocks within the budget, in rank order."""
    kept = within_budget(blocks, budget).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "block"))).alias("b"))
    return kept.select("query_id", F.array_join(F.col("b.block"), "\n---\n").alias("context"), F.size("b").cast("long").alias("n_blocks"))


def verified_answer(answer: Column, included: Column) -> dict[str, Column]:
    """The answer without citation markers of numbers that were not included, and those numbers."""
    used = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))
    wrong = F.array_except(used, included)
    clean = F.aggregate(wrong, answer, lambda s, n: F.replace(s, F.concat(F.lit("["), n.cast("string"), F.lit("]")), F.lit("")))
    tidy = T.strip(F.regexp_replace(F.regexp_replace(clean, r" +([.,;:])", "$1"), " {2,}", " "))
    return {"answer": tidy, "dropped": wrong, "cited": F.array_sort(F.array_distinct(F.array_intersect(used, included)))}


def downgraded(level: Column, cited: Column) -> Column:
    lower = F.when(level == "high", "medium").when(level == "medium", "low").otherwise(level)
    return F.when(F.size(cited) == 0, lower).otherwise(level)


def keyword_hints(questions: DataFrame, keywords: DataFrame, word_boundary: bool = False) -> DataFrame:
    """(query_id, hints): the entity types of which a keyword stands in the question, as a substring or a word.

    keywords: entity_type, keyword; a small dimension, joined by a test of every pair with a question."""
    q = F.concat(F.lit(" "), F.regexp_replace(F.lower("question"), "[^a-z0-9]+", " "), F.lit(" ")) if word_boundary else F.lower("question")
    key = F.concat(F.lit(" "), F.col("keyword"), F.lit(" ")) if word_boundary else F.col("keyword")
    hit = questions.select("query_id", q.alias("q")).join(small(keywords), F.contains(F.col("q"), key))
    return hit.groupBy("query_id").agg(F.array_sort(F.collect_set("entity_type")).alias("hints"))


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, similarity, rank): the k nearest of all vectors by cosine, for a stated set of queries.

    queries and vectors: vec_id, embedding.  Vectors are multiplied with blocks of queries where they are, and
    only what is among the first k of its task moves."""
    return top_per_query(products.nearest(queries, vectors, k), "similarity", k, tie="vec_id")


def matches(asked: DataFrame, docs: DataFrame, doc_text: str = "body") -> DataFrame:
    """(query_id, doc_id): the documents that have every word of ``all_of`` and none of ``none_of``.

    asked: query_id, all_of and none_of array<string>; a query without wanted words matches nothing."""
    index = terms(docs, "doc_id", doc_text)
    wanted = asked.select("query_id", F.explode(F.array_distinct("all_of")).alias("term"))
    unwanted = asked.select("query_id", F.explode("none_of").alias("term"))
    need = asked.select("query_id", F.size(F.array_distinct("all_of")).alias("need"))
    has = index.join(small(wanted), "term").groupBy("query_id", "doc_id").agg(F.count("*").alias("n"))
    full = has.join(small(need), "query_id").where("n = need").select("query_id", "doc_id")
    return full.join(index.join(small(unwanted), "term").select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
