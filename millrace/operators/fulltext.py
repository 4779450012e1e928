"""Full-text search by written queries: words, quoted phrases, ``or``, and ``-`` before what must not be there."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators.broadcasts import small

#: How much a clause counts that stands in the title, and one that stands in the body.
TITLE, BODY = 1.0, 0.4


def alternatives(asked: DataFrame, text_col: str = "query") -> DataFrame:
    """(query_id, alternative, must, must_not) of asked: query_id and a written query.

    ``or`` parts alternatives; in one, all phrases of ``must`` and none of ``must_not`` are wanted.  A word is
    a phrase of one; signs that are no words ask for nothing, and a query of nothing else has no row."""
    clause = asked.select("query_id", F.posexplode(F.regexp_extract_all(F.lower(text_col), F.lit('(-?"[^"]*"|\\S+)'), F.lit(1))).alias("pos", "clause"))
    parted = clause.withColumn("alternative", F.sum((F.col("clause") == "or").cast("int")).over(Window.partitionBy("query_id").orderBy("pos"))).where("clause <> 'or'")
    phrase = F.array_join(T.tokens(F.col("clause")), " ")
    kept = parted.select("query_id", "alternative", F.startswith("clause", F.lit("-")).alias("negated"), phrase.alias("phrase")).where("phrase <> ''")
    said = lambda negated: F.array_sort(F.collect_set(F.when(F.col("negated") == negated, F.col("phrase"))))
    return kept.groupBy("query_id", "alternative").agg(said(False).alias("must"), said(True).alias("must_not"))


def search(asked: DataFrame, docs: DataFrame, text_col: str = "query", title_col: str = "title", body_col: str = "body") -> DataFrame:
    """(query_id, doc_id, score) of the documents that a query matches, in title and body together.

    The score is the mean over the wanted phrases of TITLE if one stands in the title plus BODY if it stands
    in the body, of the best alternative; one that only excludes scores 0.  Queries are few: each document
    is read once and tested for all of them.  Null titles and bodies are empty."""
    padded = lambda c: F.concat(F.lit(" "), F.array_join(T.tokens(F.coalesce(F.col(c), F.lit(""))), " "), F.lit(" "))
    texts = docs.select("doc_id", padded(title_col).alias("t"), padded(body_col).alias("b"))
    within = lambda text, phrase: F.contains(F.col(text), F.concat(F.lit(" "), phrase, F.lit(" ")))
    either = lambda p: within("t", p) | within("b", p)
    hit = texts.join(small(alternatives(asked, text_col)), F.forall("must", either) & ~F.exists("must_not", either))
    one = lambda p: F.when(within("t", p), TITLE).otherwise(0.0) + F.when(within("b", p), BODY).otherwise(0.0)
    score = F.coalesce(F.aggregate("must", F.lit(0.0), lambda s, p: s + one(p)) / F.nullif(F.size("must"), F.lit(0)), F.lit(0.0))
    return hit.select("query_id", "doc_id", score.alias("score")).groupBy("query_id", "doc_id").agg(F.round(F.max("score"), 6).alias("score"))


