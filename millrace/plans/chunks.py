"""Queries over chunked documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators.chunking import chunk_documents
from millrace.plans.catalog import query
from millrace.sources.tables import sectioned_bodies


def chunked(spark, sf):
    docs = sectioned_bodies(spark, sf).select(F.col("doc_id").alias("document_key"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("header"), F.lit("kind: prose").alias("facts"), "body")
    return chunk_documents(docs)


@query("k11_chunks")
def k11(spark, sf):
    return chunked(spark, sf).select(F.col("document_key").alias("doc_id"), "ordinal", F.array_join("heading_path", " > ").alias("path"), "text")


@query("k11_chunk_keys", "SELECT doc_id, 0 AS first_ordinal, true AS gapless FROM documents")
def chunk_keys(spark, sf):
    got = chunked(spark, sf).groupBy(F.col("document_key").alias("doc_id")).agg(F.min("ordinal").alias("first_ordinal"), (F.max("ordinal") + 1 == F.count("*")).alias("gapless"))
    return got


@query("k07_headings", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)
SELECT doc_id, count(*) AS headings FROM l WHERE pos % 7 = 3 AND trim(substr(line, 1, 40), ' ') <> '' GROUP BY doc_id""")
def k07(spark, sf):
    lines = sectioned_bodies(spark, sf).select("doc_id", F.explode(F.split("body", "\n")).alias("line"))
    return lines.where(F.col("line").rlike(r"^## +\S")).groupBy("doc_id").agg(F.count("*").alias("headings"))
