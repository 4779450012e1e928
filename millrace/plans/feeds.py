"""Queries over the paged source and the outbox."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators.checkpoints import new_folder
from millrace.plans.catalog import query
from millrace.sources import paged
from millrace.sources.tables import table
from millrace.streaming import outbox

PER_WINDOW = 200


def site(spark, sf: str) -> str:
    """pages as a site that answers by windows of their ids."""
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.regexp_extract("url", "([^/]+)/?$", 1).alias("title"), F.col("html").alias("body"))
    return paged.publish(pages, new_folder(spark, "site"), PER_WINDOW)


@query("s06_paged_source", f"SELECT (page_id // {PER_WINDOW})::INTEGER AS \"window\", page_id::VARCHAR AS source_id, regexp_extract(url, '([^/]+)/?$', 1) AS title, md5(html) AS body FROM pages")
def paged_source(spark, sf):
    return paged.paged(spark, site(spark, sf)).withColumn("body", F.md5("body"))


@query("s06_pushed_windows", f"SELECT page_id::VARCHAR AS source_id, md5(html) AS body FROM pages WHERE page_id // {PER_WINDOW} IN (0, 2, 3) AND page_id // {PER_WINDOW} < 3 AND length(html) > 500")
def pushed_windows(spark, sf):
    """Only the windows 0 and 2 are asked for."""
    got = paged.paged(spark, site(spark, sf)).where("`window` in (0, 2, 3) and `window` < 3 and length(body) > 500")
    return got.select("source_id", F.md5("body").alias("body"))


@query("s22_delivered_frames", "SELECT user_id, event_id AS seq, event_type AS payload FROM events")
def delivered(spark, sf):
    """events as frames: a stream that ends after half of them, and another that goes on from its checkpoint."""
    frames = table(spark, sf, "events").select("user_id", F.col("event_id").alias("seq"), F.col("event_type").alias("payload"))
    folder, path, checkpoint = (new_folder(spark, n) for n in ("frames", "outbox", "stream"))
    for half in (0, 1):
        frames.where(F.col("seq") % 2 == half).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(outbox.FRAME).parquet(folder)
        outbox.deliver(stream, path, checkpoint).awaitTermination()
    return outbox.delivered(spark, path).drop("batch")
