"""Incremental ingestion and event processing with Structured Streaming.

Documents arrive as files; each micro-batch is compared with the store by key and content hash, and only
what is new or changed is cut into chunks and written.  The store's tables are delta tables: a batch adds to
them what it changes, and one that is run again after a failure adds nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from millrace.functions import text as T
from millrace.operators import relational as R
from millrace.operators.checkpoints import settled
from millrace.operators.chunking import Sizes, chunk_documents
from millrace.operators.deltas import DeltaTable
from millrace.operators.measures import action_counters, observed

DOCUMENT = "source string, source_id string, entity_type string, title string, body string, game_version string"


def with_keys(docs: DataFrame) -> DataFrame:
    """docs with document_key and content_hash; blank titles go, the last of a key's rows in a batch stays."""
    keyed = docs.where("trim(title) <> ''").withColumn("document_key", T.stable_key(F.col("source"), F.col("game_version"), F.col("source_id")))
    hashed = keyed.withColumn("body", T.normalise_text(F.coalesce("body", F.lit("")))).withColumn("content_hash", T.content_hash(F.col("title"), F.col("body")))
    return R.latest(hashed, ["document_key"], [F.desc("content_hash")])


STORED = f"{DOCUMENT}, document_key string, content_hash string, batch long"
CHUNKS = "document_key string, ordinal int, heading_path array<string>, text string"
ERRORS = "document_key string, source string, source_id string, message string, batch long"


class Store:
    """Documents, their chunks and the errors of documents, as delta tables under a folder that all executors share.

    Each batch is a version of every table, whatever stream it came from, and so is each folding of deltas."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.documents = DeltaTable(spark, f"{root}/documents", STORED, "document_key", touched="batch")
        self.chunks = DeltaTable(spark, f"{root}/chunks", CHUNKS, "document_key")
        self.errors = DeltaTable(spark, f"{root}/errors", ERRORS, "document_key")

    def read(self, table: str, version: int | None = None, schema: str | None = None) -> DataFrame:
        """A version of a table, the newest by default; ``schema`` is the table's own and may be left out."""
        return getattr(self, table).read(version)


def wrong_with(docs: DataFrame) -> Column:
    """What keeps a document out, null for nothing; one document's fault keeps no other out."""
    return F.when(F.col("source").isNull() | F.col("source_id").isNull() | F.col("game_version").isNull(), "no key").when(F.coalesce(F.trim("title"), F.lit("")) == "", "no title")


def ingest_batch(store: Store, batch: DataFrame, batch_id: int, sizes: Sizes = Sizes(), writer: str = "batch") -> dict:
    """Commit a batch to the store; returns its counters, which are observed while its actions are settled.

    What is written follows the batch: changed documents and their chunks, and for unchanged ones, which are
    not cut again, the key and the number of the batch.  Only the keys and hashes of the batch's documents are
    looked up.  Documents that are wrong are left out, each with its reason in ``errors``.  A batch that the writer
    has committed before is not written again; documents come last, so a commit that broke off is made whole."""
    stored = store.documents
    new = settled(with_keys(batch.where(wrong_with(batch).isNull())).withColumn("batch", F.lit(batch_id).cast("long")))
    old = stored.read(only=new, columns=["document_key", "content_hash"])
    judged, passed = observed(R.upsert_actions(old, new, "document_key", ["content_hash"]), **action_counters())
    actions = settled(judged)
    changed = new.join(actions.where("action <> 'touch'"), "document_key", "left_semi")
    seen = new.join(actions.where("action = 'touch'"), "document_key", "left_semi")
    counters = passed.get
    cut = chunk_documents(changed.select("document_key", F.concat("title", F.lit(" ("), "entity_type", F.lit(")")).alias("header"), F.lit("").alias("facts"), "body"), sizes)
    faults = batch.withColumn("message", wrong_with(batch)).where("message is not null")
    number = F.concat_ws(":", F.lit(writer), F.lit(batch_id), F.monotonically_increasing_id())  # a fault stands on its own, whatever its document is called
    store.errors.commit(writer, batch_id, puts=faults.select(number.alias("document_key"), "source", "source_id", "message", F.lit(batch_id).cast("long").alias("batch")))
    store.chunks.commit(writer, batch_id, puts=cut)
    return stored.commit(writer, batch_id, puts=changed.select(*stored.columns), touches=seen.select("document_key", "batch"), note=counters)


def ingest_files(spark: SparkSession, source: str, store: Store, checkpoint: str, files_per_batch: int = 1, done: Callable[[int, dict], None] | None = None) -> StreamingQuery:
    """Ingest the JSON files that lie in source now and end; the next call goes on with newer files.

    The checkpoint is the lock: one query at a time writes with it.  Its query is the writer that the store knows;
    a new checkpoint over an old store reads all files again and finds their documents unchanged."""
    stream = spark.readStream.schema(DOCUMENT).option("maxFilesPerTrigger", files_per_batch).json(source)

    def each(batch: DataFrame, batch_id: int) -> None:
        writer = spark.read.schema("id string").json(f"{checkpoint}/metadata").first()["id"]
        counters = ingest_batch(store, batch, batch_id, writer=writer)
        if done:
            done(batch_id, counters)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rate_counts(events: DataFrame, seconds: int, limit: int, late: str = "10 minutes") -> DataFrame:
    """(user_id, start, n, rejected): requests per user and fixed window of a stream with event time ``ts``."""
    counted = events.withWatermark("ts", late).groupBy("user_id", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("w.start").alias("start"), "n", F.greatest(F.col("n") - limit, F.lit(0)).alias("rejected"))


def fanned_out(frames: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Each frame of a stream once per subscriber of its user; subscriptions are a static table."""
    return frames.join(subscriptions.select("user_id", "subscriber"), "user_id")


class Sequence(StatefulProcessor):
    """Numbers the frames of each user from 1, in event-time order within a micro-batch."""

    def init(self, handle) -> None:
        self.seq = handle.getValueState("seq", "n long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803  names of the interface
        import pandas as pd

        last = self.seq.get()[0] if self.seq.exists() else 0
        frames = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "event_id"], ignore_index=True)
        frames["seq"] = range(last + 1, last + 1 + len(frames))
        self.seq.update((int(frames["seq"].iloc[-1]),))
        yield frames[["user_id", "event_id", "seq"]]

    def close(self) -> None:
        pass


class OnceWithin(StatefulProcessor):
    """Lets a key's first row through and drops further ones until ``ttl_ms`` have passed: single-use
    tokens, deny lists and answers that stay good for a time."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "n long", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803  names of the interface
        import pandas as pd

        every = pd.concat(list(rows), ignore_index=True)
        if not self.seen.exists():
            self.seen.update((1,))
            yield every.sort_values(["ts", "event_id"]).head(1)[["user_id", "event_id"]]

    def close(self) -> None:
        pass


def numbered(frames: DataFrame) -> DataFrame:
    """(user_id, event_id, seq) of a stream with user_id, event_id and ts."""
    return frames.groupBy("user_id").transformWithStateInPandas(statefulProcessor=Sequence(), outputStructType="user_id long, event_id long, seq long", outputMode="Append", timeMode="None")


def once_within(rows: DataFrame, ttl_ms: int) -> DataFrame:
    return rows.groupBy("user_id").transformWithStateInPandas(statefulProcessor=OnceWithin(ttl_ms), outputStructType="user_id long, event_id long", outputMode="Append", timeMode="ProcessingTime")
