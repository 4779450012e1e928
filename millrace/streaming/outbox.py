"""A sink that delivers frames to users once, as a Spark data source with a commit per batch.

``spark.dataSource.register(Outbox)``, then ``writeStream.format("outbox").option("path", ...)``.  Tasks write files that
nobody reads yet; the commit of a batch names its files in one manifest, which is put in place whole.  A batch
that Spark runs again after a failure finds its manifest and leaves the first delivery as it is; what an aborted
batch wrote is deleted.  Within a batch a frame of one user and number is delivered once.

The folder stands for the users' connections: ``delivered`` reads what has arrived."""

from __future__ import annotations

import contextlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage

FRAME = "user_id long, seq long, payload string"


@dataclass
class Written(WriterCommitMessage):
    file: str
    frames: int


class OutboxWriter(DataSourceStreamWriter):
    def __init__(self, path: str):
        self.path = path.removeprefix("file:")

    def write(self, iterator: Iterator) -> Written:
        """A task's frames in a file of its own.  Frames must be dealt by user for (user, seq) to be met in one task."""
        os.makedirs(f"{self.path}/frames", exist_ok=True)
        name, seen = f"{uuid.uuid4().hex}.json", set()
        with open(f"{self.path}/frames/{name}", "w") as f:
            for row in iterator:
                key = (row["user_id"], row["seq"])
                if key not in seen:
                    seen.add(key)
                    f.write(json.dumps(row.asDict()) + "\n")
        return Written(name, len(seen))

    def _manifest(self, batch: int) -> str:
        return f"{self.path}/commits/{batch:012d}.json"

    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N802, N803  names of the interface
        os.makedirs(f"{self.path}/commits", exist_ok=True)
        if os.path.exists(self._manifest(batchId)):
            self.abort(messages, batchId)
            return
        part = f"{self._manifest(batchId)}.{uuid.uuid4().hex}"
        with open(part, "w") as f:
            json.dump({"batch": batchId, "files": [m.file for m in messages if m and m.frames]}, f)
        os.rename(part, self._manifest(batchId))

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N802, N803
        for m in messages:
            if m:
                with contextlib.suppress(FileNotFoundError):
                    os.remove(f"{self.path}/frames/{m.file}")


class Outbox(DataSource):
    @classmethod
    def name(cls) -> str:
        return "outbox"

    def schema(self) -> str:
        return FRAME

    def streamWriter(self, schema, overwrite: bool) -> OutboxWriter:  # noqa: N802
        return OutboxWriter(self.options["path"])


def deliver(frames: DataFrame, path: str, checkpoint: str):
    """Deliver a stream of frames (user_id, seq, payload) that are there now, and end."""
    frames.sparkSession.dataSource.register(Outbox)
    dealt = frames.select("user_id", "seq", "payload").repartition("user_id")
    return dealt.writeStream.format("outbox").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def delivered(spark: SparkSession, path: str) -> DataFrame:
    """(batch, user_id, seq, payload) of the committed batches."""
    named = spark.read.schema("batch long, files array<string>").json(f"{path}/commits/*.json").select("batch", F.explode("files").alias("file"))
    frames = spark.read.schema(FRAME).json(f"{path}/frames").withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return frames.join(F.broadcast(named), "file").select("batch", "user_id", "seq", "payload")
