"""Cutting the lineage of iterative computations through the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="millrace-checkpoint-"))
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """df, computed and written to the folder that the session names in ``spark.checkpoint.dir``.  A lost
    executor costs its running tasks only.  Where no folder is named one is made on a local master; on a
    cluster that is an error, as machines do not see each other's temporary folders."""
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the same folder that nothing has yet, for tables that live as long as the session."""
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
