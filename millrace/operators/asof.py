"""As-of joins: for each row the newest value of its key at or before its time, without a join by ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.broadcasts import small
from millrace.operators.checkpoints import settled


def last_before(rows: DataFrame, values: DataFrame, key: str, ts: str, name: str = "last") -> DataFrame:
    """rows with ``name``: a struct of the columns of the newest row of values with the same key at or before the
    row's time, null if there is none.

    values: key, ts and what is wanted; of rows of one key and time the greatest counts.  Nulls in key or time
    find nothing and are found by nothing.  Both sides are laid out as one, by ranges of (key, time), so that a
    key that holds most of either is spread over many tasks.  A task fills its own rows from the values it has
    met; only the first key of a range can have begun in an earlier one, and what that key brings along is one row
    per range."""
    wanted = [c for c in values.columns if c != key]
    value = F.struct(*[F.col(c) for c in wanted])
    kind = values.select(value.alias("v")).schema["v"].dataType
    real = f"`{key}` is not null and `{ts}` is not null"
    asked = rows.withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in rows.columns])).select(F.col(key).alias("__key"), F.col(ts).alias("__ts"), "__row", F.lit(None).cast(kind).alias("__value"))
    known = values.where(real).select(F.col(key).alias("__key"), F.col(ts).alias("__ts"), F.lit(None).cast(asked.schema["__row"].dataType).alias("__row"), value.alias("__value"))
    # at one time values stand before rows, smaller ones first; rows without key or time stand apart
    order = [F.col("__key"), F.col("__ts"), F.col("__value").isNull(), F.col("__value")]
    dealt = settled(asked.where("__key is not null and __ts is not null").unionByName(known).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    ends = dealt.groupBy("__part").agg(F.min("__key").alias("first"), F.max(F.when(F.col("__value").isNotNull(), F.struct("__key", "__ts", "__value"))).alias("end"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # of a row per range
    brought = ends.withColumn("end", F.max("end").over(earlier)).select(F.col("__part").alias("__at"), F.when(F.col("end.__key") == F.col("first"), F.col("end.__value")).alias("__brought"), F.col("first").alias("__first"))
    w = Window.partitionBy("__part", "__key").orderBy("__ts", F.col("__value").isNull(), "__value")
    filled = dealt.withColumn("__last", F.last("__value", ignorenulls=True).over(w)).where("__row is not null")
    joined = filled.join(small(brought), (F.col("__part") == F.col("__at")) & (F.col("__key") == F.col("__first")), "left")
    found = joined.select("__row.*", F.coalesce("__last", "__brought").alias(name))
    return found.unionByName(rows.where(f"not ({real})").withColumn(name, F.lit(None).cast(kind)))
