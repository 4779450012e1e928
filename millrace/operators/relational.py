"""Row-store operations over tables: paging, upserts, look-ups, validation, ordered grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.broadcasts import small
from millrace.operators.checkpoints import settled


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of df in the order given, which must end in a unique key."""
    return df.orderBy(*order).offset(offset).limit(limit)


def page_envelope(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One row: items in the page, total, limit, offset, has_more.  The total is an aggregate of df, not a window."""
    total = df.agg(F.count("*").alias("total"))
    got = page(df, order, limit, offset).agg(F.count("*").alias("items"))
    return got.join(total).select("items", "total", F.lit(limit).alias("limit"), F.lit(offset).alias("offset"), (F.col("total") > offset + F.col("items")).alias("has_more"))


def replace_rows(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """table with the rows of the keys of new deleted wholesale and new's rows appended."""
    return table.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def update_rows(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """table with every non-null column of changes (unique by keys) put over the old value."""
    set_cols = [c for c in changes.columns if c not in keys]
    new = changes.select(*keys, *[F.col(c).alias(f"__{c}") for c in set_cols])
    joined = table.join(new, keys, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in set_cols else F.col(c) for c in table.columns])


def upsert_actions(stored: DataFrame, incoming: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """(key, action) of each incoming row: insert, update if any compared column differs, else touch."""
    old = stored.select(key, F.lit(True).alias("__old"), *[F.col(c).alias(f"__{c}") for c in compare])
    same = F.lit(True)
    for c in compare:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    return incoming.join(old, key, "left").select(key, F.when(F.col("__old").isNull(), "insert").when(~same, "update").otherwise("touch").alias("action"))


def upsert(stored: DataFrame, incoming: DataFrame, key: str, compare: list[str], touched: str) -> DataFrame:
    """stored with incoming rows written over it; unchanged ones only have ``touched`` renewed."""
    names = stored.columns
    old = stored.select(F.col(key), F.lit(True).alias("__old"), *[F.col(c).alias(f"__{c}") for c in names if c != key])
    new = incoming.withColumn("__new", F.lit(True))
    both = old.join(new, key, "full_outer")
    same = F.col("__old").isNotNull() & F.col("__new").isNotNull()
    for c in compare:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    keep_old = F.col("__new").isNull() | same
    old_if = {c: F.col("__new").isNull() if c == touched else keep_old for c in names}
    return both.select(*[F.col(c) if c == key else F.when(old_if[c], F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in names])


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order given; no sort of whole groups is kept."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rn") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing_references(df: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """The distinct non-null values of df's key that known does not have."""
    return df.select(F.col(key).alias("missing")).where("missing is not null").distinct().join(known.select(F.col(known_key).alias("missing")), "missing", "left_anti")


def in_list(column: str, values: list | None) -> Column:
    """Membership; no filter at all for None."""
    return F.lit(True) if values is None else F.col(column).isin(values)


def eligible_counts(characters: DataFrame, quests: DataFrame) -> DataFrame:
    """Every row of characters with n, the quests of its faction and of a required_level up to its level; a null
    on either side is a wildcard.  Only the distinct kinds of both sides are compared, never their rows."""
    kinds = quests.groupBy(F.col("faction").alias("__f"), F.col("required_level").alias("__l")).agg(F.count("*").alias("__n"))
    have = characters.select("faction", "level").distinct()
    may = (F.col("__f").isNull() | F.col("faction").isNull() | (F.col("__f") == F.col("faction"))) & (F.col("__l").isNull() | F.col("level").isNull() | (F.col("__l") <= F.col("level")))
    n = have.join(kinds, may).groupBy(F.col("faction").alias("__hf"), F.col("level").alias("__hl")).agg(F.sum("__n").alias("n"))
    same = F.col("faction").eqNullSafe(F.col("__hf")) & F.col("level").eqNullSafe(F.col("__hl"))
    return characters.join(small(n), same, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long")).drop("__hf", "__hl")


def islands(df: DataFrame, keys: list[str], order: list[Column], value: str, name: str = "run") -> DataFrame:
    """Number the runs of equal values in order, from 1, within each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("__new", changed).withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def rate_limited(events: DataFrame, key: str, ts: str, seconds: int, limit: int, tie: str) -> DataFrame:
    """Each event with its count in its fixed window, whether it is allowed, and the seconds until the window ends."""
    epoch = F.unix_timestamp(ts)
    bucket = F.floor(epoch / seconds)
    n = F.row_number().over(Window.partitionBy(key, "bucket").orderBy(ts, tie))
    return events.withColumn("bucket", bucket).withColumn("n", n).withColumn("allowed", F.col("n") <= limit).withColumn("retry_after", F.when(F.col("n") > limit, seconds - epoch % seconds))


def positions(df: DataFrame, group: list[str], order: list[Column], name: str = "pos") -> DataFrame:
    """df with the place of each row in its group, from 1, in the order given, which must end in a unique key.

    A group may hold most of the table: rows are dealt by ranges of (group, order), so that it is spread
    over many tasks; each task numbers its own rows, and the rows of the group in earlier tasks are added.
    Null groups are a group."""
    keys = [F.col(g) for g in group]
    dealt = settled(df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()))
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(*group, "__part").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    before = small(sizes.select(*[F.col(g).alias(f"__{g}") for g in group], F.col("__part").alias("__at"), "__before"))
    same = F.col("__part") == F.col("__at")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"__{g}"))
    nth = F.row_number().over(Window.partitionBy(*group, "__part").orderBy(*order))
    return dealt.join(before, same).select(*df.columns, (F.col("__before") + nth).alias(name))
