"""Synchronising accounts from outside: scopes that fail apart, batches, one run at a time, two-source collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.asof import last_before


def scope_outcomes(fetched: DataFrame) -> DataFrame:
    """fetched (char_id, scope, payload, error) with ``ok`` and ``reason``: a scope fails on an error or without a
    payload, whatever becomes of the others."""
    ok = F.col("error").isNull() & F.col("payload").isNotNull()
    return fetched.withColumn("ok", ok).withColumn("reason", F.when(~ok, F.coalesce("error", F.lit("no data"))))


def character_reports(outcomes: DataFrame) -> DataFrame:
    """(char_id, synced, failed, status): the scopes by outcome, in order; ``failed`` if none succeeded."""
    names = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("scope"))))
    got = outcomes.groupBy("char_id").agg(names(F.col("ok")).alias("synced"), names(~F.col("ok")).alias("failed"))
    return got.withColumn("status", F.when(F.size("failed") == 0, "success").when(F.size("synced") == 0, "failed").otherwise("partial"))


def planned_batches(characters: DataFrame, running: DataFrame, size: int) -> DataFrame:
    """(account_id, batch, char_ids): each account's characters in batches of ``size``.

    characters: account_id, region, char_id, char_region.  An account with a running job gets no batch, nor
    does a character of another region than its account."""
    free = characters.where("region = char_region").join(running.select("account_id").distinct(), "account_id", "left_anti")
    nth = F.row_number().over(Window.partitionBy("account_id").orderBy("char_id")) - 1
    return free.withColumn("batch", F.floor(nth / size)).groupBy("account_id", "batch").agg(F.sort_array(F.collect_list("char_id")).alias("char_ids"))


def job_status(failed: Column, synced: Column) -> Column:
    return F.when(failed == 0, "success").when(synced > 0, "partial").otherwise("failed")


def account_jobs(batches: DataFrame, reports: DataFrame) -> DataFrame:
    """(account_id, batches, synced, failed, status) of the planned characters; one without a report has failed."""
    each = batches.select("account_id", "batch", F.explode("char_ids").alias("char_id")).join(reports.select("char_id", F.col("status").alias("got")), "char_id", "left")
    good = F.coalesce(F.col("got") != "failed", F.lit(False))
    done = each.groupBy("account_id").agg(F.count_distinct("batch").alias("batches"), F.count_if(good).alias("synced"), F.count_if(~good).alias("failed"))
    return done.withColumn("status", job_status(F.col("failed"), F.col("synced")))


def account_collections(accounts: DataFrame, mounts: DataFrame, pets: DataFrame) -> DataFrame:
    """(account_id, mounts, pets): both collections of each account, parsed from their payloads; what is missing or
    no list is empty.  mounts and pets: account_id, payload as JSON with a list of that name."""

    def parsed(df: DataFrame, name: str) -> DataFrame:
        ids = F.from_json("payload", f"{name} array<struct<id:long>>")[name]["id"]
        return df.select("account_id", F.array_sort(F.array_compact(ids)).alias(name))

    none = F.expr("cast(array() as array<bigint>)")
    both = accounts.select("account_id").join(parsed(mounts, "mounts"), "account_id", "left").join(parsed(pets, "pets"), "account_id", "left")
    return both.select("account_id", F.coalesce("mounts", none).alias("mounts"), F.coalesce("pets", none).alias("pets"))


def cached_answers(requests: DataFrame, answers: DataFrame, ttl: int, negative_ttl: int) -> DataFrame:
    """requests (key, user_scoped, ts) with ``hit``: whether the newest answer of the key at or before the request
    still holds then.

    answers: key, ts, found; later answers do not matter.  One that found nothing holds for the shorter
    ``negative_ttl``; what is asked for a user is never cached.  Times are seconds."""
    last = last_before(requests, answers.select("key", "ts", "found"), "key", "ts")
    fresh = F.col("ts") - F.col("last.ts") < F.when(F.col("last.found"), ttl).otherwise(negative_ttl)
    return last.withColumn("hit", F.coalesce(fresh & ~F.col("user_scoped"), F.lit(False))).drop("last")
