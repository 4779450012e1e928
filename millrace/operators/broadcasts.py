"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ROWS = 200_000


def few(df: DataFrame, most: int = MOST_ROWS) -> bool:
    """Whether df has at most ``most`` rows.  The check stops counting at the bound."""
    return df.limit(most + 1).count() <= most


def small(df: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most ``most`` rows; otherwise Spark shuffles it."""
    return F.broadcast(df) if few(df, most) else df
