"""Replay of a log up to its first bad record; what follows is discarded even where it is intact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def intact_prefix(log: DataFrame, pos: str, bad: Column) -> DataFrame:
    first = log.where(bad).agg(F.min(pos).alias("_torn"))
    return log.join(first, F.col("_torn").isNull() | (F.col(pos) < F.col("_torn"))).drop("_torn")


def torn_at(log: DataFrame, pos: str, bad: Column) -> DataFrame:
    """torn_at (null for a clean log), records and last_seq of the prefix."""
    first = log.where(bad).agg(F.min(pos).alias("torn_at"))
    kept = intact_prefix(log, pos, bad).agg(F.count(F.lit(1)).alias("records"), F.max("seq").alias("last_seq"))
    return first.join(kept, F.lit(True))


def last_sequence(log: DataFrame, recorded: int) -> DataFrame:
    """Survives reopening even where all logs are gone."""
    return log.agg(F.greatest(F.lit(recorded).cast("long"), F.max("seq")).alias("last_seq"))
