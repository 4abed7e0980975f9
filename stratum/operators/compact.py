"""Compaction: which level is due, which files take part, and what their merge leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prune import candidates, key_range
from .resolve import latest


def budget(level: Column, level_bytes: int, fanout: int) -> Column:
    """Bytes allowed in a level from 1 on."""
    return (F.lit(level_bytes) * F.pow(F.lit(fanout), level - 1)).cast("long")


def scores(files: DataFrame, l0_trigger: int, level_bytes: int, fanout: int) -> DataFrame:
    """level, files, bytes, score, eligible. Level 0 counts files and is due at its trigger; deeper levels must exceed their bytes."""
    by = files.groupBy("level").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))
    ratio = lambda a, b: F.when(b == 0, F.lit(float("inf"))).otherwise(a / b)
    deep = ratio(F.col("bytes").cast("double"), budget(F.col("level"), level_bytes, fanout).cast("double"))
    score = F.when(F.col("level") == 0, F.lit(None).cast("double") if not l0_trigger else F.col("files") / F.lit(float(l0_trigger))).otherwise(deep)
    return by.withColumn("score", score).withColumn("eligible", F.coalesce(F.when(F.col("level") == 0, F.col("score") >= 1).otherwise(F.col("score") > 1), F.lit(False)))


def plan_level(files: DataFrame, l0_trigger: int, level_bytes: int, fanout: int) -> DataFrame:
    """The level most in need, shallower first among equals; no row if none is."""
    return scores(files, l0_trigger, level_bytes, fanout).where("eligible").orderBy(F.desc("score"), "level").limit(1).select("level", "score")


def inputs_for(files: DataFrame, level: int) -> DataFrame:
    """All of level 0, or the lowest number of a deeper level, and what they overlap one level down."""
    own = files.where(F.col("level") == level)
    if level:
        own = own.orderBy("number").limit(1)
    low, high = key_range(own)
    under = files.where((F.col("level") == level + 1) & (F.col("min_key") <= F.lit(high)) & (F.col("max_key") >= F.lit(low)))
    return own.unionByName(under)


def merge(*runs: DataFrame) -> DataFrame:
    """Newest version of each key of several runs; obsolete ones go, tombstones stay."""
    whole = runs[0]
    for r in runs[1:]:
        whole = whole.unionByName(r)
    return latest(whole)


def purge(merged: DataFrame, deeper: DataFrame) -> DataFrame:
    """Without the tombstones that no deeper file can need. deeper: files below the output level."""
    dead = merged.where("value is null")
    needed = candidates(dead, deeper.select("min_key", "max_key"), "left_semi")
    return merged.where("value is not null").unionByName(needed)


def level_sizes(files: DataFrame) -> DataFrame:
    """level and files for every level down to the deepest, empty ones too."""
    have = files.groupBy("level").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))
    deepest = files.agg(F.coalesce(F.max("level"), F.lit(0)).alias("deepest"))
    every = deepest.select(F.explode(F.sequence(F.lit(0), "deepest")).alias("level"))
    return every.join(have, "level", "left").select("level", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def first_gap(numbers: DataFrame, n: str) -> DataFrame:
    """present (length of the unbroken prefix 0..), holes and past_end (numbers after the first gap), for a crash check."""
    ordered = numbers.select(F.col(n).alias("n")).distinct()
    follow = ordered.join(ordered.select((F.col("n") - 1).alias("n"), F.lit(True).alias("next")), "n", "left")
    ends = follow.where("next is null").agg(F.min("n").alias("end"))
    first = ordered.agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count(F.lit(1)).alias("total"))
    prefix = F.when(F.col("low") == 0, F.col("end") + 1).otherwise(F.lit(0))
    return first.join(ends, F.lit(True)).select(F.coalesce(prefix, F.lit(0)).cast("long").alias("present"), F.coalesce(F.col("high") + 1 - F.col("total"), F.lit(0)).cast("long").alias("holes"), F.coalesce(F.col("total") - prefix, F.lit(0)).cast("long").alias("past_end"))
