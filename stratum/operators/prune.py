"""Which files can hold a key: ranges of files against keys and against each other.

The files side has a row for each file. Up to BROADCAST_FILES of them are broadcast; beyond, keys and files meet in
slots of the key space, by equality. Slots are cut at evenly spaced ranks of the files' least keys, SLOTS of them at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.sources.mutations import numbered

BROADCAST_FILES = 64
SLOTS = 256


def covers(key: str = "key") -> Column:
    return F.col(key).between(F.col("min_key"), F.col("max_key"))


def overlaps(a: str, b: str) -> Column:
    """Closed ranges of two aliases share a key."""
    return (F.col(f"{a}.min_key") <= F.col(f"{b}.max_key")) & (F.col(f"{b}.min_key") <= F.col(f"{a}.max_key"))


def _small(files: DataFrame) -> bool:
    return files.limit(BROADCAST_FILES + 1).count() <= BROADCAST_FILES


def _slots(files: DataFrame) -> Callable[[Column], Column]:
    """The number of the slot of a key, as a function of its column. What is collected are SLOTS keys at most."""
    step = max(1, -(-files.count() // SLOTS))
    bounds = [r[0] for r in numbered(files.select(F.col("min_key").alias("b")), 0, ["b"]).where((F.col("seq") - 1) % step == 0).select("b").distinct().orderBy("b").collect()]
    if not bounds:
        return lambda c: F.lit(0)
    return lambda c: F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= c))


def _spread(files: DataFrame, slot: Callable[[Column], Column]) -> DataFrame:
    """Each file in every slot that its range touches."""
    return files.withColumn("_first", slot(F.col("min_key"))).withColumn("_slot", F.explode(F.sequence("_first", slot(F.col("max_key")))))


def candidates(keys: DataFrame, files: DataFrame, how: str = "inner") -> DataFrame:
    """keys (column key) with the files that cover them; also left_semi and left_anti."""
    if _small(files):
        return keys.join(F.broadcast(files), covers(), how)
    slot = _slots(files)
    s, k = _spread(files, slot).drop("_first").alias("s"), keys.withColumn("_slot", slot(F.col("key"))).alias("k")
    meet = (F.col("k._slot") == F.col("s._slot")) & (F.col("k.key") >= F.col("s.min_key")) & (F.col("k.key") <= F.col("s.max_key"))
    joined = k.join(s, meet, how)
    return joined.select("k.*", *[f"s.{c}" for c in files.columns]).drop("_slot") if how == "inner" else joined.drop("_slot")


def overlapping_pairs(files: DataFrame) -> DataFrame:
    """a_number < b_number for every two files whose ranges meet. They meet in slots, and count in the first that both touch."""
    spread = _spread(files.select("number", "min_key", "max_key"), _slots(files))
    meet = (F.col("a._slot") == F.col("b._slot")) & (F.col("a._slot") == F.greatest("a._first", "b._first")) & (F.col("a.number") < F.col("b.number")) & overlaps("a", "b")
    return spread.alias("a").join(spread.alias("b"), meet).select(F.col("a.number").alias("a_number"), F.col("b.number").alias("b_number"))


def key_range(files: DataFrame) -> tuple:
    """Least and greatest key of some files."""
    return tuple(files.agg(F.min("min_key"), F.max("max_key")).first())
