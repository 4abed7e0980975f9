"""Last write wins: the newest version of each key, and the three-way answer found / deleted / missing.

Partial aggregation keeps one version of a key for each task before the shuffle, so hot keys do not pile up. Tombstones go last: a deleted
key must hide its older versions first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratum.plans.model import DELETED, FOUND, MISSING
from stratum.sources.mutations import numbered

ARRIVALS = 1 << 20  # rows of a block


def latest(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Newest version of each key (with `by`: of each key within each group), tombstones included."""
    keys = [*(by or []), "key"]
    return log.groupBy(*keys).agg(F.max(F.struct("seq", "value")).alias("_v")).select(*keys, "_v.seq", "_v.value")


def live(log: DataFrame) -> DataFrame:
    return latest(log).where("value is not null")


def tombstones(log: DataFrame) -> DataFrame:
    return latest(log).where("value is null").select("key", "seq")


def lookup(requests: DataFrame, log: DataFrame) -> DataFrame:
    """key, status and value of each requested key (column key). The log is reduced to the requested keys before it is aggregated."""
    wanted = requests.select("key").distinct()
    known = latest(log.join(wanted, "key", "left_semi"))
    status = F.when(F.col("seq").isNull(), MISSING).when(F.col("value").isNull(), DELETED).otherwise(FOUND)
    return requests.join(known, "key", "left").withColumn("status", status)


def get(log: DataFrame, key) -> DataFrame:
    """Versions of one key: the filter reaches the scan."""
    return live(log.where(F.col("key") == F.lit(key)))


def was_newest(log: DataFrame, *arrival: Column, block: int = ARRIVALS) -> DataFrame:
    """Whether each row was the newest of its key when it arrived. The arrivals of a key are taken in blocks, and only the greatest number of each block meets
    the others, so a key with most of the rows is spread over tasks. Rows must differ in `arrival`."""
    placed = numbered(log.withColumnRenamed("seq", "_seq"), 0, list(arrival)).withColumnsRenamed({"seq": "_n", "_seq": "seq"}).withColumn("_b", F.expr(f"_n div {block}"))
    tops = placed.groupBy("key", "_b").agg(F.max("seq").alias("_top"))
    before = tops.select("key", "_b", F.max("_top").over(W.partitionBy("key").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    seen = F.max("seq").over(W.partitionBy("key", "_b").orderBy("_n").rowsBetween(W.unboundedPreceding, -1))
    joined = placed.withColumn("_seen", seen).join(before, ["key", "_b"])
    return joined.select(*log.columns, F.coalesce(F.col("seq") > F.greatest("_seen", "_before"), F.lit(True)).alias("newest"))


def octets(*names: str) -> Column:
    out = F.lit(0).cast("long")
    for n in names:
        out = out + F.coalesce(F.octet_length(F.col(n).cast("string")).cast("long"), F.lit(0))
    return out


def table_stats(log: DataFrame) -> DataFrame:
    """Keys (tombstones included), bytes of the newest versions, bytes of all versions."""
    newest = latest(log).agg(F.count(F.lit(1)).alias("keys"), F.sum(F.when(F.col("value").isNull(), 1).otherwise(0)).alias("tombstones"), F.sum(octets("key", "value")).alias("newest_bytes"))
    return newest.join(log.agg(F.sum(octets("key", "value")).alias("all_bytes")), F.lit(True))


def scan(log: DataFrame) -> DataFrame:
    """Newest version of every key in key order; the sort is a range partitioning, not a single task."""
    return latest(log).orderBy("key")


def level_walk(runs: DataFrame, newest_first: str = "file") -> DataFrame:
    """The answer of the first run that knows a key. A tombstone is an answer and ends the walk."""
    first = runs.groupBy("key").agg(F.max(F.struct(newest_first, "seq", "value")).alias("_v"))
    return first.select("key", "_v.seq", "_v.value").where("value is not null")
