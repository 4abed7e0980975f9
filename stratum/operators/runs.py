"""Sorted runs: what a flush writes, the statistics that describe a run, and the cuts into blocks and output files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .resolve import latest, octets

BLOCK_BYTES = 4096
RECORD_BYTES = 13  # seq, kind and key length of a record; a value has a length of 4 bytes too


def record_bytes():
    return RECORD_BYTES + octets("key") + F.when(F.col("value").isNull(), 0).otherwise(4 + octets("value"))


def run_stats(log: DataFrame, file: str = "file") -> DataFrame:
    """file, min_key, max_key, entries and bytes of each run, after newest-of-key within the run."""
    return latest(log, [file]).groupBy(file).agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count(F.lit(1)).alias("entries"), F.sum(octets("key", "value")).alias("bytes"))


def cuts(entries: DataFrame, file: str, limit: int, name: str = "block") -> DataFrame:
    """Numbers each entry of a file, in key order, with its block: a block ends once it has `limit` bytes.

    The fold starts anew after each cut, so a running sum cannot express it; a file, which bounds the group, is folded in one task.
    """
    rows = entries.select(F.col(file).alias("file"), "key", record_bytes().alias("size"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        out, block, n = [], 0, 0
        for size in pdf["size"].tolist():
            out.append(block)
            n += size
            if n >= limit:
                block, n = block + 1, 0
        return pdf.assign(block=out)

    kind = rows.schema["key"].dataType.simpleString()
    where = rows.schema["file"].dataType.simpleString()
    return rows.groupBy("file").applyInPandas(fold, f"file {where}, key {kind}, size long, block long").withColumnRenamed("block", name)


def sparse_index(entries: DataFrame, file: str = "file", limit: int = BLOCK_BYTES) -> DataFrame:
    """file, block, first_key, entries, bytes of each block."""
    return cuts(entries, file, limit).groupBy("file", "block").agg(F.min("key").alias("first_key"), F.count(F.lit(1)).alias("entries"), F.sum("size").alias("bytes"))
