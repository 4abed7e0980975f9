"""Bloom filters over keys: the exact filter, its size and its theory.

Parquet's own filters do the pruning of reads (see PARQUET_OPTIONS); the exact filter is for measuring and for foreign files. Its hash
needs wrapping 64-bit arithmetic, which SQL refuses, so it is a vectorised Arrow function over whole columns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the filter: offset and prime of the first hash, multipliers of its finalizer, least size, scaled ln 2.
OFFSET, PRIME = 0xCBF29CE484222325, 0x100000001B3
FINAL = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
MIN_BITS, LN2, SCALE = 64, 69_315, 100_000


def parquet_options(key: str = "key", ndv: int = 1_000_000) -> dict[str, str]:
    return {f"parquet.bloom.filter.enabled#{key}": "true", f"parquet.bloom.filter.expected.ndv#{key}": str(ndv)}


def hash_keys(keys: list[bytes]) -> np.ndarray:
    """64-bit hashes, one byte position of all keys at a time."""
    size = np.fromiter(map(len, keys), np.int64, len(keys))
    state = np.full(len(keys), OFFSET, np.uint64)
    if len(keys) and size.max():
        flat, start = np.frombuffer(b"".join(keys), np.uint8), np.cumsum(size) - size
        order = np.argsort(-size, kind="stable")
        counts = len(keys) - np.searchsorted(np.sort(size), np.arange(size.max()), "right")
        with np.errstate(over="ignore"):
            for i, n in enumerate(counts.tolist()):
                live = order[:n]
                state[live] = (state[live] ^ flat[start[live] + i]) * np.uint64(PRIME)
    with np.errstate(over="ignore"):
        for shift, by in zip((30, 27), FINAL, strict=True):
            state = (state ^ (state >> np.uint64(shift))) * np.uint64(by)
    return state ^ (state >> np.uint64(31))


def probes_for(bits_per_key: int) -> int:
    return min(30, max(1, (bits_per_key * LN2 + SCALE // 2) // SCALE))


def positions(hashes: np.ndarray, probes: int, bits: int) -> np.ndarray:
    """The bits of each hash: a walk in 32-bit arithmetic whose step is odd."""
    first, step = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    walk = first[:, None] + step[:, None] * np.arange(probes, dtype=np.uint32)[None, :]
    return walk % np.uint32(min(bits, 0xFFFFFFFF))


def build(keys: list[bytes], bits_per_key: int) -> bytes:
    """The bits, and the number of probes in the last byte."""
    size = -(-max(len(keys) * bits_per_key, MIN_BITS) // 8)
    probes = probes_for(bits_per_key)
    bits = np.zeros(size * 8, np.uint8)
    bits[positions(hash_keys(keys), probes, size * 8).ravel()] = 1
    return np.packbits(bits, bitorder="little").tobytes() + bytes([probes])


def may_contain(filter_: bytes, keys: list[bytes]) -> np.ndarray:
    """False is certain. Raises ValueError where the bytes are no filter."""
    if len(filter_) < 2 or not filter_[-1]:
        raise ValueError("not a filter")
    bits = np.unpackbits(np.frombuffer(filter_[:-1], np.uint8), bitorder="little")
    return bits[positions(hash_keys(keys), filter_[-1], len(bits))].all(axis=1)


def key_hash(key: Column) -> Column:
    @F.pandas_udf("long")
    def hashed(keys: pd.Series) -> pd.Series:
        return pd.Series(hash_keys([bytes(k) for k in keys]).view(np.int64))

    return hashed(key.cast("binary"))


def filters(entries: DataFrame, file: str = "file", bits_per_key: int = 10) -> DataFrame:
    """file, filter: the exact filter of each file's keys (a file, of bounded size, is one group)."""

    def make(key, table: pa.Table) -> pa.Table:
        return pa.table({"file": pa.array([key[0].as_py()], pa.int64()), "filter": pa.array([build(table.column("key").to_pylist(), bits_per_key)], pa.binary())})

    make.__annotations__ = {}
    return entries.select(F.col(file).cast("long").alias("file"), F.col("key").cast("binary").alias("key")).groupBy("file").applyInArrow(make, "file long, filter binary")


def probe(keys: DataFrame, filters_: DataFrame) -> DataFrame:
    """file and key rows with `maybe`; keys and filters meet by file, a filter with all its keys at once."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        own = left.column("key").to_pylist()
        hit = may_contain(right.column("filter")[0].as_py(), own) if right.num_rows else np.zeros(len(own), bool)
        return pa.table({"file": pa.array([key[0].as_py()] * len(own), pa.int64()), "key": pa.array(own, pa.binary()), "maybe": pa.array(hit)})

    run.__annotations__ = {}
    rows = keys.select(F.col("file").cast("long").alias("file"), F.col("key").cast("binary").alias("key"))
    return rows.groupBy("file").cogroup(filters_.groupBy("file")).applyInArrow(run, "file long, key binary, maybe boolean")


def probes_column(bits_per_key: Column) -> Column:
    return F.least(F.lit(30), F.greatest(F.lit(1), F.floor((bits_per_key * LN2 + SCALE // 2) / F.lit(SCALE)))).cast("int")


def theory(bits_per_key: Column) -> Column:
    """Expected share of false positives."""
    k = probes_column(bits_per_key).cast("double")
    return F.pow(1 - F.exp(-k / bits_per_key), k)
