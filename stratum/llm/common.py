"""What the operators share: the scratch folder, and vectorised scans of text held as Arrow buffers.

A scan looks at a block of texts as one array of bytes. Words, their hashes and the hashes of
runs of words come from vector operations on that array, so no Python code runs per word. Blocks hold
about BLOCK_BYTES of text (one longer text is a block of its own), which bounds a worker's memory.

Defined results: a null text is an empty one; a word or window never reaches over the end of a text; hashes depend on bytes and seed only.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum.plans.scratch import scratch_root

BLOCK_BYTES = 1 << 20


# ---------------------------------------------------------------- scratch tables
class Scratch:
    """Tables written to the shared folder. They cut lineage, so a lost executor costs one stage and not the whole plan."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, **options) -> DataFrame:
        df.write.mode("overwrite").options(**options).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def free(self) -> None:
        """Lets Spark delete the shuffle files of plans that nothing refers to any more, now and not when the driver next collects its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def _reach(self, path: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def drop(self, name: str) -> None:
        fs, path = self._reach(self.path(name))
        fs.delete(path, True)

    def only(self, name: str) -> None:
        """Deletes all tables but this one, once nothing reads them any more."""
        fs, root = self._reach(self.root)
        for found in fs.listStatus(root):
            if found.getPath().getName() != name:
                fs.delete(found.getPath(), True)


def long_id(df: DataFrame, name: str) -> Column:
    """The id column as a long. Ids of other types have no order or number that results could carry, so they are refused."""
    if not isinstance(df.schema[name].dataType, T.IntegralType):
        raise TypeError(f"column {name} must hold whole numbers, not {df.schema[name].dataType.simpleString()}")
    return F.col(name).cast("long")


def schema_of(rows: DataFrame, names: list[str], ddl: str) -> T.StructType:
    """Some columns of rows, then those of a DDL string."""
    return T.StructType([*[rows.schema[n] for n in names], *T.StructType.fromDDL(ddl)])


# ---------------------------------------------------------------- blocks of texts
def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and 64-bit offsets of a column of strings or bytes; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64, len(column) + 1, column.offset * 8) if at is not None and len(column) else np.zeros(1, np.int64)
    lo, hi = int(at[0]), int(at[-1])
    body = np.frombuffer(data, np.uint8, hi - lo, lo) if data is not None and hi > lo else np.zeros(0, np.uint8)
    return body, at - lo


def release() -> None:
    """Gives back what a finished task has freed, so that idle workers do not hold it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch in pieces of about `limit` bytes of text: the rows, their bytes, their offsets."""
    for batch in batches:
        body, at = buffers(batch.column(batch.schema.get_field_index(text)))
        first, n = 0, batch.num_rows
        while first < n:
            last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
            last = min(last, n)
            yield batch.slice(first, last - first), body[at[first] : at[last]], at[first : last + 1] - at[first]
            first = last
    release()


# ---------------------------------------------------------------- hashing
SPANS = 1 << 18  # byte ranges hashed at once
_ODD, _LENGTH, _KEY = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xA0761D6478BD642F), 0xD1B54A32D192ED03
_MASK = (np.uint64(1) << (np.arange(8, dtype=np.uint64) * np.uint64(8))) - np.uint64(1)
_MASK = np.r_[_MASK, np.uint64(0xFFFFFFFFFFFFFFFF)]


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, on uint64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _key(seed: int, number: int = 0) -> np.uint64:
    return np.uint64((_KEY * (2 * seed + 1) + 0x9E3779B97F4A7C15 * number) & 0xFFFFFFFFFFFFFFFF)


def lanes(body: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as one number; zeros follow the last."""
    held = np.zeros(len(body) + 8, np.uint8)
    held[: len(body)] = body
    return np.ndarray((len(body) + 1,), "<u8", held, strides=(1,))


def _rest(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All lanes but the first of the ranges longer than eight bytes: those ranges, where each one's lanes begin, and the number, place and width of each lane."""
    long = np.flatnonzero(size > 8)
    n = (size[long] - 1) >> 3
    begin = np.cumsum(n) - n
    number = np.arange(int(n.sum())) - np.repeat(begin, n) + 1
    return long, begin, number, np.repeat(start[long], n) + 8 * number, np.minimum(np.repeat(size[long], n) - 8 * number, 8)


def span_hashes(view: np.ndarray, start: np.ndarray, end: np.ndarray, *seeds: int) -> list[np.ndarray]:
    """Hashes of byte ranges, one array for each seed. Every eight bytes go through a non-linear mix keyed by the seed and their number, so that
    no pattern within a text cancels out; hashes of different seeds are independent all the way. view: lanes() of the bytes."""
    out = [np.empty(len(start), np.uint64) for _ in seeds]
    for i in range(0, len(start), SPANS):
        low, size = start[i : i + SPANS], (end - start if len(start) <= SPANS else end[i : i + SPANS] - start[i : i + SPANS])
        first = view[low] & _MASK[np.minimum(size, 8)]
        long, begin, number, at, width = _rest(low, size)
        more = view[at] & _MASK[width]
        for hashes, seed in zip(out, seeds, strict=True):
            sums = mix(first + _key(seed))
            if len(long):
                sums[long] += np.add.reduceat(mix(more + _key(seed) + number.astype(np.uint64) * _LENGTH), begin)
            hashes[i : i + SPANS] = mix(sums ^ size.astype(np.uint64) * _ODD)
    return out


def same_bytes(one: np.ndarray, a: np.ndarray, size: np.ndarray, two: np.ndarray, b: np.ndarray, its: np.ndarray) -> np.ndarray:
    """Whether the ranges of one text (lanes) have the bytes of those of another."""
    same = size == its
    mask = _MASK[np.minimum(size, 8)]
    same &= (one[a] & mask) == (two[np.where(same, b, 0)] & mask)
    some = np.flatnonzero(same)
    long, begin, number, at, width = _rest(a[some], size[some])
    if len(long):
        mask = _MASK[width]
        same[some[long]] = np.logical_and.reduceat((one[at] & mask) == (two[np.repeat(b[some[long]], np.diff(np.r_[begin, len(number)])) + 8 * number] & mask), begin)
    return same


def window_hashes(values: np.ndarray, width: int, seed: int = 0, have: int = 1) -> np.ndarray:
    """Hashes of all runs of `width` values: longer runs from pairs of shorter ones, by a non-linear mix, in log2(width) steps.

    have: the values are hashes of runs of so many already.
    """
    while have < width:
        step = min(have, width - have)
        values = values[:-step] * _ODD + values[step:] if len(values) > step else values[:0]
        values = mix(values + _key(seed, have + step))
        have += step
    return values


def byte_windows(view: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hashes of all runs of `width` bytes. view: lanes() of the bytes."""
    n, have = len(view) - 1, min(width, 8)
    if n < width:
        return np.zeros(0, np.uint64)
    return window_hashes(mix((view[: n - have + 1] & _MASK[have]) + _key(seed)), width, seed, have)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(body: np.ndarray, at: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, in bytes, and for each text the number of its first word (one more at the end).

    breaks: which byte values are not part of a word. A word never reaches over the end of a text.
    """
    n = len(body)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~breaks[body]
    head = np.zeros(n + 1, bool)
    head[at] = True  # a text begins here
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | head[1:n]
    finishes = inside.copy()
    finishes[:-1] &= ~inside[1:] | head[1:n]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(finishes) + 1, np.searchsorted(starts, at)


def word_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, *seeds: int, lower: bool = False) -> list[np.ndarray]:
    """Hashes of the words, one array for each seed; with `lower`, A-Z count as a-z."""
    return span_hashes(lanes(_LOWER[body] if lower else body), starts, ends, *seeds)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """For each i, the place of the least of values[i : i + width], the last one if several are equal."""
    at, best, have = np.arange(len(values)), values, 1
    while have < width:
        step = min(have, width - have)
        left, right = best[:-step], best[step:]
        take = right <= left
        at, best = np.where(take, at[step:], at[:-step]), np.where(take, right, left)
        have += step
    return at


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def union_spans(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-open ranges merged where they touch or overlap, in order."""
    if not len(first):
        return first, last
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    new = np.flatnonzero(np.r_[True, first[1:] > last[:-1]])
    return first[new], last[np.r_[new[1:] - 1, len(last) - 1]]
