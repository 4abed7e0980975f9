"""Streaming passes over rows that are dealt by a key and sorted, in constant memory.

Each pass keeps one row between Arrow batches, so a key with any number of rows is never held together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

Columns = list[np.ndarray]


def _columns(batch: pa.RecordBatch) -> Columns:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def distinct_rows(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[Columns]:
    """Columns of sorted batches without the rows whose first n_keys columns equal those of the row before."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = _columns(batch)
        same = np.ones(batch.num_rows, bool)
        same[0] = last is not None and all(c[0] == x for c, x in zip(cols, last, strict=False))
        for c in cols[:n_keys]:
            same[1:] &= c[1:] == c[:-1]
        last = [c[-1] for c in cols[:n_keys]]
        if not same.all():
            yield [c[~same] for c in cols]


def with_neighbours(batches: Iterator[Columns], n_keys: int) -> Iterator[tuple[Columns, np.ndarray, np.ndarray]]:
    """Rows in order, each once: columns, whether the row before has the same first n_keys columns, whether the next has.

    One row is held back until its successor is known.
    """
    held: Columns | None = None
    held_before = False
    for cols in batches:
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
        n = len(cols[0])
        same = np.ones(n - 1, bool)
        for k in cols[:n_keys]:
            same &= k[1:] == k[:-1]
        before = np.r_[held_before, same]
        if n > 1:
            yield [c[:-1] for c in cols], before[:-1], same
        held, held_before = [c[-1:] for c in cols], bool(before[-1])
    if held is not None:
        yield held, np.array([held_before]), np.array([False])


def first_of_run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For rows (key, member, ...) sorted by both: keys, members and the first member of each row's key, without repeated rows."""
    key = first = last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k, m = _columns(batch)[:2]
        n = len(k)
        new = np.r_[True, k[1:] != k[:-1]]
        if key is not None and k[0] == key:
            new[0] = False
        start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        lead = np.where(start >= 0, m[np.maximum(start, 0)], first if first is not None else 0)
        repeat = np.r_[False, (k[1:] == k[:-1]) & (m[1:] == m[:-1])]
        if key is not None and k[0] == key and m[0] == last:
            repeat[0] = True
        yield k[~repeat], m[~repeat], lead[~repeat]
        key, first, last = k[-1], lead[-1], m[-1]


def map_runs(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict[str, np.ndarray]]], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for out in fn(batches):
            if len(next(iter(out.values()))):
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return run
