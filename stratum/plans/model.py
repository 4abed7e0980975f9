"""Schemas, configuration and errors. A mutation whose value is null is a tombstone; an empty value is a value."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

MUTATION = T.StructType([T.StructField("key", T.BinaryType(), False), T.StructField("seq", T.LongType(), False), T.StructField("value", T.BinaryType(), True)])
FILE = T.StructType(
    [
        T.StructField("number", T.LongType(), False),
        T.StructField("level", T.IntegerType(), False),
        T.StructField("min_key", T.BinaryType(), False),
        T.StructField("max_key", T.BinaryType(), False),
        T.StructField("bytes", T.LongType(), False),
        T.StructField("entries", T.LongType(), False),
    ]
)

FOUND, DELETED, MISSING = "FOUND", "DELETED", "MISSING"


class StoreError(Exception):
    """Anything a store can fail on."""


class StoreIoError(StoreError):
    def __init__(self, path: str, source: object):
        super().__init__(f"{path}: {source}")


class Corrupt(StoreError):
    def __init__(self, path: str, detail: str):
        super().__init__(f"{path}: corrupt: {detail}")


class TooLarge(StoreError):
    def __init__(self, size: int):
        super().__init__(f"{size} bytes exceeds the 4 GiB limit for one key or value")


@dataclass(frozen=True)
class Config:
    """Defaults of a store. memtable_bytes is also the size of compaction's output files and, times fanout, the budget of level 1."""

    sync: str = "group"
    memtable_bytes: int = 4 << 20
    l0_trigger: int = 4
    fanout: int = 10
    bits_per_key: int = 10

    @property
    def level_bytes(self) -> int:
        return self.memtable_bytes * self.fanout


def file_name(number: int, kind: str = "run") -> str:
    """Logs and runs share one number space."""
    return f"{number:06d}.{kind}"
