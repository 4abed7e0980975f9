"""Mutation logs: rows (key, seq, value) with the highest seq of a key standing, from tables and from byte logs."""

from __future__ import annotations

import struct
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.plans.model import Corrupt, TooLarge
from stratum.plans.scratch import scratch_root


def mutations(df: DataFrame, key: str | Column, seq: str | Column, value: str | Column, deleted: Column | None = None, **more: Column) -> DataFrame:
    """Any table as a log; rows where `deleted` holds are tombstones."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    v = col(value)
    if deleted is not None:
        v = F.when(deleted, F.lit(None)).otherwise(v)
    return df.select(col(key).alias("key"), col(seq).cast("long").alias("seq"), v.alias("value"), *[c.alias(n) for n, c in more.items()])


def numbered(batch: DataFrame, last_seq: int, order: list[str] | None = None) -> DataFrame:
    """Appends: rows in the given order or that of arrival get the sequence numbers after last_seq.

    The batch is computed once, into a table of the scratch folder, and counts and rows are read from there: computed twice, it may be cut into
    other partitions, as Spark chooses these by the sizes of the columns that it needs.
    """
    rows = placed(batch, order)
    staged = f"{scratch_root(batch.sparkSession)}/numbered-{uuid.uuid4().hex[:12]}"
    rows.write.mode("overwrite").parquet(staged)
    return number(batch.sparkSession.read.schema(rows.schema).parquet(staged), last_seq)


def placed(batch: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Rows with their place (_id): the partition, and the position in it. To be kept before it is numbered."""
    arrived = batch if order is None else batch.sort(*order)
    return arrived.withColumn("_id", F.monotonically_increasing_id())


def number(kept: DataFrame, last_seq: int) -> DataFrame:
    """Numbers placed rows, which are read twice and must be the same both times, so they are a table or persisted.

    Numbers are dense within and across partitions: each partition's offset comes from the partitions' counts, so no task sees all rows.
    """
    counts = kept.groupBy(F.shiftright("_id", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()
    offsets, total = [], last_seq
    for r in counts:
        offsets.append((r["p"], total))
        total += r["n"]
    table = kept.sparkSession.createDataFrame(offsets or [(0, last_seq)], "p long, base long")
    joined = kept.join(F.broadcast(table), F.shiftright("_id", 33) == F.col("p"))
    return joined.withColumn("seq", F.col("base") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_id", "p", "base")


# ---------------------------------------------------------------- byte logs
#: Fixed values of the record format.
KIND_SET, KIND_DELETE, HEADER, VERSION = 0, 1, 8, 2
LIMIT = (1 << 32) - 1
MAGIC = b"STRATLOG"
PIECE, READ = 1 << 12, 1 << 20  # bytes of a log in a row (Spark hands over 10,000 rows at once), and bytes of a file read at once


def encode_record(seq: int, key: bytes, value: bytes | None) -> bytes:
    """crc and length of the payload, then the payload; the crc covers the length too."""
    for part in (key, value or b""):
        if len(part) > LIMIT:
            raise TooLarge(len(part))
    payload = struct.pack("<QBI", seq, KIND_DELETE if value is None else KIND_SET, len(key)) + key
    if value is not None:
        payload += struct.pack("<I", len(value)) + value
    if len(payload) > LIMIT:
        raise TooLarge(len(payload))
    body = struct.pack("<I", len(payload)) + payload
    return struct.pack("<I", zlib.crc32(body)) + body


def decode_record(payload: bytes) -> tuple[int, bytes, bytes | None] | None:
    """(seq, key, value), or None for what is no record of this version."""
    if len(payload) < 13:
        return None
    seq, kind, n = struct.unpack_from("<QBI", payload)
    key, rest = payload[13 : 13 + n], payload[13 + n :]
    if len(key) < n or kind not in (KIND_SET, KIND_DELETE):
        return None
    if kind == KIND_DELETE:
        return None if rest else (seq, key, None)
    if len(rest) < 4 or len(rest) - 4 != struct.unpack_from("<I", rest)[0]:
        return None
    return seq, key, rest[4:]


class LogReader:
    """A log read piece by piece: a piece gives the records that it completes. What is held is a piece and a record at most. `end` is the end of the intact
    records so far, `torn` where the first torn one begins; it is known once the log is finished (None for a clean end)."""

    def __init__(self, path: str = "", magic: bytes = MAGIC):
        self.path, self.magic, self.end, self.torn = path, magic, 0, None
        self.parts, self.held, self.needed = [], 0, len(magic) + 4

    def feed(self, piece: bytes) -> list[tuple[int, bytes, bytes | None]]:
        if self.torn is not None:
            return []
        self.parts.append(piece)
        self.held += len(piece)
        if self.held < self.needed:
            return []
        data, at, out = b"".join(self.parts), 0, []
        if not self.end:
            at = self.end = len(self.magic) + 4
            if data[: len(self.magic)] != self.magic or struct.unpack_from("<I", data, len(self.magic))[0] != VERSION:
                raise Corrupt(self.path, "not a log of this version")
        while True:
            self.needed = HEADER
            if len(data) - at < HEADER:
                break
            crc, n = struct.unpack_from("<II", data, at)
            self.needed, end = HEADER + n, at + HEADER + n
            if end > len(data):
                break
            record = decode_record(data[at + HEADER : end]) if zlib.crc32(data[at + 4 : end]) == crc else None
            if record is None:
                self.torn, self.parts, self.held = self.end, [], 0
                return out
            out.append(record)
            self.end += end - at
            at = end
        self.parts, self.held = [data[at:]], len(data) - at
        return out

    def finish(self) -> None:
        if self.torn is None and self.held:
            self.torn = self.end


def read_log(data: bytes, path: str = "", magic: bytes = MAGIC) -> tuple[list[tuple[int, bytes, bytes | None]], int, int | None]:
    """Intact records of a log, their end, and where the first torn one begins (None for a clean end)."""
    reader = LogReader(path, magic)
    out = reader.feed(data)
    reader.finish()
    return out, reader.end, reader.torn


def write_log(records: list[tuple[int, bytes, bytes | None]], magic: bytes = MAGIC) -> bytes:
    return magic + struct.pack("<I", VERSION) + b"".join(encode_record(*r) for r in records)


def read_logs(spark: SparkSession, path: str, magic: bytes = MAGIC) -> DataFrame:
    """path, key, seq, value of the intact prefix of each log file in a folder."""

    def run(batches):
        for b in batches:
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                reader = LogReader(p, magic)
                for at in range(0, len(data), READ):
                    rows = reader.feed(data[at : at + READ])
                    yield pa.RecordBatch.from_arrays([pa.array([p] * len(rows), pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["path", "key", "seq", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, key binary, seq long, value binary")
