"""A versioned key-value store on Parquet runs.

Writes are batches: each becomes a log folder with sequence numbers. flush() resolves the logs into one sorted run of level 0; compact()
merges levels until none is over its limit. Reads take the manifest's runs that can hold the keys, and the logs, and let the
highest sequence number win, so no order among files is needed. With background(), a thread of the driver flushes and compacts what is due; writes, flushes,
merges and point reads take turns.
"""

from __future__ import annotations

import functools
import threading

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.functions.bloom import parquet_options
from stratum.operators import compact, prune, resolve
from stratum.operators.resolve import octets
from stratum.sources import manifest
from stratum.sources.manifest import FileMeta, Folder, Snapshot
from stratum.sources.mutations import number, placed

from .maintenance import PAUSE, Maintenance
from .model import MUTATION, Config, Corrupt, file_name


def _in_turn(method):
    @functools.wraps(method)
    def call(self, *args, **named):
        with self.turn:
            return method(self, *args, **named)

    return call


class Store:
    def __init__(self, spark: SparkSession, path: str, config: Config | None = None):
        """Opens or creates. Partial files and runs that the manifest does not name are deleted; runs without a manifest are refused."""
        self.spark, self.config, self.folder = spark, config or Config(), Folder(spark, path)
        self.turn, self.maintenance = threading.RLock(), None
        names = self.folder.names()
        for n in names:
            if n.endswith(".tmp"):
                self.folder.delete(n)
        runs = [n for n in names if n.endswith(".run")]
        known = manifest.load(self.folder)
        if known is None and runs:
            raise Corrupt(path, "runs without a manifest")
        self.snapshot = known or Snapshot()
        live = {file_name(f.number) for f in self.snapshot.files}
        for n in runs:
            if n not in live:
                self.folder.delete(n)
        self.logs = [n for n in names if n.endswith(".log")]
        taken = [int(n.split(".")[0]) for n in [*self.logs, *runs]]
        self.next_number = max([self.snapshot.next_number, *(t + 1 for t in taken)])
        self.seq = self.snapshot.last_seq
        if self.logs:
            self.seq = max(self.seq, self.log().agg(F.max("seq")).first()[0] or 0)
        self.opened_written, self.groups_read, self.commits = self.snapshot.written, 0, 0

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Ends the background loop. There is nothing to save: what was not flushed is in the logs."""
        if self.maintenance is not None:
            self.maintenance.close()
            self.maintenance = None

    def background(self, pause: float = PAUSE) -> None:
        """Flushes and compacts what is due from now on, beside the writers."""
        self.maintenance = self.maintenance or Maintenance(self, pause)

    def dir(self) -> str:
        return self.folder.path

    # ------------------------------------------------------------ writes
    def _number(self) -> int:
        self.next_number += 1
        return self.next_number - 1

    def apply(self, batch: DataFrame, order: list[str] | None = None) -> None:
        """Appends rows (key, value; null deletes), numbered in the given order or that of arrival. All or nothing. Reports what the background loop failed on."""
        if self.maintenance is not None:
            self.maintenance.report()
        self._append(batch, order)
        if self.maintenance is not None:
            self.maintenance.notify()

    @_in_turn
    def _append(self, batch: DataFrame, order: list[str] | None) -> None:
        name = file_name(self._number(), "log")
        staged, rows = f"{name}.placed.tmp", placed(batch.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), *(order or [])), order)
        if order is None:  # the log has the batch's own partitions
            kept = rows.persist(StorageLevel.DISK_ONLY)
        else:
            rows.write.mode("overwrite").parquet(f"{self.folder.path}/{staged}")
            kept = self.spark.read.schema(rows.schema).parquet(f"{self.folder.path}/{staged}")
        try:
            number(kept, self.seq).select("key", "seq", "value").write.mode("overwrite").parquet(f"{self.folder.path}/{name}.tmp")
        finally:
            rows.unpersist()
            self.folder.delete(staged)
        self.folder.rename(f"{name}.tmp", name)
        self.logs.append(name)
        self.commits += 1
        self.seq = max(self.seq, self.spark.read.schema(MUTATION).parquet(f"{self.folder.path}/{name}").agg(F.max("seq")).first()[0] or 0)

    def set(self, key: bytes, value: bytes) -> None:
        self.apply(self.spark.createDataFrame([(key, value)], "key binary, value binary"))

    def delete(self, *keys: bytes) -> None:
        """Tombstones, even for keys that are absent."""
        self.apply(self.spark.createDataFrame([(k, None) for k in keys], "key binary, value binary"))

    def sync(self) -> None:
        """apply() returns after its commit, so there is nothing left to push."""

    # ------------------------------------------------------------ reads
    def log(self) -> DataFrame:
        if not self.logs:
            return self.spark.createDataFrame([], MUTATION)
        return self.spark.read.schema(MUTATION).parquet(*[f"{self.folder.path}/{n}" for n in self.logs])

    def runs(self, files: list[FileMeta]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], MUTATION)
        return self.spark.read.schema(MUTATION).parquet(*[f"{self.folder.path}/{file_name(f.number)}" for f in files])

    def versions(self, files: list[FileMeta] | None = None) -> DataFrame:
        return self.log().unionByName(self.runs(list(self.snapshot.files) if files is None else files))

    def view(self) -> DataFrame:
        return resolve.live(self.versions())

    def row_groups(self, file: FileMeta, key: bytes, filters: bool = True) -> int:
        """How many row groups of a run a read of this key opens: those whose statistics and, with filters, Bloom filters (or dictionaries, where
        a column is encoded by them as a whole) let it pass."""
        jvm = self.spark.sparkContext._jvm
        parquet, n = jvm.org.apache.parquet, 0
        value = parquet.io.api.Binary.fromConstantByteArray(key)
        wanted = parquet.filter2.compat.FilterCompat.get(parquet.filter2.predicate.FilterApi.eq(parquet.filter2.predicate.FilterApi.binaryColumn("key"), value))
        options = parquet.ParquetReadOptions.builder().withRecordFilter(wanted).useStatsFilter(True).useDictionaryFilter(filters).useBloomFilter(filters).build()
        for part in self.folder.parts(file_name(file.number), ".parquet"):
            reader = parquet.hadoop.ParquetFileReader.open(parquet.hadoop.util.HadoopInputFile.fromPath(part, self.folder.conf), options)
            n += reader.getRowGroups().size()
            reader.close()
        return n

    @_in_turn
    def get(self, key: bytes) -> bytes | None:
        """Reads the runs whose range covers the key and whose row groups may hold it; the filter, statistics and Bloom filters prune within them too."""
        groups = {f: self.row_groups(f, key) for f in self.snapshot.files if f.covers(key)}
        files = [f for f, n in groups.items() if n]
        self.groups_read += sum(groups.values())
        row = resolve.get(self.versions(files), key).select("value").first()
        return None if row is None else bytes(row[0])

    def lookup(self, requests: DataFrame) -> DataFrame:
        """key, status, value of many keys (column key)."""
        files = list(self.snapshot.files)
        if files:
            covering = prune.candidates(requests.select("key").distinct(), manifest.files_frame(self.spark, self.snapshot).select("number", "min_key", "max_key"))
            numbers = {r[0] for r in covering.select("number").distinct().collect()}
            files = [f for f in files if f.number in numbers]
        self.groups_read += len(files)
        return resolve.lookup(requests, self.versions(files))

    @_in_turn
    def remove(self, *keys: bytes) -> int:
        """Deletes the keys that are present and says how many were; a key asked for twice counts once."""
        wanted = self.spark.createDataFrame([(k,) for k in dict.fromkeys(keys)], "key binary")
        present = [bytes(r[0]) for r in self.lookup(wanted).where("status = 'FOUND'").select("key").collect()]
        if present:
            self.delete(*present)
        return len(present)

    # ------------------------------------------------------------ flush and compaction
    def _write_runs(self, entries: DataFrame, level: int) -> list[FileMeta]:
        """Sorted runs with Bloom filters on the key, in files of about memtable_bytes that do not overlap: all one run at level 0, a run each below."""
        total, count = entries.agg(F.sum(octets("key", "value")), F.count(F.lit(1))).first()
        if total is None:
            return []
        pieces = max(1, -(-int(total) // self.config.memtable_bytes))
        stage = f"{file_name(self._number())}.tmp"
        staged = f"{self.folder.path}/{stage}"
        ranged = entries.repartitionByRange(pieces, "key").sortWithinPartitions("key")
        options = parquet_options(ndv=max(64, -(-2 * count // pieces)))  # ranges are sampled, so files differ in size
        stats = [F.min("key").alias("a"), F.max("key").alias("b"), F.count(F.lit(1)).alias("n")]
        if level == 0:
            ranged.write.mode("overwrite").options(**options).parquet(staged)
            found = [(stage, self.spark.read.schema(MUTATION).parquet(staged).agg(*stats).first())]
        else:
            ranged.withColumn("_p", F.spark_partition_id()).write.mode("overwrite").options(**options).partitionBy("_p").parquet(staged)
            found = [(f"{stage}/_p={r['_p']}", r) for r in self.spark.read.parquet(staged).groupBy("_p").agg(*stats).orderBy("_p").collect()]
        out = []
        for where, r in found:
            number = self._number()
            self.folder.rename(where, file_name(number))
            out.append(FileMeta(number, level, bytes(r["a"]), bytes(r["b"]), self.folder.size(file_name(number)), r["n"]))
        self.folder.delete(stage)
        return out

    def _commit(self, added: list[FileMeta], removed: set[int]) -> None:
        new = self.snapshot.changed(added, removed, self.seq)
        new = Snapshot(new.files, new.last_seq, max(new.next_number, self.next_number), new.written)
        manifest.store(self.folder, new)
        self.snapshot = new

    def flush_due(self) -> bool:
        """Whether the logs are as large as a run may be."""
        with self.turn:
            return sum(self.folder.size(n) for n in self.logs) >= self.config.memtable_bytes

    @_in_turn
    def flush(self) -> None:
        """The logs become one run of level 0; they go only after the manifest has it."""
        if not self.logs:
            return
        self._commit(self._write_runs(resolve.latest(self.log()), 0), set())
        for n in self.logs:
            self.folder.delete(n)
        self.logs = []
        if self.maintenance is not None:
            self.maintenance.notify()

    def wait_for_flush(self) -> None:
        """Until nothing is due; without the background loop, by flushing."""
        if self.maintenance is None:
            self.flush()
        else:
            self.maintenance.wait()

    def compaction_due(self) -> int | None:
        """The level most in need of compaction."""
        c = self.config
        with self.turn:
            due = compact.plan_level(manifest.files_frame(self.spark, self.snapshot), c.l0_trigger, c.level_bytes, c.fanout).first()
        return None if due is None else due["level"]

    @_in_turn
    def compact_once(self) -> bool:
        level = self.compaction_due()
        if level is None:
            return False
        files = manifest.files_frame(self.spark, self.snapshot)
        numbers = {r[0] for r in compact.inputs_for(files, level).select("number").collect()}
        inputs = [f for f in self.snapshot.files if f.number in numbers]
        merged = compact.merge(self.runs(inputs))
        kept = compact.purge(merged, files.where(F.col("level") > level + 1))
        self._commit(self._write_runs(kept, level + 1), numbers)
        for f in inputs:
            self.folder.delete(file_name(f.number))
        return True

    def compact(self) -> None:
        while self.compact_once():
            pass

    # ------------------------------------------------------------ counters
    def table_count(self) -> int:
        return len(self.snapshot.files)

    def level_sizes(self) -> list[int]:
        return [len(self.snapshot.at_level(n)) for n in range(self.snapshot.deepest_level() + 1)]

    def last_sequence(self) -> int:
        return self.seq

    def block_reads(self) -> int:
        """Row groups that point reads, and runs that lookups, have opened since the store was opened."""
        return self.groups_read

    def commit_count(self) -> int:
        """Batches written since the store was opened."""
        return self.commits

    def bytes_written(self) -> int:
        return self.snapshot.written - self.opened_written
