"""Last write wins over a stream: each micro-batch is one group commit.

There is no event time, so no watermark: state is one version for each key, whatever the order of arrival.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratum.plans.store import Store


def logs(spark: SparkSession, path: str, schema, pending_bytes: int = 64 << 10) -> DataFrame:
    """A folder of Parquet logs as a stream; a micro-batch takes files until it has `pending_bytes`, one at least."""
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", pending_bytes).parquet(path)


def latest_stream(log: DataFrame) -> DataFrame:
    """Newest version of each key so far, in update mode: only changed keys come out."""
    return log.groupBy("key").agg(F.max(F.struct("seq", "value")).alias("_v")).select("key", "_v.seq", "_v.value")


def into_store(stream: DataFrame, store: Store, checkpoint: str, interval: str = "10 milliseconds", flush: bool = True) -> StreamingQuery:
    """Rows (key, value) of a stream as writes, one batch a trigger."""

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.apply(batch)
            if flush:
                store.flush()
                store.compact()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def replayed(spark: SparkSession, source: DataFrame, root: str, mode: str = "update") -> DataFrame:
    """Runs a bounded stream of (key, seq, value) to its end and gives the live keys of what it emitted, from a table in `root`."""
    at = f"{root.rstrip('/')}/stream-{uuid.uuid4().hex[:12]}"
    spark.createDataFrame([], source.schema).write.parquet(f"{at}/out/batch=-1")

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={n}")

    query = latest_stream(source).writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    emitted = spark.read.schema(source.schema).parquet(*[f"{at}/out"]).select("key", "seq", "value")
    newest = emitted.groupBy("key").agg(F.max(F.struct("seq", "value")).alias("_v")).select("key", "_v.seq", "_v.value")
    return newest.where("value is not null")


def commit_windows(log: DataFrame, at: str, length: str) -> DataFrame:
    """Appends for each commit if all that arrives within `length` is one commit."""
    return log.groupBy(F.window(at, length).alias("w")).agg(F.count(F.lit(1)).alias("appends")).select(F.col("w.start").alias("start"), "appends")
