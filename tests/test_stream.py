from pyspark.sql import functions as F

from stratum.operators import resolve
from stratum.plans.store import Store
from stratum.sources.mutations import mutations
from stratum.streaming import latest

EVENTS = "/root/testdata/sf0.001"


def log(events):
    return mutations(events, "user_id", F.col("event_id") + 1, "props", F.col("event_type") == "error")


def test_the_stream_ends_where_the_batch_does(spark, tmp_path):
    table = spark.read.parquet(f"{EVENTS}/events.parquet")
    table.repartition(5).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sorted(map(tuple, latest.replayed(spark, log(source), f"file://{tmp_path}").collect()))
    assert got == sorted(map(tuple, resolve.live(log(table)).collect()))


def test_a_stream_writes_into_a_store(spark, tmp_path):
    spark.createDataFrame([(b"a", b"1"), (b"b", None)], "key binary, value binary").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key binary, value binary").parquet(str(tmp_path / "in"))
    store = Store(spark, f"file://{tmp_path}/store")
    query = latest.into_store(stream, store, str(tmp_path / "check"))
    query.processAllAvailable()
    query.stop()
    assert store.get(b"a") == b"1" and store.get(b"b") is None and store.table_count() == 1


def test_commit_windows(spark):
    df = spark.createDataFrame([("2026-01-01 00:59:59",), ("2026-01-01 01:00:00",), ("2026-01-01 01:30:00",)], "t string").select(F.to_timestamp("t").alias("ts"))
    assert sorted(r.appends for r in latest.commit_windows(df, "ts", "1 hour").collect()) == [1, 2]
