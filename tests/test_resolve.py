"""One contract over three plans of last write wins, and the answers of lookups."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratum.operators import resolve

LOG = "key binary, seq long, value binary"


def by_rank(log):
    k = F.row_number().over(W.partitionBy("key").orderBy(F.desc("seq")))
    return log.withColumn("k", k).where("k = 1").select("key", "seq", "value")


def by_walk(log):
    whole = log.withColumn("file", F.col("seq"))
    first = whole.groupBy("key").agg(F.max(F.struct("file", "seq", "value")).alias("v"))
    return first.select("key", "v.seq", "v.value")


def rows(df):
    return sorted((bytes(r.key), r.seq, None if r.value is None else bytes(r.value)) for r in df.select("key", "seq", "value").collect())


def newest(log):
    out = {}
    for k, s, v in log:
        if k not in out or s > out[k][0]:
            out[k] = (s, v)
    return sorted((k, s, v) for k, (s, v) in out.items())


def random_log(seed, n=300):
    r = random.Random(seed)
    keys = [b"", b"a", b"\x00\x01\xff", b"\x00\xff\n\x80", *(b"key:%02d" % i for i in range(20))]
    log = [(r.choice(keys), s + 1, r.choice([None, b"", b"v%d" % s])) for s in range(n)]
    r.shuffle(log)
    return log


@pytest.mark.parametrize("plan", [resolve.latest, by_rank, by_walk])
def test_highest_sequence_wins_whatever_the_arrival(spark, plan):
    log = random_log(1)
    assert rows(plan(spark.createDataFrame(log, LOG).repartition(3))) == newest(log)


def test_tombstones_hide_older_versions_and_empty_values_stand(spark):
    log = [(b"a", 1, b"x"), (b"a", 2, None), (b"b", 3, b""), (b"c", 4, None), (b"c", 5, b"y")]
    df = spark.createDataFrame(log, LOG)
    assert rows(resolve.live(df)) == [(b"b", 3, b""), (b"c", 5, b"y")]
    assert [(bytes(r.key), r.seq) for r in resolve.tombstones(df).collect()] == [(b"a", 2)]


def test_lookup_tells_deleted_from_missing(spark):
    df = spark.createDataFrame([(b"a", 1, b"x"), (b"b", 2, b"y"), (b"b", 3, None)], LOG)
    asked = spark.createDataFrame([(b"a",), (b"b",), (b"c",), (b"a",)], "key binary")
    got = sorted((bytes(r.key), r.status) for r in resolve.lookup(asked, df).collect())
    assert got == [(b"a", "FOUND"), (b"a", "FOUND"), (b"b", "DELETED"), (b"c", "MISSING")]


def test_was_newest_follows_arrival(spark):
    arrived = [(b"k", 3, b"", 0), (b"k", 1, b"", 1), (b"k", 4, b"", 2), (b"j", 2, b"", 3)]
    df = spark.createDataFrame(arrived, LOG + ", at int")
    for block in (1, 2, 100):
        got = {r.at: r.newest for r in resolve.was_newest(df, F.col("at"), block=block).collect()}
        assert got == {0: True, 1: False, 2: True, 3: True}


def test_was_newest_keeps_every_row_of_a_large_log(spark, narrow_cut):
    df = spark.range(0, 20_000, 1, 4).selectExpr("19999 - id AS at", "repeat(md5(cast(id AS string)), 4) AS value").selectExpr("at % 10 AS key", "(at * 7919) % 20000 AS seq", "value", "at")
    top, want = {}, []
    for i in range(20_000):
        seq = (i * 7919) % 20_000
        want.append((i, seq > top.get(i % 10, -1)))
        top[i % 10] = max(seq, top.get(i % 10, -1))
    assert sorted((r.at, r.newest) for r in resolve.was_newest(df, F.col("at"), block=64).select("at", "newest").collect()) == want


def test_scan_is_in_byte_order(spark):
    log = random_log(2)
    got = [bytes(r.key) for r in resolve.scan(spark.createDataFrame(log, LOG)).collect()]
    assert got == sorted({k for k, _, _ in log})


def test_table_stats_counts_newest_and_all(spark):
    df = spark.createDataFrame([(b"ab", 1, b"xyz"), (b"ab", 2, b"x"), (b"c", 3, None)], LOG)
    r = resolve.table_stats(df).first()
    assert (r["keys"], r.tombstones, r.newest_bytes, r.all_bytes) == (2, 1, 4, 9)


def test_get_pushes_the_key_to_the_scan(spark, tmp_path):
    path = str(tmp_path / "run")
    spark.createDataFrame(random_log(3), LOG).write.parquet(path)
    plan = resolve.get(spark.read.parquet(path), b"key:01")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key" in plan
