import math

import pytest
from pyspark.sql import functions as F

from stratum.functions import bloom


def test_hash_vectors():
    got = bloom.hash_keys([b"", b"only", b"key:1000", b"key:1001"]).tolist()
    assert got == [0xF52A15E9A9B5E89B, 0x345EB8053708CFCD, 0x66D4F8BEDE34A0B9, 0x770872ADB4CC82DD]


def test_probes():
    assert [bloom.probes_for(b) for b in (0, 4, 8, 10, 12, 16, 100)] == [1, 3, 6, 7, 8, 11, 30]


def test_no_false_negative_and_a_rate_near_theory():
    keys = [b"key:%d" % i for i in range(10_000)]
    f = bloom.build(keys, 10)
    assert bloom.may_contain(f, keys).all()
    assert int(bloom.may_contain(f, [b"absent:%d" % i for i in range(200_000)]).sum()) == 1636


def test_small_filters_have_the_least_size():
    assert len(bloom.build([b"only"], 10)) == 9 and bloom.may_contain(bloom.build([], 10), [b"x"]).tolist() == [False]


@pytest.mark.parametrize("bad", [b"", b"\x01", b"\xff\x00"])
def test_bytes_that_are_no_filter(bad):
    with pytest.raises(ValueError):
        bloom.may_contain(bad, [b"k"])


def test_columns_agree_with_the_functions(spark):
    df = spark.createDataFrame([(b,) for b in (1, 4, 8, 10, 12, 16, 90)], "b long")
    for r in df.select("b", bloom.probes_column(F.col("b")).alias("p"), bloom.theory(F.col("b")).alias("t")).collect():
        assert r.p == bloom.probes_for(r.b) and math.isclose(r.t, (1 - math.exp(-r.p / r.b)) ** r.p)
    keys = spark.createDataFrame([(b"only",), (b"",)], "k binary")
    assert sorted(x[0] & (2**64 - 1) for x in keys.select(bloom.key_hash(F.col("k"))).collect()) == sorted([0x345EB8053708CFCD, 0xF52A15E9A9B5E89B])


def test_filters_of_files_prune_absent_keys(spark):
    entries = spark.range(6000).selectExpr("id % 11 as file", "cast(concat('key:', id) as binary) as key")
    asked = spark.range(1000).selectExpr("id % 11 as file", "cast(concat('key:', id, 'x') as binary) as key")
    maybe = bloom.probe(asked, bloom.filters(entries)).where("maybe").count()
    assert maybe < 30
