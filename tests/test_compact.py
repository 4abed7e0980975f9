from pyspark.sql import functions as F

from stratum.operators import compact, prune, replay, runs
from stratum.plans.model import FILE


def files(spark, *rows):
    return spark.createDataFrame([(n, level, a.encode(), b.encode(), size, 1) for n, level, a, b, size in rows], FILE)


def chosen(spark, *rows, trigger=4, level_bytes=100, fanout=10):
    r = compact.plan_level(files(spark, *rows), trigger, level_bytes, fanout).first()
    return None if r is None else r.level


def test_level_zero_is_due_at_its_trigger_and_others_beyond_their_bytes(spark):
    zero = [(i, 0, "a", "z", 1) for i in range(4)]
    assert chosen(spark, *zero) == 0 and chosen(spark, *zero[:3]) is None and chosen(spark, *zero, trigger=0) is None
    assert chosen(spark, (1, 1, "a", "b", 100)) is None and chosen(spark, (1, 1, "a", "b", 101)) == 1
    assert chosen(spark, (1, 1, "a", "b", 300), (2, 2, "a", "b", 1500)) == 1
    assert chosen(spark, *zero, (9, 1, "a", "b", 100)) == 0  # a tie goes to the shallower
    assert chosen(spark, *zero, (9, 1, "a", "b", 101)) == 1
    assert chosen(spark, (1, 1, "a", "b", 1), level_bytes=0) == 1


def test_inputs(spark):
    f = files(spark, (1, 1, "d", "m", 1), (2, 1, "a", "c", 1), (3, 2, "a", "c", 1), (4, 2, "m", "z", 1), (5, 2, "n", "z", 1), (6, 0, "b", "c", 1), (7, 0, "x", "y", 1))
    numbers = lambda level: sorted(r.number for r in compact.inputs_for(f, level).collect())
    assert numbers(1) == [1, 4] and numbers(0) == [1, 2, 6, 7]


def test_merge_keeps_the_newest_and_purge_what_is_needed(spark):
    log = "key binary, seq long, value binary"
    new = spark.createDataFrame([(b"a", 10, b"new"), (b"c", 11, None), (b"x", 12, None)], log)
    old = spark.createDataFrame([(b"a", 1, b"old"), (b"b", 2, b"kept"), (b"c", 3, b"deleted")], log)
    merged = compact.merge(new, old)
    got = lambda df: sorted((bytes(r.key), r.seq) for r in df.collect())
    assert got(merged) == [(b"a", 10), (b"b", 2), (b"c", 11), (b"x", 12)]
    assert got(compact.purge(merged, files(spark, (1, 3, "c", "d", 1)))) == [(b"a", 10), (b"b", 2), (b"c", 11)]
    assert got(compact.purge(merged, files(spark).where("level > 9"))) == [(b"a", 10), (b"b", 2)]


def test_range_join_by_slots_equals_the_broadcast(spark, monkeypatch):
    f = files(spark, *[(i, 1, f"{i * 3:04d}", f"{i * 3 + (i % 9):04d}", 1) for i in range(200)])
    keys = spark.range(700).select(F.format_string("%04d", "id").cast("binary").alias("key"))
    for how in ("inner", "left_semi", "left_anti"):
        monkeypatch.setattr(prune, "BROADCAST_FILES", 20_000)
        want = sorted(map(str, prune.candidates(keys, f, how).collect()))
        monkeypatch.setattr(prune, "BROADCAST_FILES", 3)
        monkeypatch.setattr(prune, "SLOTS", 20)
        assert sorted(map(str, prune.candidates(keys, f, how).collect())) == want


def test_blocks_start_anew_after_each_cut(spark):
    rows = spark.createDataFrame([(1, b"%04d" % i, b"x" * 10) for i in range(100)], "file long, key binary, value binary")
    sizes = [r.entries for r in runs.sparse_index(rows, "file", 31 * 7 - 1).orderBy("block").collect()]
    assert sizes == [7] * 14 + [2]
    big = spark.createDataFrame([(1, b"a", b"x"), (1, b"b", b"y" * 9000), (1, b"c", b"z")], "file long, key binary, value binary")
    assert [(bytes(r.first_key), r.entries) for r in runs.sparse_index(big).orderBy("block").collect()] == [(b"a", 2), (b"c", 1)]


def test_level_sizes_has_empty_levels(spark):
    got = compact.level_sizes(files(spark, (1, 0, "a", "b", 5), (2, 3, "a", "b", 6))).orderBy("level").collect()
    assert [(r.level, r.files, r.bytes) for r in got] == [(0, 1, 5), (1, 0, 0), (2, 0, 0), (3, 1, 6)]


def test_replay_stops_at_the_first_bad_record(spark):
    log = spark.range(10).select(F.col("id").alias("pos"), (F.col("id") + 1).alias("seq"))
    r = replay.torn_at(log, "pos", F.col("pos").isin(4, 7)).first()
    assert (r.torn_at, r.records, r.last_seq) == (4, 4, 4)
    r = replay.torn_at(log, "pos", F.col("pos") > 99).first()
    assert (r.torn_at, r.records, r.last_seq) == (None, 10, 10)
    assert replay.last_sequence(log.limit(0), 7).first().last_seq == 7


def test_first_gap(spark):
    gap = lambda xs: tuple(compact.first_gap(spark.createDataFrame([(x,) for x in xs], "n long"), "n").first())
    assert gap([0, 1, 2, 5, 6]) == (3, 2, 2) and gap([0, 1, 2]) == (3, 0, 0) and gap([1, 2]) == (0, 1, 2) and gap([]) == (0, 0, 0)
