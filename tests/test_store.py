import threading

import pytest

from stratum import conformance
from stratum.functions.resp import Command, Failure, Simple
from stratum.plans.commands import execute, run_batch
from stratum.plans.maintenance import Maintenance
from stratum.plans.model import Config, Corrupt
from stratum.plans.store import Store
from stratum.sources import manifest

SMALL = Config(memtable_bytes=256, l0_trigger=2, fanout=2)


def put(store, pairs):
    store.apply(store.spark.createDataFrame(pairs, "key binary, value binary"))


def state(store):
    return {bytes(r.key): bytes(r.value) for r in store.view().collect()}


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/store"


def test_writes_survive_reopening_flush_and_compaction(spark, path):
    s = Store(spark, path, SMALL)
    want = {}
    for r in range(3):
        pairs = [(b"key:%04d" % i, None if (i + r) % 7 == 0 else b"round:%d" % r) for i in range(40)]
        put(s, pairs)
        for k, v in pairs:
            want[k] = v
        if r:
            s.flush()
    want = {k: v for k, v in want.items() if v is not None}
    assert state(s) == want
    s.compact()
    assert state(s) == want and state(Store(spark, path, SMALL)) == want
    levels = s.level_sizes()
    assert levels[0] == 0 and sum(levels) == s.table_count() and len(levels) > 1
    for level in range(1, len(levels)):
        files = sorted(s.snapshot.at_level(level), key=lambda f: f.min_key)
        assert all(a.max_key < b.min_key for a, b in zip(files, files[1:]))
    # Only live versions are left once everything is in the deepest level.
    if len([n for n in levels if n]) == 1:
        assert sum(f.entries for f in s.snapshot.files) == len(want)


def test_a_large_batch_is_written_whole(spark, path, narrow_cut):
    s = Store(spark, path)
    s.apply(spark.range(0, 20_000, 1, 4).selectExpr("20000 - id AS at", "CAST(lpad(cast(20000 - id AS string), 8, '0') AS binary) AS key", "CAST(repeat(md5(cast(id AS string)), 4) AS binary) AS value"), ["at"])
    assert s.last_sequence() == 20_000 and sorted((int(bytes(r.key)), r.seq) for r in s.view().collect()) == [(i, i) for i in range(1, 20_001)]
    assert s.folder.names() == s.logs


def test_sequence_numbers_go_on_after_reopening_without_logs(spark, path):
    s = Store(spark, path)
    put(s, [(b"a", b"1"), (b"b", b"2")])
    s.flush()
    assert s.last_sequence() == 2 and s.logs == []
    s = Store(spark, path)
    s.set(b"a", b"3")
    assert s.last_sequence() == 3 and s.get(b"a") == b"3"


def test_a_deleted_key_does_not_come_back(spark, path):
    s = Store(spark, path, SMALL)
    put(s, [(b"key:%02d" % i, b"x" * 40) for i in range(20)])
    s.flush()
    put(s, [(b"zz", b"x")])
    s.flush()
    s.compact()
    s.delete(b"key:05", b"absent")
    s.flush()
    assert s.get(b"key:05") is None
    put(s, [(b"key:05x", b"x")])
    s.flush()
    s.compact()
    assert s.get(b"key:05") is None and s.get(b"key:06") == b"x" * 40 and s.get(b"") is None


def test_opening_cleans_up_and_refuses(spark, path, tmp_path):
    s = Store(spark, path)
    s.set(b"a", b"1")
    s.flush()
    (tmp_path / "store" / "000077.run").mkdir()
    (tmp_path / "store" / "MANIFEST.tmp").write_text("half")
    s = Store(spark, path)
    names = s.folder.names()
    assert "000077.run" not in names and "MANIFEST.tmp" not in names and s.next_number > 77 and s.get(b"a") == b"1"
    data = (tmp_path / "store" / "MANIFEST").read_bytes()
    (tmp_path / "store" / "MANIFEST").write_bytes(data.replace(b"last_seq", b"lost_seq"))
    with pytest.raises(Corrupt):
        Store(spark, path)
    (tmp_path / "store" / "MANIFEST").unlink()
    with pytest.raises(Corrupt, match="without a manifest"):
        Store(spark, path)


def test_manifest_round_trip_and_ranges():
    f = manifest.FileMeta(7, 1, b"d", b"m", 10, 2)
    s = manifest.Snapshot((f,), 9, 8).changed([manifest.FileMeta(9, 0, b"", b"\xff", 5, 1)], {7}, 4)
    assert manifest.decode(manifest.encode(s)) == s and (s.last_seq, s.next_number, s.deepest_level()) == (9, 10, 0)
    assert [f.overlaps(a, b) for a, b in ((b"a", b"d"), (b"m", b"z"), (b"e", b"f"), (b"a", b"c"), (b"n", b"z"))] == [True, True, True, False, False]
    assert f.covers(b"d") and f.covers(b"m") and not f.covers(b"c")
    with pytest.raises(Corrupt):
        manifest.decode(b"{}")


def test_commands(spark, path):
    s = Store(spark, path)
    run = lambda name, *args: execute(s, Command(name, list(args)))
    assert run("PING") == Simple("PONG") and run("PING", b"hi") == b"hi" and run("SET", b"k", b"v") == Simple("OK")
    assert run("GET", b"k") == b"v" and run("GET", b"none") is None and run("DEL", b"k", b"k", b"none") == 1 and run("GET", b"k") is None
    assert s.last_sequence() == 2  # what was not there got no tombstone
    assert run("SET", b"k", b"v", b"EX") == Failure("ERR syntax error") and run("SET", b"k") == Failure("ERR wrong number of arguments for 'set' command")
    assert run("PING", b"a", b"b") == Failure("ERR wrong number of arguments for 'ping' command") and run("DEL") == Failure("ERR wrong number of arguments for 'del' command")
    assert run("CONFIG", b"get", b"x") == [] and run("CONFIG", b"set") == Failure("ERR only CONFIG GET is supported") and run("COMMAND", b"docs") == []
    assert len(run("HELLO")) == 12 and run("HELLO", b"3").startswith("NOPROTO") and run("SELECT", b"0") == Simple("OK") and run("SELECT", b"1") == Failure("ERR DB index is out of range")
    assert run("NOPE") == Failure("ERR unknown command 'NOPE', with args beginning with:") and run("QUIT") == Simple("OK")
    assert b"last_sequence:2\r\n" in run("INFO") and s.block_reads() == 0
    out, rest, closed = run_batch(s, b"SET a 1\r\nGET a\r\n*1\r\n:")
    assert out == b"+OK\r\n$1\r\n1\r\n-Protocol error: expected '$', got something else\r\n" and closed


def test_background_loop(spark, path):
    with Store(spark, path, Config(memtable_bytes=1024, l0_trigger=2)) as s:
        s.background()
        for r in range(2):
            put(s, [(b"key:%04d" % i, b"round:%d" % r) for i in range(60)])
        s.wait_for_flush()
        assert s.logs == [] and s.table_count() >= 1 and s.commit_count() == 2
        real, s.flush = s.flush, lambda: (_ for _ in ()).throw(OSError("disk"))
        put(s, [(b"last", b"x")])
        with pytest.raises(OSError, match="disk"):
            s.wait_for_flush()
        s.flush = real
    assert state(Store(spark, path)) == {b"key:%04d" % i: b"round:1" for i in range(60)} | {b"last": b"x"}


def test_what_is_written_while_the_loop_looks_is_not_missed():
    class Slow:
        due, flushes, looked, go = False, 0, threading.Event(), threading.Event()

        def flush_due(self):
            due = self.due
            self.looked.set()
            self.go.wait(10)
            return due

        def compaction_due(self):
            return None

        def flush(self):
            self.due, self.flushes = False, self.flushes + 1

    store = Slow()
    loop = Maintenance(store)
    assert store.looked.wait(10)
    store.due = True
    loop.notify()
    store.go.set()
    loop.wait()
    assert store.flushes == 1
    loop.close()


def test_the_background_query_flushes_and_merges_while_batches_come_in(spark, monkeypatch):
    stores = []

    class Watched(Store):
        def __init__(self, *args):
            super().__init__(*args)
            stores.append(self)
            self.merges = self.beside = 0

        def apply(self, *args):
            self.beside += self.maintenance is not None
            super().apply(*args)

        def compact_once(self):
            done = super().compact_once()
            self.merges += done and threading.current_thread().name == "maintenance"
            return done

    monkeypatch.setattr(conformance, "Store", Watched)
    rows = conformance.q41_store_in_the_background(spark, "/root/testdata/sf0.001").count()
    (store,) = stores
    assert store.beside > 1 and store.merges and store.snapshot.deepest_level() and not store.logs and sum(f.entries for f in store.snapshot.files) >= rows > 0


def test_lookup_of_many_keys(spark, path):
    s = Store(spark, path)
    put(s, [(b"a", b"1"), (b"b", b"2")])
    s.flush()
    s.delete(b"b")
    asked = spark.createDataFrame([(b"a",), (b"b",), (b"c",)], "key binary")
    assert sorted((bytes(r.key), r.status) for r in s.lookup(asked).collect()) == [(b"a", "FOUND"), (b"b", "DELETED"), (b"c", "MISSING")]
    assert s.block_reads() == 1 and s.bytes_written() > 0 and s.dir().endswith("store")
