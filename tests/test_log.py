import zlib

import pytest

from stratum.plans.model import Corrupt, TooLarge
from stratum.sources import mutations as m

RECORDS = [(1, b"a", b"1"), (2, b"b", b"2"), (3, b"a", None), (4, b"", b""), ((1 << 63) - 1, b"\x00\xff\n\x80", b"x" * 5000)]


def test_records_round_trip():
    for seq, key, value in RECORDS:
        data = m.encode_record(seq, key, value)
        assert zlib.crc32(data[4:]) == int.from_bytes(data[:4], "little")
        assert m.decode_record(data[8:]) == (seq, key, value)


def test_payload_with_trailing_bytes_or_unknown_kind_is_no_record():
    payload = m.encode_record(7, b"k", b"v")[8:]
    assert m.decode_record(payload + b"x") is None
    assert m.decode_record(payload[:8] + b"\x02" + payload[9:]) is None
    assert all(m.decode_record(payload[:n]) is None for n in range(len(payload)))


def test_every_torn_length_keeps_the_whole_records_before_it():
    whole = m.write_log(RECORDS[:4])
    ends = [len(m.write_log(RECORDS[:n])) for n in range(5)]
    for n in range(12, len(whole) + 1):
        got, valid, torn = m.read_log(whole[:n])
        k = max(i for i, e in enumerate(ends) if e <= n)
        assert got == RECORDS[:k] and valid == ends[k]
        assert torn == (None if n == ends[k] else ends[k])


def test_a_log_read_in_pieces_is_the_log_read_at_once():
    whole = m.write_log(RECORDS)
    flipped = bytearray(whole)
    flipped[len(m.write_log(RECORDS[:2])) + 5] ^= 1  # a length that reaches beyond the record
    for data in (whole, whole[:-3], bytes(flipped), whole[:12], whole[:5], b""):
        for size in (1, 7, 4096):
            reader, got = m.LogReader(), []
            for at in range(0, len(data), size):
                got += reader.feed(data[at : at + size])
                assert reader.held < reader.needed or reader.torn is not None
            reader.finish()
            assert (got, reader.end, reader.torn) == m.read_log(data)


def test_no_row_of_the_replayed_logs_holds_a_whole_log(spark):
    from stratum import conformance

    rows = conformance._logs(spark, "/root/testdata/sf0.01").collect()
    assert max(len(r.log) for r in rows) <= 4096 < sum(len(r.log) for r in rows if r.file == 4)


def test_a_flipped_bit_ends_replay_even_before_intact_records():
    data = bytearray(m.write_log(RECORDS[:4]))
    data[len(m.write_log(RECORDS[:1])) + 10] ^= 1
    assert m.read_log(bytes(data))[0] == RECORDS[:1]


def test_empty_short_and_foreign_logs():
    assert m.read_log(b"") == ([], 0, None)
    assert m.read_log(b"STRAT") == ([], 0, 0)
    with pytest.raises(Corrupt):
        m.read_log(b"OTHERLOG" + bytes(8))


def test_too_large_is_refused_by_length():
    class Long(bytes):
        def __len__(self):
            return 1 << 32

    with pytest.raises(TooLarge, match="4294967296 bytes exceeds the 4 GiB limit"):
        m.encode_record(1, Long(b"k"), b"v")


def test_logs_are_read_through_spark(spark, tmp_path):
    (tmp_path / "000001.log").write_bytes(m.write_log(RECORDS[:3]))
    (tmp_path / "000002.log").write_bytes(m.write_log(RECORDS[3:])[:-1])
    got = sorted((r.path[-10:], r.seq, bytes(r.key), None if r.value is None else bytes(r.value)) for r in m.read_logs(spark, str(tmp_path)).collect())
    assert got == [("000001.log", *r) for r in RECORDS[:3]] + [("000002.log", *RECORDS[3])]


def test_numbering_is_dense_and_in_order(spark):
    df = spark.range(0, 1000, 1, 7).selectExpr("id")
    got = sorted((r.id, r.seq) for r in m.numbered(df, 40).collect())
    assert got == [(i, 41 + i) for i in range(1000)]


def test_numbering_is_dense_where_wide_rows_are_cut_into_other_partitions(spark, narrow_cut):
    df = spark.range(0, 20_000, 1, 4).selectExpr("20000 - id AS id", "repeat(md5(cast(id AS string)), 4) AS value", "0 AS more")
    got = sorted((r.id, r.seq) for r in m.numbered(df, 40, ["id"]).select("id", "value", "seq").collect())
    assert got == [(i, 40 + i) for i in range(1, 20_001)]
