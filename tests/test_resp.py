import pytest
from pyspark.sql import functions as F

from stratum.functions import resp
from stratum.functions.resp import Command, Failure, Simple

SET = b"*3\r\n$3\r\nset\r\n$1\r\nk\r\n$4\r\n\x00\r\n\xff\r\n"


def test_a_command_and_all_its_strict_prefixes():
    assert resp.parse(SET) == (Command("SET", [b"k", b"\x00\r\n\xff"]), len(SET))
    assert all(resp.parse(SET[:n]) is None for n in range(len(SET)))


def test_inline_and_empty_requests():
    assert resp.parse(b"  get\tfoo   bar \r\n") == (Command("GET", [b"foo", b"bar"]), 18)
    assert resp.parse(b"\r\n") == (None, 2) and resp.parse(b"*0\r\n") == (None, 4) and resp.parse(b"*-1\r\nrest") == (None, 5)


@pytest.mark.parametrize(
    "data, text",
    [
        (b"*x\r\n", "invalid multibulk length"),
        (b"*1048577\r\n", "invalid multibulk length"),
        (b"*1\r\n:1\r\n", "expected '$', got something else"),
        (b"*1\r\n$-1\r\n", "invalid bulk length"),
        (b"*1\r\n$999999999999\r\n", "invalid bulk length"),
        (b"*1\r\n$1\r\nabc", "unbalanced bulk string"),
        (b"x" * (64 * 1024 + 1), "too big inline request"),
    ],
)
def test_protocol_errors(data, text):
    with pytest.raises(resp.ProtocolError, match="Protocol error: ") as e:
        resp.parse(data)
    assert str(e.value) == f"Protocol error: {text}"


def test_batches_keep_the_tail_and_what_came_before_an_error():
    commands, rest, error = resp.take_batch(SET + b"PING\r\n" + SET[:9])
    assert [c.name for c in commands] == ["SET", "PING"] and rest == SET[:9] and error is None
    commands, _, error = resp.take_batch(b"PING\r\n*1\r\n:1\r\n")
    assert [c.name for c in commands] == ["PING"] and error.startswith("Protocol error")


def test_replies():
    reply = [Simple("OK"), Failure("ERR x"), 42, b"\xc3\xa9", None, []]
    assert resp.encode(reply) == b"*6\r\n+OK\r\n-ERR x\r\n:42\r\n$2\r\n\xc3\xa9\r\n$-1\r\n*0\r\n"


def test_columns_encode_as_the_functions_do(spark):
    df = spark.createDataFrame([("héllo", "e", 7), (None, "", -1)], "v string, e string, n long")
    for r in df.select("v", "e", "n", resp.bulk(F.col("v")).alias("b"), resp.error(F.col("e")).alias("x"), resp.integer(F.col("n")).alias("i"), resp.simple(F.col("e")).alias("s"), resp.array(F.array(resp.integer(F.col("n")))).alias("a")).collect():
        assert r.b.encode() == resp.encode(None if r.v is None else r.v.encode())
        assert (r.x.encode(), r.i.encode(), r.s.encode(), r.a.encode()) == (resp.encode(Failure(r.e)), resp.encode(r.n), resp.encode(Simple(r.e)), resp.encode([r.n]))


def test_requests_of_connections(spark):
    df = spark.createDataFrame([(1, SET + b"PING\r\nGE"), (2, b"*x\r\n")], "c int, data binary")
    got = {(r.connection, r.pos): r for r in resp.requests(spark, df, "c", "data").collect()}
    assert got[1, 0].name == "SET" and bytes(got[1, 0].args[1]) == b"\x00\r\n\xff" and got[1, 1].name == "PING"
    assert bytes(got[1, -1].rest) == b"GE" and got[2, -1].error == "Protocol error: invalid multibulk length"
