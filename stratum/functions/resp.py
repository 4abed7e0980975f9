"""The command protocol: bytes to commands, replies to bytes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

#: Fixed values of the protocol.
MAX_ARGS, MAX_BULK, MAX_INLINE = 1024 * 1024, 512 * 1024 * 1024, 64 * 1024
END = b"\r\n"


class ProtocolError(Exception):
    def __init__(self, detail: str):
        super().__init__(f"Protocol error: {detail}")


@dataclass(frozen=True)
class Command:
    name: str
    args: list[bytes] = field(default_factory=list)

    def arg(self, i: int) -> bytes | None:
        return self.args[i] if i < len(self.args) else None


class Simple(str):
    """A status line."""


class Failure(str):
    """An error line."""


Reply = Simple | Failure | int | bytes | None | list


def encode(reply: Reply) -> bytes:
    if isinstance(reply, Simple | Failure):
        return (b"+" if isinstance(reply, Simple) else b"-") + reply.encode() + END
    if reply is None:
        return b"$-1" + END
    if isinstance(reply, int):
        return b":%d" % reply + END
    if isinstance(reply, bytes):
        return b"$%d" % len(reply) + END + reply + END
    return b"*%d" % len(reply) + END + b"".join(map(encode, reply))


def _number(text: bytes, error: str, most: int) -> int:
    digits = text[1:] if text[:1] in (b"+", b"-") else text
    if not digits.isdigit() or not -(1 << 63) <= int(text) < 1 << 63 or int(text) > most:
        raise ProtocolError(error)
    return int(text)


def parse(data: bytes, at: int = 0) -> tuple[Command | None, int] | None:
    """The request that begins at `at` and where it ends; None while it is not whole. An empty request has no command."""
    if at >= len(data):
        return None
    if data[at : at + 1] != b"*":
        return _inline(data, at)
    stop = data.find(END, at)
    if stop < 0:
        return None
    count, at = _number(data[at + 1 : stop], "invalid multibulk length", MAX_ARGS), stop + 2
    words: list[bytes] = []
    while len(words) < count:
        if at >= len(data):
            return None
        if data[at : at + 1] != b"$":
            raise ProtocolError("expected '$', got something else")
        stop = data.find(END, at)
        if stop < 0:
            return None
        size = _number(data[at + 1 : stop], "invalid bulk length", MAX_BULK)
        if size < 0:
            raise ProtocolError("invalid bulk length")
        first, after = stop + 2, stop + 2 + size
        if len(data) < after + 2:
            return None
        if data[after : after + 2] != END:
            raise ProtocolError("unbalanced bulk string")
        words.append(data[first:after])
        at = after + 2
    return (Command(words[0].decode("utf-8", "replace").upper(), words[1:]) if words else None), at


def _inline(data: bytes, at: int) -> tuple[Command | None, int] | None:
    stop = data.find(b"\n", at)
    if stop < 0:
        if len(data) - at > MAX_INLINE:
            raise ProtocolError("too big inline request")
        return None
    line = data[at:stop].removesuffix(b"\r").translate(bytes.maketrans(b"\t\n\x0c\r", b"    "))
    words = [w for w in line.split(b" ") if w]
    return (Command(words[0].decode("utf-8", "replace").upper(), words[1:]) if words else None), stop + 1


def take_batch(data: bytes) -> tuple[list[Command], bytes, str | None]:
    """All whole requests, the bytes left, and the protocol error that ended the batch, if one did."""
    out: list[Command] = []
    at = 0
    try:
        while found := parse(data, at):
            command, at = found
            if command is not None:
                out.append(command)
    except ProtocolError as error:
        return out, data[at:], str(error)
    return out, data[at:], None


@udtf(returnType="pos int, name string, args array<binary>, rest binary, error string")
class Requests:
    """Bytes as rows of commands; the last row (pos -1) has the tail and the error."""

    def eval(self, data: bytes):
        commands, rest, error = take_batch(bytes(data or b""))
        for i, c in enumerate(commands):
            yield i, c.name, c.args, None, None
        yield -1, None, None, rest, error


def requests(spark: SparkSession, connections: DataFrame, name: str, data: str) -> DataFrame:
    """One row for each request of each connection's bytes."""
    spark.udtf.register("stratum_requests", Requests)
    connections.select(F.col(name).alias("connection"), F.col(data).cast("binary").alias("data")).createOrReplaceTempView("stratum_connections")
    return spark.sql("SELECT connection, r.* FROM stratum_connections, LATERAL stratum_requests(data) r")


# ---------------------------------------------------------------- the same as columns
def bulk(value: Column) -> Column:
    """A bulk reply; nil for null."""
    end = F.lit("\r\n")
    return F.coalesce(F.concat(F.lit("$"), F.octet_length(value).cast("string"), end, value, end), F.lit("$-1\r\n"))


def simple(text: Column) -> Column:
    return F.concat(F.lit("+"), text, F.lit("\r\n"))


def error(text: Column) -> Column:
    return F.concat(F.lit("-"), text, F.lit("\r\n"))


def integer(n: Column) -> Column:
    return F.concat(F.lit(":"), n.cast("string"), F.lit("\r\n"))


def array(items: Column) -> Column:
    """Of encoded replies."""
    return F.concat(F.lit("*"), F.size(items).cast("string"), F.lit("\r\n"), F.array_join(items, ""))


def inline(line: Column) -> Column:
    """struct(name, args) of a line of words."""
    words = F.filter(F.split(line, r"[ \t\n\f\r]+"), lambda w: w != "")
    return F.struct(F.upper(F.get(words, 0)).alias("name"), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))).alias("args"))
