"""Derivatives of WARC response records: linked metadata and plain-text conversion records.

Files are read and written through Spark (binaryFile, text), so any store that Spark knows will do. Each record is a gzip member of its own, so it can be
reached by its offset. Each response gives a metadata record (links, title, source headers) and a conversion record (plain text), both
with WARC-Refers-To, the target URI and date of the response, and digests of their own blocks; the two stand together in one file.

Record ids and contents depend on the input only. There is no shuffle. Tasks gather records into bundles of BUNDLE_BYTES, PER_FILE of which
make a file; a longer record is a bundle of its own. A file is read member by member, so what a worker holds is a compressed file and one record.

Defined results: a record that is not a response, or has no HTTP header, gives no derivative; null html is an empty payload and null urls an empty
target; a payload that is not UTF-8 is read with replacement characters; repeated rows give records with equal ids, and a row each; an empty table gives no
records; unclosed comments, scripts and the like are markup, and a `<` that no `>` follows before the next `<` is text; other columns do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import html as html_
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release

#: Fixed values of the formats. The last is a gzip member of nothing.
VERSION, END = b"WARC/1.1", b"\r\n\r\n"
DATE = "2026-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # of URLs
GZIP, NOTHING = b"\x1f\x8b", bytes.fromhex("1f8b08000000000000030300") + bytes(8)

BUNDLE_BYTES, PER_FILE = 4 << 20, 4
CHUNK, FEED = 1 << 20, 1 << 13  # bytes that a step of decompression gives at most, and takes
HELD_BYTES = 4 << 20  # records that are handed on at once

# Each of these looks at a character once: tags hold no other "<", and what an element is closed by is looked for once.
_OPEN = re.compile(r"(?i)<!--|<!doctype[^<>]*>|<(script|style|noscript|template|head)\b[^<>]*>")
_CLOSE = {k: re.compile(rf"(?i)</{k}\s*>") for k in ("script", "style", "noscript", "template", "head", "title")} | {"<!--": re.compile("-->")}
_TAG = re.compile(r"(?i)<(?:/?(p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|header|footer|nav|main|blockquote|pre)\b)?[^<>]*>")
_BLANKS = re.compile(r"[^\S\n ][^\S\n]*| [^\S\n]+")  # all but single spaces
_TITLE = re.compile(r"(?i)<title\b[^<>]*>")
_LINK = re.compile(r"(?i)<a\b[^<>]*>")
_HREF = re.compile(r"""(?i)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(0).join(parts))}>"


def record(kind: str, name: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record, without the two line ends that follow it."""
    line = lambda v: re.sub(r"[\r\n]+", " ", v) if "\n" in v or "\r" in v else v
    clean = [("WARC-Type", kind), ("WARC-Record-ID", name), *[(k, line(v)) for k, v in headers], ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in clean) + b"\r\n" + block


def _chunks(data: bytes) -> Iterator[tuple[int | None, bytes]]:
    """The content of a file, decompressed, in parts; with the first part of a gzip member, the member's offset."""
    if data[:2] != GZIP:
        yield 0, data
        return
    at = 0
    while data[at : at + 2] == GZIP:
        member, start = zlib.decompressobj(31), at
        while not member.eof and at < len(data):
            # Little at a time, as the library copies what follows the member.
            feed = data[at : at + FEED]
            part = member.decompress(feed, CHUNK)
            used = len(feed) - len(member.unused_data if member.eof else member.unconsumed_tail)
            at += used
            if part or member.eof:
                yield start, part
                start = None
            elif not used:
                return
        if not member.eof:
            return


def records(data: bytes) -> Iterator[tuple[int | None, dict[str, str], bytes]]:
    """Offset (of the gzip member that the record begins; None within a member), headers (names in lower case) and block of each record of a file. A record
    that the file does not hold whole is left out."""
    held, offset, parts = bytearray(), None, _chunks(data)
    headers, size = None, 0
    for start, part in parts:
        if start is not None and not held.strip(b"\r\n") and headers is None:
            held.clear()
            offset = start
        held += part
        while True:
            if headers is None:
                begin = held.find(VERSION[:5])
                end = held.find(END, max(begin, 0))
                if begin < 0 or end < 0:
                    break
                lines = bytes(held[begin:end]).decode("utf-8", "replace").split("\r\n")[1:]
                headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
                size = int(headers["content-length"]) if headers.get("content-length", "").isdecimal() else 0
                del held[: end + 4]
            if len(held) < size:
                break
            yield offset, headers, bytes(held[:size])
            del held[:size]
            headers, offset = None, None


def response(page_id, url: str | None, page: str | None) -> bytes:
    body = (page or "").encode("utf-8", "replace")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    headers = [("WARC-Target-URI", url or ""), ("WARC-Date", DATE), ("X-Page-ID", "" if page_id is None else str(page_id)), ("WARC-Payload-Digest", digest(body)), ("Content-Type", "application/http; msgtype=response")]
    return record("response", record_id("response", str(page_id), url or "", digest(body)), headers, block)


def visible(page: str) -> str:
    """Markup without comments, scripts, styles and the head."""
    out, at, unclosed = [], 0, set()
    for m in _OPEN.finditer(page):
        kind = (m[1] or m[0][:4]).lower()
        if m.start() < at or kind in unclosed:
            continue
        if kind == "<!do":  # a document type
            end = m.end()
        elif close := _CLOSE[kind].search(page, m.end()):
            end = close.end()
        else:
            unclosed.add(kind)
            continue
        out.append(page[at : m.start()])
        at = end
    return " ".join([*out, page[at:]])


def title_of(page: str) -> str:
    start = _TITLE.search(page)
    close = _CLOSE["title"].search(page, start.end()) if start else None
    return " ".join(html_.unescape(page[start.end() : close.start()]).split()) if close else ""


def links_of(markup: str) -> Iterator[str]:
    for tag in _LINK.finditer(markup):
        if m := _HREF.search(tag[0]):
            yield " ".join(html_.unescape(m[1] or m[2] or m[3] or "").split())


def plain_text(markup: str) -> str:
    """Text of visible markup: blocks on lines of their own, white space collapsed, entities resolved."""
    parts = _TAG.split(markup)
    parts[1::2] = ["\n" if block else "" for block in parts[1::2]]
    bare = html_.unescape("".join(parts))
    lines = (x.strip(" ") for x in _BLANKS.sub(" ", bare).split("\n"))
    return "\n".join(x for x in lines if x)


def derivatives(headers: dict[str, str], block: bytes) -> list[tuple[str, str, bytes]]:
    """(kind, id, record) of the metadata and conversion records of a response."""
    head, found, body = block.partition(END)
    if headers.get("warc-type") != "response" or not found:
        return []
    source, uri = headers.get("warc-record-id", ""), headers.get("warc-target-uri", "")
    page = body.decode("utf-8", "replace")
    meta_id, text_id = record_id("metadata", source), record_id("conversion", source)
    markup = visible(page)
    fields = [("title", title_of(page)), ("conversion", text_id), ("source-block-digest", headers.get("warc-block-digest", "")), ("source-payload-digest", headers.get("warc-payload-digest", ""))]
    fields += [("source-http", x) for x in head.decode("utf-8", "replace").split("\r\n")]
    fields += [("outlink", x) for x in links_of(markup)]
    shared = [("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", headers.get("warc-date", "")), ("WARC-Target-URI", uri), ("WARC-Date", headers.get("warc-date", "")), ("X-Page-ID", headers.get("x-page-id", ""))]
    meta = record("metadata", meta_id, [*shared, ("Content-Type", "application/warc-fields")], "".join(f"{k}: {v}\r\n" for k, v in fields).encode())
    text = record("conversion", text_id, [*shared, ("WARC-Concurrent-To", meta_id), ("Content-Type", "text/plain; charset=utf-8")], plain_text(markup).encode())
    return [("metadata", meta_id, meta), ("conversion", text_id, text)]


def bundles(made: Iterator[bytes]) -> Iterator[bytes]:
    """Records as gzip members, many together, without the last byte, which is 0: the writer puts it between bundles."""
    held, n = [], 0
    for x in made:
        member = zlib.compressobj(1, zlib.DEFLATED, 16 + 14, 7)  # a small window: records are small, and each begins anew
        held.append(member.compress(x) + member.compress(END) + member.flush())
        n += len(held[-1])
        if n >= BUNDLE_BYTES:
            yield b"".join([*held, *([] if held[-1].endswith(b"\0") else [NOTHING])])[:-1]
            held, n = [], 0
    if held:
        yield b"".join([*held, *([] if held[-1].endswith(b"\0") else [NOTHING])])[:-1]


def _write(rows: DataFrame, make, to: str) -> None:
    """make(batches) gives records."""

    def run(batches):
        for x in bundles(make(batches)):
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary())], ["value"])
        release()

    lines = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    lines.write.mode("overwrite").option("lineSep", "\0").option("maxRecordsPerFile", PER_FILE).text(to)


def write_responses(pages: DataFrame, to: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    def make(batches):
        for b in batches:
            for i in range(0, b.num_rows, 64):
                for row in zip(*(c.to_pylist() for c in b.slice(i, 64).columns), strict=True):
                    yield response(*row)

    _write(pages.select(F.col(page_id).alias("p"), F.col(url).alias("u"), F.col(html).alias("h")), make, to)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")


def _batches(rows: Iterator[tuple], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for r in rows:
        held.append(r)
        n += size(r)
        if n > HELD_BYTES or len(held) == 2000:
            yield pa.RecordBatch.from_arrays([pa.array([v[i] for v in held], f.type) for i, f in enumerate(schema)], schema=schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([v[i] for v in held], f.type) for i, f in enumerate(schema)], schema=schema)


def _contents(batches) -> Iterator[tuple[str, bytes]]:
    for b in batches:
        for path, data in zip(b.column(0), b.column(1), strict=True):
            yield path.as_py(), data.as_buffer().to_pybytes()


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, headers (a map with names in lower case) and block of all records in the files of a folder."""
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])

    def run(batches):
        yield from _batches(((f, o, list(h.items()), x) for f, data in _contents(batches) for o, h, x in records(data)), schema, lambda r: len(r[3]) + 500)
        release()

    return _files(spark, path).mapInArrow(run, "file string, offset long, headers map<string,string>, block binary")


def derive(spark: SparkSession, source: str, to: str) -> None:
    """Writes the derivatives of all responses in the files of `source` to files in `to`."""

    def make(batches):
        for _, data in _contents(batches):
            for _, headers, block in records(data):
                for _, _, x in derivatives(headers, block):
                    yield x

    _write(_files(spark, source), make, to)


LINKED = "page_id long, refers_to string, uri string, metadata_id string, metadata_digest string, conversion_id string, conversion_digest string, concurrent_to string, text_chars long, text_sha256 string"


def linked(spark: SparkSession, path: str, bodies: bool = True) -> DataFrame:
    """One row for each pair of derivatives in the files that derive() wrote: page_id, refers_to, uri, ids and digests of both, concurrent_to, text_chars, text_sha256,
    and the text and the metadata fields if `bodies`. A conversion record meets the metadata record before it in its file; one without has nulls there."""
    strings = [f.split()[0] for f in LINKED.split(", ")]
    schema = pa.schema([(n, pa.int64() if n in ("page_id", "text_chars") else pa.string()) for n in [*strings, *(["text", "fields"] if bodies else [])]])

    def pairs(data: bytes) -> Iterator[tuple]:
        meta = None
        for _, h, block in records(data):
            if h.get("warc-type") == "metadata":
                meta = h, block
            elif h.get("warc-type") == "conversion":
                m, fields = meta if meta and meta[0].get("warc-refers-to") == h.get("warc-refers-to") else ({}, None)
                page, text = h.get("x-page-id", ""), block.decode("utf-8", "replace")
                row = (int(page) if re.fullmatch(r"-?\d+", page) else None, h.get("warc-refers-to"), h.get("warc-target-uri"), m.get("warc-record-id"), m.get("warc-block-digest"), h.get("warc-record-id"), h.get("warc-block-digest"), h.get("warc-concurrent-to"), len(text), hashlib.sha256(block).hexdigest())
                yield (*row, text, fields.decode("utf-8", "replace") if fields is not None else None) if bodies else row
                meta = None

    def run(batches):
        yield from _batches((r for _, data in _contents(batches) for r in pairs(data)), schema, lambda r: 500 + (len(r[-2] or "") if bodies else 0))
        release()

    return _files(spark, path).mapInArrow(run, LINKED + ", text string, fields string" * bodies)
