"""Operators whose results are checked by round trips, the library itself or a plain version: tokens, WARC, URLs, language models."""

import base64
import collections
import gzip
import hashlib
import html
import math
import random
import re
import time
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from stratum.llm import bpe, lmscore, orctokens, urlfilter, warc
from tests.llm.conftest import frame

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def word():
    return tokenizers.Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def byte():
    return tokenizers.Tokenizer.from_file(BYTE)


ODD = ["'s", "'ll", "'d've", "'", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "\u3000", "e\u0301", "Σ", "ΑΣ", "ß", "İ", "漢", "ب", "²", "<|endoftext|>", "<|startoftext|>", "<|end", "The", "x", "1", "23", "!", "...", "\U0001f600", "\x00", "ﬁ", "K"]


def odd_texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(ODD) if r.random() < 0.8 else chr(r.choice([r.randrange(32, 0x250), r.randrange(0x370, 0x530), r.randrange(0x2000, 0x2100), r.randrange(32, 0xD7FF)])) for _ in range(r.randrange(15))) for _ in range(n)]


def test_bpe_is_the_librarys(word):
    mine = bpe.ForcedBoundaryCodec(WORD)
    for t in odd_texts(3000, 1):
        ids = word.encode(t, add_special_tokens=False).ids
        assert mine.encode(t) == ids and mine.decode(ids) == word.decode(ids, skip_special_tokens=False)


def test_cuts_stand_where_no_token_spans():
    mine = bpe.ForcedBoundaryCodec(WORD)
    assert "".join(mine.fragments("abcéxqzzj")) == "abcéxqzzj"
    for w in ("qzxqj", "hello", "a", "zzzqqqvvv"):
        parts = mine.fragments(w)
        cuts = np.cumsum([len(p) for p in parts])[:-1]
        for c in cuts:
            right = w[c] + (mine.suffix if c == len(w) - 1 else "")
            ends = mine.suffix in right
            assert not any(t.endswith(w[c - 1] + right) if ends else w[c - 1] + right in (t[: -len(mine.suffix) - 1] if t.endswith(mine.suffix) else t) for t in mine.vocab)
    assert len(mine.fragments("qzxqj")) > 1


def test_a_small_cache_changes_nothing(word, monkeypatch):
    mine = bpe.ForcedBoundaryCodec(WORD)
    mine.table = bpe.PieceTable(3)
    for t in ("one two three four five six", "six five seven one", "two two eight"):
        assert mine.encode(t) == word.encode(t, add_special_tokens=False).ids


def test_ids_survive_colliding_hashes(word, monkeypatch):
    from stratum.llm import pieces

    monkeypatch.setattr(pieces, "span_hashes", lambda view, start, end, seed: [(end - start).astype(np.uint64) % np.uint64(3)])
    mine = bpe.ForcedBoundaryCodec(WORD)
    for t in ("one two three four five six", "six five seven one", "two two eight one", "on ho it is at as"):
        assert mine.encode(t) == word.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [341, 1024, 4096])
def test_pieces_that_cancel_out_in_polynomial_hashes(word, byte, n):
    from tests.llm.test_texts import thue_morse

    texts = thue_morse(n)
    coder, mine = orctokens.BytePieces(BYTE), bpe.ForcedBoundaryCodec(WORD)
    ids, size = coder.encode_block(np.frombuffer("".join(texts).encode(), np.uint8), np.array([0, n, 2 * n]))
    assert [x.tolist() for x in np.split(ids, [size[0]])] == [byte.encode(t, add_special_tokens=False).ids for t in texts]
    assert [mine.encode(t) for t in texts] == [word.encode(t, add_special_tokens=False).ids for t in texts]


def test_other_tokenizer_files(word, tmp_path):
    import json

    spec = json.load(open(WORD, encoding="utf-8"))
    spec["normalizer"] = None  # splits as before, keeps case
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    library, mine = tokenizers.Tokenizer.from_file(str(path)), bpe.ForcedBoundaryCodec(str(path))
    for t in ["The END's here", "", "a\u0301 B<|endoftext|>c", *odd_texts(200, 5)]:
        assert mine.encode(t) == library.encode(t, add_special_tokens=False).ids
    spec["model"]["unk_token"] = "<|endoftext|>"
    path.write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError, match="unk_token"):
        bpe.ForcedBoundaryCodec(str(path))


def test_shown_ids_of_long_texts(word, monkeypatch):
    monkeypatch.setattr(bpe, "SHOWN", 7)
    mine, texts = bpe.ForcedBoundaryCodec(WORD), ["", "one", "a b c d e f g", "x " * 50, "", "y z", ""]
    data = [t.encode() for t in texts]
    ids, n = mine.encode_block(np.frombuffer(b"".join(data), np.uint8), np.r_[0, np.cumsum([len(d) for d in data])])
    want = [word.encode(t, add_special_tokens=False).ids for t in texts]
    assert mine.digests(ids, n, False) == [sha(" ".join(map(str, w))) for w in want]
    assert mine.digests(ids, n, True) == [sha(word.decode(w, skip_special_tokens=False)) for w in want]


def test_bpe_of_repeated_rows_and_null_ids(spark, word):
    got = bpe.round_trip(frame(spark, [(1, "a b"), (1, "a b"), (None, None), (None, "c")]), WORD, ["doc_id"]).collect()
    assert sorted((str(r.doc_id), r.b_n) for r in got) == [("1", 2), ("1", 2), ("None", 0), ("None", 1)]


def test_bpe_of_a_table(docs, rows, none, word):
    got = {r.doc_id: r for r in bpe.round_trip(docs, WORD, ["doc_id", "b_n"], with_ids=True, with_decoded=True).drop("b_n").collect()}
    for i, t in rows:
        ids = word.encode(t or "", add_special_tokens=False).ids
        assert list(got[i].b_ids) == ids and got[i].b_ids_sha256 == sha(" ".join(map(str, ids)))
        assert got[i].b_decoded_sha256 == sha(word.decode(ids, skip_special_tokens=False)) == sha(got[i].b_decoded)
    assert bpe.round_trip(none, WORD, ["doc_id"]).count() == 0


def test_byte_pieces_are_the_librarys(byte):
    mine, texts = orctokens.BytePieces(BYTE), odd_texts(6000, 2)
    for k in range(0, len(texts), 40):
        data = [t.encode() for t in texts[k : k + 40]]
        at = np.r_[0, np.cumsum([len(d) for d in data])].astype(np.int64)
        with np.errstate(over="ignore"):
            ids, n = mine.encode_block(np.frombuffer(b"".join(data), np.uint8), at)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [byte.encode(t, add_special_tokens=False).ids for t in texts[k : k + 40]]


def test_orc_round_trip(spark, docs, rows, none, byte, tmp_path):
    path = f"file://{tmp_path}/orc"
    orctokens.write(docs, BYTE, path)
    table = orctokens.read(spark, path)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in orctokens.checksums(table).collect()}
    start, want = 0, {}
    for i, t in rows:
        ids = [*byte.encode(t or "", add_special_tokens=False).ids, 0]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got == want
    assert [r.n_tokens for r in table.where(f"doc_id = {rows[5][0]}").collect()] == [want[rows[5][0]][1]]
    files = sorted(tmp_path.glob("orc/*.orc"))
    import pyarrow.orc

    last = -1
    for f in files:  # ascending within and across files
        ids = pyarrow.orc.ORCFile(f).read(columns=["doc_id"]).column(0).to_pylist()
        assert ids == sorted(ids) and (not ids or ids[0] > last)
        last = ids[-1] if ids else last
    assert all(pyarrow.orc.ORCFile(f).nstripes >= 1 for f in files)
    orctokens.write(none, BYTE, f"file://{tmp_path}/none")
    assert orctokens.read(spark, f"file://{tmp_path}/none").count() == 0


def test_orc_of_null_and_repeated_ids(spark, tmp_path):
    orctokens.write(frame(spark, [(None, "a"), (4, "b c"), (4, "b c"), (1, None)]), BYTE, f"file://{tmp_path}/orc")
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in orctokens.read(spark, f"file://{tmp_path}/orc").collect())
    assert got == [(0, None, 2), (2, 1, 1), (3, 4, 3), (6, 4, 3)]


def test_orc_indexes_prune(spark, tmp_path, monkeypatch):
    """Run-length encoding, row indexes and Bloom filters are in the files, and a filter on the id reads one row group of many."""
    monkeypatch.setattr(orctokens, "ROW_INDEX_STRIDE", 1000)
    path = f"file://{tmp_path}/orc"
    docs = spark.range(0, 12_000, 2).selectExpr("id as doc_id", "concat('text ', id) as text")
    orctokens.write(docs, BYTE, path)
    jvm, kinds, encodings = spark._jvm, set(), set()
    for f in tmp_path.glob("orc/*.orc"):
        conf = jvm.org.apache.hadoop.conf.Configuration()
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(f)), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == 1000
        rows = reader.rows()
        for stripe in reader.getStripes():
            footer = rows.readStripeFooter(stripe)
            kinds |= {(s.getColumn(), s.getKind().toString()) for s in footer.getStreamsList()}
            encodings |= {e.getKind().toString() for e in footer.getColumnsList()}
        rows.close()
    assert {(1, "BLOOM_FILTER_UTF8"), (1, "ROW_INDEX"), (4, "ROW_INDEX")} <= kinds and "DIRECT_V2" in encodings

    def scanned(condition):
        found = spark.read.schema(orctokens.STORED).orc(path).where(condition).select("doc_id", "n_tokens")
        n = len(found.collect())
        leaf = found._jdf.queryExecution().executedPlan().collectLeaves().head()
        return n, leaf.metrics().get("numOutputRows").get().value()

    assert scanned("doc_id >= 0") == (6000, 6000)
    assert scanned("doc_id = 5000")[0] == 1 and scanned("doc_id = 5000")[1] <= 1000
    assert scanned("doc_id = 5001") == (0, 0)  # within the range of a row group: the Bloom filter says no


# ---------------------------------------------------------------- URLs
def plain_verdict(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :], re.S)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), h, p, a) for h, p, a in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else None
    return host, path, best and best[2] + best[3], best[4] if best else default


def test_urls(spark):
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "", "block"), ("b.org", "", "allow"), ("", "/x", "block"), ("a.b.org", "/x", "block"), ("é.com", "/é", "block")]
    hosts = ["com", "a.com", "Example.COM", "www.example.com", "xexample.com", "example.net", "m.example.net", "b.org", "a.b.org", "x.a.b.org", "", "a..org", "é.com", "com:80", "org."]
    paths = ["", "/", "/en/", "/en", "/en/7", "/en/77?x=/de/", "/de/8", "/de/7#y", "/x/é", "?q", "#f", "/é\n/x"]
    urls = [s + h + p for s in ("http://", "x", "://") for h in hosts for p in paths] + [None, "", "http:/a.com/en/", "a://b.org://com/en/"]
    data = list(enumerate(urls)) + [(9999, urls[1]), (9999, urls[1])]
    pages = spark.createDataFrame([(i, u, "h", "d") for i, u in data], "page_id long, url string, h string, digest string").repartition(3)
    got = urlfilter.judge(pages, urlfilter.rule_table(spark, rules), ["page_id", "digest"]).collect()
    want = sorted(repr((i, *plain_verdict(u, rules))) for i, u in data)
    assert sorted(repr((r.page_id, r.u_host, r.u_path, r.u_rule, r.u_verdict)) for r in got) == want
    none = spark.createDataFrame([], "rule_host string, rule_path string, action string")
    assert {r.u_verdict for r in urlfilter.judge(pages, none, ["page_id"], default="block").collect()} == {"block"}
    assert urlfilter.judge(pages.limit(0), urlfilter.rule_table(spark, rules), ["page_id"]).count() == 0


def test_url_filter_is_native(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    plan = urlfilter.judge(pages, urlfilter.rule_table(spark, [("com", "/", "block")]), ["page_id"])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# ---------------------------------------------------------------- WARC
PAGES = [
    (1, "http://a.example/x", "<html><head><title>A &amp; B</title><style>p{}</style></head><body><script>if (a<b) {}</script><p>One<br>two &lt;3</p><!-- no --><a href='/l?a=1&amp;b=2'>link</a> WARC/1.1\r\n\r\nend</body></html>"),
    (2, "http://b.example/\r\nX: y", "plain\r\n\r\n\r\n\r\ntext"),
    (3, None, None),
    (4, "http://c.example/", "<p>" + "é漢" * 40000),
    (None, "http://d.example/", ""),
]


def test_warc_derivatives(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, headers string")
    warc.write_responses(pages, f"file://{tmp_path}/in")
    sources = {r.headers["warc-record-id"]: r for r in warc.read_records(spark, f"file://{tmp_path}/in").collect()}
    assert len(sources) == len(PAGES)
    by_page = {r.headers["x-page-id"]: r for r in sources.values()}
    for p, _, page in PAGES:
        r = by_page["" if p is None else str(p)]
        body = bytes(r.block).split(b"\r\n\r\n", 1)[1]
        assert body == (page or "").encode() and r.headers["warc-payload-digest"] == warc.digest(body) and r.headers["warc-block-digest"] == warc.digest(bytes(r.block))
    warc.derive(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out")
    made = warc.read_records(spark, f"file://{tmp_path}/out").collect()
    assert collections.Counter(r.headers["warc-type"] for r in made) == {"metadata": 5, "conversion": 5}
    ids = {r.headers["warc-record-id"] for r in made}
    for r in made:
        source = sources[r.headers["warc-refers-to"]]
        assert r.headers["warc-block-digest"] == warc.digest(bytes(r.block)) and r.headers["warc-refers-to-target-uri"] == source.headers["warc-target-uri"] and r.headers["warc-refers-to-date"] == source.headers["warc-date"]
        if r.headers["warc-type"] == "conversion":
            assert r.headers["warc-concurrent-to"] in ids
        else:
            assert f"source-payload-digest: {source.headers['warc-payload-digest']}".encode() in bytes(r.block)
        # Each record is reached by its offset, and its member holds nothing else.
        with open(r.file.removeprefix("file:"), "rb") as f:
            f.seek(r.offset)
            one = zlib.decompressobj(31).decompress(f.read())
        assert one.startswith(b"WARC/1.1\r\n") and one.endswith(bytes(r.block) + b"\r\n\r\n") and r.headers["warc-record-id"].encode() in one
    for f in tmp_path.glob("*/part-*"):
        gzip.open(f).read()
    rows = {r.page_id: r for r in warc.linked(spark, f"file://{tmp_path}/out").collect()}
    assert rows[1].text == "One\ntwo <3\nlink WARC/1.1\nend" and "outlink: /l?a=1&b=2" in rows[1].fields and "title: A & B" in rows[1].fields and "source-http: HTTP/1.1 200 OK" in rows[1].fields
    assert rows[2].text == "plain\ntext" and rows[3].text == "" and rows[4].text == "é漢" * 40000 and rows[None].uri == "http://d.example/"


BLOCKS = "p div br li ul ol h1 h2 h3 h4 h5 h6 tr table article section header footer nav main blockquote pre".split()


def plain_page(page):
    """Text, title and links, by reading the page from left to right."""

    def tag_at(t, i):
        """(name, end) of a tag that starts here, or None."""
        if i >= len(t) or t[i] != "<":
            return None
        j = i + 1
        while j < len(t) and t[j] not in "<>":
            j += 1
        if j >= len(t) or t[j] != ">":
            return None
        k = i + 1
        while k < j and (t[k].isalnum() or t[k] == "_"):
            k += 1
        return t[i + 1 : k].lower(), j + 1

    def close_of(t, i, name):
        while i < len(t):
            if t[i : i + 2 + len(name)].lower() == "</" + name:
                j = i + 2 + len(name)
                while j < len(t) and t[j].isspace():
                    j += 1
                if t[j : j + 1] == ">":
                    return i, j + 1
            i += 1
        return None

    out, i = [], 0
    while i < len(page):
        if page.startswith("<!--", i):
            j = page.find("-->", i + 4)
            if j >= 0:
                out.append(" ")
                i = j + 3
                continue
        elif page[i : i + 9].lower() == "<!doctype":
            j = i + 9
            while j < len(page) and page[j] not in "<>":
                j += 1
            if page[j : j + 1] == ">":
                out.append(" ")
                i = j + 1
                continue
        elif (tag := tag_at(page, i)) and tag[0] in ("script", "style", "noscript", "template", "head") and (close := close_of(page, tag[1], tag[0])):
            out.append(" ")
            i = close[1]
            continue
        out.append(page[i])
        i += 1
    markup = "".join(out)
    text, links, i = [], [], 0
    while i < len(markup):
        j = i + 1
        while markup[i] == "<" and j < len(markup) and markup[j] not in "<>":
            j += 1
        if markup[i] == "<" and markup[j : j + 1] == ">":
            inside = markup[i + 1 : j]
            name = re.match(r"/?(\w*)", inside)[1].lower()
            if name in BLOCKS:
                text.append("\n")
            if re.match(r"(?i)a\b", inside) and (m := re.search(r"""(?i)\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"']+)""", inside)):
                links.append(" ".join(html.unescape(m[1].strip("\"'") if m[1][0] in "\"'" else m[1]).split()))
            i = j + 1
        else:
            text.append(markup[i])
            i += 1
    lines = [" ".join(x.split()) for x in html.unescape("".join(text)).split("\n")]
    title, i = "", 0
    while i < len(page):
        tag = tag_at(page, i)
        if tag and tag[0] == "title":
            close = close_of(page, tag[1], "title")
            title = " ".join(html.unescape(page[tag[1] : close[0]]).split()) if close else ""
            break
        i += 1
    return "\n".join(x for x in lines if x), title, links


PARTS = ["<p>", "</p>", "<br/>", "<a href='x y'>", '<A HREF="&amp;q">', "<a name=b href=c>", "<a>", "</a>", "<!--", "-->", "<script>", "</script >", "<STYLE a=b>", "</style>", "<head>", "</head>", "<title>", "</title>", "<!doctype html>", "<", ">", "&lt;", "&amp;", "&nbsp;", " ", "\n", "\r\n", "word", "é", "<b>", "</b>", "<pre", "=", '"', "'", "<template>", "<!DOCTYPE", "\x00"]


def plain_linked(page_id, url, page):
    """What the query op5 says of a page, written out."""
    sha1 = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    name = lambda *x: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(x))}>"
    body, url = (page or "").encode(), url or ""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}"
    source = name("response", str(page_id), url, sha1(body))
    meta_id, text_id = name("metadata", source), name("conversion", source)
    text, title, links = plain_page(page or "")
    fields = [f"title: {title}", f"conversion: {text_id}", f"source-block-digest: {sha1(head.encode() + bytes([13, 10, 13, 10]) + body)}", f"source-payload-digest: {sha1(body)}", *(f"source-http: {x}" for x in head.split("\r\n")), *(f"outlink: {x}" for x in links)]
    meta = "".join(f"{x}\r\n" for x in fields).encode()
    return page_id, source, re.sub(r"[\r\n]+", " ", url).strip(), meta_id, sha1(meta), text_id, sha1(text.encode()), meta_id, len(text), hashlib.sha256(text.encode()).hexdigest()


def test_warc_against_a_plain_version(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 3000)
    monkeypatch.setattr(warc, "CHUNK", 100)
    r = random.Random(11)
    pages = [(k, f"http://h{k % 5}/{k}" if k % 9 else None, "".join(r.choice(PARTS) for _ in range(r.randrange(60)))) for k in range(300)]
    pages += pages[:5] + [(None, None, None), (None, "u", "x")] + [(400, "no scheme", "a" * 9000), (401, "", "&#x41;" * 3000)]
    docs = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    warc.write_responses(docs, f"file://{tmp_path}/in")
    warc.derive(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out")
    got = warc.linked(spark, f"file://{tmp_path}/out", bodies=False).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(plain_linked(*p)) for p in pages)


@pytest.mark.parametrize("part", ["<!--", "<script>", "<title>", "<a href='", "<p", "<", "<!doctype", "</title", "<a href=", "&amp", "<template>a</template>"])
def test_warc_of_long_malformed_pages(part):
    """Time in proportion: a page of some megabytes that is nothing but openings."""
    began = time.process_time()
    made = warc.derivatives({"warc-type": "response"}, b"HTTP/1.1 200 OK\r\n\r\n" + (part * (2_000_000 // len(part))).encode())
    assert len(made) == 2 and time.process_time() - began < 20


def test_warc_of_other_files():
    """One gzip stream for all records, no compression, records cut short."""
    one = warc.record("resource", "<a>", [], b"x" * 10) + warc.END + warc.record("resource", "<b>", [], b"y") + warc.END
    for data in (one, gzip.compress(one), b"\r\n" + one):
        assert [(h["warc-record-id"], x) for _, h, x in warc.records(data)] == [("<a>", b"x" * 10), ("<b>", b"y")]
    assert [h["warc-record-id"] for _, h, _ in warc.records(one[:-6])] == ["<a>"] and len(list(warc.records(gzip.compress(one)[:-30]))) <= 2
    assert list(warc.records(b"")) == list(warc.records(b"nothing")) == list(warc.records(warc.NOTHING)) == []


def test_warc_of_nothing(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_responses(pages, f"file://{tmp_path}/in")
    warc.derive(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out")
    assert warc.read_records(spark, f"file://{tmp_path}/out").count() == warc.linked(spark, f"file://{tmp_path}/out").count() == 0
    assert warc.derivatives({"warc-type": "request"}, b"GET / HTTP/1.1\r\n\r\n") == [] and warc.derivatives({"warc-type": "response"}, b"no header") == []


# ---------------------------------------------------------------- language models
def plain_scores(rows, targets, byte):
    end = byte.get_vocab_size()
    seqs = [(i, [end, *byte.encode(t or "", add_special_tokens=False).ids, end]) for i, t in rows]
    models = []
    for chosen in (lambda i: True, lambda i: i in targets):
        pairs, firsts = collections.Counter(), collections.Counter()
        for i, s in seqs:
            if chosen(i):
                pairs.update(zip(s, s[1:]))
                firsts.update(s[:-1])
        models.append((pairs, firsts, sum(pairs.values())))
    out = []
    for i, s in seqs:
        loss = []
        for pairs, firsts, total in models:
            one = lambda w: (firsts[w] + 1) / (total + end + 1)
            loss.append(-sum(math.log((pairs[v, w] + lmscore.MASS * one(w)) / (firsts[v] + lmscore.MASS)) for v, w in zip(s, s[1:])) / (len(s) - 1))
        out.append((i, len(s) - 1, *loss))
    return out


def test_lm_scores(spark, docs, rows, none, byte):
    targets = {i for i, _ in rows[::4]}
    marks = spark.createDataFrame([(i,) for i in targets] + [(-5,), (None,)], "doc_id long")
    got = sorted(lmscore.score(docs, marks, BYTE).collect())
    want = sorted(plain_scores(rows, targets, byte))
    assert [(r.doc_id, r.n_tokens) for r in got] == [w[:2] for w in want]
    for r, w in zip(got, want):
        assert math.isclose(r.loss_background, w[2], rel_tol=1e-9) and math.isclose(r.loss_target, w[3], rel_tol=1e-9) and math.isclose(r.score, w[2] - w[3], abs_tol=1e-9)
    assert lmscore.score(none, marks, BYTE).count() == 0
    alone = lmscore.score(frame(spark, [(1, "a b"), (1, "a b"), (None, None)]), marks.where("doc_id < -9"), BYTE).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in alone) == [("1", 3), ("1", 3), ("None", 1)]
    assert all(math.isclose(r.loss_target, math.log(byte.get_vocab_size() + 1)) for r in alone)


def test_scores_of_an_id_with_many_rows(spark, byte, monkeypatch):
    monkeypatch.setattr(lmscore, "BLOCK_BYTES", 200)
    monkeypatch.setattr(lmscore, "HOT", 4)
    r = random.Random(3)
    pairs = [(i, " ".join(r.choice("abcdefgh") for _ in range(r.randrange(30)))) for i in [7] * 40 + [8] * 40 + list(range(20)) + [None] * 30]
    for targets in ({7, 3}, {5}):
        marks = spark.createDataFrame([(i,) for i in targets], "doc_id long")
        got = sorted((repr(x.doc_id), x.n_tokens, round(x.loss_background, 9), round(x.loss_target, 9)) for x in lmscore.score(frame(spark, pairs), marks, BYTE).collect())
        assert got == sorted((repr(i), n, round(b, 9), round(t, 9)) for i, n, b, t in plain_scores(pairs, targets, byte))


def test_scores_do_not_depend_on_blocks(spark, docs, rows, monkeypatch):
    marks = spark.createDataFrame([(i,) for i, _ in rows[::4]], "doc_id long")
    want = sorted(map(tuple, lmscore.score(docs, marks, BYTE).collect()))
    monkeypatch.setattr(lmscore, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(lmscore, "PARTITIONS", 5)
    got = sorted(map(tuple, lmscore.score(docs, marks, BYTE).collect()))
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2:] for g in got], [w[2:] for w in want])


def test_scores_tell_the_target_on_held_out_texts(spark):
    r = random.Random(4)
    say = lambda words: " ".join(r.choice(words) for _ in range(60))
    good, bad = ["river", "stone", "cloud", "garden", "winter"], ["buy", "cheap", "click", "now", "offer"]
    data = [(i, say(good if i % 2 else bad)) for i in range(200)]
    marks = spark.createDataFrame([(i,) for i in range(1, 100, 2)], "doc_id long")
    got = lmscore.score(frame(spark, data), marks, BYTE).where("doc_id >= 100").collect()
    assert min(x.score for x in got if x.doc_id % 2) > max(x.score for x in got if not x.doc_id % 2)
