"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by documents: a block of texts has, for each of its terms, the sorted list of the places
where the term stands. Rows of the index hold one bucket of the terms of one block, so a search reads only the buckets of its
own terms. A search ranks its terms by their number of places in the whole corpus; within a block it shifts the
lists of a phrase by the terms' offsets and intersects them from the rarest on. What is left are the exact
matches; with a slop, the places near enough (proximity matches): a phrase is near the place of its rarest term where each other term
has a place at most `slop` words from its own, in the same document.

A term is two independent hashes of the word's bytes, of 64 and 32 bits.

Scale: one pass over the texts, no shuffle of texts; a hot term has a list in each block and none is longer than its block.
The phrases come to the executors in chunks of at most CHUNK_BYTES of benchmark text, a pass of the index each; the driver holds one
chunk's phrases and the counts of its terms, whatever the size of the benchmark.

Defined results: null and empty texts have no words and hits; an item without words has no window; items with equal ids count
once; null item ids are named "null"; every row is its own document, repeated rows too; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, long_id, schema_of, signed, slices, union_spans, word_hashes, word_spans

WINDOW = 13
BUCKETS = 16
CHUNK_BYTES = 4 << 20
BLOCK_BYTES = 1 << 20  # text of an index block
ROW_GROUP_BYTES = 4 << 20  # what a reader of the index holds at once

#: Bytes outside words: all but digits, letters and what is not ASCII.
BREAKS = np.ones(256, bool)
BREAKS[0x30:0x3A] = BREAKS[0x41:0x5B] = BREAKS[0x61:0x7B] = False
BREAKS[0x80:] = False


def _terms(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both hashes of each word, and the first word of each text."""
    starts, ends, doc_words = word_spans(body, at, BREAKS)
    terms, checks = word_hashes(body, starts, ends, 3, 4, lower=True)
    return terms, checks.astype(np.uint32), doc_words


def _order(terms: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Order by term, check and place."""
    order = np.argsort(terms, kind="stable")
    t, c = terms[order], checks[order]
    return order if ((t[1:] != t[:-1]) | (c[1:] == c[:-1])).all() else np.lexsort((checks, terms))


def _find(terms: np.ndarray, checks: np.ndarray, t: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of (t, c) among the sorted, distinct pairs (terms, checks), and which of them are there."""
    k = np.minimum(np.searchsorted(terms, t), max(len(terms) - 1, 0))
    if not len(terms):
        return k, np.zeros(len(k), bool)
    while True:
        more = np.minimum(k + 1, len(terms) - 1)
        move = (terms[k] == t) & (checks[k] != c) & (terms[more] == t) & (more > k)
        if not move.any():
            return k, (terms[k] == t) & (checks[k] == c)
        k = np.where(move, more, k)


INDEX = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("terms", pa.binary()), ("checks", pa.binary()), ("counts", pa.binary()), ("places", pa.binary()), ("docs", pa.list_(pa.int64())), ("bounds", pa.list_(pa.int32()))])
INDEX_SQL = "block long, bucket int, terms binary, checks binary, counts binary, places binary, docs array<long>, bounds array<int>"


def build_index(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of all rows. Bucket -1 of a block has its documents and their first places."""

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for part, body, at in slices(batches, "d_text", BLOCK_BYTES):
            terms, checks, doc_words = _terms(body, at)
            order = _order(terms, checks)
            ranked, its = terms[order], checks[order]
            head = np.flatnonzero(np.r_[True, (ranked[1:] != ranked[:-1]) | (its[1:] != its[:-1])]) if len(ranked) else np.zeros(0, np.int64)
            count = np.diff(np.r_[head, len(ranked)])
            keys, its, places = ranked[head], its[head], order.astype("<i4")
            edge = np.searchsorted(keys, np.arange(1, BUCKETS, dtype=np.uint64) << np.uint64(64 - (BUCKETS - 1).bit_length()))
            edge = np.r_[0, edge, len(keys)]
            rows = {n: [] for n in INDEX.names}
            rows["block"], rows["bucket"] = [block] * (BUCKETS + 1), list(range(-1, BUCKETS))
            rows["docs"], rows["bounds"] = [part.column(0).to_pylist()] + [None] * BUCKETS, [doc_words.tolist()] + [None] * BUCKETS
            for n in ("terms", "checks", "counts", "places"):
                rows[n].append(None)
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                first, last = (head[a] if a < len(head) else len(places)), (head[b] if b < len(head) else len(places))
                rows["terms"].append(keys[a:b].astype("<u8").tobytes())
                rows["checks"].append(its[a:b].astype("<u4").tobytes())
                rows["counts"].append(count[a:b].astype("<i4").tobytes())
                rows["places"].append(places[first:last].tobytes())
            yield pa.RecordBatch.from_pydict(rows, INDEX)
            block += 1

    return scratch.save(docs.select(long_id(docs, doc_id).alias("d_id"), F.col(text).alias("d_text")).mapInArrow(run, INDEX_SQL), "index", **{"parquet.block.size": ROW_GROUP_BYTES, "compression": "zstd"})


def phrases_of(items: list[tuple[str, str]], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The vocabulary of some items (terms and checks, sorted), their distinct phrases (one row of places in the vocabulary for each, padded by -1),
    lengths, and rows of (phrase, number of item)."""
    body = [(t or "").encode() for _, t in items]
    at = np.r_[0, np.cumsum([len(b) for b in body])].astype(np.int64)
    terms, checks, doc_words = _terms(np.frombuffer(b"".join(body), np.uint8), at)
    order = np.lexsort((checks, terms))
    new = np.r_[True, (terms[order][1:] != terms[order][:-1]) | (checks[order][1:] != checks[order][:-1])][: len(order)]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    rows: dict[tuple, int] = {}
    pairs = set()
    for i in range(len(items)):
        words = number[doc_words[i] : doc_words[i + 1]].tolist()
        size = min(window, len(words))
        for j in range(len(words) - size + 1 if size else 0):
            pairs.add((rows.setdefault(tuple(words[j : j + size]), len(rows)), i))
    out = np.full((len(rows), window), -1, np.int64)
    for p, k in rows.items():
        out[k, : len(p)] = p
    return terms[order][new], checks[order][new], out, np.array([len(p) for p in rows], np.int64), np.array(sorted(pairs), np.int64).reshape(-1, 2)


def intersect(lists: list[np.ndarray], offsets: list[int], slop: int = 0, bounds: np.ndarray | None = None) -> np.ndarray:
    """Starts where every list has a place at its offset, at most `slop` away and between the same two bounds (of documents). Lists come rarest first."""
    place = lists[0]
    low, high = np.full(len(place), -(1 << 62)), np.full(len(place), 1 << 62)
    if bounds is not None and len(place):
        d = np.searchsorted(bounds, place, "right")
        low, high = bounds[d - 1], bounds[d] - 1
    start = place - offsets[0]
    for have, o in zip(lists[1:], offsets[1:], strict=True):
        if not len(start):
            break
        want = start + o
        k = np.searchsorted(have, np.maximum(want - slop, low))
        near = (k < len(have)) & (have[np.minimum(k, len(have) - 1)] <= np.minimum(want + slop, high))
        start, low, high = start[near], low[near], high[near]
    return start


def term_counts(index: DataFrame, terms: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Places of each of these terms (sorted) in the whole corpus. What is collected is as large as `terms` at most."""

    def run(batches):
        for b in batches:
            keys, its, n = (np.concatenate([np.frombuffer(x, t) for x in b.column(i).to_pylist()] or [np.zeros(0, t)]) for i, t in enumerate(("<u8", "<u4", "<i4")))
            k, hit = _find(terms, checks, keys, its)
            sums = np.bincount(k[hit], n[hit], len(terms)).astype(np.int64)
            some = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["term", "n"])

    out = np.zeros(len(terms), np.int64)
    if len(terms):
        found = index.where("bucket >= 0").select("terms", "checks", "counts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        for k, n in found.collect():
            out[k] = n
    return out


HITS = "block long, row int, doc_id long, n_words long, starts array<int>, ends array<int>, items array<string>"
HITS_SCHEMA = pa.schema([("block", pa.int64()), ("row", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])


def search(index: DataFrame, items: list[tuple[str, str]], window: int = WINDOW, slop: int = 0) -> DataFrame:
    """For each row of the documents: its words, the word ranges of all matches (merged) and the names of the items with a match."""
    vocabulary, checks, column, size, pairs = phrases_of(items, window)
    names = [n for n, _ in items]
    frequency = term_counts(index, vocabulary, checks)
    # Rarest terms first, by the whole corpus; phrases with a term that the corpus lacks go.
    rank = np.where(column >= 0, frequency[np.maximum(column, 0)] if len(frequency) else 0, np.iinfo(np.int64).max)
    order = np.argsort(rank, axis=1, kind="stable") if len(column) else np.zeros((0, window), np.int64)
    alive = (rank > 0).all(axis=1) if len(column) else np.zeros(0, bool)
    used = sorted({int(t >> np.uint64(64 - (BUCKETS - 1).bit_length())) for t in vocabulary})

    def trim(batches):
        """Lists of the searched terms only, named by their places in the vocabulary."""
        schema = pa.schema([("block", pa.int64()), ("found", pa.binary()), *[INDEX.field(n) for n in ("counts", "places", "docs", "bounds")]])
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                terms, its, counts, places = (row.column(k)[0].as_buffer() for k in (1, 2, 3, 4))
                if terms is None:
                    yield pa.RecordBatch.from_arrays([row.column(k) for k in (0, 1, 3, 4, 5, 6)], schema=schema)
                    continue
                n = np.frombuffer(counts, "<i4")
                k, keep = _find(vocabulary, checks, np.frombuffer(terms, "<u8"), np.frombuffer(its, "<u4"))
                if keep.any():
                    mine = np.frombuffer(places, "<i4")[np.repeat(keep, n)]
                    cells = [row.column(0), *(pa.array([x.tobytes()], pa.binary()) for x in (k[keep].astype("<i4"), n[keep], mine)), row.column(5), row.column(6)]
                    yield pa.RecordBatch.from_arrays(cells, schema=schema)

    def match(key, found):
        head = next(r for r in found.select(["docs", "bounds"]).to_pylist() if r["docs"] is not None)
        ids, bounds = head["docs"], np.array(head["bounds"], np.int64)
        lists: list[np.ndarray | None] = [None] * len(vocabulary)
        present = np.zeros(len(vocabulary) + 1, bool)
        present[-1] = True  # padding
        for r in found.select(["found", "counts", "places"]).to_pylist():
            if r["found"] is not None:
                at = np.frombuffer(r["found"], "<i4")
                cut = np.cumsum(np.frombuffer(r["counts"], "<i4"))
                for k, x in zip(at.tolist(), np.split(np.frombuffer(r["places"], "<i4").astype(np.int64), cut[:-1]), strict=True):
                    lists[k], present[k] = x, True
        doc = lambda place: np.searchsorted(bounds, place, "right") - 1
        first, last, of_phrase = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for p in np.flatnonzero(alive & present[column].all(axis=1)).tolist() if len(column) else ():
            offsets = order[p, : size[p]].tolist()
            start = intersect([lists[column[p, o]] for o in offsets], offsets, slop, bounds)
            if len(start):
                d = doc(start + offsets[0])
                first.append(np.maximum(start, bounds[d]))
                last.append(np.minimum(start + size[p], bounds[d + 1]))
                of_phrase.append(np.full(len(start), p))
        first, last, of_phrase = np.concatenate(first), np.concatenate(last), np.concatenate(of_phrase)
        d = doc(first)
        rows = {n: [] for n in HITS_SCHEMA.names}
        by = np.argsort(d, kind="stable")
        edge = np.searchsorted(d[by], np.arange(len(ids) + 1))
        for i, name in enumerate(ids):
            mine = by[edge[i] : edge[i + 1]]
            a, b = union_spans(first[mine] - bounds[i], last[mine] - bounds[i])
            hit = np.unique(pairs[np.isin(pairs[:, 0], of_phrase[mine]), 1]) if len(mine) else ()
            for k, v in zip(rows, (key[0].as_py(), i, name, int(bounds[i + 1] - bounds[i]), a.tolist(), b.tolist(), sorted({names[x] for x in hit})), strict=True):
                rows[k].append(v)
        return pa.Table.from_pydict(rows, HITS_SCHEMA)

    wanted = index.where(F.col("bucket").isin([-1, *used]))
    trimmed = wanted.select("block", "terms", "checks", "counts", "places", "docs", "bounds").mapInArrow(trim, "block long, found binary, counts binary, places binary, docs array<long>, bounds array<int>")
    return trimmed.groupBy("block").applyInArrow(match, HITS)


def chunks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[str, str]]]:
    """The items, in chunks of bounded size; one chunk at a time is on the driver."""
    now, n = [], 0
    for name, body in benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")), F.coalesce(F.col(text), F.lit(""))).toLocalIterator():
        if now and n + len(body) > CHUNK_BYTES:
            yield now
            now, n = [], 0
        now.append((name, body))
        n += len(body)
    yield now


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, slop: int = 0) -> DataFrame:
    """One row for each document: doc_id, n_words, starts and ends (hit word ranges), items (sorted names). With a slop, proximity matches count too."""
    scratch = Scratch(docs.sparkSession, "decontam")
    index = build_index(docs, scratch, doc_id, text)
    found = [search(index, c, window, slop) for c in chunks(benchmark, item_id, item_text)]
    if len(found) == 1:
        return found[0].select("doc_id", "n_words", "starts", "ends", "items")
    whole = found[0]
    for f in found[1:]:
        whole = whole.union(f)
    gathered = whole.groupBy("block", "row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return gathered.select("doc_id", "n_words", "starts", "ends", "items")


def report(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items."""

    def run(batches):
        for b in batches:
            hit, sha = [], []
            for s, e, items in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                first, last = union_spans(np.array(s, np.int64), np.array(e, np.int64))
                hit.append(int((last - first).sum()))
                sha.append(hashlib.sha256(",".join(items).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hit, pa.int64()), pa.array(sha, pa.string()), b.column(4)], ["doc_id", "n_words", "n_hit", "items_sha256", "items"])

    rows = contamination(docs, benchmark, **names).mapInArrow(run, "doc_id long, n_words long, n_hit long, items_sha256 string, items array<string>")
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items_sha256", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "items")


def cut(rows: DataFrame, names: list[str], text: str = "text", starts: str = "starts", ends: str = "ends") -> DataFrame:
    """`names`, d_words, d_hit and d_text: the text without the words of its ranges, a line end for each cut; the text itself without ranges."""
    rows = rows.select(*names, F.col(text).alias("d_body"), F.coalesce(starts, F.array().cast("array<int>")).alias("d_starts"), F.coalesce(ends, F.array().cast("array<int>")).alias("d_ends"))
    schema = schema_of(rows, names, "d_words long, d_hit long, d_text string")
    k = len(names)

    def run(batches):
        for part, body, at in slices(batches, "d_body"):
            words, hit, left = [], [], []
            valid = part.column(k).is_valid().to_pylist()
            for i, (s, e) in enumerate(zip(part.column(k + 1).to_pylist(), part.column(k + 2).to_pylist(), strict=True)):
                own = body[at[i] : at[i + 1]]
                if not s:
                    words.append(None)
                    hit.append(0)
                    left.append(own.tobytes().decode() if valid[i] else None)
                    continue
                low, high, _ = word_spans(own, np.array([0, len(own)]), BREAKS)
                a, b = union_spans(np.array(s, np.int64), np.array(e, np.int64))
                data = own.tobytes()
                parts = [data[x:y] for x, y in zip([0, *high[b - 1].tolist()], [*low[a].tolist(), len(data)], strict=True)]
                words.append(len(low))
                hit.append(int((b - a).sum()))
                left.append(b"\n".join(parts).decode())
            columns = [*part.columns[:k], pa.array(words, pa.int64()), pa.array(hit, pa.int64()), pa.array(left, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "d_words", "d_hit", "d_text"])

    return rows.mapInArrow(run, schema)
