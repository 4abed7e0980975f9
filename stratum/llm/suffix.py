"""Removal of every byte under a repeated string of LENGTH bytes, by suffix sorting of shards.

Strings that repeat have the same winnowed anchor (the least hash of SEED-byte runs in them), so all places of a string fall to the shard of its
anchor. An anchor carries the stretch of strings that it stands for. Equal stretches repeat as a whole; an anchor with one stretch is
done. Where an anchor has different stretches, the first place of each sends its bytes to the anchor's shard. An anchor with more than
HOT such stretches is hot: they are cut into parts of PART strings, dealt by the bytes that all strings of a part share, and treated like stretches; where
even these are hot, strings are dealt by two hashes of the whole string, so that equal ones still meet, in
runs that are passed in constant memory. Each shard is one
text, whose suffixes and common prefixes come from external induced sorting (see induced.py); a suffix repeats if it shares
LENGTH bytes with a neighbour in the order.

Scale: one shuffle of about 2 rows for (LENGTH - SEED + 2) bytes; equal stretches of a block go on as one row, so a passage that is everywhere
reaches a shard once for each block. A shard ends at an anchor's end once it has SHARD_BYTES. From its first piece it is a text in files, and so is all that
is made of it, so that it may be larger than the memory. These files live in the task's own folder and end with the task.

Defined results: null and empty texts have no bytes; texts shorter than LENGTH lose nothing; each row is a place of its own, so rows that repeat a long text
lose it, whatever their ids; a null id is a document; kept bytes may end within a character where a repeat does, hence s_kept is binary; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, Scratch, buffers, byte_windows, lanes, mix, release, schema_of, signed, slices, span_hashes, union_spans
from .induced import Disk, Tape, repeated
from .pieces import spread
from .runs import _columns, map_runs, with_neighbours
from .substring import keyed, stretches

LENGTH = 200
SEED = 64
SHARD_BYTES = 8 << 20
MARKS = 1 << 20  # places of a shard looked at at once
CHUNK = 1000  # stretches whose strings are hashed at once
HOT = 1000  # different stretches of an anchor beyond which they are cut into parts
PART = 16  # strings of a part

SEEDS = pa.schema([("h", pa.int64()), ("s", pa.int64()), ("v", pa.int64()), ("doc", pa.int64()), ("tie", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("kind", pa.int8())])
FOUND = pa.schema([("doc", pa.int64()), ("tie", pa.int64()), ("h", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("kind", pa.int8())])
PIECES = pa.schema([("h", pa.int64()), ("doc", pa.int64()), ("tie", pa.int64()), ("first", pa.int32()), ("piece", pa.binary())])
STRINGS = pa.schema([("w", pa.int64()), ("v", pa.int64()), ("doc", pa.int64()), ("tie", pa.int64()), ("first", pa.int32())])
RANGES = pa.schema([("doc", pa.int64()), ("tie", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])
_SQL = {"int64": "long", "int32": "int", "int8": "tinyint", "binary": "binary"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_SQL[str(f.type)]}" for f in schema)


def _seed_rows(length: int, seed: int):
    """(doc, tie, text) -> the first of each stretch of a block (kind 0); ranges of strings that repeat within the block (kind 1)."""

    def run(batches):
        for part, body, at in slices(batches, "text"):
            ids, ties = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
            # A text longer than a block is scanned in pieces that overlap by one string less a byte, so each string is in one piece.
            step = max(1, len(body)) if len(at) > 2 else BLOCK_BYTES
            found = []
            for low in range(0, len(body), step):
                view = lanes(body[low : low + step + length - 1])
                _, a, b, h = stretches(byte_windows(view, seed, 7), doc[low : low + step + length - 1], length, seed)
                found.append((a + low, b + low, h, *span_hashes(view, a, b + length, 8, 9)))
            first, last, h, s, v = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 5
            if not len(first):
                continue
            d = doc[first].astype(np.int64)
            first, last = first - at[d], last - at[d]
            order = np.lexsort((v, s, h))
            again = np.r_[False, (h[order][1:] == h[order][:-1]) & (s[order][1:] == s[order][:-1]) & (v[order][1:] == v[order][:-1])]
            gone, keep = order[again | np.r_[again[1:], False]], order[~again]
            rows = {"h": h[keep], "s": s[keep], "v": v[keep], "d": d[keep], "first": first[keep], "last": last[keep], "kind": np.zeros(len(keep), np.int8)}
            if len(gone):
                step = np.int64(int(last.max()) + 2)
                a, b = union_spans(d[gone] * step + first[gone], d[gone] * step + last[gone] + 1)
                more = {"h": mix(a.astype(np.uint64)), "s": mix(b.astype(np.uint64)), "v": np.zeros(len(a), np.uint64), "d": a // step, "first": a % step, "last": (b - 1) % step, "kind": np.ones(len(a), np.int8)}
                rows = {k: np.concatenate([rows[k], more[k]]) for k in rows}
            yield {"h": signed(rows["h"]), "s": signed(rows["s"]), "v": signed(rows["v"]), "doc": ids[rows["d"]], "tie": ties[rows["d"]], "first": rows["first"].astype(np.int32), "last": rows["last"].astype(np.int32), "kind": rows["kind"]}

    return map_runs(run, SEEDS)


def _meet(batches):
    """Rows sorted by (h, s, v): equal stretches are removed (kind 1); the first of each is open (kind 2) if its anchor has other ones."""
    out = lambda c, which, kind: {"doc": c[3][which], "tie": c[4][which], "h": c[0][which], "first": c[5][which], "last": c[6][which], "kind": np.full(int(which.sum()), kind, np.int8)}
    held, held_before = None, False
    for cols, before, after in with_neighbours((_columns(b) for b in batches if b.num_rows), 3):
        kind = cols[7]
        yield out(cols, (kind == 1) | before | after, 1)
        lead = [c[(kind == 0) & ~before] for c in cols]
        if held is not None:
            lead = [np.concatenate([a, b]) for a, b in zip(held, lead, strict=True)]
        if not len(lead[0]):
            continue
        same = lead[0][1:] == lead[0][:-1]
        known = np.r_[held_before, same]
        yield out([c[:-1] for c in lead], known[:-1] | same, 2)
        held, held_before = [c[-1:] for c in lead], bool(known[-1])
    if held is not None and held_before:
        yield out(held, np.ones(1, bool), 2)


def _cut(length: int):
    """(doc, tie, text, open) -> the bytes of the open stretches."""

    def run(batches):
        for part, body, at in slices(batches, "text"):
            ids, ties = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False)
            spans = part.column(3)
            d = np.repeat(np.arange(len(at) - 1), np.diff(spans.offsets.to_numpy()))
            flat = spans.flatten()
            h, first, last = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            data, begin = body.tobytes(), at[d] + first
            pieces = [data[i:j] for i, j in zip(begin.tolist(), (at[d] + last + length).tolist(), strict=True)]
            yield {"h": h, "doc": ids[d], "tie": ties[d], "first": first, "piece": pieces}

    return map_runs(run, PIECES)


def _open_bytes(batches, length: int):
    """(doc, tie, text, open) -> some open stretches at a time: ids, ties, anchors' hashes, firsts, numbers of strings, lanes() of the stretches' bytes one after another, and where each begins there."""
    for part, body, at in slices(batches, "text"):
        ids, ties = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False)
        spans = part.column(3)
        d = np.repeat(np.arange(len(at) - 1), np.diff(spans.offsets.to_numpy()))
        flat = spans.flatten()
        h, first, last = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
        for i in range(0, len(d), CHUNK):
            own, low, size = d[i : i + CHUNK], first[i : i + CHUNK], last[i : i + CHUNK] - first[i : i + CHUNK] + 1
            width = size + length - 1
            yield ids[own], ties[own], h[i : i + CHUNK], low, size, lanes(body[spread(at[own] + low, width)]), np.cumsum(width) - width


def _parts(length: int, seed: int):
    """(doc, tie, text, open) -> the open stretches of hot anchors, cut into parts of at most PART strings by their distance from the anchor. All strings of a
    part have its core in common, the bytes that any string of such a part has, so equal strings meet by the hash of the core."""

    def run(batches):
        for ids, ties, h, low, size, view, begin in _open_bytes(batches, length):
            # The anchor is the last run of its hash in the first string.
            reach = length - seed
            runs = byte_windows(view, seed, 7)[begin[:, None] + np.arange(reach + 1)] == h.view(np.uint64)[:, None]
            anchor = reach - np.argmax(runs[:, ::-1], axis=1)
            most, least = anchor // PART, (anchor - size + 1) // PART  # of the distances from first and last
            n = most - least + 1
            k, which = np.repeat(most, n) - spread(np.zeros(len(n), np.int64), n), np.repeat(np.arange(len(n)), n)
            a = np.maximum(anchor[which] - (k + 1) * PART + 1, 0)
            b = np.minimum(anchor[which] - k * PART, size[which] - 1)
            at = begin[which]
            (core,) = span_hashes(view, at + anchor[which] - k * PART, at + anchor[which] - (k + 1) * PART + 1 + length, 11)
            s, v = span_hashes(view, at + a, at + b + length, 8, 9)
            yield {"h": signed(mix(core + k.astype(np.uint64))), "s": signed(s), "v": signed(v), "doc": ids[which], "tie": ties[which], "first": (low[which] + a).astype(np.int32), "last": (low[which] + b).astype(np.int32), "kind": np.zeros(len(k), np.int8)}

    return map_runs(run, SEEDS)


def _strings(length: int):
    """(doc, tie, text, open) -> one row for each string of the open stretches: two independent hashes of its bytes."""

    def run(batches):
        for ids, ties, _, low, size, view, begin in _open_bytes(batches, length):
            own, step = np.repeat(np.arange(len(size)), size), spread(np.zeros(len(size), np.int64), size)
            w, v = (signed(byte_windows(view, length, s)[begin[own] + step]) for s in (8, 9))
            yield {"w": w, "v": v, "doc": ids[own], "tie": ties[own], "first": (low[own] + step).astype(np.int32)}

    return map_runs(run, STRINGS)


def _again(batches):
    """Rows sorted by (w, v): the places of strings that are there more than once."""
    for c, before, after in with_neighbours((_columns(b) for b in batches if b.num_rows), 2):
        hit = before | after
        yield {"doc": c[2][hit], "tie": c[3][hit], "first": c[4][hit], "last": c[4][hit]}


_ROW = np.dtype([("doc", "<i8"), ("tie", "<i8"), ("edge", "<i8"), ("size", "<i4"), ("first", "<i4")])


class Shard:
    """Pieces of whole anchors as one text, in files of the task's own folder from the start."""

    def __init__(self):
        self.folder = tempfile.TemporaryDirectory()
        self.disk = Disk(self.folder.name)
        self.text, self.rows = Tape(self.disk, np.dtype("<u2")), Tape(self.disk, _ROW)

    def add(self, doc: np.ndarray, tie: np.ndarray, first: np.ndarray, data: np.ndarray, size: np.ndarray) -> None:
        """data: the pieces' bytes, one piece after another. In the text each is followed by a sign of its own."""
        text = np.full(len(data) + len(size), 256, np.uint16)  # more than any byte; bytes are one more than they are
        text[np.arange(len(data)) + np.repeat(np.arange(len(size)), size)] = data.astype(np.uint16) + 1
        rows = np.empty(len(size), _ROW)
        rows["doc"], rows["tie"], rows["first"], rows["size"] = doc, tie, first, size
        rows["edge"] = self.text.n + np.cumsum(size + 1) - size - 1
        self.text.add(text)
        self.rows.add(rows)

    def ranges(self, length: int) -> Iterator[dict[str, np.ndarray]]:
        """Ranges of strings that repeat."""
        self.text.add(np.zeros(1, np.uint16))
        marks = repeated(self.text.mapped(), length, self.disk)
        rows = self.rows.mapped()
        for i in range(0, len(marks), MARKS):
            hit = np.flatnonzero(marks[i : i + MARKS]) + i
            which = np.searchsorted(rows["edge"], hit, "right") - 1
            own = rows[which]
            inside = hit + length <= own["edge"] + own["size"]
            a, b = union_spans(hit[inside], hit[inside] + 1)
            own = rows[np.searchsorted(rows["edge"], a, "right") - 1]
            shift = own["first"] - own["edge"]
            yield {"doc": own["doc"], "tie": own["tie"], "first": (a + shift).astype(np.int32), "last": (b - 1 + shift).astype(np.int32)}
            Disk.rest(marks, rows)

    def close(self) -> None:
        self.text.close()
        self.rows.close()
        self.folder.cleanup()
        release()


def _sorted_shards(length: int):
    """Pieces sorted by anchor -> ranges of strings that repeat, a shard of whole anchors at a time."""

    def finish(shard: Shard):
        yield from shard.ranges(length)
        shard.close()

    def run(batches):
        shard, last = None, None
        for batch in batches:
            h, doc, tie, first = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            data, at = buffers(batch.column(4))
            new = np.r_[len(h) > 0 and h[0] != last, h[1:] != h[:-1]][: len(h)]
            low = 0
            while low < len(h):
                # Rows up to the bound, then those up to the next anchor.
                have = shard.text.n if shard else 0
                high = int(np.searchsorted(at, at[low] + SHARD_BYTES - have, "left"))
                follow = np.flatnonzero(new[max(high, low) :])
                high = max(high, low) + int(follow[0]) if len(follow) else len(h)
                if high > low:
                    shard = shard or Shard()
                    shard.add(doc[low:high], tie[low:high], first[low:high], data[at[low] : at[high]], np.diff(at[low : high + 1]))
                if len(follow) and shard:
                    yield from finish(shard)
                    shard = None
                low = high
            last = h[-1] if len(h) else last
        if shard:
            yield from finish(shard)

    return map_runs(run, RANGES)


def repeated_ranges(docs: DataFrame, scratch: Scratch, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """doc, tie, gone: an array of (first, last) starts, by byte, of strings that also start elsewhere. docs: doc, tie, text."""

    def texts(spans: DataFrame) -> DataFrame:
        spans = spans.groupBy("doc", "tie").agg(F.collect_list(F.struct("h", "first", "last")).alias("open"))
        return docs.join(spans, ["doc", "tie"]).select("doc", "tie", "text", "open")

    def met(seeds: DataFrame, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Ranges known to repeat, the open stretches of hot anchors, those of others. There is at most one hot anchor for HOT open stretches."""
        found = scratch.save(seeds.repartition("h").sortWithinPartitions("h", "s", "v").mapInArrow(map_runs(_meet, FOUND), _ddl(FOUND)), name)
        open_ = found.where("kind = 2").select("doc", "tie", "h", "first", "last")
        hot = scratch.save(open_.groupBy("h").agg(F.count(F.lit(1)).alias("stretches")).where(F.col("stretches") > HOT).select("h"), f"hot_{name}")
        return found.where("kind = 1").select("doc", "tie", "first", "last"), open_.join(hot, "h", "left_semi"), open_.join(hot, "h", "left_anti")

    whole, hot, cold = met(docs.mapInArrow(_seed_rows(length, seed), _ddl(SEEDS)), "stretches")
    parts, hot_parts, cold_parts = met(texts(hot).mapInArrow(_parts(length, seed), _ddl(SEEDS)), "parts")
    columns = ["doc", "tie", "h", "first", "last"]
    pieces = texts(cold.select(columns).union(cold_parts.select(columns))).mapInArrow(_cut(length), _ddl(PIECES)).repartition("h").sortWithinPartitions("h")
    sorted_ = pieces.mapInArrow(_sorted_shards(length), _ddl(RANGES))
    strings = texts(hot_parts).mapInArrow(_strings(length), _ddl(STRINGS)).repartition("w").sortWithinPartitions("w", "v")
    again = strings.mapInArrow(map_runs(_again, RANGES), _ddl(RANGES))
    gone = whole.union(parts).union(sorted_).union(again)
    gone = scratch.save(gone.groupBy("doc", "tie").agg(F.collect_list(F.struct("first", "last")).alias("gone")), "gone")
    scratch.only("gone")
    return gone


def strip(docs: DataFrame, keep: list[str], doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, seed: int = SEED, with_bytes: bool = False) -> DataFrame:
    """`keep`, s_bytes, s_removed, s_spans, s_kept_sha256 (and s_kept, the remaining bytes, with with_bytes) for each row."""
    scratch = Scratch(docs.sparkSession, "suffix")
    gone = repeated_ranges(keyed(docs, doc_id, text), scratch, length, seed)
    names = [f"s_keep{i}" for i in range(len(keep))]
    rows = keyed(docs, doc_id, text, keep).join(gone, ["doc", "tie"], "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<struct<first:int,last:int>>"))).select(*names, "text", "gone")
    schema = schema_of(rows, names, "s_bytes long, s_removed long, s_spans long, s_kept_sha256 string" + ", s_kept binary" * with_bytes)

    def run(batches):
        for part, body, at in slices(batches, "text"):
            lists = part.column(len(names) + 1)
            flat = lists.flatten()
            f, t = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            edge = np.r_[0, np.cumsum(np.diff(lists.offsets.to_numpy()))]
            data = body.tobytes()
            removed, spans, sha, left = [], [], [], []
            for i in range(len(at) - 1):
                a, b = union_spans(f[edge[i] : edge[i + 1]], t[edge[i] : edge[i + 1]] + length)
                own = data[at[i] : at[i + 1]]
                kept = b"".join([own[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(own)], strict=True)])
                removed.append(len(own) - len(kept))
                spans.append(len(a))
                sha.append(hashlib.sha256(kept).hexdigest())
                left.append(kept if with_bytes else None)
            columns = [*part.columns[: len(names)], pa.array(np.diff(at)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()), *([pa.array(left, pa.binary())] if with_bytes else [])]
            yield pa.RecordBatch.from_arrays(columns, [*names, "s_bytes", "s_removed", "s_spans", "s_kept_sha256", *(["s_kept"] if with_bytes else [])])

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], *out.columns[len(names) :])
