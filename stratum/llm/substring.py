"""Substring deduplication by seed and extend.

Seeds: of the hashes of SEED-word runs inside a window, the least is its anchor (winnowing), so equal windows
have equal anchors wherever they stand. Each anchor carries the stretch of windows that it stands for. Documents meet on
anchors. Where stretches of two occurrences are equal, all windows of the later one repeat. Otherwise the match is
extended from the anchor to both sides, word by word, for exactly the windows in question: those whose words agree over the
whole window join, and the first one stands. Touching windows merge into maximal repeats.

Scale: one shuffle of about 2 rows for each (WINDOW - SEED + 2) words, equal stretches of a block collapsed to the
first before it; anchors that occur once end there. Passes over sorted rows keep one row in memory, whatever the group's size, and no pairs are
made. Only documents with an unresolved stretch send their text again.

Defined results: null, empty and shorter texts have no window and lose nothing; of rows with equal ids but different texts
each is its own document (their order is that of their texts' hashes); rows that repeat id and text are one document and share its result; a null id
comes first; other columns do not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Scratch, long_id, mix, schema_of, signed, slices, sliding_min, union_spans, window_hashes, word_hashes, word_spans
from .runs import distinct_rows, map_runs, with_neighbours

WINDOW = 20
SEED = 8
_STRETCH = np.uint64(0xD6E8FEB86659FD93)


def stretches(grams: np.ndarray, doc: np.ndarray, window: int, seed: int):
    """Winnowed anchors of a sequence of units.

    grams: hash of the run of `seed` units from each unit on; doc: number of the text of each unit. Gives for each stretch of windows
    with one anchor: anchor place, first window, last window (places of units), hash of the anchor's run.
    """
    n = len(doc)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none.view(np.uint64)
    anchor = sliding_min(grams, window - seed + 1)  # of the window that starts here
    whole = doc[: n - window + 1] == doc[window - 1 :]
    start = np.flatnonzero(whole)
    anchor = anchor[start]
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)]) if len(start) else none
    first, last, place = start[new], start[np.r_[new[1:] - 1, len(start) - 1]] if len(new) else none, anchor[new]
    return place, first, last, grams[place] if len(place) else none.view(np.uint64)


def _stretch(windows: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of whole stretches: their first and last windows cover them, as the anchor is in both."""
    return mix(mix(windows[first] + (place - first).astype(np.uint64) * _STRETCH) + windows[last] ^ ((last - first).astype(np.uint64) << np.uint64(40)))


def _scan_words(body: np.ndarray, at: np.ndarray):
    """Two independent hashes of each word, the text of each word, the first word of each text."""
    starts, ends, doc_words = word_spans(body, at, SPACE)
    return word_hashes(body, starts, ends, 1, 2), np.repeat(np.arange(len(at) - 1), np.diff(doc_words)), doc_words


#: Sorted by the first six columns: the anchor, two independent hashes of the stretch, its place.
SEEDS = pa.schema([("h", pa.int64()), ("s", pa.int64()), ("v", pa.int64()), ("doc", pa.int64()), ("tie", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("kind", pa.int8())])


def _seed_rows(window: int, seed: int):
    """(doc, tie, text) -> anchors (kind 0); stretches equal to an earlier one of the block become removed ranges at once (kind 1)."""

    def run(batches):
        for part, body, at in slices(batches, "text"):
            ids, ties = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False)
            (one, two), doc, doc_words = _scan_words(body, at)
            grams = window_hashes(one, seed, 1)
            place, first, last, h = stretches(grams, doc, window, seed)
            if not len(place):
                continue
            s, v = _stretch(window_hashes(grams, window, 1, seed), place, first, last), _stretch(window_hashes(two, window, 2), place, first, last)
            d = doc[first]
            first, last = first - doc_words[d], last - doc_words[d]
            order = np.lexsort((first, ties[d], ids[d], v, s, h))
            again = np.r_[False, (h[order][1:] == h[order][:-1]) & (s[order][1:] == s[order][:-1]) & (v[order][1:] == v[order][:-1])]
            copy = again & np.r_[False, (ids[d[order]][1:] == ids[d[order]][:-1]) & (ties[d[order]][1:] == ties[d[order]][:-1]) & (first[order][1:] == first[order][:-1])]
            order = order[~copy]  # rows that repeat both id and text are one document
            again = np.r_[False, (h[order][1:] == h[order][:-1]) & (s[order][1:] == s[order][:-1]) & (v[order][1:] == v[order][:-1])]
            keep, gone = order[~again], order[again]
            rows = {"h": h[keep], "s": s[keep], "v": v[keep], "d": d[keep], "first": first[keep], "last": last[keep], "kind": np.zeros(len(keep), np.int8)}
            if len(gone):
                # ranges of windows, merged within a document
                step = np.int64(int(last.max()) + 2)
                a, b = union_spans(d[gone] * step + first[gone], d[gone] * step + last[gone] + 1)
                more = {"h": mix(a.astype(np.uint64)), "s": mix(b.astype(np.uint64)), "v": np.zeros(len(a), np.uint64), "d": a // step, "first": a % step, "last": (b - 1) % step, "kind": np.ones(len(a), np.int8)}
                rows = {k: np.concatenate([rows[k], more[k]]) for k in rows}
            yield {"h": signed(rows["h"]), "s": signed(rows["s"]), "v": signed(rows["v"]), "doc": ids[rows["d"]], "tie": ties[rows["d"]], "first": rows["first"].astype(np.int32), "last": rows["last"].astype(np.int32), "kind": rows["kind"]}

    return map_runs(run, SEEDS)


FOUND = pa.schema([("doc", pa.int64()), ("tie", pa.int64()), ("h", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("kind", pa.int8())])


def _meet(batches):
    """Rows sorted by (h, s, v, doc, tie, first): later ones of a stretch are removed (kind 1); the first of each is open (kind 2) if its anchor has other stretches too."""

    def leaders(source):
        for cols, before, _ in with_neighbours(distinct_rows(source, 6), 3):
            kind = cols[7]
            yield [c[kind == 1] for c in cols], True
            yield [c[(kind == 0) & before] for c in cols], True
            lead = (kind == 0) & ~before
            yield [c[lead] for c in cols], False

    held, held_before = None, False
    out = lambda c, kind: {"doc": c[3], "tie": c[4], "h": c[0], "first": c[5], "last": c[6], "kind": np.full(len(c[0]), kind, np.int8)}
    for cols, gone in leaders(batches):
        if gone:
            yield out(cols, 1)
            continue
        if held is not None:
            cols = [np.concatenate([a, b]) for a, b in zip(held, cols, strict=True)]
        n = len(cols[0])
        if not n:
            continue
        same = cols[0][1:] == cols[0][:-1]
        before = np.r_[held_before, same]
        open_ = before[:-1] | same
        yield out([c[:-1][open_] for c in cols], 2)
        held, held_before = [c[-1:] for c in cols], bool(before[-1])
    if held is not None and held_before:
        yield out(held, 2)


WINDOWS = pa.schema([("w", pa.int64()), ("v", pa.int64()), ("doc", pa.int64()), ("tie", pa.int64()), ("start", pa.int32())])


def _extend_rows(window: int):
    """(doc, tie, text, open) -> one row for each window of the open stretches: two independent hashes of its words."""

    def run(batches):
        for part, body, at in slices(batches, "text"):
            ids, ties = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False)
            spans = part.column(3)
            n_open = np.diff(spans.offsets.to_numpy())
            flat = spans.flatten()
            first, last = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            words, _, doc_words = _scan_words(body, at)
            w, v = (window_hashes(x, window, i + 1) for i, x in enumerate(words))
            d = np.repeat(np.arange(len(n_open)), n_open)
            size = last - first + 1
            start = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.r_[0, np.cumsum(size)[:-1]], size)
            d = np.repeat(d, size)
            a = start + doc_words[d]
            yield {"w": signed(w[a]), "v": signed(v[a]), "doc": ids[d], "tie": ties[d], "start": start.astype(np.int32)}

    return map_runs(run, WINDOWS)


GONE = pa.schema([("doc", pa.int64()), ("tie", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])


def _later(batches):
    for cols, before, _ in with_neighbours(distinct_rows(batches, 5), 2):
        c = [x[before] for x in cols]
        yield {"doc": c[2], "tie": c[3], "first": c[4], "last": c[4]}


def removed_ranges(docs: DataFrame, scratch: Scratch, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc, tie, gone: an array of (first, last) windows, by word number, that also start earlier. docs: doc, tie, text."""
    spark = docs.sparkSession
    seeds = docs.mapInArrow(_seed_rows(window, seed), "h long, s long, v long, doc long, tie long, first int, last int, kind tinyint")
    met = seeds.repartition("h").sortWithinPartitions("h", "s", "v", "doc", "tie", "first").mapInArrow(map_runs(_meet, FOUND), "doc long, tie long, h long, first int, last int, kind tinyint")
    met = scratch.save(met, "met")
    scratch.free()  # or the anchors stay beside the texts and windows that meet next
    open_ = met.where("kind = 2").groupBy("doc", "tie").agg(F.collect_list(F.struct("first", "last")).alias("open"))
    texts = docs.join(open_, ["doc", "tie"]).select("doc", "tie", "text", "open")
    windows = texts.mapInArrow(_extend_rows(window), "w long, v long, doc long, tie long, start int")
    later = windows.repartition("w").sortWithinPartitions("w", "v", "doc", "tie", "start").mapInArrow(map_runs(_later, GONE), "doc long, tie long, first int, last int")
    gone = met.where("kind = 1").select("doc", "tie", "first", "last").union(later)
    gone = scratch.save(gone.groupBy("doc", "tie").agg(F.collect_list(F.struct("first", "last")).alias("gone")), "gone")
    scratch.only("gone")
    scratch.free()
    return gone


def keyed(docs: DataFrame, doc_id: str, text: str, keep: list[str] | None = None) -> DataFrame:
    """doc, tie, text: rows with equal ids differ in tie. A null id is the least."""
    extra = [F.col(c).alias(f"s_keep{i}") for i, c in enumerate(keep or [])]
    return docs.select(F.coalesce(long_id(docs, doc_id), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(F.col(text)).alias("tie"), F.col(text).alias("text"), *extra)


def dedup(docs: DataFrame, keep: list[str], doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """`keep`, s_words, s_removed, s_text (kept stretches as they stand, a line end between them; the text itself where nothing is removed), s_kept_sha256 and s_ranges (removed word ranges, half open)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    gone = removed_ranges(keyed(docs, doc_id, text), scratch, window, seed)
    rows = keyed(docs, doc_id, text, keep).join(gone, ["doc", "tie"], "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<struct<first:int,last:int>>")))
    names = [f"s_keep{i}" for i in range(len(keep))]
    schema = schema_of(rows, names, "s_words long, s_removed long, s_text string, s_kept_sha256 string, s_ranges array<struct<first:int,last:int>>")

    def run(batches):
        for part, body, at in slices(batches, "text"):
            index = {n: i for i, n in enumerate(part.schema.names)}
            starts, ends, doc_words = word_spans(body, at, SPACE)
            data, valid = body.tobytes(), part.column(index["text"]).is_valid().to_pylist()
            lists = part.column(index["gone"])
            flat = lists.flatten()
            f, t = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            n_gone = np.diff(lists.offsets.to_numpy())
            edges = np.r_[0, np.cumsum(n_gone)]
            out = {k: [] for k in ("words", "removed", "text", "sha", "ranges")}
            for i in range(len(at) - 1):
                lo, hi = doc_words[i], doc_words[i + 1]
                a, b = union_spans(f[edges[i] : edges[i + 1]], t[edges[i] : edges[i + 1]] + window)
                kept = np.ones(hi - lo, bool)
                for x, y in zip(a, b, strict=True):
                    kept[x:y] = False
                left = np.flatnonzero(kept) + lo
                joined = b" ".join([data[x:y] for x, y in zip(starts[left].tolist(), ends[left].tolist(), strict=True)])
                runs = np.flatnonzero(np.r_[True, left[1:] != left[:-1] + 1]) if len(left) else left
                parts = [data[x:y] for x, y in zip(starts[left[runs]].tolist(), ends[left[np.r_[runs[1:] - 1, len(left) - 1]]].tolist(), strict=True)] if len(a) and len(left) else []
                out["words"].append(int(hi - lo))
                out["removed"].append(int(hi - lo - len(left)))
                out["text"].append(b"\n".join(parts).decode() if len(a) else data[at[i] : at[i + 1]].decode() if valid[i] else None)
                out["sha"].append(hashlib.sha256(joined).hexdigest())
                out["ranges"].append([{"first": int(x), "last": int(y)} for x, y in zip(a, b, strict=True)])
            columns = [*[part.column(index[n]) for n in names], pa.array(out["words"], pa.int64()), pa.array(out["removed"], pa.int64()), pa.array(out["text"], pa.string()), pa.array(out["sha"], pa.string()), pa.array(out["ranges"], pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))]
            yield pa.RecordBatch.from_arrays(columns, [*names, "s_words", "s_removed", "s_text", "s_kept_sha256", "s_ranges"])

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "s_words", "s_removed", "s_text", "s_kept_sha256", "s_ranges")
