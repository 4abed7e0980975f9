"""Operators on whole texts against plain versions: removal of repeats, joins, decontamination, quality."""

import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratum.llm import components, decontam, induced, jaccard, quality, substring, suffix
from stratum.llm.common import Scratch
from tests.llm.conftest import frame

SPACE = "[^\x20\x09-\x0d]+"
sha = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()
lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


# ---------------------------------------------------------------- substring dedup
def plain_substring(rows, window=20):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = re.findall(SPACE, t or "")
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            k = tuple(w[j : j + window])
            if k in seen:
                gone[j : j + window] = [True] * window
            seen.add(k)
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("window, seed", [(20, 8), (20, 20), (5, 2)])
def test_substring_dedup(docs, rows, window, seed):
    got = substring.dedup(docs, ["doc_id", "tie"], window=window, seed=seed).collect()
    assert {r.doc_id: (r.s_words, r.s_removed, r.s_kept_sha256) for r in got} == plain_substring(rows, window)
    texts = dict(rows)
    assert all(r.s_text == texts[r.doc_id] for r in got if not r.s_removed)
    assert all(re.findall(SPACE, r.s_text) == [w for k, w in enumerate(re.findall(SPACE, texts[r.doc_id])) if not any(a <= k < b for a, b in r.s_ranges)] for r in got if r.s_removed)


def test_substring_dedup_of_repeated_rows_and_null_ids(spark):
    t = " ".join(map(str, range(40)))
    got = substring.dedup(frame(spark, [(1, t), (1, t), (2, t), (None, t), (1, t + " end")]), ["doc_id"]).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.s_words, r.s_removed) for r in got) == [(False, 0, 40, 0), (True, 1, 40, 40), (True, 1, 40, 40), (True, 1, 41, 40), (True, 2, 40, 40)]


# ---------------------------------------------------------------- suffix dedup
def plain_suffix(rows, length):
    data = {i: (t or "").encode() for i, t in rows}
    count = collections.Counter(b[j : j + length] for b in data.values() for j in range(len(b) - length + 1))
    out = {}
    for i, b in data.items():
        gone = np.zeros(len(b) + 1, bool)
        for j in range(len(b) - length + 1):
            if count[b[j : j + length]] > 1:
                gone[j : j + length] = True
        out[i] = (len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), sha(bytes(x for x, g in zip(b, gone) if not g)))
    return out


@pytest.mark.parametrize("length, seed", [(200, 64), (30, 8)])
def test_suffix_dedup(docs, rows, length, seed, monkeypatch):
    monkeypatch.setattr(suffix, "SHARD_BYTES", 2000)
    got = suffix.strip(docs, ["doc_id", "h"], length=length, seed=seed, with_bytes=True).collect()
    assert {r.doc_id: (r.s_bytes, r.s_removed, r.s_spans, r.s_kept_sha256) for r in got} == plain_suffix(rows, length)
    assert all(sha(bytes(r.s_kept)) == r.s_kept_sha256 for r in got)


@pytest.mark.parametrize("hot, part", [(0, 4), (3, 16)])
def test_suffix_dedup_with_hot_anchors(docs, rows, hot, part, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "PART", part)
    monkeypatch.setattr(suffix, "CHUNK", 7)
    got = suffix.strip(docs, ["doc_id"], length=30, seed=8).collect()
    assert {r.doc_id: (r.s_bytes, r.s_removed, r.s_spans, r.s_kept_sha256) for r in got} == plain_suffix(rows, 30)


@pytest.mark.parametrize("hot", [10, 10**9])
def test_suffix_dedup_where_a_passage_is_everywhere(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "SHARD_BYTES", 2000)
    r = np.random.default_rng(4)
    say = lambda n: bytes(r.integers(97, 123, n).tolist()).decode()
    passage = say(300)
    pairs = [(i, say(250) + passage + say(250)) for i in range(200)]
    got = suffix.strip(frame(spark, pairs), ["doc_id"]).collect()
    assert {x.doc_id: (x.s_bytes, x.s_removed, x.s_spans, x.s_kept_sha256) for x in got} == plain_suffix(pairs, 200)


def test_suffix_dedup_of_repeated_rows_and_null_ids(spark):
    t, u = "".join(f"{k}," for k in range(100)), "".join(f"{k};" for k in range(100))
    got = suffix.strip(frame(spark, [(1, t), (1, t), (2, u), (None, u + "x"), (None, None), (3, "".join(f"{k}-" for k in range(90)))]), ["doc_id"]).collect()
    assert sorted((str(r.doc_id), r.s_bytes, r.s_removed) for r in got) == [("1", 290, 290), ("1", 290, 290), ("2", 290, 290), ("3", 260, 0), ("None", 0, 0), ("None", 291, 290)]


def test_ids_that_are_no_numbers_are_refused(spark):
    docs = spark.createDataFrame([("a", "b")], "doc_id string, text string")
    for call in (lambda: substring.dedup(docs, ["doc_id"]), lambda: suffix.strip(docs, ["doc_id"]), lambda: jaccard.join(docs, ["doc_id"]), lambda: decontam.build_index(docs, Scratch(spark, "test"))):
        with pytest.raises(TypeError, match="whole numbers"):
            call()


def test_long_texts_are_scanned_in_pieces(spark, rows, monkeypatch):
    from stratum.llm import common

    body = np.frombuffer(("ab c " * 300 + "x" * 700 + " yz").encode(), np.uint8)
    starts, ends, _ = common.word_spans(body, np.array([0, len(body)]))
    whole = common.word_hashes(body, starts, ends, 1, 2)
    for limit in (1, 50, 600):
        monkeypatch.setattr(common, "SPANS", limit)
        assert all((a == b).all() for a, b in zip(common.word_hashes(body, starts, ends, 1, 2), whole))
    r = np.random.default_rng(2)
    for limit in (100, 333, 5000):
        monkeypatch.setattr(suffix, "BLOCK_BYTES", limit)
        text = bytes(r.integers(97, 123, 3000).tolist()).decode()
        text = text[:1500] + text[200:900] + text[1500:]
        import pyarrow as pa

        batch = pa.RecordBatch.from_pydict({"doc": [1], "tie": [2], "text": [text]})
        got = pa.Table.from_batches(list(suffix._seed_rows(60, 20)(iter([batch])))).to_pylist()
        starts = {x for g in got if g["kind"] == 0 for x in range(g["first"], g["last"] + 1)} | {x for g in got if g["kind"] == 1 for x in range(g["first"], g["last"] + 1)}
        assert starts == set(range(len(text) - 59))
        gone = {x for g in got if g["kind"] == 1 for x in range(g["first"], g["last"] + 1)}
        seen = collections.Counter(text[j : j + 60] for j in range(len(text) - 59))
        assert all(seen[text[x : x + 60]] > 1 for x in gone)


def sorted_suffixes(text, folder, cap=1000):
    disk, got = induced.Disk(str(folder)), []
    held = disk.array(np.int32, len(text))
    held[:] = text
    induced.sort_suffixes(held, disk, cap, lambda p, lcp, _: got.append((p.copy(), lcp.copy())))
    disk.drop(held)
    return np.concatenate([p for p, _ in got])[::-1].tolist(), np.concatenate([x for _, x in got])[::-1].tolist()[:-1]


@pytest.mark.parametrize("batch, frequent, queue", [(1 << 16, 4096, 1 << 20), (8, 3, 100), (16, 0, 1000), (64, 2, 200)])
def test_induced_sorting(tmp_path, monkeypatch, batch, frequent, queue):
    for name, x in (("BATCH", batch), ("FREQUENT", frequent), ("QUEUE_BYTES", queue)):
        monkeypatch.setattr(induced, name, x)
    r = np.random.default_rng(5)
    for n in [0, 1, 2, 3, *r.integers(4, 150, 60).tolist()]:
        text = r.integers(1, r.integers(2, 30), n)
        if n % 3 == 0 and n:
            text = np.tile(text[: max(1, n // 6)], 6)
        b = [*text.tolist(), 0]
        order, lcps = sorted_suffixes(b, tmp_path)
        assert order == sorted(range(len(b)), key=lambda i: b[i:])
        for i, j, c in zip(order, order[1:], lcps):
            k = 0
            while max(i, j) + k < len(b) and b[i + k] == b[j + k]:
                k += 1
            assert k == c
    assert not list(tmp_path.iterdir())


def test_induction_recurses_until_names_are_unique(tmp_path, monkeypatch):
    seen, real = [], induced.sort_suffixes
    monkeypatch.setattr(induced, "sort_suffixes", lambda text, *a: (seen.append(len(text)), real(text, *a))[1])
    r = np.random.default_rng(6)
    part = r.integers(1, 5, 3000)
    sorted_suffixes(np.r_[part, part, r.integers(1, 5, 500), part, 0], tmp_path)
    assert len(seen) > 3 and all(2 * b <= a + 1 for a, b in zip(seen, seen[1:]))


LARGE = """
import resource, sys, tempfile
import numpy as np
sys.path.insert(0, {root!r})
from stratum.llm import induced
induced.QUEUE_BYTES, induced.BATCH = 1 << 18, 1 << 14
n = {n}
with tempfile.TemporaryDirectory() as folder:
    disk = induced.Disk(folder)
    text = disk.array(np.uint16, n + 1)
    r = np.random.default_rng(3)
    for i in range(0, n, 1 << 16):
        text[i : min(i + (1 << 16), n)] = r.integers(1, 9, min(1 << 16, n - i))
    text[n] = 0
    text[n // 2 : n // 2 + 5000] = text[:5000]
    disk.rest(text)
    spilled, real = [0], induced.Tape.add
    def add(self, rows):
        spilled[0] += rows.nbytes
        return real(self, rows)
    induced.Tape.add = add
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    # Memory of the process's own, mapped files apart, may not grow by more than this.
    with open("/proc/self/status") as f:
        own = next(int(x.split()[1]) for x in f if x.startswith("VmData"))
    resource.setrlimit(resource.RLIMIT_DATA, ((own << 10) + (24 << 20), -1))
    marks = induced.repeated(text, 200, disk)
    hits = np.flatnonzero(marks)
    assert (hits == np.r_[0:4801, n // 2 : n // 2 + 4801]).all(), len(hits)
    print(spilled[0] // induced.QUEUE_BYTES)
"""


def test_a_shard_much_larger_than_the_memory(tmp_path):
    """A text of which the tuples alone are hundreds of times the queues' memory, in a process that may take 24 MB for it (mapped files apart)."""
    import subprocess
    import sys
    from pathlib import Path

    code = LARGE.format(root=str(Path(__file__).resolve().parents[2]), n=3_000_000)
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "OPENBLAS_NUM_THREADS": "1", "TMPDIR": str(tmp_path)})
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout) > 100


# ---------------------------------------------------------------- hashes
def thue_morse(n):
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a[:n], b[:n]


@pytest.mark.parametrize("n", [256, 1024, 4096])
def test_words_that_cancel_out_in_polynomial_hashes(spark, n):
    x, y = thue_morse(n)
    plain = [f"w{i}" for i in range(19)]
    pairs = [(1, " ".join([*plain, x])), (2, " ".join([*plain, y])), (3, " ".join([x, "b", "c"])), (4, " ".join([y, "b", "c"])), (5, x), (6, y), (7, x + "q" + y), (8, y + "q" + x)]
    docs = frame(spark, pairs)
    assert {r.doc_id: (r.s_words, r.s_removed, r.s_kept_sha256) for r in substring.dedup(docs, ["doc_id"]).collect()} == plain_substring(pairs)
    assert {r.doc_id: (r.j_shingles, r.j_component) for r in jaccard.join(docs, ["doc_id"]).collect()} == plain_jaccard(pairs, 3, 90, 100)
    items = [(1, x), (2, "b c")]
    got = decontam.report(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == plain_contamination(pairs, items)
    got = suffix.strip(docs, ["doc_id"]).collect()
    assert {r.doc_id: (r.s_bytes, r.s_removed, r.s_spans, r.s_kept_sha256) for r in got} == plain_suffix(pairs, 200)


# ---------------------------------------------------------------- Jaccard join
def shingles(t, size):
    w = re.findall(SPACE, lower(t or ""))
    return {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}


def plain_jaccard(rows, size, num, den):
    sets = {i: shingles(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("size, num, den", [(3, 90, 100), (5, 80, 100), (2, 50, 100), (1, 95, 100)])
def test_jaccard_join(docs, rows, size, num, den, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_GRAMS", 700)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 4)
    got = jaccard.join(docs, ["doc_id", "n"], size=size, num=num, den=den).collect()
    want = plain_jaccard(rows, size, num, den)
    assert {r.doc_id: (r.j_shingles, r.j_component) for r in got} == want and len(got) == len(rows)
    assert all(r.j_first == (r.doc_id == r.j_component) for r in got)


def test_signatures_meet_for_every_similar_pair():
    r = np.random.default_rng(1)
    for _ in range(1500):
        num = int(r.choice([80, 90]))
        n = int(r.integers(2, 120))
        x = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        y = x[r.random(len(x)) < 0.97]
        y = np.unique(np.r_[y, r.integers(0, 1 << 63, int(r.integers(0, 4)), dtype=np.uint64)])
        both = len(np.intersect1d(x, y))
        if not len(y) or 100 * both < num * (len(x) + len(y) - both) or np.array_equal(x, y):
            continue
        for share in (0, 0.3, 0.8, 1):  # whatever is taken for heavy
            heavy = np.sort(np.unique(np.r_[x, y])[r.random(len(np.unique(np.r_[x, y]))) < share])
            sig, which = jaccard.signatures(np.r_[x, y], np.r_[0, len(x), len(x) + len(y)].astype(np.int64), num, 100, heavy)
            assert set(sig[which == 0].tolist()) & set(sig[which == 1].tolist())


@pytest.mark.parametrize("null", [False, True])
def test_jaccard_links_of_ids_with_several_texts(spark, null):
    r = np.random.default_rng(9)
    pairs, want = [], {}
    for g in range(12):  # two versions under one id, twice the first, and two near copies under ids of their own
        base = [f"w{x}" for x in r.integers(0, 1 << 40, 120)]
        shared = None if null else 10 * g
        ids = [shared, shared, 10 * g + 1, 10 * g + 2]
        pairs += [(i, " ".join([*base[:-1], f"end{k}"])) for k, i in enumerate(ids)]
        pairs.append(pairs[-4])
        want |= dict.fromkeys(ids, shared)
    got = jaccard.join(frame(spark, pairs), ["doc_id"], size=5, num=80, den=100).collect()
    assert len(got) == len(pairs) and {r.doc_id: r.j_component for r in got} == want


def plain_roots(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("hubs, edges", [(4, 0), (4096, 0), (4, 50_000)])
def test_components_of_hubs_and_chains(spark, monkeypatch, hubs, edges):
    monkeypatch.setattr(components, "HUBS", hubs)
    monkeypatch.setattr(components, "HUB_EDGES", edges)
    r = np.random.default_rng(3)
    big = 1 << 62  # ids whose sums overflow
    edges = [(big + 5, big + k) for k in range(6, 300)] + [(-big - k, -big - k - 1) for k in range(40)] + [(int(a), int(b)) for a, b in r.integers(0, 80, (60, 2)) if a != b] + [(big + 5, big + 7)] * 3
    found = components.components(spark.createDataFrame([*edges, (9, 9)], "a long, b long"), Scratch(spark, "test"), "c")
    assert {x.node: x.root for x in found.collect()} == plain_roots(edges)
    assert components.components(spark.createDataFrame([(9, 9)], "a long, b long"), Scratch(spark, "test"), "c").count() == 0


def test_jaccard_of_repeated_rows_and_null_ids(spark):
    t = " ".join(map(str, range(60)))
    got = jaccard.join(frame(spark, [(4, t), (4, t), (None, "a b c"), (None, None), (None, "a b c"), (6, t)]), ["doc_id"]).collect()
    assert sorted((str(r.doc_id), r.j_shingles, str(r.j_component)) for r in got) == [("4", 58, "4"), ("4", 58, "4"), ("6", 58, "4"), ("None", 0, "None"), ("None", 1, "None"), ("None", 1, "None")]


def test_first_of_groups_keeps_one_row(spark):
    t, u = " ".join(map(str, range(60))), " ".join(map(str, range(61)))
    got = jaccard.first_of_groups(frame(spark, [(5, t), (5, t), (3, u), (9, None), (8, ""), (None, "alone here")])).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("3", u), ("9", None), ("8", ""), ("None", "alone here")])


# ---------------------------------------------------------------- decontamination
WORD = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def plain_contamination(rows, items, window=13):
    words = lambda t: re.findall(WORD, lower(t or ""))
    grams = collections.defaultdict(set)
    for name, t in items:
        w = words(t)
        n = min(window, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            grams[tuple(w[j : j + n])].add(name)
    out = {}
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in grams:
                    found |= grams[tuple(w[j : j + n])]
                    hit |= set(range(j, j + n))
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("chunk", [4 << 20, 300])
def test_decontamination(spark, docs, rows, chunk, monkeypatch):
    monkeypatch.setattr(decontam, "CHUNK_BYTES", chunk)
    texts = [t for _, t in rows if t and len(t) > 400]
    items = [(k, " ".join(t.split()[5:30])) for k, t in enumerate(texts[::3])] + [(900, "One, TWO"), (901, None), (902, "..."), (903, "a"), (10, "a a a"), (903, "zzz not there")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.report(docs, bench).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == plain_contamination(rows, items)


def test_contamination_of_repeated_rows_and_null_ids(spark):
    bench = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c d"), (None, None)], "item_id long, text string")
    got = decontam.report(frame(spark, [(1, "x a b"), (1, "x a b"), (None, "c d"), (None, None), (2, "A, b. C d")]), bench).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.items) for r in got) == [("1", 3, 2, ["1"]), ("1", 3, 2, ["1"]), ("2", 4, 4, ["1", "null"]), ("None", 0, 0, []), ("None", 2, 2, ["null"])]


def plain_near(rows, items, window, slop):
    """Word ranges near phrases, by the definition: around each place of the rarest term."""
    texts = {i: re.findall(WORD, lower(t or "")) for i, t in rows}
    count = collections.Counter(w for ws in texts.values() for w in ws)
    out = {i: set() for i in texts}
    for _, t in items:
        words = re.findall(WORD, lower(t or ""))
        n = min(window, len(words))
        for phrase in {tuple(words[j : j + n]) for j in range(len(words) - n + 1 if n else 0)}:
            if all(count[w] for w in phrase):
                o = min(range(n), key=lambda k: count[phrase[k]])
                for i, ws in texts.items():
                    for p in (p for p, w in enumerate(ws) if w == phrase[o]):
                        if all(any(0 <= q < len(ws) and ws[q] == w for q in range(p - o + k - slop, p - o + k + slop + 1)) for k, w in enumerate(phrase) if k != o):
                            out[i] |= set(range(max(p - o, 0), min(p - o + n, len(ws))))
    return out


@pytest.mark.parametrize("slop", [1, 3])
def test_proximity_of_a_table(spark, slop):
    r = np.random.default_rng(8)
    pairs = [(i, " ".join(f"w{x}" for x in r.integers(0, 12, r.integers(0, 40)))) for i in range(60)]
    items = [(k, " ".join(f"w{x}" for x in r.integers(0, 13, 5))) for k in range(6)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: {w for a, b in zip(x.starts, x.ends) for w in range(a, b)} for x in decontam.contamination(frame(spark, pairs), bench, window=4, slop=slop).collect()}
    assert got == plain_near(pairs, items, 4, slop) and any(got.values())


def test_proximity():
    a, b, c = np.array([3, 10, 50]), np.array([4, 12, 70]), np.array([5, 13, 52])
    assert decontam.intersect([a, b, c], [0, 1, 2]).tolist() == [3]
    assert decontam.intersect([a, b, c], [0, 1, 2], slop=1).tolist() == [3, 10]
    assert decontam.intersect([b, a], [1, 0], slop=20).tolist() == [3, 11, 69]


# ---------------------------------------------------------------- quality
def plain_measures(t):
    w = re.findall(SPACE, t or "")
    at = collections.defaultdict(list)
    for j in range(len(w) - 2):
        at[tuple(w[j : j + 3])].append(j)
    again = {x for v in at.values() if len(v) > 1 for j in v for x in (j, j + 1, j + 2)}
    lines = [x for x in (t or "").split("\n") if re.search(SPACE, x)]
    n = (len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in t or ""), len(lines) - len(set(lines)), len(again))
    return (*n, n[0] < 50 or 100 * n[4] > 50 * n[0])


def test_quality_base_counts(docs, rows):
    got = quality.judge(docs, ["doc_id"]).collect()
    assert {r.doc_id: (r.q_words, r.q_chars, r.q_symbols, r.q_dup_lines, r.q_repeat, r.q_base_failed) for r in got} == {i: plain_measures(t) for i, t in rows}
    assert not any(r.q_kept for r in got if r.q_base_failed)


HASHES = "".join(f" ##{j}" for j in range(120))


def test_quality_bounds_follow_the_group(spark):
    say = lambda k, extra: " ".join(f"w{(k * 7 + j) % 97}{j}" for j in range(80)) + extra
    plain = [(k, say(k, "")) for k in range(300)]
    noisy = [(1000 + k, say(k, HASHES)) for k in range(300)]
    odd = [(5000, say(1, HASHES))]
    data = [(i, t, "en", s) for s, part in (("plain", plain + odd), ("noisy", noisy)) for i, t in part]
    got = {r.doc_id: r.q_kept for r in quality.judge(spark.createDataFrame(data, "doc_id long, text string, lang string, source string"), ["doc_id"]).collect()}
    assert not got[5000] and all(got[i] for i, _ in plain + noisy)


def test_quality_bounds_stay_below_junk_of_a_group(spark):
    say = lambda k, extra: " ".join(f"w{(k * 7 + j) % 97}{j}" for j in range(80)) + extra
    data = [(k, say(k, HASHES if k % 6 == 0 else ""), "en", "one") for k in range(300)]
    got = {r.doc_id: r.q_kept for r in quality.judge(spark.createDataFrame(data, "doc_id long, text string, lang string, source string"), ["doc_id"]).collect()}
    assert got == {k: k % 6 != 0 for k in range(300)}


def test_quality_word_length_follows_the_quantiles(spark):
    say = lambda k, n: " ".join(f"{(k * 7919 + j * 104729) % 10 ** n:0{n}d}" for j in range(80))
    data = [(k, say(k, 5), "en", "one") for k in range(100)] + [(500, say(3, 7), "en", "one"), (501, say(3, 3), "en", "one")]
    got = {r.doc_id: r.q_kept for r in quality.judge(spark.createDataFrame(data, "doc_id long, text string, lang string, source string"), ["doc_id"]).collect()}
    assert got == {**dict.fromkeys(range(100), True), 500: False, 501: False}


def test_quality_errors_against_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    judged = quality.judge(docs, ["doc_id"]).join(labels, "doc_id").where("not q_base_failed")
    n = {(r.quality, r.q_kept): r["count"] for r in judged.groupBy("quality", "q_kept").count().collect()}
    assert n[0, False] >= 0.9 * (n[0, False] + n.get((0, True), 0)) and n.get((1, False), 0) <= 0.02 * n[1, True]


def plain_verdicts(rows):
    """rows: (text, lang, source). The rule written out: quartiles of bins, drawn towards language and corpus, then bounds."""
    out, groups = [], collections.defaultdict(list)
    for text, lang, source in rows:
        w, chars, symbols, lines, repeat, failed = plain_measures(text)
        m = (symbols * 10**6 // max(chars, 1), lines * 10**7 // max(w, 1), repeat * 10**6 // max(w, 1), chars * 10**6 // max(w, 1))
        out.append((m, failed, lang, source))
        if not failed:
            groups[lang, source].append(m)

    def quartile(values, k):
        ranked = sorted(v >> max(v.bit_length() - 8, 0) << max(v.bit_length() - 8, 0) for v in values)
        return float(ranked[-(-k * len(ranked) // 4) - 1])

    whole, bounds = [m for ms in groups.values() for m in ms], {}
    for (lang, source), own in groups.items():
        tongue = [m for (x, _), ms in groups.items() if x == lang for m in ms]
        for j, (sides, least) in enumerate(quality.MEASURES.values()):
            d = []
            for k in (1, 2, 3):
                g, t, c = (quartile([m[j] for m in ms], k) for ms in (own, tongue, whole))
                d.append((g * len(own) + ((t * len(tongue) + c * 200) / (len(tongue) + 200)) * 200) / (len(own) + 200))
            bounds[lang, source, j] = (d[1] - max((d[1] - d[0]) * 10.0, least) if sides == "both" else -1.0, d[1] + max((d[2] - d[1]) * 10.0, least))
    return [not failed and all(bounds[lang, source, j][0] <= m[j] <= bounds[lang, source, j][1] for j in range(4)) for m, failed, lang, source in out]


def test_quality_verdicts(spark):
    r = np.random.default_rng(5)
    rows = []
    for k in range(260):
        n = int(r.choice([0, 10, 60, 90, 200]))
        words = ["w" * int(x) + str(j) for j, x in enumerate(r.integers(1, 9 if k % 7 else 30, n))]
        text = " ".join(w + "#" * int(r.integers(0, 2 + 4 * (k % 11 == 0))) for w in words) + "\nsame line" * int(r.integers(0, 3 + 40 * (k % 13 == 0)))
        rows.append((text if n else None, ["en", "de", None][k % 3], ["a", None][k % 2]))
    rows += rows[:20]
    data = [(k, *x) for k, x in enumerate(rows)]
    got = {x.doc_id: x.q_kept for x in quality.judge(spark.createDataFrame(data, "doc_id long, text string, lang string, source string").repartition(5), ["doc_id"]).collect()}
    assert [got[k] for k in range(len(rows))] == plain_verdicts(rows) and len(set(got.values())) == 2


def test_quality_is_native(spark, docs):
    plan = quality.judge(docs, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# ---------------------------------------------------------------- empty tables
def test_empty_tables(spark, none):
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    no_bench = bench.where("item_id < 0")
    assert substring.dedup(none, ["doc_id"]).count() == 0 and suffix.strip(none, ["doc_id"]).count() == 0
    assert jaccard.join(none, ["doc_id"]).count() == 0 and jaccard.first_of_groups(none).count() == 0
    assert quality.judge(none, ["doc_id"]).count() == 0 and decontam.report(none, bench).count() == 0
    some = frame(spark, [(1, "one two"), (2, None)])
    assert sorted((r.doc_id, r.n_words, r.n_hit) for r in decontam.report(some, no_bench).collect()) == [(1, 2, 0), (2, 0, 0)]


def test_chance_ties_do_not_multiply_the_texts_to_verify(spark, monkeypatch):
    """Documents of 250 words share passages of 60 with some others each, as in a corpus whose passages are too rare to be heavy."""
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 20)
    monkeypatch.setattr(jaccard, "LOCAL", 1 << 20)  # none is heavy
    sent, save = {}, Scratch.save

    def spy(self, df, name, **options):
        out = save(self, df, name, **options)
        if name in ("units", "classes"):
            sent[name] = out.count()
        return out

    monkeypatch.setattr(Scratch, "save", spy)
    r = np.random.default_rng(5)
    words = lambda n: " ".join(f"w{x}" for x in r.integers(0, 1 << 40, n))
    passages = [words(60) for _ in range(120)]
    pairs = [(i, f"{words(65)} {passages[r.integers(120)]} {passages[r.integers(120)]} {words(65)}") for i in range(600)]
    pairs += [(1000 + i, f"{t} more") for i, t in pairs[:40]]
    got = jaccard.first_of_groups(frame(spark, pairs)).collect()
    assert {x.doc_id for x in got} == {i for i, _ in pairs[:600]}
    assert sent["classes"] == 640 and sent["units"] <= 2 * 640


def test_similar_sets_meet_at_the_larger_ones_level_under_every_order():
    r = np.random.default_rng(2)
    for order in (0, 1, 2, 5):
        for _ in range(300):
            num, n = int(r.choice([80, 90])), int(r.integers(2, 700))
            x = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
            y = np.sort(r.choice(x, max(1, -(-num * len(x) // 100)), replace=False))
            if len(y) == len(x):
                continue
            heavy = np.sort(x[r.random(len(x)) < r.choice([0, 0.3, 0.8, 1])])
            sig, which, own = jaccard.levelled(np.r_[y, x], np.r_[0, len(y), len(x) + len(y)].astype(np.int64), num, 100, heavy, order)
            assert set(sig[which == 0].tolist()) & set(sig[(which == 1) & own].tolist())


def test_substring_passes_free_what_they_have_shuffled(spark, docs, monkeypatch):
    calls, free, save = [], Scratch.free, Scratch.save
    monkeypatch.setattr(Scratch, "free", lambda self: (calls.append("free"), free(self)))
    monkeypatch.setattr(Scratch, "save", lambda self, df, name, **options: (calls.append(name), save(self, df, name, **options))[1])
    substring.dedup(docs, ["doc_id"])
    assert calls == ["met", "free", "gone", "free"]
