"""Exact Jaccard join of documents on word n-grams by vertical partitioning.

The n-grams of all documents have one global order (that of their hashes), which is cut into F fragments. Two sets whose
Jaccard similarity reaches the threshold differ in at most d elements, so with F > d at least one fragment of both is equal:
documents meet on equal fragments (F grows with the size of the set in steps of about 1.4, so that it is little over d and fragments are long; a set
near a step takes part in the next one too, to meet larger sets only). Each run of meeting sets is tied to its first one, and the ties' connected components
bound the verification. There the overlaps are counted fragment by fragment, each on its own, and summed for each pair.

N-grams of passages that many documents share would tie documents that are not similar. So the fragments leave out the heavy n-grams (those
in LOCAL of the documents that a task gathers at once, at most HEAVY of them, one fixed set for the run): what is left of two similar sets differs in at most d
elements too. The argument needs an equal fragment that is not empty; a set with too few filled fragments for that sends the fragments of
its whole set as well, and where even these are too few, its prefix in the global order, heavy n-grams last (two such sets share an element of it). So
the result does not depend on which n-grams are heavy.

Scale: identical sets are one class from the start. The fragments' rows are about a sixth of the n-grams at 0.9 (a half at 0.8), equal
rows of a block collapsed. No pairs are emitted: a run of any length is passed in constant memory. A component is verified in
blocks of about BLOCK_GRAMS n-grams and BLOCK_SETS sets, each pair of blocks a unit of its own, which emits a spanning forest of the true links. A set is sent once
for each block of its component, so chance ties (documents that share a passage, which shares a fragment now and then) must not grow into components
of the whole corpus: sets of components of several blocks meet again, each with those of its component, under other global orders of the n-grams. Similar sets meet
under every order, others only by chance. The heavy n-grams are the only thing sent to the executors, 8 bytes each.

Defined results: null and empty texts have an empty set and no links, and are components of their own; rows with equal ids are one node, which has the links of
all of them; a null id is the least; other columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, Scratch, buffers, mix, signed, slices, window_hashes, word_hashes, word_spans
from .components import components
from .runs import first_of_run, map_runs
from .substring import keyed

BLOCK_GRAMS, BLOCK_SETS = 600_000, 500
LOCAL, GATHER = 3, 4_000_000  # documents that share an n-gram, among those that a task gathers at once: so many n-grams
HEAVY = 500_000
ORDERS, LESS = 6, 0.75  # times that sets of large components meet again at most, and while that leaves less than this share of the copies to send
COLUMNS = 2048  # n-grams whose overlaps are counted at once
FRAGMENTS = np.ceil(2.0 ** (np.arange(4, 61) / 2)).astype(np.int64)
_SECOND = np.uint64(0xA0761D6478BD642F)
_PREFIX = np.uint64(0xE7037ED1A0B428DB)
_WHOLE = np.uint64(1 << 62)
_ORDER = 0x8EBC6AF09C88C6E3


def grams_of(body: np.ndarray, at: np.ndarray, size: int, other: bool = False) -> tuple[np.ndarray, ...]:
    """Sets of the texts of a block: hashes, sorted and distinct for each text, and the offsets of the texts; with `other`, also independent hashes of the same n-grams."""
    starts, ends, doc_words = word_spans(body, at, SPACE)
    words = word_hashes(body, starts, ends, 5, *([6] if other else []), lower=True)
    n = np.diff(doc_words)
    whole = n >= size
    count = np.where(whole, n - size + 1, np.minimum(n, 1))
    edge = np.r_[0, np.cumsum(count)]
    doc = np.repeat(np.arange(len(n)), count)
    first = np.arange(edge[-1]) - edge[doc] + doc_words[doc]
    grams = []
    for seed, values in enumerate(words, 5):
        made = np.empty(len(doc), np.uint64)
        for k in range(1, size + 1):  # texts of fewer words are one n-gram
            these = np.flatnonzero(whole[doc]) if k == size else np.flatnonzero(n[doc] == k)
            if len(these):
                made[these] = window_hashes(values, k, seed)[first[these]]
        grams.append(made)
    order = None
    if other:
        order = np.lexsort((grams[0], doc))
        grams = [g[order] for g in grams]
    else:
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if b - a > 1:
                grams[0][a:b].sort()
    keep = np.r_[True, (grams[0][1:] != grams[0][:-1]) | (doc[1:] != doc[:-1])][: len(doc)]
    offsets = np.r_[0, np.cumsum(np.bincount(doc[keep], minlength=len(n)))].astype(np.int64)
    return grams[0][keep], offsets, *(g[keep] for g in grams[1:])


def level_for(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """The level of pairs whose larger set has n elements: at level k a set is cut into FRAGMENTS[k - 1], which leaves some more equal fragments than
    the greatest difference d needs, so that a few empty ones do no harm; 0 where only equal sets are similar."""
    d = (den - num) * 2 * n // (den + num)
    return np.where(d > 0, np.searchsorted(FRAGMENTS, d + 1 + np.maximum(2, d // 8)) + 1, 0)


def set_key(grams: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    n = np.diff(edge)
    sums = np.zeros(len(n), np.uint64)
    if len(grams):
        some = np.flatnonzero(n)
        sums[some] = np.add.reduceat(mix(grams ^ _SECOND), edge[some])
    return mix(sums ^ n.astype(np.uint64))


def _fragments(grams: np.ndarray, doc: np.ndarray, level: np.ndarray, salt: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """(signature, set) of the filled fragments; grams sorted within each set."""
    if not len(grams):
        return grams, doc
    fragment = (grams >> np.uint64(32)) * FRAGMENTS[level - 1].astype(np.uint64)[doc] >> np.uint64(32)
    head = np.flatnonzero(np.r_[True, (fragment[1:] != fragment[:-1]) | (doc[1:] != doc[:-1])])
    d = doc[head]
    return mix(np.add.reduceat(mix(grams), head) ^ mix((fragment[head] + (level[d].astype(np.uint64) << np.uint64(40))) ^ salt)), d


def signatures(grams: np.ndarray, edge: np.ndarray, num: int, den: int, heavy: np.ndarray | None = None, order: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(signature, number of the set): two sets of the block or of any other that reach num/den share a signature, if they are not equal.

    heavy: sorted n-grams to leave out where that is safe; order: number of the global order of the n-grams.
    """
    return levelled(grams, edge, num, den, heavy, order)[:2]


def levelled(grams: np.ndarray, edge: np.ndarray, num: int, den: int, heavy: np.ndarray | None = None, order: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """signatures(), and whether each is of the set's own level: that of the larger set is, where two similar sets share a signature."""
    n = np.diff(edge)
    own, most = level_for(n, num, den), level_for(n * den // num, num, den)
    doc = np.repeat(np.arange(len(n)), n)
    light = np.ones(len(grams), bool)
    if heavy is not None and len(heavy):
        light = heavy[np.minimum(np.searchsorted(heavy, grams), len(heavy) - 1)] != grams
    if order:
        grams = mix(grams + np.uint64(order * _ORDER & (1 << 64) - 1))
        by = np.lexsort((grams, doc))
        grams, light = grams[by], light[by]
    sigs, sets, owns = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    for step in range(int((most - own).max()) + 1 if len(n) else 0):
        level = own + step
        left = (level <= most) & (level > 0) & (n > 0)
        # Two sets of this number of fragments differ in so many at most; as many empty ones, and one more, may be equal without meaning it.
        differ = np.minimum((den - num) * (n + n * den // num) // (den + num), FRAGMENTS[np.maximum(level, 1) - 1] - 3)
        for salt, part in ((np.uint64(0), light), (_WHOLE, None)):
            at = np.flatnonzero(left[doc] if part is None else left[doc] & part)
            sig, which = _fragments(grams[at], doc[at], level, salt)
            sigs.append(sig)
            sets.append(which)
            left = left & (np.bincount(which, minlength=len(n)) <= differ)
        weak = np.flatnonzero(left)
        if len(weak):
            size = n[weak] - -(-num * n[weak] // den) + 1
            at = np.flatnonzero(left[doc])
            at = at[np.lexsort((~light[at], doc[at]))]  # the global order for prefixes has the heavy n-grams last
            skip = np.cumsum(n[weak]) - n[weak]
            place = at[np.repeat(skip, size) + np.arange(size.sum()) - np.repeat(np.r_[0, np.cumsum(size)[:-1]], size)]
            sigs.append(mix(grams[place] ^ _PREFIX))
            sets.append(np.repeat(weak, size))
        owns.append(np.full(sum(map(len, sigs)) - sum(map(len, owns)), step == 0))
    return np.concatenate(sigs), np.concatenate(sets), np.concatenate(owns)


SETS = pa.schema([("doc", pa.int64()), ("tie", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
SIGS = pa.schema([("sig", pa.int64()), ("a", pa.int64())])
EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _often(grams: np.ndarray) -> np.ndarray:
    """What LOCAL of the sets have that these n-grams come from. Sorts in place."""
    grams.sort()
    if len(grams) < LOCAL:
        return grams[:0]
    first = grams[: len(grams) - LOCAL + 1]
    return np.unique(first[first == grams[LOCAL - 1 :]])


def _sets(size: int):
    """One row for each text, and (n = -1) one for each n-gram that LOCAL of the texts gathered together have."""

    def run(batches):
        held, n_held = np.empty(0, np.uint64), 0
        for part, body, at in slices(batches, "text"):
            grams, edge, others = grams_of(body, at, size, other=True)
            a, b = set_key(grams, edge), set_key(others, edge)
            yield {"doc": part.column(0), "tie": part.column(1), "n": np.diff(edge), "a": signed(a), "b": signed(b)}
            if n_held and n_held + len(grams) > GATHER:
                yield _marks(_often(held[:n_held]))
                n_held = 0
            if n_held + len(grams) > len(held):
                more = np.empty(max(GATHER, len(grams)), np.uint64)
                more[:n_held] = held[:n_held]
                held = more
            held[n_held : n_held + len(grams)] = grams
            n_held += len(grams)
        if n_held:
            yield _marks(_often(held[:n_held]))

    return map_runs(run, SETS)


def _marks(often: np.ndarray) -> dict[str, np.ndarray]:
    none = np.zeros(len(often), np.int64)
    return {"doc": none, "tie": none, "n": none - 1, "a": signed(often), "b": none}


def _signatures(size: int, num: int, den: int, heavy: np.ndarray, order: int = 0):
    """(text), or with an order (text, root) -> signatures, those of a root apart from others'; even where they are of the set's own level."""

    def run(batches):
        for part, body, at in slices(batches, "text"):
            grams, edge = grams_of(body, at, size)
            a = set_key(grams, edge)
            _, one = np.unique(a, return_index=True)  # one of each class of the block
            keep = np.zeros(len(a), bool)
            keep[one] = True
            sig, which, own = levelled(grams, edge, num, den, heavy, order)
            if order:
                root = part.column(part.schema.get_field_index("root")).to_numpy().view(np.uint64)
                sig = mix(sig ^ mix(root + np.uint64(_ORDER))[which])
            sig = sig & ~np.uint64(1) | (~own).astype(np.uint64)
            keep = keep[which]
            yield {"sig": signed(sig[keep]), "a": signed(a[which[keep]])}

    return map_runs(run, SIGS)


def _own_runs(batches):
    """The runs of rows (signature, member) that begin with a member of that level: others have no larger set of a similar pair. Without the mark of the level."""
    last, good = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        sig, member = (c.to_numpy() for c in batch.columns[:2])
        key = sig >> 1
        start = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], np.arange(len(key)), 0))
        fine = sig[start] & 1 == 0
        if last is not None and key[0] == last:
            fine[start == 0] = good
        last, good = key[-1], bool(fine[-1])
        if fine.any():
            yield pa.RecordBatch.from_arrays([pa.array(key[fine]), pa.array(member[fine])], ["sig", "a"])


def _meet(batches):
    """Ties every member of a run of equal signatures to the run's first."""
    for _, member, lead in first_of_run(_own_runs(batches)):
        other = member != lead
        pairs = np.unique(np.stack([lead[other], member[other]], 1), axis=0)
        yield {"a": pairs[:, 0], "b": pairs[:, 1]}


def overlaps(grams: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all sets with each other: partial counts of each fragment of the global order, summed."""
    m = len(edge) - 1
    doc = np.repeat(np.arange(m), np.diff(edge))
    order = np.argsort(grams, kind="stable")
    ranked, who = grams[order], doc[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1  # an n-gram of one set adds nothing
    who, column = who[shared], column[shared]
    column = np.unique(column, return_inverse=True)[1]
    total = np.zeros((m, m))  # whole numbers up to 2 ** 53
    cut = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + COLUMNS + 1, COLUMNS))
    for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
        part = np.zeros((m, COLUMNS), np.float32)
        part[who[a:b], column[a:b] - i * COLUMNS] = 1
        total += part @ part.T
    return total


def forest(grams: np.ndarray, edge: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (set, first set of its component) by the links among these sets."""
    both = overlaps(grams, edge)
    n = np.diff(edge)
    link = np.empty(both.shape, bool)
    for i in range(0, len(n), 256):  # whole numbers, a few rows at a time
        part = both[i : i + 256].astype(np.int64)
        link[i : i + 256] = den * part >= num * (n[i : i + 256, None] + n[None, :] - part)
    del both
    np.fill_diagonal(link, True)
    label = np.arange(len(n))
    while True:
        new = np.concatenate([np.where(link[i : i + 256], label[None, :], len(n)).min(1) for i in range(0, len(n), 256)])
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(n)))
    return moved, label[moved]


def _verify(size: int, num: int, den: int):
    """Rows (unit, doc, tie, text) sorted by unit, doc and tie: the spanning forest of each unit, as document ids."""

    def unit(rows: list[pa.RecordBatch]):
        one = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        grams, edge = grams_of(*buffers(one.column(3)), size)
        doc = one.column(1).to_numpy()
        x, y = forest(grams, edge, num, den)
        return {"a": doc[x], "b": doc[y]}

    def run(batches):
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            # Rows that repeat id and text are one set of the unit; they may be any number.
            key, doc, tie = (batch.column(i).to_numpy() for i in range(3))
            new = np.r_[last != (key[0], doc[0], tie[0]), (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])]
            last = key[-1], doc[-1], tie[-1]
            if not new.all():
                batch, key = batch.filter(pa.array(new)), key[new]
            if not batch.num_rows:
                continue
            cut = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                if held and held[-1].column(0)[0].as_py() != int(key[i]):
                    yield unit(held)
                    held = []
                held.append(batch.slice(i, j - i))
        if held:
            yield unit(held)

    return map_runs(run, EDGES)


def clusters(docs: DataFrame, scratch: Scratch, size: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc, tie, n (size of the set), root (least id reachable by links). docs: doc, tie, text."""
    spark = docs.sparkSession
    scanned = scratch.save(docs.mapInArrow(_sets(size), "doc long, tie long, n long, a long, b long"), "scanned")
    sets = scratch.save(scanned.where("n >= 0").distinct(), "sets")
    often = scanned.where("n < 0").groupBy("a").agg(F.count(F.lit(1)).alias("blocks")).orderBy(F.desc("blocks"), "a").limit(HEAVY)
    heavy = np.sort(np.array([r[0] for r in often.select("a").collect()], np.int64).view(np.uint64))
    # An id may have several texts, so the representative of a class is an id and the tie of its text.
    classes = sets.where("n > 0").groupBy("n", "a", "b").agg(F.min(F.struct("doc", "tie")).alias("least")).select("n", "a", "b", F.col("least.doc").alias("rep"), F.col("least.tie").alias("rep_tie"))
    classes = scratch.save(classes, "classes")  # a plain table, so that Spark can split the rows of a class of many copies when they join it

    def met(texts: DataFrame, name: str, order: int = 0) -> DataFrame:
        sigs = texts.mapInArrow(_signatures(size, num, den, heavy, order), "sig long, a long")
        ties = sigs.repartition(F.shiftright("sig", 1)).sortWithinPartitions("sig", "a").mapInArrow(map_runs(_meet, EDGES), "a long, b long")
        return components(ties, scratch, name)

    def loads(member: DataFrame) -> DataFrame:
        return member.groupBy("root").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_GRAMS), F.ceil(F.count(F.lit(1)) / BLOCK_SETS)).cast("int").alias("blocks"), F.count(F.lit(1)).alias("m")).where("m > 1")

    near = met(docs, "near")
    scratch.free()
    cols = ["rep", "rep_tie", "a", "n", "root"]
    member = scratch.save(classes.join(near, classes["a"] == near["node"]).select(*cols), "member")
    wanted = member.select("rep", "rep_tie", "a")
    held = scratch.save(wanted.hint("merge").join(docs, (wanted["rep"] == docs["doc"]) & (wanted["rep_tie"] == docs["tie"])).select("rep", "rep_tie", "a", "text"), "texts")
    scratch.free()
    sent, order = None, 0
    while order < ORDERS:
        large = loads(member).where("blocks > 1").select("root", "blocks", "m")
        now = large.agg(F.sum(F.col("m") * F.col("blocks"))).first()[0] or 0
        if not now or (sent is not None and now > LESS * sent):
            break
        sent, order = now, order + 1
        among = member.join(large.select("root"), "root", "left_semi").select(*cols)
        found = met(held.join(among.select("rep", "rep_tie", "root"), ["rep", "rep_tie"]).select("text", "root"), f"near{order}-", order).withColumnRenamed("root", "to")
        finer = among.join(found, among["a"] == found["node"]).select("rep", "rep_tie", "a", "n", F.col("to").alias("root"))
        member = scratch.save(member.join(large.select("root"), "root", "left_anti").select(*cols).union(finer), f"member{order}")
        scratch.free()

    member = member.join(loads(member), "root").withColumn("block", F.pmod(F.xxhash64("rep", "rep_tie"), F.col("blocks")).cast("int"))
    # Each block meets every block of its component, itself included: unit (least, greatest).
    units = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("rep", "rep_tie", F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other")).alias("unit"))
    units = scratch.save(units, "units")
    texts = units.join(held, ["rep", "rep_tie"]).select("unit", "rep", "rep_tie", "text")
    links = texts.repartition("unit").sortWithinPartitions("unit", "rep", "rep_tie").mapInArrow(_verify(size, num, den), "a long, b long")
    # Copies join their class by its least id.
    copies = sets.where("n > 0").join(classes.withColumnsRenamed({"n": "cn", "a": "ca", "b": "cb"}), (F.col("n") == F.col("cn")) & (F.col("a") == F.col("ca")) & (F.col("b") == F.col("cb"))).where("doc <> rep").select(F.col("rep").alias("a"), F.col("doc").alias("b"))
    linked = components(links.union(copies), scratch, "linked")
    del texts, links, copies
    scratch.free()
    return sets.join(linked, sets["doc"] == linked["node"], "left").groupBy("doc", "tie").agg(F.max("n").alias("n"), F.min(F.coalesce("root", "doc")).alias("root"))


def _known(docs: DataFrame, doc_id: str, text: str, size: int, num: int, den: int) -> DataFrame:
    """doc, tie, n, root, is_first."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    found = scratch.save(clusters(keyed(docs, doc_id, text), scratch, size, num, den), "found")
    scratch.only("found")
    # The first row of a component is found by its own key, so a component of any size is no hot key.
    lead = found.where("n > 0").groupBy("root").agg(F.min(F.struct("doc", "tie")).alias("lead")).select(F.col("lead.doc").alias("doc"), F.col("lead.tie").alias("tie"), F.lit(True).alias("leads"))
    return found.join(lead, ["doc", "tie"], "left").select("doc", "tie", "n", "root", ((F.col("n") == 0) | F.coalesce("leads", F.lit(False))).alias("is_first"))


def join(docs: DataFrame, keep: list[str], doc_id: str = "doc_id", text: str = "text", size: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """`keep`, j_shingles, j_component and j_first (this row stands for its component) for each row."""
    rows = keyed(docs, doc_id, text, keep).drop("text").join(_known(docs, doc_id, text, size, num, den), ["doc", "tie"])
    root = F.when(F.col("root") == -(1 << 63), None).otherwise(F.col("root"))
    return rows.select(*[F.col(f"s_keep{i}").alias(c) for i, c in enumerate(keep)], F.col("n").alias("j_shingles"), root.alias("j_component"), F.col("is_first").alias("j_first"))


def first_of_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs, one for each component; of repeated rows one stays. Documents without words all stay."""
    names = [f"s_keep{i}" for i in range(len(docs.columns))]
    rows = keyed(docs, doc_id, text, docs.columns).drop("text").join(_known(docs, doc_id, text, size, num, den), ["doc", "tie"]).where("is_first")
    once = rows.withColumn("copy", F.row_number().over(W.partitionBy("doc", "tie").orderBy("root"))).where("copy = 1 or n = 0")
    return once.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
