"""Cross-entropy difference of documents under two matched n-gram models.

A target model (the documents whose ids are given) and a background model (all documents) have the same vocabulary (that of a
tokenizer file), order (bigrams over the end sign, the tokens and the end sign) and smoothing (unigrams with one added to each count; bigrams
with MASS times the unigram). A document's score is the mean over its tokens, end sign included, of the background loss minus the target loss:
the more it resembles the target, the higher.

Scale: documents are dealt once to blocks of about BLOCK_BYTES. A block sends each of its n-grams once, with its counts, to the
n-gram's partition, where all blocks' counts are summed, and gets the sums back only where they differ from its own. So the
models grow with the corpus, no table of n-grams is broadcast, and a common n-gram has one row for each block, far fewer than a partition's share of all n-grams.
The blocks' shuffle is used by both passes. Rows without an id, and those of an id with more than one in HOT of the rows (there are fewer than HOT such ids, which
are broadcast), are dealt by their texts, so that no block is larger than others because of one id.

Defined results: a null or empty text has only its end sign; ids that occur several times are scored row by row and are target documents together; a null id
is never a target; without target documents the target model is uniform; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import long_id, slices
from .orctokens import pieces

BLOCK_BYTES = 4 << 20  # a worker holds about 50 times as much
PARTITIONS = 20_000  # at most; then a partition has several blocks, one after another
MASS = 2.0
HOT = 4096
UNIGRAM = np.int64(0xFFFFFFFF)  # in place of a second token
TOTAL = np.int64(-1)

GRAMS = pa.schema([("blk", pa.int32()), ("g", pa.int64()), ("c_all", pa.int64()), ("c_target", pa.int64())])


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their numbers."""
    ranked = np.sort(keys)
    head = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return ranked[head], np.diff(np.r_[head, len(keys)])


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, a, b = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.argsort(keys, kind="stable")
    keys, a, b = keys[order], a[order], b[order]
    head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return (keys[head], np.add.reduceat(a, head), np.add.reduceat(b, head)) if len(head) else (keys, a, b)


class Sequences:
    """Texts of a block as bigram keys."""

    def __init__(self, tokenizer: str):
        self.coder = pieces(tokenizer)
        self.size = self.coder.library.get_vocab_size()

    def bigrams(self, body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all bigrams of the texts, and the number of each text's."""
        ids, n = self.coder.encode_block(body, at)
        edge = np.cumsum(n)
        second = np.insert(ids, edge, self.size).astype(np.int64)  # the end sign is one more than the vocabulary
        first = np.insert(ids, edge - n, self.size).astype(np.int64)
        return (first << np.int64(32)) | second, n + 1


def _block_counts(seq: Sequences, table: pa.RecordBatch, targets: np.ndarray, sequences: list | None = None):
    """Bigrams of a block with their numbers in all and in target documents; `sequences` gets the ids and bigrams of its texts."""
    parts = []
    for part, body, at in slices([table], "text"):
        keys, n = seq.bigrams(body, at)
        ids = part.column(part.schema.get_field_index("doc"))
        every, count = _counted(keys)
        parts.append((every, count, np.zeros_like(count)))
        chosen = np.isin(ids.to_numpy(zero_copy_only=False), targets) | part.column(part.schema.get_field_index("chosen")).to_numpy(zero_copy_only=False)
        if chosen.any():
            some, count = _counted(keys[np.repeat(chosen, n)])
            parts.append((some, np.zeros_like(count), count))
        if sequences is not None:
            sequences.append((ids, keys, n))
    return _merged(parts) if parts else (np.zeros(0, np.int64),) * 3


def _with_unigrams(keys, a, b):
    """Bigrams, the unigrams that follow from them, and the totals."""
    u, ua, ub = _merged([(keys >> np.int64(32), a, b)])
    return np.r_[keys, (u << np.int64(32)) | UNIGRAM, TOTAL], np.r_[a, ua, a.sum()], np.r_[b, ub, b.sum()]


def score(docs: DataFrame, targets: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", target_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, loss_background, loss_target, score for each row of docs. targets: ids of the target documents."""
    total, n_rows = docs.agg(F.sum(F.octet_length(F.col(text))), F.count(F.lit(1))).first()
    total = total or 0
    blocks = max(8, -(-int(total) // BLOCK_BYTES))
    parts = min(blocks, PARTITIONS)
    none = F.lit(None)
    deal = lambda *c: F.pmod(F.xxhash64(*c), F.lit(blocks)).cast("int")
    ids = docs.select(long_id(docs, doc_id).alias("doc"), F.col(text).alias("text"))
    wanted = targets.select(long_id(targets, target_id).alias("doc")).where("doc is not null")
    # Ids of many rows, and whether they are targets: fewer than HOT rows.
    hot = ids.where("doc is not null").groupBy("doc").count().where(F.col("count") > 1 + n_rows / HOT).select("doc")
    hot = hot.join(wanted.distinct().withColumn("is_target", F.lit(True)), "doc", "left").select(F.col("doc").alias("hot"), F.coalesce("is_target", F.lit(False)).alias("hot_target"))
    rows = ids.join(F.broadcast(hot), F.col("doc") == F.col("hot"), "left")
    rows = rows.select("doc", "text", F.lit(False).alias("mark"), F.coalesce("hot_target", F.lit(False)).alias("chosen"), F.when(F.col("doc").isNull() | F.col("hot").isNotNull(), deal("text")).otherwise(deal("doc")).alias("blk"))
    marks = wanted.select("doc", none.cast("string").alias("text"), F.lit(True).alias("mark"), F.lit(False).alias("chosen"), deal("doc").alias("blk"))
    dealt = rows.union(marks).repartitionById(parts, F.col("blk"))  # as even as the blocks

    def is_target(table: pa.Table) -> tuple[pa.RecordBatch, np.ndarray]:
        one = table.combine_chunks()
        mark = one.column("mark").to_numpy(zero_copy_only=False).astype(bool)
        texts = one.filter(pa.array(~mark)).select(["doc", "text", "chosen"]).combine_chunks()
        batches = texts.to_batches()
        batch = batches[0] if batches else pa.RecordBatch.from_pydict({"doc": pa.array([], pa.int64()), "text": pa.array([], pa.string()), "chosen": pa.array([], pa.bool_())})
        return batch, one.filter(pa.array(mark)).column("doc").to_numpy()

    def count(key, table):
        batch, marked = is_target(table)
        keys, a, b = _with_unigrams(*_block_counts(Sequences(tokenizer), batch, marked))
        return pa.Table.from_arrays([pa.array(np.full(len(keys), key[0].as_py(), np.int32)), pa.array(keys), pa.array(a), pa.array(b)], schema=GRAMS)

    def judge(key, table, sums):
        seq = Sequences(tokenizer)
        batch, marked = is_target(table)
        sequences: list = []
        keys, a, b = _with_unigrams(*_block_counts(seq, batch, marked, sequences))
        order = np.argsort(keys)
        keys, a, b = keys[order], a[order].copy(), b[order].copy()
        place = np.searchsorted(keys, sums.column("g").to_numpy())
        a[place], b[place] = sums.column("t_all").to_numpy(), sums.column("t_target").to_numpy()
        size, out = seq.size + 1, {n: [] for n in ("doc", "n", "background", "target")}
        for ids, grams, n in sequences:
            out["doc"].append(np.array(ids.to_pylist(), object) if ids.null_count else ids.to_numpy(zero_copy_only=False))
            out["n"].append(n)
            distinct, which = np.unique(grams, return_inverse=True)
            own, before = np.searchsorted(keys, distinct), np.searchsorted(keys, (distinct & ~UNIGRAM) | UNIGRAM)
            after = np.searchsorted(keys, ((distinct & UNIGRAM) << np.int64(32)) | UNIGRAM)
            edge = np.cumsum(n) - n
            for name, c in (("background", a), ("target", b)):
                one = (c[after] + 1.0) / (float(c[np.searchsorted(keys, TOTAL)]) + size)
                loss = -np.log((c[own] + MASS * one) / (c[before] + MASS))
                out[name].append(np.add.reduceat(loss[which], edge) / n)
        cat = lambda x, t: pa.array([v for y in x for v in y.tolist()], t)
        return pa.Table.from_arrays([cat(out["doc"], pa.int64()), cat(out["n"], pa.int64()), cat(out["background"], pa.float64()), cat(out["target"], pa.float64())], names=["doc_id", "n_tokens", "loss_background", "loss_target"])

    grams = dealt.groupBy("blk").applyInArrow(count, "blk int, g long, c_all long, c_target long")
    by = W.partitionBy("g")
    sums = grams.select("blk", "g", "c_all", "c_target", F.sum("c_all").over(by).alias("t_all"), F.sum("c_target").over(by).alias("t_target"))
    sums = sums.where("t_all <> c_all or t_target <> c_target").select("blk", "g", "t_all", "t_target").repartitionById(parts, F.col("blk"))
    judged = dealt.groupBy("blk").cogroup(sums.groupBy("blk")).applyInArrow(judge, "doc_id long, n_tokens long, loss_background double, loss_target double")
    return judged.withColumn("score", F.col("loss_background") - F.col("loss_target"))
