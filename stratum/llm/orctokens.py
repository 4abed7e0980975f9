"""Token ids in ORC files: ascending document ids, integer run-length encoding, row indexes and Bloom filters.

Texts are dealt by ranges of the document id (and a hash of the text, so that an id of many rows is no range of its own), about RANGE_BYTES each,
sorted within each range, encoded and written, one file for each range.
Each row has the ids of one document (end id appended) and their place within its range; the table of
ranges, one row for each file, gives the place of the range. It is stored beside the files, and Spark broadcasts it only if it is small enough. Readers work stripe by stripe, and a filter on the id is
answered from stripe statistics, row indexes and Bloom filters.

Defined results: a null or empty text is only the end id; rows with a null document id come first; rows with equal ids keep their
own entries, in the order of a hash of their texts; an empty table gives an empty set of files.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import long_id, slices
from .pieces import PieceTable, spread

RANGE_BYTES = 64 << 20
STRIPE_BYTES = 32 << 20
ROW_INDEX_STRIDE = 2000
BLOCK_BYTES = 2 << 20
CACHE_PIECES = 1_000_000
#: Fixed values of the byte-level splitting pattern: the endings that an apostrophe at the start of a piece takes with it.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]
#: Code points whose class all pattern libraries agree on; texts with others are left to the library as a whole.
USUAL = r"[\x00-\x1B\x20-\u024F\u0391-\u03C9\u0410-\u044F\u2010-\u2027]"
LETTER, NUMBER, SPACE_, OTHER, UNUSUAL = range(5)


class BytePieces:
    """Encodes with a byte-level file of the tokenizers library. Texts are cut into the library's own pieces, a block at a time;
    the library encodes each new piece once, and a bounded table keeps its ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        import tokenizers

        self.library = tokenizers.Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        every = "".join(map(chr, range(0x2100)))
        self.classes = np.full(0x110000, UNUSUAL, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE_, r"\s"), (OTHER, r"[^\s\p{L}\p{N}]")):
            hits = np.array([m.start() for m in regex.finditer(pattern, every)])
            self.classes[hits] = kind
        usual = np.zeros(0x110000, bool)
        usual[[m.start() for m in regex.finditer(USUAL, every)]] = True
        self.classes[~usual] = UNUSUAL
        self.line = self.library.encode("\n", add_special_tokens=False).ids
        self.table = PieceTable(CACHE_PIECES)

    def starts(self, code: np.ndarray, cls: np.ndarray, head: np.ndarray) -> np.ndarray:
        """Where pieces start. head: where texts start (one more place at the end)."""
        n = len(code)
        first = head[:n]
        space, blank = cls == SPACE_, code == 0x20
        before, after = np.r_[False, space[:-1]] & ~first, np.r_[space[1:], True] | head[1:]
        change = np.r_[True, cls[1:] != cls[:-1]] | first
        begin = np.where(space, change | (before & ~after), change & ~(np.r_[False, blank[:-1]] & ~first))
        # An apostrophe that starts a piece may end with its ending, within a run of letters.
        tick = np.flatnonzero((code == 0x27) & begin)
        if len(tick):
            follow = np.full(n + 4, 0, code.dtype)
            follow[:n] = code
            ends = np.r_[head, True, True, True]
            done = np.zeros(len(tick), bool)
            for e in ENDINGS:
                fits = ~done
                for k, ch in enumerate(e, 1):
                    fits &= (follow[tick + k] == ord(ch)) & ~ends[np.minimum(tick + k, n)] & (tick + k < n)
                hit = tick[fits]
                begin[hit + 1] = False
                rest = hit + 1 + len(e)
                rest = rest[rest < n]
                begin[rest[cls[rest] != SPACE_]] = True
                done |= fits
        return np.flatnonzero(begin)

    def encode_pieces(self, pieces: list[str], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """plain: pieces without white space but for a blank before a character; between line ends these stay pieces of their own."""
        size, parts = np.zeros(len(pieces), np.int64), []
        order = np.r_[np.flatnonzero(plain), np.flatnonzero(~plain)]
        n = int(plain.sum())
        if n:
            whole = np.array(self.library.encode("\n".join([pieces[i] for i in order[:n].tolist()]), add_special_tokens=False).ids, np.int32)
            line = np.flatnonzero(whole == self.line[0])
            if len(line) == n - 1 and len(self.line) == 1:
                size[order[:n]] = np.diff(np.r_[-1, line, len(whole)]) - 1
                parts.append(np.delete(whole, line))
            else:
                n = 0
        rest = [np.array(e.ids, np.int32) for e in self.library.encode_batch_fast([pieces[i] for i in order[n:].tolist()], add_special_tokens=False)]
        size[order[n:]] = np.fromiter(map(len, rest), np.int64, len(rest))
        ids = np.concatenate([np.zeros(0, np.int32), *parts, *rest])
        at = np.empty(len(pieces), np.int64)
        at[order] = np.cumsum(size[order]) - size[order]
        return ids[spread(at, size)], size

    def encode_block(self, body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a block, one after another, and the number of each."""
        text = body.tobytes().decode()
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        n_docs = len(at) - 1
        if not len(code):
            return np.zeros(0, np.int32), np.zeros(n_docs, np.int64)
        place = np.r_[0, np.cumsum((body & 0xC0) != 0x80)][at]  # of the texts, in code points
        head = np.zeros(len(code) + 1, bool)
        head[place] = True
        cls = self.classes[code]
        odd = np.zeros(n_docs, bool)
        if (cls == UNUSUAL).any():
            odd[np.searchsorted(place, np.flatnonzero(cls == UNUSUAL), "right") - 1] = True
        if any(t in text for t in self.special):
            for i in range(n_docs):
                odd[i] |= any(t in text[place[i] : place[i + 1]] for t in self.special)
        start = self.starts(code, cls, head)
        end = np.r_[start[1:], len(code)]
        doc = np.searchsorted(place, start, "right") - 1
        keep = ~odd[doc]
        start, end, doc = start[keep], end[keep], doc[keep]
        byte_at = np.r_[np.flatnonzero((body & 0xC0) != 0x80), len(body)]  # of the code points

        def make(low, high):
            x, y = np.searchsorted(byte_at, low), np.searchsorted(byte_at, high)
            blanks = np.r_[0, np.cumsum(cls == SPACE_)]
            plain = (blanks[y] == blanks[x + 1]) & ((cls[x] != SPACE_) | ((code[x] == 0x20) & (y > x + 1)))
            return self.encode_pieces([text[i:j] for i, j in zip(x.tolist(), y.tolist(), strict=True)], plain)

        ids, size = self.table.look_up(body, byte_at[start], byte_at[end], make)
        count = np.bincount(doc, size, n_docs).astype(np.int64)
        if odd.any():
            parts = np.split(ids, np.cumsum(count)[:-1])
            for i in np.flatnonzero(odd).tolist():
                parts[i] = np.array(self.library.encode(text[place[i] : place[i + 1]], add_special_tokens=False).ids, np.int32)
                count[i] = len(parts[i])
            ids = np.concatenate(parts)
        return ids, count


_PIECES: dict[str, BytePieces] = {}


def pieces(path: str) -> BytePieces:
    if path not in _PIECES:
        _PIECES[path] = BytePieces(path)
    return _PIECES[path]


STORED = "doc_id long, part int, place long, n_tokens long, ids array<int>"
RANGES = "_ranges"  # the table of the ranges' places, which readers of the files pass over


def write(docs: DataFrame, tokenizer: str, to: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0) -> None:
    """Writes the ORC files of all rows to the folder `to`."""

    def run(batches):
        from pyspark import TaskContext

        coder, place, part_no = pieces(tokenizer), 0, TaskContext.get().partitionId()
        for part, body, offsets in slices(batches, "o_text", BLOCK_BYTES):
            ids, n = coder.encode_block(body, offsets)
            ids, n = np.insert(ids, np.cumsum(n), end_id).astype(np.int32), n + 1
            at = np.r_[0, np.cumsum(n)]
            values = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(len(n), part_no, np.int32)), pa.array(at[:-1] + place), pa.array(n), values], ["doc_id", "part", "place", "n_tokens", "ids"])
            place += int(at[-1])

    rows = docs.select(long_id(docs, doc_id).alias("o_id"), F.col(text).alias("o_text"), F.xxhash64(F.col(text)).alias("o_tie"))
    total = rows.agg(F.sum(F.octet_length("o_text"))).first()[0] or 0
    ranges = max(docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // RANGE_BYTES))
    ordered = rows.repartitionByRange(ranges, "o_id", "o_tie").sortWithinPartitions("o_id", "o_tie").drop("o_tie")
    tokens = ordered.mapInArrow(run, STORED)
    tokens.write.mode("overwrite").option("orc.bloom.filter.columns", "doc_id").option("orc.create.index", "true").option("orc.row.index.stride", ROW_INDEX_STRIDE).option("orc.stripe.size", STRIPE_BYTES).option("compression", "zstd").orc(to)
    stored = docs.sparkSession.read.schema(STORED).orc(to)
    ends = stored.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    ends.select(F.col("part").alias("p"), (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base")).write.mode("overwrite").parquet(f"{to}/{RANGES}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids."""
    stored, bases = spark.read.schema(STORED).orc(path), spark.read.schema("p int, base long").parquet(f"{path}/{RANGES}")
    return stored.join(bases, F.col("part") == F.col("p")).select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids")


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what read() gives."""

    def run(batches):
        for b in batches:
            ids = b.column(3)
            at = ids.offsets.to_numpy()
            raw = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [zlib.crc32(raw[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
