"""Byte-pair encoding and decoding by forced-boundary splitting.

A pair of neighbouring symbols that stands inside no token of the vocabulary can never be merged, so the
text is certainly cut there. The fragments are encoded independently by the tokenizers library's merges and their
ids concatenated. Texts are split into words by vector operations, a block at a time; a bounded table keeps the ids of words.

Defined results: a null or empty text has no tokens and decodes to the empty string; special tokens that
stand in a text literally are single ids, as in the library; texts of any length are encoded whole; equal rows give equal rows.
Rows are independent, so there is no shuffle and nothing to skew.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import release, schema_of, slices
from .pieces import PieceTable, spread

CACHE_PIECES = 300_000
SHOWN = 1 << 16  # ids turned into text at once

#: Fixed values of the byte-level alphabet: these bytes stand for themselves, the others follow from 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: How files normalize and split texts that this module can follow without the library, and the endings in the pattern.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]
#: Code points below TOP whose class and case all libraries agree on; texts with others go through the library's own normalizer and splitter.
TOP = 0x2100
USUAL = r"[\x00-\x1B\x20-\u024F\u0391-\u03C9\u0410-\u044F\u2010-\u2027]"
LETTER, NUMBER, SPACE_, OTHER, UNUSUAL = range(5)


def byte_alphabet() -> dict[int, str]:
    other = [b for b in range(256) if b not in set(PRINTABLE)]
    return {b: chr(b) for b in PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(other)}


class ForcedBoundaryCodec:
    """The codec of one tokenizers file: a BPE over the byte alphabet, with or without a word-end suffix. Files with what it does not know are refused."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers
        from tokenizers.models import BPE

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self._refuse_unknown(spec, model)
        self.path, self.suffix, self.vocab = path, model.get("end_of_word_suffix") or "", model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.inner = tokenizers.Tokenizer(BPE(vocab=self.vocab, merges=merges))
        self.last = tokenizers.Tokenizer(BPE(vocab=self.vocab, merges=merges, end_of_word_suffix=self.suffix)) if self.suffix else self.inner
        self.inside = {pair for t in self.vocab for pair in self._pairs(self._symbols(t))}
        self.alphabet = byte_alphabet()
        self.back = {c: b for b, c in self.alphabet.items()}
        # Texts are normalized and split here where the file does that in the way known; else, and for unusual texts, by the library's own parts of the file.
        self.known = spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"] == SPLITTER
        self.classes, self.lower = self._characters()
        self.table = PieceTable(CACHE_PIECES)
        size = max(self.tokens, default=-1) + 1
        self.shown = [self._pool([f" {i}" for i in range(size)]), self._pool([" " + self.tokens.get(i, "") for i in range(size)])]

    @staticmethod
    def _refuse_unknown(spec: dict, model: dict) -> None:
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers") or [spec["pre_tokenizer"] or {}]
        plain = [t for t in spec["added_tokens"] if not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"])]
        unknown = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        unknown += [k for k in ("post_processor", "decoder") if spec.get(k)]
        if model["type"] != "BPE" or steps[-1].get("type") != "ByteLevel" or steps[-1].get("add_prefix_space") or len(plain) < len(spec["added_tokens"]) or unknown:
            raise ValueError(f"not a tokenizer file that this codec can follow: {model['type']}, {unknown}")

    @staticmethod
    def _pool(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all texts, where each begins, and its size."""
        data = [t.encode() for t in texts]
        size = np.fromiter(map(len, data), np.int64, len(data))
        return np.frombuffer(b"".join(data), np.uint8), np.cumsum(size) - size, size

    @staticmethod
    def _characters() -> tuple[np.ndarray, np.ndarray]:
        """Class and lower case of code points. Those that normalization or lower-casing may make several of are unusual."""
        every = "".join(map(chr, range(TOP)))
        classes, lower = np.full(TOP + 1, UNUSUAL, np.uint8), np.arange(TOP + 1, dtype=np.uint32)
        for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE_, r"\s"), (OTHER, r"[^\s\p{L}\p{N}]")):
            classes[[m.start() for m in regex.finditer(pattern, every)]] = kind
        for c in every:
            small = c.lower()
            if not regex.fullmatch(USUAL, c) or len(small) != 1 or ord(small) >= TOP or unicodedata.combining(c) or not unicodedata.is_normalized("NFC", c):
                classes[ord(c)] = UNUSUAL
            else:
                lower[ord(c)] = ord(small)
        classes[TOP] = UNUSUAL
        return classes, lower

    @functools.cached_property
    def whole(self):
        """The library's own tokenizer, for the words of unusual texts."""
        import tokenizers

        return tokenizers.Tokenizer.from_file(self.path)

    @functools.cached_property
    def split_special(self):
        return regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")")

    def _symbols(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix) and token != self.suffix:
            body = list(token[: -len(self.suffix)])
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    @staticmethod
    def _pairs(symbols: list[str]) -> Iterator[tuple[str, str]]:
        return zip(symbols, symbols[1:], strict=False)

    def fragments(self, word: str) -> list[str]:
        """A word of the byte alphabet, cut wherever two neighbouring symbols are in no token together."""
        out, first, end = [], 0, len(word) - 1
        for i in range(end):
            right = word[i + 1] + (self.suffix if i + 1 == end else "")
            if (word[i], right) not in self.inside:
                out.append(word[first : i + 1])
                first = i + 1
        out.append(word[first:])
        return out

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words, one after another, and the number of each."""
        cut = [self.fragments("".join(map(self.alphabet.__getitem__, w))) for w in words]
        inner = list({f for fs in cut for f in fs[:-1]})
        ids = dict(zip(inner, (e.ids for e in self.inner.encode_batch_fast(inner, add_special_tokens=False)), strict=True))
        last = self.last.encode_batch_fast([fs[-1] for fs in cut], add_special_tokens=False)
        each = [[*(i for f in fs[:-1] for i in ids[f]), *e.ids] for fs, e in zip(cut, last, strict=True)]
        return np.array([i for x in each for i in x], np.int32), np.fromiter(map(len, each), np.int64, len(each))

    def _look_up(self, body: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.table.look_up(body, start, end, lambda a, b: self.encode_words([body[i:j].tobytes() for i, j in zip(a.tolist(), b.tolist(), strict=True)]))

    def spans(self, code: np.ndarray, cls: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words start and end, in lower-cased code points. head: where texts start (one more place at the end)."""
        n = len(code)
        first, space = head[:n], cls == SPACE_
        begin = ~space & (np.r_[True, cls[1:] != cls[:-1]] | first | (cls == NUMBER))
        # An apostrophe that is a word by itself takes one of the endings of the letters that follow.
        tick = np.flatnonzero((code == 0x27) & begin)
        follow, ends = np.r_[code, np.zeros(4, code.dtype)], np.r_[head, True, True, True]
        done = np.zeros(len(tick), bool)
        for e in ENDINGS:
            fits = ~done
            for k, ch in enumerate(e, 1):
                fits &= (follow[tick + k] == ord(ch)) & ~ends[np.minimum(tick + k, n)]
            done |= fits
            begin[tick[fits] + 1] = False
            rest = tick[fits] + 1 + len(e)
            rest = rest[rest < n]
            begin[rest[cls[rest] != SPACE_]] = True
        start, stops = np.flatnonzero(begin), np.r_[np.flatnonzero(begin | space | first), n]
        return start, stops[np.searchsorted(stops, start, "right")]

    def encode_block(self, body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a block, one after another, and the number of each."""
        text, n_docs = body.tobytes().decode(), len(at) - 1
        code = np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), TOP)
        place = np.r_[0, np.cumsum((body & 0xC0) != 0x80)][at]  # of the texts, in code points
        cls, head = self.classes[code], np.zeros(len(code) + 1, bool)
        head[place] = True
        odd = np.full(n_docs, not self.known)
        if self.known and (cls == UNUSUAL).any():
            odd[np.searchsorted(place, np.flatnonzero(cls == UNUSUAL), "right") - 1] = True
        if any(t in text for t in self.special):
            for i in range(n_docs):
                odd[i] |= any(t in text[place[i] : place[i + 1]] for t in self.special)
        ids, count = np.zeros(0, np.int32), np.zeros(n_docs, np.int64)
        if len(code) and not odd.all():
            code = self.lower[code]
            small = np.frombuffer(code.tobytes().decode("utf-32-le").encode(), np.uint8)
            byte_at = np.r_[np.flatnonzero((small & 0xC0) != 0x80), len(small)]
            start, end = self.spans(code, cls, head)
            doc = np.searchsorted(place, start, "right") - 1
            keep = ~odd[doc]
            ids, size = self._look_up(small, byte_at[start[keep]], byte_at[end[keep]])
            count = np.bincount(doc[keep], size, n_docs).astype(np.int64)
        if odd.any():
            parts = np.split(ids, np.cumsum(count)[:-1])
            for i in np.flatnonzero(odd).tolist():
                parts[i] = self.encode_odd(text[place[i] : place[i + 1]])
                count[i] = len(parts[i])
            ids = np.concatenate(parts)
        return ids, count

    def encode_odd(self, text: str) -> np.ndarray:
        """The ids of a text that the library normalizes and splits; special tokens stand for themselves."""
        out = []
        for k, part in enumerate(self.split_special.split(text) if self.special else [text]):
            if k % 2:
                out.append(np.array([self.special[part]], np.int32))
                continue
            part = self.whole.normalizer.normalize_str(part) if self.whole.normalizer else part
            words = [bytes(self.back[c] for c in p) for p, _ in self.whole.pre_tokenizer.pre_tokenize_str(part)]
            edge = np.r_[0, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))]
            out.append(self._look_up(np.frombuffer(b"".join(words), np.uint8), edge[:-1], edge[1:])[0])
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def show(self, ids: np.ndarray, count: np.ndarray, decoded: bool) -> Iterator[bytes]:
        """The ids of each text in decimal, or its tokens (as the library decodes for files without a decoder), joined by single spaces; a few at a time
        for a long text, with None after each text."""
        pool, begin, size = self.shown[decoded]
        edge = np.r_[0, np.cumsum(count)]
        doc = 0
        for low in range(0, max(len(ids), 1), SHOWN):
            part = ids[low : low + SHOWN]
            off = np.r_[0, np.cumsum(size[part])]
            data = pool[spread(begin[part], size[part])].tobytes()
            while doc < len(count):
                a, b = max(int(edge[doc]) - low, 0), min(int(edge[doc + 1]) - low, len(part))
                if b > a:
                    yield data[off[a] + (edge[doc] >= low) : off[b]]
                if edge[doc + 1] - low > len(part):
                    break
                yield None
                doc += 1

    def digests(self, ids: np.ndarray, count: np.ndarray, decoded: bool) -> list[str]:
        out, now = [], hashlib.sha256()
        for x in self.show(ids, count, decoded):
            if x is None:
                out.append(now.hexdigest())
                now = hashlib.sha256()
            else:
                now.update(x)
        return out

    def encode(self, text: str) -> list[int]:
        data = text.encode()
        return self.encode_block(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0].tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(x for x in self.show(np.array(ids, np.int64), np.array([len(ids)]), True) if x).decode()


_CODECS: dict[str, ForcedBoundaryCodec] = {}


def codec(path: str) -> ForcedBoundaryCodec:
    """One for each process, as reading the file takes longer than a small task."""
    if path not in _CODECS:
        _CODECS[path] = ForcedBoundaryCodec(path)
    return _CODECS[path]


def round_trip(docs: DataFrame, path: str, keep: list[str], text: str = "text", with_ids: bool = False, with_decoded: bool = False) -> DataFrame:
    """`keep`, b_n, b_ids_sha256, b_decoded_sha256 (and b_ids, b_decoded if asked for) of each row."""
    rows = docs.selectExpr(*[f"`{c}` as b_keep{i}" for i, c in enumerate(keep)], f"`{text}` as b_text")
    made = "b_n long, b_ids_sha256 string, b_decoded_sha256 string" + ", b_ids array<int>" * with_ids + ", b_decoded string" * with_decoded
    schema = schema_of(rows, [f"b_keep{i}" for i in range(len(keep))], made)

    def run(batches):
        coder = codec(path)
        for part, body, offsets in slices(batches, "b_text"):
            ids, n = coder.encode_block(body, offsets)
            columns = [*part.columns[:-1], pa.array(n), *(pa.array(coder.digests(ids, n, d), pa.string()) for d in (False, True))]
            names = [*part.schema.names[:-1], "b_n", "b_ids_sha256", "b_decoded_sha256"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(ids)))
                names.append("b_ids")
            if with_decoded:
                at = np.r_[0, np.cumsum(n)]
                columns.append(pa.array([coder.decode(ids[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)], pa.string()))
                names.append("b_decoded")
            yield pa.RecordBatch.from_arrays(columns, names)
        coder.table.forget()  # a worker without a task keeps the vocabulary only
        release()

    out = rows.mapInArrow(run, schema)
    return out.selectExpr(*[f"b_keep{i} as `{c}`" for i, c in enumerate(keep)], *[f.name for f in out.schema.fields[len(keep) :]])
