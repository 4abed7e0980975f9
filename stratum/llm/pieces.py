"""A bounded table of what pieces of text are encoded as.

Pieces are found by a hash of their bytes and then compared byte by byte, so a collision costs time and never a wrong id. About 60 bytes for
each piece; a table that is full is emptied. Any bytes may be a piece, the empty string too.
"""

from __future__ import annotations

import numpy as np

from .common import lanes, same_bytes, span_hashes


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of ranges, one range after another."""
    edge = np.cumsum(size)
    return np.repeat(start - edge + size, size) + np.arange(int(edge[-1]) if len(edge) else 0)


class Pool:
    """A growing array."""

    def __init__(self, dtype):
        self.data, self.used = np.zeros(1 << 12, dtype), 0

    def add(self, values: np.ndarray) -> int:
        """Where the values begin."""
        at = self.used
        if at + len(values) > len(self.data):
            more = np.zeros(max(2 * len(self.data), at + len(values)), self.data.dtype)
            more[:at] = self.data[:at]
            self.data = more
        self.data[at : at + len(values)] = values
        self.used = at + len(values)
        return at


class PieceTable:
    def __init__(self, limit: int):
        self.limit = limit
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.low, self.bytes, self.at, self.size = (np.zeros(0, np.int64) for _ in range(4))
        self.text, self.ids = Pool(np.uint8), Pool(np.int32)

    def _learn(self, body: np.ndarray, a: np.ndarray, b: np.ndarray, make) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of new pieces begin in the pool, and their numbers."""
        ids, size = make(a, b)
        return self.ids.add(ids) + np.cumsum(size) - size, size

    def look_up(self, body: np.ndarray, start: np.ndarray, end: np.ndarray, make) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces body[start:end], one after another, and the number of each. make(starts, ends) gives the same for pieces that the table lacks."""
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        if len(self.keys) > self.limit:
            self.forget()
        view = lanes(body)
        (key,) = span_hashes(view, start, end, 10)
        distinct, one, which = np.unique(key, return_index=True, return_inverse=True)
        a, b = start[one], end[one]
        k = np.minimum(np.searchsorted(self.keys, distinct), max(len(self.keys) - 1, 0))
        known = self.keys[k] == distinct if len(self.keys) else np.zeros(len(distinct), bool)
        at, size = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        if len(self.keys):
            at[known], size[known] = self.at[k[known]], self.size[k[known]]
        new = np.flatnonzero(~known)
        if len(new):
            at[new], size[new] = self._learn(body, a[new], b[new], make)
            width = b[new] - a[new]
            low = self.text.add(body[spread(a[new], width)]) + np.cumsum(width) - width
            place = np.searchsorted(self.keys, distinct[new])
            for name, x in (("keys", distinct[new]), ("low", low), ("bytes", width), ("at", at[new]), ("size", size[new])):
                setattr(self, name, np.insert(getattr(self, name), place, x))
            k = np.searchsorted(self.keys, distinct)
        # Each piece against the stored one of its hash: those of other bytes are encoded by themselves.
        same = same_bytes(view, start, end - start, lanes(self.text.data[: self.text.used]), self.low[k][which], self.bytes[k][which])
        at, size = at[which], size[which]
        if not same.all():
            odd = np.flatnonzero(~same)
            at[odd], size[odd] = self._learn(body, start[odd], end[odd], make)
        return self.ids.data[spread(at, size)], size
