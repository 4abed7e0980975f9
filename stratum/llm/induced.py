"""Suffix sorting by recursive induction in external memory.

A text ends with a unique 0. Suffixes that begin a rise after a fall are its stars. One induction sorts the pieces between stars, which are named by
their order; the text of the names is sorted by recursion until names are unique; a second induction gives the order of all suffixes
and their common prefixes from those of the stars.

An induction goes through the characters in order. A priority queue holds suffix tuples (character, place, common prefix with
the tuple before); taking the least character gives its suffixes in order, and each sends the place before it to the
queue, if that suffix is of the kind in question. The common prefix of two neighbours is one more than the least among those between their sources.

What is in memory: the queue's newest tuples (QUEUE_BYTES; the rest is in its file), and a batch of BATCH tuples, which is one part of a frequent character's
or all of those of some rare characters, handled together by vector operations. Texts, names, stars and orders are files, mapped or read
in parts. So a text may be far larger than the memory.

Common prefixes are cut at `cap`, and the order is by the first `cap` characters at least.

Defined results: a text of the 0 alone has one suffix; equal strings anywhere are neighbours in the order; values may be any whole numbers of 32 bits, none of them negative.
"""

from __future__ import annotations

import mmap
import os
from collections import deque
from collections.abc import Iterator

import numpy as np

QUEUE_BYTES = 8 << 20
BATCH = 1 << 16
FREQUENT = 4096  # a character with more places is a batch of its own


class Disk:
    """Files of one folder: arrays mapped into memory, and tapes."""

    def __init__(self, folder: str):
        self.folder, self.n = folder, 0

    def path(self) -> str:
        self.n += 1
        return os.path.join(self.folder, f"f{self.n}")

    def array(self, dtype, n: int) -> np.ndarray:
        return np.memmap(self.path(), dtype, "w+", shape=(max(n, 1),))[:n]

    @staticmethod
    def rest(*arrays: np.ndarray) -> None:
        """Lets the system take back the memory of mapped pages; their content stays in the files."""
        for a in arrays:
            while a is not None and not isinstance(a, mmap.mmap):
                a = a.base
            if a is not None:
                a.madvise(mmap.MADV_DONTNEED)

    @staticmethod
    def drop(array: np.ndarray) -> None:
        Disk.rest(array)
        os.remove(array.filename)


class Tape:
    """Rows in a file, added at the end and read anywhere."""

    def __init__(self, disk: Disk, dtype: np.dtype):
        self.path, self.dtype, self.n = disk.path(), dtype, 0
        self.file = open(self.path, "w+b", buffering=1 << 20)  # noqa: SIM115

    def add(self, rows: np.ndarray) -> int:
        """The number of the first of the rows."""
        at = self.n
        self.file.seek(0, 2)
        self.file.write(np.ascontiguousarray(rows).tobytes())
        self.n += len(rows)
        return at

    def read(self, first: int, last: int) -> np.ndarray:
        self.file.seek(first * self.dtype.itemsize)
        return np.frombuffer(self.file.read((last - first) * self.dtype.itemsize), self.dtype)

    def mapped(self) -> np.ndarray:
        self.file.flush()
        return np.memmap(self.path, self.dtype, "r+", shape=(self.n,))

    def close(self) -> None:
        self.file.close()
        os.remove(self.path)


def tuples(char, place: np.ndarray, lcp: np.ndarray, wide: bool) -> np.ndarray:
    out = np.empty(len(place), _tuple(wide))
    out["char"], out["place"], out["lcp"] = char, place, lcp
    return out


def _tuple(wide: bool) -> np.dtype:
    return np.dtype([("char", "<i4"), ("place", "<i8" if wide else "<i4"), ("lcp", "<i4")])


class Queue:
    """Tuples by the batch of their character, first in, first out within each; the newest are in memory, others in one file."""

    def __init__(self, disk: Disk, wide: bool):
        self.tape, self.memory, self.stored, self.bytes = Tape(disk, _tuple(wide)), {}, {}, 0

    def put(self, batch: int, t: np.ndarray) -> None:
        self.memory.setdefault(batch, []).append(t)
        self.bytes += t.nbytes
        if self.bytes > QUEUE_BYTES:
            for b, ts in self.memory.items():
                for x in ts:
                    self.stored.setdefault(b, deque()).append((self.tape.add(x), len(x)))
            self.memory, self.bytes = {}, 0

    def chunks(self, batch: int) -> Iterator[np.ndarray]:
        """Takes the tuples of a batch in parts, those that come meanwhile too."""
        while True:
            if self.stored.get(batch):
                parts, n = [], 0
                while n < BATCH and self.stored[batch]:
                    at, m = self.stored[batch].popleft()
                    if n + m > BATCH:
                        self.stored[batch].appendleft((at + BATCH - n, m - (BATCH - n)))
                        m = BATCH - n
                    parts.append(self.tape.read(at, at + m))
                    n += m
            elif self.memory.get(batch):
                parts = self.memory.pop(batch)
                self.bytes -= sum(t.nbytes for t in parts)
            else:
                return
            t = parts[0] if len(parts) == 1 else np.concatenate(parts)
            for i in range(0, len(t), BATCH):
                yield t[i : i + BATCH]

    def take(self, batch: int) -> np.ndarray:
        parts = list(self.chunks(batch))
        return np.concatenate(parts) if parts else np.empty(0, self.tape.dtype)

    def close(self) -> None:
        self.tape.close()


def range_min(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min(values[a + 1 : b + 1]) for each pair a < b."""
    level = np.frexp((b - a).astype(np.float64))[1] - 1
    out, table = np.empty(len(a), values.dtype), values
    for k in range(int(level.max()) + 1 if len(level) else 0):
        now = np.flatnonzero(level == k)
        if len(now):
            out[now] = np.minimum(table[a[now] + 1], table[b[now] + 1 - (1 << k)])
        table = np.minimum(table[: -(1 << k)], table[1 << k :])
    return out


def common(text: np.ndarray, i: np.ndarray, j: np.ndarray, most, have=0) -> np.ndarray:
    """Common prefixes of pairs of suffixes, cut at `most`; `have` characters are known to agree."""
    n = len(text)
    most = np.broadcast_to(most, i.shape)
    lcp = np.minimum(np.broadcast_to(have, i.shape), most).astype(np.int64)
    left = np.flatnonzero(lcp < most)
    while len(left):
        a, b = i[left] + lcp[left], j[left] + lcp[left]
        same = (a < n) & (b < n)
        same[same] = text[a[same]] == text[b[same]]
        left = left[same]
        lcp[left] += 1
        left = left[lcp[left] < most[left]]
    return lcp


def stable_order(key: np.ndarray) -> np.ndarray:
    """Order by a key from 0 up, equal ones as they stand. The places go into the key, as sorting numbers is faster than sorting places."""
    bits = max(len(key) - 1, 1).bit_length()
    if len(key) and int(key.max()) >= 1 << (62 - bits):
        return np.argsort(key, kind="stable")
    packed = (key << bits) | np.arange(len(key))
    packed.sort()
    return packed & ((1 << bits) - 1)


def _heads(x: np.ndarray) -> np.ndarray:
    """Which values differ from the one before."""
    return np.r_[True, x[1:] != x[:-1]][: len(x)]


class Induction:
    """One text, its batches of characters, and the two directions in which its suffixes are induced."""

    def __init__(self, text: np.ndarray, disk: Disk, cap: int):
        self.text, self.disk, self.cap, self.wide = np.asarray(text), disk, cap, len(text) >= 1 << 31
        top = max(int(text[i : i + BATCH].max()) for i in range(0, len(text), BATCH))
        count = disk.array(np.int64, top + 1)
        for i in range(0, len(text), BATCH):
            c, n = np.unique(text[i : i + BATCH], return_counts=True)
            count[c] += n
        self.top, self.bounds = top, np.array([*self._cut(count), top + 1])
        disk.drop(count)

    @staticmethod
    def _cut(count: np.ndarray) -> Iterator[int]:
        """The first character of each batch: 0, each frequent character, and as many rare ones as a batch holds."""
        yield 0
        for i in range(1, len(count), BATCH):
            n = np.asarray(count[i : i + BATCH])
            edge, own, at = np.r_[0, np.cumsum(n)], np.flatnonzero(n > FREQUENT), 0
            while at < len(n):
                yield i + at
                if n[at] > FREQUENT:
                    at += 1
                    continue
                follow = own[np.searchsorted(own, at) :][:1]
                at = min([max(at + 1, int(np.searchsorted(edge, edge[at] + BATCH, "right")) - 1), *follow.tolist()])

    def _batches(self, char: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, char, "right") - 1

    def _before(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places before, and their characters (-1 where there is none)."""
        before = place - 1
        return before, np.where(before >= 0, self.text[np.maximum(before, 0)].astype(np.int64), -1)

    def put(self, queue: Queue, char: np.ndarray, place: np.ndarray, lcp: np.ndarray) -> None:
        """Queues tuples whose batches are in order."""
        batch = self._batches(char)
        edge = np.flatnonzero(_heads(batch)).tolist()
        t = tuples(char, place, lcp, self.wide)
        for a, b in zip(edge, [*edge[1:], len(t)], strict=True):
            queue.put(int(batch[a]), t[a:b])

    def _send(self, queue: Queue, sign: int, before, char, lcp, go, since: Since | None, with_lcp: bool) -> None:
        """Queues the places before the suffixes of a batch, in order, where `go`."""
        source = np.flatnonzero(go)
        target = char[source]
        order = stable_order(target if sign > 0 else self.top - target)
        source, target = source[order], target[order]
        new = np.ones(len(source), np.int64)  # other characters than before follow
        if with_lcp:
            head = _heads(target)
            more = np.flatnonzero(~head)
            new[more] = range_min(lcp.astype(np.int32), source[more - 1], source[more]) + 1
            if since is not None:
                first = np.flatnonzero(head)
                found, least = since.pass_on(lcp, target[first], source[first], source[np.r_[first[1:], len(target)] - 1] if len(first) else first)
                new[first[found]] = least + 1
            new = np.minimum(new, self.cap)
        if len(source):
            self.put(queue, target, before[source], new)

    def _one(self, queue: Queue, sign: int, batch: int, second: Iterator, out, with_lcp: bool) -> None:
        """A batch of one character, in parts: what the queue has, what that induces in turn, then `second`."""
        c, since, last = int(self.bounds[batch]), Since(self.cap), None
        for t in queue.chunks(batch):
            place, lcp = t["place"].astype(np.int64), t["lcp"].astype(np.int64)
            if last is None:
                lcp[0] = 0
            last = int(place[-1])
            out(c, place, lcp, np.ones(len(place), bool))
            before, char = self._before(place)
            self._send(queue, sign, before, char, lcp, (char >= 0) & (sign * char >= sign * c), since, with_lcp)
        for place, lcp in second:
            if last is not None and len(place):
                lcp[0] = common(self.text, np.array([last]), place[:1], self.cap, 1)[0] if with_lcp else 0
                last = None
            out(c, place, lcp, np.zeros(len(place), bool))
            before, char = self._before(place)
            self._send(queue, sign, before, char, lcp, (char >= 0) & (sign * char > sign * c), since, with_lcp)

    def _several(self, queue: Queue, sign: int, batch: int, second: np.ndarray, out, with_lcp: bool) -> None:
        """A batch of rare characters at once. Suffixes that are induced within the batch are ranked by those that induce them, by doubling."""
        low, high = int(self.bounds[batch]), int(self.bounds[batch + 1])
        char, place, lcp, kind, source, before, ahead = ([] for _ in range(7))
        n = 0
        for k, t in ((0, queue.take(batch)), (2, second)):
            c = t["char"].astype(np.int64)
            t = t[stable_order(c - low if sign > 0 else high - c)]
            char.append(t["char"].astype(np.int64))
            place.append(t["place"].astype(np.int64))
            lcp.append(t["lcp"].astype(np.int64))
            kind.append(np.full(len(t), k))
            source.append(np.arange(n, n + len(t)))
            n += len(t)
        now, rounds = (np.concatenate(place), np.concatenate(char), np.concatenate(kind), np.arange(n)), -1
        while len(now[0]):
            rounds += 1
            b, c = self._before(now[0])
            before.append(b)
            ahead.append(c)
            go = (c >= low) & (c < high) & np.where(now[2] == 2, sign * c > sign * now[1], sign * c >= sign * now[1])
            m = int(go.sum())
            now = b[go], c[go], np.ones(m, np.int64), now[3][go]
            for have, x in ((place, now[0]), (char, now[1]), (kind, now[2]), (source, now[3]), (lcp, np.ones(m, np.int64))):
                have.append(x)
            now = *now[:3], np.arange(n, n + m)
            n += m
        if not n:
            return
        char, place, lcp, kind, source, before, ahead = (np.concatenate(x) for x in (char, place, lcp, kind, source, before, ahead))
        at = self._ranks((char - low if sign > 0 else high - char) * 3 + kind, kind == 1, source)
        order = np.empty(n, np.int64)
        order[at] = np.arange(n)
        group, char, place, lcp = kind[order], char[order], place[order], lcp[order].astype(np.int32)
        head = _heads(char)
        lcp[head] = 0
        if with_lcp:
            turn = np.flatnonzero(~head[1:] & (group[1:] == 2) & (group[:-1] != 2)) + 1
            lcp[turn] = common(self.text, place[turn - 1], place[turn], self.cap, 1)
            inner = np.flatnonzero(~head[1:] & (group[1:] == 1) & (group[:-1] == 1)) + 1
            p, q = at[source[order[inner - 1]]], at[source[order[inner]]]
            lcp[inner] = self.cap
            for _ in range(rounds if len(inner) else 0):  # right so many rounds deep
                lcp[inner] = np.minimum(range_min(lcp, p, q) + 1, self.cap)
        out(char, place, lcp, group != 2)
        ahead = ahead[order]
        self._send(queue, sign, before[order], ahead, lcp, ahead >= high if sign > 0 else (ahead >= 0) & (ahead < low), None, with_lcp)

    @staticmethod
    def _ranks(key: np.ndarray, inner: np.ndarray, source: np.ndarray) -> np.ndarray:
        """The place of each row in the order by key; the inner ones of equal keys by the places of their sources, others as they stand."""
        order = stable_order(key)
        rank = np.empty(len(key), np.int64)
        rank[order] = np.maximum.accumulate(np.where(_heads(key[order]) | ~inner[order], np.arange(len(key)), 0))
        jump, open_ = source, np.flatnonzero(inner)
        while len(open_):
            # Prefix doubling: a tie is resolved by the ranks so many sources further on.
            key = rank[open_] * len(rank) + rank[jump[open_]]
            order = stable_order(key)
            open_, key = open_[order], key[order]
            tie = _heads(rank[open_])
            first = np.maximum.accumulate(np.where(tie, np.arange(len(open_)), 0))
            new = _heads(key)
            place = rank[open_] + np.maximum.accumulate(np.where(new, np.arange(len(open_)), 0)) - first
            rank[open_] = place
            open_, jump = open_[~new | np.r_[~new[1:], False]], jump[jump]
        return rank

    def run(self, stars: Queue, with_lcp: bool, emit) -> None:
        """From the stars in order, all suffixes: emit(places, lcps, rises) from the greatest to the least; lcps[i] is the common prefix with the suffix
        emitted before; rises: which are smaller than their successors."""
        up, falls, cut = Queue(self.disk, self.wide), Tape(self.disk, _tuple(self.wide)), [0]

        def fall(char, place, lcp, first):
            t = tuples(char, place, lcp, self.wide)
            falls.add(t if first.all() else t[first])

        for batch in range(len(self.bounds) - 1):
            if self.bounds[batch + 1] - self.bounds[batch] == 1:
                self._one(up, 1, batch, ((t["place"].astype(np.int64), t["lcp"].astype(np.int64)) for t in stars.chunks(batch)), fall, with_lcp)
            else:
                self._several(up, 1, batch, stars.take(batch), fall, with_lcp)
            cut.append(falls.n)
        up.close()
        self.disk.rest(self.text)
        down = Queue(self.disk, self.wide)
        for batch in range(len(self.bounds) - 2, 0, -1):
            back = _backwards(falls, cut[batch], cut[batch + 1])
            put = lambda _, place, lcp, first: emit(place, lcp, first)
            if self.bounds[batch + 1] - self.bounds[batch] == 1:
                self._one(down, -1, batch, ((place, lcp) for _, place, lcp in back), put, with_lcp)
            else:
                parts = [tuples(*x, self.wide) for x in back]
                self._several(down, -1, batch, np.concatenate(parts) if parts else np.empty(0, _tuple(self.wide)), put, with_lcp)
        emit(np.array([len(self.text) - 1]), np.zeros(1, np.int64), np.ones(1, bool))
        down.close()
        falls.close()
        self.disk.rest(self.text)


class Since:
    """The least common prefix since the last source of each character, for a batch that comes in parts."""

    def __init__(self, cap: int):
        self.cap, self.char, self.least = cap, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def pass_on(self, lcp: np.ndarray, char: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """char: distinct characters that have sources in this part, the first and last ones at these places. Gives which of them had one before, and the least since."""
        if not len(lcp):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.searchsorted(self.char, char)
        known = self.char[np.minimum(k, max(len(self.char) - 1, 0))] == char if len(self.char) else np.zeros(len(char), bool)
        found = np.flatnonzero(known)
        out = np.minimum(self.least[k[found]], np.minimum.accumulate(lcp)[first[found]])
        self.least = np.minimum(self.least, lcp.min())
        after = np.r_[np.minimum.accumulate(lcp[::-1])[::-1], self.cap][last + 1]
        self.least[k[found]] = after[found]
        new = np.flatnonzero(~known)
        new = new[np.argsort(char[new])]
        self.char, self.least = np.insert(self.char, k[new], char[new]), np.insert(self.least, k[new], after[new])
        return found, out


def _backwards(tape: Tape, first: int, last: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Tuples from the last to the first, each with the common prefix with the one before it in this order."""
    held = 0
    while last > first:
        low = max(first, last - BATCH)
        t = tape.read(low, last)[::-1]
        yield t["char"], t["place"].astype(np.int64), np.r_[held, t["lcp"][:-1]].astype(np.int64)
        held, last = int(t["lcp"][-1]), low


def star_places(text: np.ndarray, disk: Disk) -> np.ndarray:
    """Places of the suffixes that are smaller than their successors, while the one before is greater; the last one counts as smaller."""
    n = len(text)
    out = disk.array(np.int64, n // 2 + 1)
    at, rise = len(out), True
    for high in range(n, 0, -BATCH):
        low = max(0, high - BATCH)
        x = np.asarray(text[low : high + 1]).astype(np.int64)
        step = np.r_[np.sign(x[1:] - x[:-1]), 0][: high - low]
        place = np.minimum.accumulate(np.where(step != 0, np.arange(len(step)), len(step))[::-1])[::-1]
        rises = np.r_[step > 0, rise][place]
        before = np.r_[text[low - 1] if low else -1, x[: high - low - 1]]
        stars = np.flatnonzero(rises & (before > x[: high - low])) + low
        out[at - len(stars) : at] = stars
        at, rise = at - len(stars), bool(rises[0])
    return out[at:]


def _named(text: np.ndarray, stars: np.ndarray, ordered: Tape, disk: Disk) -> tuple[np.ndarray, int]:
    """The names of the stars' pieces in the order of the text, by the order of the pieces, and their number. A piece ends with the first character of the next."""
    names, name, last = disk.array(np.int32, len(stars)), -1, np.zeros(0, np.int64)
    for high in range(ordered.n, 0, -BATCH):
        low = max(0, high - BATCH)
        place = np.r_[last, ordered.read(low, high)[::-1]]
        which = np.searchsorted(stars, place)
        size = np.where(which + 1 < len(stars), stars[np.minimum(which + 1, len(stars) - 1)] + 1, len(text)) - place
        same = size[1:] == size[:-1]
        some = np.flatnonzero(same)
        same[some] = common(text, place[some], place[some + 1], size[some]) == size[some]
        new = np.r_[[] if len(last) else [True], ~same].astype(bool)
        number = name + np.cumsum(new)
        names[which[len(last) :]] = number
        name, last = int(number[-1]), place[-1:]
    return names, name + 1


def sort_suffixes(text: np.ndarray, disk: Disk, cap: int, emit) -> None:
    """emit(places, lcps, rises) of all suffixes, as Induction.run() does. text: non-negative, ending with its only 0."""
    if len(text) == 1:
        emit(np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones(1, bool))
        return
    mapped, text = text, np.asarray(text)
    stars, work = star_places(text, disk), Induction(text, disk, cap)
    queue, ordered = Queue(disk, work.wide), Tape(disk, np.dtype("<i8"))

    def note(place, _, rises):
        place = place[rises & (place > 0)]
        ordered.add(place[text[place - 1] > text[place]])

    for i in range(0, len(stars), BATCH):
        place = np.asarray(stars[i : i + BATCH])
        place = place[stable_order(text[place].astype(np.int64))]
        work.put(queue, text[place].astype(np.int64), place, np.zeros(len(place), np.int64))
    work.run(queue, False, note)
    queue.close()
    names, kinds = _named(text, stars, ordered, disk)
    ordered.close()
    disk.rest(mapped, stars, names)

    queue, last = Queue(disk, work.wide), np.zeros(0, np.int64)
    if kinds == len(stars):
        order = disk.array(np.int64, len(stars))
        for i in range(0, len(stars), BATCH):
            order[names[i : i + BATCH]] = np.arange(i, min(i + BATCH, len(stars)))
        ranked = ((order[i : i + BATCH], np.zeros(min(BATCH, len(stars) - i), np.int64)) for i in range(0, len(stars), BATCH))
    else:
        tape = Tape(disk, _tuple(True))
        sort_suffixes(names, disk, cap, lambda place, lcp, _: tape.add(tuples(0, place, lcp, True)))
        ranked = ((place, lcp) for _, place, lcp in _backwards(tape, 0, tape.n))
    for which, agree in ranked:
        # Common prefixes of neighbouring stars, in characters: whole equal pieces, then character by character.
        i, j, agree = np.r_[last, which[:-1]], which[1 - len(last) :], agree[1 - len(last) :]
        known = stars[np.minimum(i + agree, len(stars) - 1)] - stars[i]
        lcp = common(text, stars[i], stars[j], cap, known)
        place = stars[which]
        work.put(queue, text[place].astype(np.int64), place, lcp if len(last) else np.r_[0, lcp])
        last = which[-1:]
    if kinds == len(stars):
        disk.drop(order)
    else:
        tape.close()
    disk.drop(names)
    disk.rest(mapped, stars)
    work.run(queue, True, emit)
    queue.close()
    disk.drop(stars)


def repeated(text: np.ndarray, length: int, disk: Disk) -> np.ndarray:
    """For each place of `text` (non-negative, ending with its only 0), 1 where a string of this length starts that starts elsewhere too; a mapped file."""
    marks, last = disk.array(np.uint8, len(text)), np.zeros(0, np.int64)

    def emit(place, lcp, _):
        nonlocal last
        hit = lcp >= length
        marks[place[hit]] = 1
        marks[np.r_[last, place[:-1]][hit[1 - len(last) :]]] = 1
        last = place[-1:]

    sort_suffixes(text, disk, length, emit)
    return marks
