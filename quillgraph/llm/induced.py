"""Suffixes in order by external induced sorting, with common-prefix lengths up to a limit, in bounded memory.

The order of the S* suffixes (those smaller than their successor and not than their predecessor) induces that of all L suffixes in
a rising scan, and that of the L suffixes the order of all S suffixes in a falling scan. Both scans work through a priority queue of
suffix positions keyed by first byte: what is popped pushes the suffixes one byte longer. Queues hold tuples (position, length of the prefix
shared with the suffix pushed before). The S* suffixes themselves are ordered through the reduced string of names of the substrings
between them. The recursion on it goes by doubling the length that names stand for: tuples (name, next name, position) go
through a priority queue of their own, those whose names differ already don't any more, and it ends as soon as all names differ or
`limit` bytes are covered.

Whatever grows with the text (text, kinds, positions, names, queues, runs, results) is an array or queue that keeps what exceeds `memory`
bytes in a temporary file of the task, is worked through in blocks, and is given on in blocks; so a text may be far larger
than memory.
"""

from __future__ import annotations

import tempfile
from collections import deque
from collections.abc import Iterator

import numpy as np

Block = tuple[np.ndarray, np.ndarray]


def array(n: int, kind, memory: int) -> np.ndarray:
    """Zeros; in a file if they take more than `memory` bytes."""
    kind = np.dtype(kind)
    if n * kind.itemsize <= memory:
        return np.zeros(n, kind)
    with tempfile.TemporaryFile() as f:
        return np.memmap(f, kind, "w+", shape=(n,))


def cuts(lo: int, hi: int, size: int) -> Iterator[tuple[int, int]]:
    for x in range(lo, hi, size):
        yield x, min(hi, x + size)


def block_size(memory: int) -> int:
    return max(16, memory // 64)


class Queue:
    """Batches of (positions, common prefixes) by key, first in, first out. Beyond `memory` bytes they wait in a file."""

    def __init__(self, memory: int):
        self.memory, self.held, self.batches, self.file, self.spilled = memory, 0, {}, None, 0

    def push(self, key: int, at: np.ndarray, common: np.ndarray) -> None:
        if self.held + at.nbytes > self.memory:
            self.file = self.file or tempfile.TemporaryFile()
            entry = (self.file.seek(0, 2), len(at))
            self.file.write(at.astype(np.int64).tobytes() + common.tobytes())
            self.spilled += 9 * len(at)
        else:
            entry = (at, common)
            self.held += at.nbytes
        self.batches.setdefault(key, deque()).append(entry)

    def pop(self, key: int, most: int) -> Block | None:
        """The first batches of a key, until there are `most` positions."""
        waiting = self.batches.get(key)
        if not waiting:
            return None
        out, n = [], 0
        while waiting and (not n or n + (waiting[0][1] if isinstance(waiting[0][0], int) else len(waiting[0][0])) <= most):
            a, b = waiting.popleft()
            if isinstance(a, int):
                self.file.seek(a)
                data = self.file.read(9 * b)
                a, b = np.frombuffer(data[: 8 * b], np.int64), np.frombuffer(data[8 * b :], np.uint8)
            else:
                self.held -= a.nbytes
            out.append((a, b))
            n += len(a)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def close(self) -> None:
        if self.file:
            self.file.close()


class Sorter:
    """A priority queue of tuples (key, value): all are pushed, then popped in the order of keys, then of pushing. Runs wait in a file."""

    def __init__(self, memory: int):
        self.memory, self.held, self.blocks, self.runs, self.file = memory, 0, [], [], None

    def push(self, key: np.ndarray, value: np.ndarray) -> None:
        if len(key):
            self.blocks.append((key.astype(np.uint64), value.astype(np.int64)))
            self.held += 16 * len(key)
            if self.held > self.memory:
                self._run()

    def _sorted(self) -> Block:
        key, value = (np.concatenate(x) for x in zip(*self.blocks, strict=True))
        order = np.argsort(key, kind="stable")
        self.blocks, self.held = [], 0
        return key[order], value[order]

    def _run(self) -> None:
        key, value = self._sorted()
        self.file = self.file or tempfile.TemporaryFile()
        at = self.file.seek(0, 2)
        self.file.write(np.stack([key.view(np.int64), value], 1).tobytes())
        self.runs.append((at, len(key)))

    def popped(self) -> Iterator[Block]:
        if not self.runs:
            if self.blocks:
                key, value = self._sorted()
                for lo, hi in cuts(0, len(key), block_size(self.memory)):
                    yield key[lo:hi], value[lo:hi]
            return
        if self.blocks:
            self._run()
        size = max(16, self.memory // 16 // (len(self.runs) + 1))
        heads: list[list] = [[at, n, np.zeros(0, np.uint64), np.zeros(0, np.int64)] for at, n in self.runs]  # what isn't read yet, and what is
        while True:
            for h in heads:
                if not len(h[2]) and h[1]:
                    k = min(size, h[1])
                    self.file.seek(h[0])
                    data = np.frombuffer(self.file.read(16 * k), np.int64).reshape(-1, 2)
                    h[:] = [h[0] + 16 * k, h[1] - k, data[:, 0].copy().view(np.uint64), data[:, 1].copy()]
            heads = [h for h in heads if len(h[2])]
            if not heads:
                self.file.close()
                return
            # all that is before the least last key of runs with more to come, and of equal keys only the earlier runs'
            stop = min(((h[2][-1], i) for i, h in enumerate(heads) if h[1]), default=None)
            out = []
            for i, h in enumerate(heads):
                n = len(h[2]) if stop is None else int(np.searchsorted(h[2], stop[0], "right" if i <= stop[1] else "left"))
                out.append((h[2][:n], h[3][:n]))
                h[2], h[3] = h[2][n:], h[3][n:]
            key, value = (np.concatenate(x) for x in zip(*out, strict=True))
            order = np.argsort(key, kind="stable")
            yield key[order], value[order]


def shared(text: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, up to limit; the terminator 0 equals nothing."""
    out = np.zeros(len(a), np.uint8)
    live = np.arange(len(a))
    for k in range(limit):
        x, y = text[np.minimum(a[live] + k, len(text) - 1)], text[np.minimum(b[live] + k, len(text) - 1)]
        live = live[(x == y) & (x > 0)]
        if not len(live):
            break
        out[live] = k + 1
    return out


def kinds(text: np.ndarray, memory: int) -> np.ndarray:
    """True for S suffixes: those that are smaller than the next; equal bytes have the kind of what follows them."""
    n = len(text)
    s = array(n, bool, memory)
    for lo, hi in reversed(list(cuts(0, n, 8 * block_size(memory)))):
        part = text[lo:hi].astype(np.int16)
        step = np.sign(np.diff(part, append=np.int16(text[hi]) if hi < n else np.int16(-1)))
        other = np.where(step != 0, np.arange(hi - lo), hi - lo)
        nearest = np.minimum.accumulate(other[::-1])[::-1]
        rising = np.append(step > 0, hi < n and s[hi])
        s[lo:hi] = rising[nearest] | (part == 0)
    return s


def stars(text: np.ndarray, s: np.ndarray, memory: int) -> np.ndarray:
    """The S* positions, and the terminators."""

    def found() -> Iterator[np.ndarray]:
        for lo, hi in cuts(0, len(text), 8 * block_size(memory)):
            before = np.concatenate([[lo == 0 or s[lo - 1]], s[lo : hi - 1]])
            yield np.flatnonzero(s[lo:hi] & ~before | (text[lo:hi] == 0)) + lo

    out = array(sum(map(len, found())), np.int64, memory)
    n = 0
    for x in found():
        out[n : n + len(x)] = x
        n += len(x)
    return out


def rename(name: np.ndarray, queue: Sorter, shift: int) -> Iterator[np.ndarray]:
    """Pop tuples (old name and what refines it below `shift` bits, star); give stars of equal keys the place of the first in the order of all as
    their name. Yields stars whose names others may have too."""
    place, last, first, begin = 0, None, 0, 0
    for key, star in queue.popped():
        at = place + np.arange(len(key))
        old = (key >> np.uint64(shift)).astype(np.int64)
        same = np.concatenate([[key[0] == last], key[1:] == key[:-1]])
        same_old = np.concatenate([[last is not None and int(last) >> shift == old[0]], old[1:] == old[:-1]])
        firsts = np.maximum.accumulate(np.where(same, first, at))
        begins = np.maximum.accumulate(np.where(same_old, begin, at))
        name[star] = old + firsts - begins
        tied = same | np.append(same[1:], True)  # the last of a block may have followers
        yield star[tied]
        place, last, first, begin = place + len(key), key[-1], firsts[-1], begins[-1]


def gathered(parts: Iterator[np.ndarray], most: int, memory: int) -> np.ndarray:
    """At most so many numbers, together."""
    out, n = array(most, np.int64, memory), 0
    for x in parts:
        out[n : n + len(x)] = x
        n += len(x)
    return out[:n]


def star_order(text: np.ndarray, s: np.ndarray, limit: int, memory: int) -> np.ndarray:
    """S* positions in the order of their suffixes' first `limit` bytes at least."""
    star, size = stars(text, s, memory), block_size(memory)
    m = len(star)
    if not m:
        return star
    ends = np.concatenate([np.flatnonzero(text[star[lo:hi]] == 0) + lo for lo, hi in cuts(0, m, size)])  # a terminator a segment
    name = array(m, np.int64, memory)

    def signs(i: np.ndarray, reach: int, count: int) -> Block:
        """The next signs (byte, kind) of the substrings of stars, up to the next star; and how long they are."""
        at = star[i]
        upto = np.where(text[at] == 0, at, star[np.minimum(i + 1, m - 1)])
        word = np.zeros(len(i), np.uint64)
        for k in range(reach, reach + count):
            x = np.minimum(at + k, len(text) - 1)
            sign = text[x].astype(np.uint64) * np.uint64(2) + s[x].astype(np.uint64) + np.uint64(1)
            word = word << np.uint64(10) | np.where(at + k <= upto, sign, np.uint64(0))
        return word, upto - at

    # names of the substrings: six signs, then three at a time of those that are longer
    queue = Sorter(memory)
    for lo, hi in cuts(0, m, size):
        i = np.arange(lo, hi)
        queue.push(signs(i, 0, 6)[0], i)
    live, reach = gathered(rename(name, queue, 63), m, memory), 6
    while len(live):
        queue, longer = Sorter(memory), False
        for lo, hi in cuts(0, len(live), size):
            i = live[lo:hi]
            word, length = signs(i, reach, 3)
            queue.push(name[i].astype(np.uint64) << np.uint64(30) | word, i)
            longer |= bool((length >= reach).any())
        if not longer:
            break
        live, reach = gathered(rename(name, queue, 30), len(live), memory), reach + 3

    # the reduced string: names stand for twice as many substrings each time
    live, span = gathered((np.arange(lo, hi) for lo, hi in cuts(0, m, size)), m, memory) if not len(live) else live, 1
    while len(live) and span * 2 <= limit + 2:
        queue = Sorter(memory)
        for lo, hi in cuts(0, len(live), size):
            i = live[lo:hi]
            inside = i + span <= ends[np.searchsorted(ends, i)]
            second = np.where(inside, name[np.minimum(i + span, m - 1)] + 1, 0)
            queue.push(name[i].astype(np.uint64) << np.uint64(32) | second.astype(np.uint64), i)
        live, span = gathered(rename(name, queue, 32), len(live), memory), span * 2

    # places: of stars with one name, in the order of the text
    out = array(m, np.int64, memory)
    for lo, hi in cuts(0, m, size):
        out[name[lo:hi]] = star[lo:hi]
    queue = Sorter(memory)
    for lo, hi in cuts(0, len(live), size):
        i = np.sort(live[lo:hi]) if len(live) <= size else live[lo:hi]
        queue.push(name[i], i)
    place, last, begin = 0, None, 0
    for key, i in queue.popped():
        at = place + np.arange(len(key))
        begins = np.maximum.accumulate(np.where(np.concatenate([[key[0] == last], key[1:] == key[:-1]]), begin, at))
        out[key.astype(np.int64) + at - begins] = star[i]
        place, last, begin = place + len(key), key[-1], begins[-1]
    return out


class Scan:
    """What a scan has pushed, and what it needs to know the common prefix of what it pushes next."""

    def __init__(self, text: np.ndarray, s: np.ndarray, rising: bool, limit: int, memory: int):
        self.text, self.s, self.rising, self.limit = text, s, rising, limit
        self.queue = Queue(memory)
        self.since = np.full(256, -1, np.int64)  # for each byte, the least common prefix scanned since its last push; -1: none yet

    def visit(self, at: np.ndarray, common: np.ndarray) -> None:
        """Scan suffixes in order; common[i] is shared with the one scanned before. Push what precedes them."""
        if not len(at):
            return
        before = np.maximum(at - 1, 0)
        wanted = ~self.s[before] if self.rising else self.s[before] & (self.text[before] > 0)
        i = np.flatnonzero((at > 0) & wanted)
        before = at - 1
        low = int(common.min())
        if len(i):
            byte = self.text[before[i]]
            order = np.argsort(byte, kind="stable")
            i, byte = i[order], byte[order]
            first = np.concatenate([[True], byte[1:] != byte[:-1]])
            least = np.empty(len(i), np.int64)
            prefix = np.minimum.accumulate(common)
            since = self.since[byte[first]]
            least[first] = np.where(since < 0, -1, np.minimum(since, prefix[i[first]]))
            rest = np.flatnonzero(~first)
            left, right = i[rest - 1] + 1, i[rest]
            level = np.frexp((right - left + 1).astype(np.float64))[1] - 1
            table = common
            for k in range(int(level.max()) + 1 if len(rest) else 0):  # range minima, by doubling the range
                m = level == k
                least[rest[m]] = np.minimum(table[left[m]], table[right[m] - (1 << k) + 1])
                if len(table) > 1 << k:
                    table = np.minimum(table[: -(1 << k)], table[1 << k :])
            suffix = np.minimum.accumulate(common[::-1])[::-1]
            ends = np.flatnonzero(np.concatenate([first[1:], [True]]))
            pushed = byte[ends]
            others = np.ones(256, bool)
            others[pushed] = False
            self.since[others & (self.since >= 0)] = np.minimum(self.since[others & (self.since >= 0)], low)
            self.since[pushed] = np.where(i[ends] + 1 < len(common), suffix[np.minimum(i[ends] + 1, len(common) - 1)], self.limit)
            value = np.minimum(least + 1, self.limit).astype(np.uint8)
            begin = 0
            for e, c in zip(ends, pushed, strict=True):
                self.queue.push(int(c), before[i[begin : e + 1]], value[begin : e + 1])
                begin = e + 1
        else:
            self.since = np.where(self.since >= 0, np.minimum(self.since, low), -1)


def suffix_blocks(text: np.ndarray, limit: int = 100, memory: int = 16 << 20) -> Iterator[Block]:
    """text: segments of bytes 1..255 (or any with 0 only as terminator), each closed by 0. Positions in the order of their suffixes
    (of the first `limit` bytes at least), and the prefix each shares with the one before, up to limit; block by block."""
    n, size = len(text), block_size(memory)
    if not n:
        return
    s = kinds(text, memory)
    star = star_order(text, s, limit, memory)
    heads = np.zeros(257, np.int64)  # S* suffixes are in the order of their first bytes
    for lo, hi in cuts(0, len(star), size):
        heads[1:] += np.bincount(text[star[lo:hi]], minlength=256)
    bounds = np.cumsum(heads)
    n_large = n - sum(int(np.count_nonzero(s[lo:hi])) for lo, hi in cuts(0, n, 8 * size))
    seam = lambda a, b: int(shared(text, a, b, limit)[0]) if len(a) and len(b) else 0

    rising = Scan(text, s, True, limit, memory)
    large, large_common, place = array(n_large, np.int64, memory), array(n_large, np.uint8, memory), np.zeros(257, np.int64)
    for c in range(256):
        k = place[c]
        while (x := rising.queue.pop(c, size)) is not None:
            large[k : k + len(x[0])], large_common[k : k + len(x[0])] = x
            k += len(x[0])
            rising.visit(*x)
        place[c + 1] = k
        for lo, hi in cuts(bounds[c], bounds[c + 1], size):
            at = star[lo:hi]
            before = large[k - 1 : k] if k > place[c] else at[:0]
            first = seam(before, at[:1]) if lo == bounds[c] else seam(star[lo - 1 : lo], at[:1])
            rising.visit(at, np.concatenate([[first], shared(text, at[:-1], at[1:], limit)]).astype(np.uint8))
    rising.queue.close()

    falling = Scan(text, s, False, limit, memory)
    small, small_common, down = array(n - n_large, np.int64, memory), array(n - n_large, np.uint8, memory), np.zeros(257, np.int64)
    k = 0
    for c in range(255, -1, -1):
        down[c + 1] = k
        if c == 0:
            for lo, hi in reversed(list(cuts(bounds[0], bounds[1], size))):
                small[k : k + hi - lo] = star[lo:hi][::-1]
                k += hi - lo
            break
        while (x := falling.queue.pop(c, size)) is not None:
            small[k : k + len(x[0])], small_common[k : k + len(x[0])] = x
            k += len(x[0])
            falling.visit(*x)
        lo_c, hi_c = place[c], place[c + 1]
        for lo, hi in reversed(list(cuts(lo_c, hi_c, size))):  # each shares with the one after it what that one shares with it
            after = large_common[hi] if hi < hi_c else seam(small[k - 1 : k] if k > down[c + 1] else small[:0], large[hi - 1 : hi])
            falling.visit(large[lo:hi][::-1], np.append(large_common[lo + 1 : hi], np.uint8(after))[::-1])
    falling.queue.close()

    for c in range(256):
        for lo, hi in cuts(place[c], place[c + 1], size):
            yield large[lo:hi], large_common[lo:hi]
        begin, end = down[c + 1], (n - n_large if c == 0 else down[c])  # falling
        for lo, hi in reversed(list(cuts(begin, end, size))):
            before = small_common[hi] if hi < end else seam(large[place[c + 1] - 1 : place[c + 1]] if place[c + 1] > place[c] else large[:0], small[hi - 1 : hi])
            yield small[lo:hi][::-1], np.append(small_common[lo + 1 : hi], np.uint8(before))[::-1]


def suffix_order(text: np.ndarray, limit: int = 100, memory: int = 16 << 20) -> Block:
    """As one block."""
    parts = list(suffix_blocks(text, limit, memory))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.uint8))
