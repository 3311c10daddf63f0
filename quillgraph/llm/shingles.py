"""Word shingles of texts as sorted arrays of 64-bit hashes, by numpy over the bytes of a text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))  # A-Z to a-z
WHITE = np.isin(np.arange(256), [32, *range(9, 14)])
R = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_inverse = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
PART = 1 << 20  # bytes of a text handled at a time


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > 4 * PART:  # of one very long word: not kept
        return tuple(np.cumprod(np.append(np.uint64(1), np.full(n, base, np.uint64)), dtype=np.uint64)[: n + k] for k, base in enumerate((R, _inverse)))
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        for k, base in enumerate((R, _inverse)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """Of the words between white space (space, tab to carriage return), with A-Z lowered."""
    b = np.frombuffer(text.encode().translate(LOWER), np.uint8)
    return np.concatenate([np.zeros(0, np.uint64), *map(hashes_of, parts(b))])


def parts(b: np.ndarray) -> Iterator[np.ndarray]:
    """b in parts of about PART bytes, cut before white space."""
    lo = 0
    while lo < len(b):
        at = lo + PART
        while at < len(b) and not (near := WHITE[b[at : at + PART]]).any():
            at += PART
        at = at + int(near.argmax()) if at < len(b) else len(b)
        yield b[lo:at]
        lo = at


def hashes_of(b: np.ndarray) -> np.ndarray:
    white = np.ones(len(b) + 2, bool)
    white[1:-1] = WHITE[b]
    turn = np.flatnonzero(white[1:] != white[:-1])
    start, end = turn[::2], turn[1::2]
    p, inverse = powers(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * p[:-1], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * R)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of so many words; of fewer words, the hash of them all; of none, empty."""
    h = word_hashes(text or "")
    if not len(h):
        return h
    k = min(words, len(h))
    s = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        s = mix(s * R + h[j : j + len(s)])
    return np.unique(s)
