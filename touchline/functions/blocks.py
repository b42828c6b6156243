"""Similarity of many pairs of names at once: longest common blocks by bit-parallel matching.

For each pair, bit ``j`` of word ``i`` says that letter ``i`` of the first name is letter ``j`` of the second. Runs of
``k + 1`` letters are runs of ``k`` letters shifted by one and met with single ones, so the longest block of all pairs
is found in as many steps as it has letters; what is left and right of it is searched in the next round, all pairs
together. The share is that of ``difflib.SequenceMatcher`` in every case, ties included. Names of over 64 letters do not
fit a word and are compared by ``difflib`` itself.
"""

from __future__ import annotations

import difflib

import numpy as np

WORD = 64
#: Pairs that are worked on together, so that their words stay in the cache.
TOGETHER = 8192


class _Names:
    """All letters of the names one after the other, as code points."""

    def __init__(self, names: list[str]):
        self.sizes = np.fromiter(map(len, names), np.int64, len(names))
        self.first = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32)

    def letters(self, own: np.ndarray, filler: int) -> np.ndarray:
        """Letters x names; ``filler`` stands behind each name's end."""
        at = np.arange(self.sizes[own].max())[:, None]
        here = np.minimum(self.first[own] + at, len(self.flat) - 1)
        return np.where(at < self.sizes[own], self.flat[here], np.uint32(filler))


def _words(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    kind = np.uint32 if len(b) <= 32 else np.uint64
    words = np.zeros(a.shape, kind)
    for j, letter in enumerate(b):
        words |= (a == letter) * kind(1 << j)
    return words


def _lowest(n: np.ndarray, kind: type) -> np.ndarray:
    """Words of the ``n`` lowest bits."""
    bits = 8 * np.dtype(kind).itemsize
    return np.where(n > 0, kind(2**bits - 1) >> (bits - np.maximum(n, 1)).astype(kind), kind(0))


def _shared_letters(a: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Letters that both names have, each as often as in the one that has it less often: no less than what blocks can match."""
    own = _words(a, a)
    earlier = np.bitwise_count(own & _lowest(np.arange(len(a)), own.dtype.type)[:, None])
    return (earlier < np.bitwise_count(words)).sum(axis=0)


def _longest(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length and places of the longest run of each column; the first by place in the first name, then in the second."""
    n, one = words.shape[1], words.dtype.type(1)
    length, first, second = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    alive = np.flatnonzero(words.any(axis=0))
    words = now = words[:, alive]
    k = 1
    while len(alive):
        longer = np.zeros_like(now)
        longer[:-1] = words[:-1] & (now[1:] >> one)
        on = longer.any(axis=0)
        ended = np.flatnonzero(~on)
        if len(ended):
            at = (now[:, ended] != 0).argmax(axis=0)
            bits = now[at, ended]
            length[alive[ended]], first[alive[ended]] = k, at
            second[alive[ended]] = np.bitwise_count((bits & (~bits + one)) - one)
            alive, words, longer = alive[on], words[:, on], longer[:, on]
        now = longer
        k += 1
    return length, first, second


def _matched(words: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> np.ndarray:
    """Letters in common blocks of each pair."""
    total, kind = np.zeros(words.shape[1], np.int64), words.dtype.type
    pair = np.arange(words.shape[1])
    a0, a1, b0, b1 = np.zeros_like(sizes_a), sizes_a, np.zeros_like(sizes_b), sizes_b
    rows = np.arange(len(words))[:, None]
    while len(pair):
        inside = _lowest(b1, kind) & ~_lowest(b0, kind)
        length, i, j = _longest(np.where((rows >= a0) & (rows < a1), words[:, pair] & inside, kind(0)))
        np.add.at(total, pair, length)
        left = (length > 0) & (i > a0) & (j > b0)
        right = (length > 0) & (i + length < a1) & (j + length < b1)
        pair, a0, a1, b0, b1 = (
            np.concatenate(x)
            for x in (
                (pair[left], pair[right]),
                (a0[left], (i + length)[right]),
                (i[left], a1[right]),
                (b0[left], (j + length)[right]),
                (j[left], b1[right]),
            )
        )
    return total


def ratios(a: list[str], b: list[str], least: float = 0.0) -> np.ndarray:
    """Twice the letters in common blocks over all letters, for each pair; NaN where letters alone show that it is under ``least``."""
    out = np.full(len(a), np.nan)
    left, right = _Names(a), _Names(b)
    both = left.sizes + right.sizes
    out[both == 0] = 1.0
    short = np.maximum(left.sizes, right.sizes) <= WORD
    may = (both > 0) & (2.0 * np.minimum(left.sizes, right.sizes) / np.maximum(both, 1) >= least)
    for k in np.flatnonzero(may & ~short).tolist():
        out[k] = difflib.SequenceMatcher(None, a[k], b[k]).ratio()
    order = np.flatnonzero(may & short)
    order = order[np.argsort(left.sizes[order], kind="stable")]
    for lo in range(0, len(order), TOGETHER):
        own = order[lo : lo + TOGETHER]
        # two different fillers, neither of them a code point
        x = left.letters(own, 0xFFFFFFFF)
        words = _words(x, right.letters(own, 0xFFFFFFFE))
        if least > 0.0:
            on = 2.0 * _shared_letters(x, words) / both[own] >= least
            own, words = own[on], words[:, on]
        out[own] = 2.0 * _matched(words, left.sizes[own], right.sizes[own]) / both[own]
    return out
