"""Vectorised text kernel shared by the corpus operators.

Everything works on the UTF-8 bytes of an Arrow string column, a slice of about
a megabyte at a time, so that a worker's memory does not depend on the batch.
A text is never cut: a slice always ends at a text's end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_U = np.uint64
#: A random code for each byte at each of the first places of a word; further places multiply them.
_PLACES = 32
_CODES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, _PLACES * 256, dtype=np.uint64) << _U(1) | _U(1)
#: Odd factors by the place of a word in a window; more are drawn as needed.
_PLACE_FACTORS = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 63, 4096, dtype=np.uint64) | _U(1)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table over bytes that is True inside the given inclusive ranges."""
    table = np.zeros(256, bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


#: Words are what stands between white space (space and 0x09-0x0D).
SPACED = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Words are digits, letters and everything beyond ASCII (after lower-casing).
ALNUM = ~byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole 64-bit word."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


@dataclass
class TextSlice:
    """Rows ``first .. first + rows`` of a batch: their bytes and where each begins."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def text_slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[TextSlice]:
    """Cuts a string column into slices of about ``limit`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield TextSlice(lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def span_hashes(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of non-empty words that stand one after the other in ``data``, by a random code for each byte and place."""
    if not len(lengths):
        return np.zeros(0, _U)
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(data), dtype=np.int32) - np.repeat(starts.astype(np.int32), lengths)
    with np.errstate(over="ignore"):
        codes = _CODES[(place & (_PLACES - 1)) << 8 | data]
        if lengths.max() > _PLACES:
            codes = mix(codes ^ mix((place // _PLACES).astype(_U) * _U(0xD6E8FEB86659FD93)))
            # short words keep the hash that they have among short ones
            short = np.repeat(lengths <= _PLACES, lengths)
            codes[short] = _CODES[(place[short] & (_PLACES - 1)) << 8 | data[short]]
        return mix(np.add.reduceat(codes, starts) + lengths.astype(_U) * _U(0xD6E8FEB86659FD93))


@dataclass
class Words:
    """Word bounds in a slice, a 64-bit hash of each word, and each row's first word."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray
    lowered: np.ndarray
    #: The words' bytes, one word behind the other.
    packed: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())


def words(piece: TextSlice, inside: np.ndarray = SPACED) -> Words:
    """Lower-cases A-Z, finds the words (maximal runs of ``inside``) and hashes them."""
    data = _LOWER[piece.data]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, _U), np.zeros(piece.rows + 1, np.int64), data, data)
    is_word = inside[data]
    edge = np.ones(n + 1, bool)
    edge[1:-1] = is_word[1:] != is_word[:-1]
    inner = piece.offsets[1:-1]
    edge[inner] = True  # a word ends where its text ends
    cuts = np.flatnonzero(edge)
    keep = is_word[cuts[:-1]]
    starts, ends = cuts[:-1][keep], cuts[1:][keep]
    packed = data[is_word]
    hashes = span_hashes(packed, ends - starts)
    return Words(starts, ends, hashes, np.searchsorted(starts, piece.offsets), data, packed)


def window_hashes(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside a row, and the first word of each."""
    n = len(w.hashes)
    if n < size:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        total = np.zeros(n - size + 1, _U)
        for k in range(size):
            total += w.hashes[k : n - size + 1 + k] * _PLACE_FACTORS[k]
        total = mix(total + _U(size))
    last = np.repeat(w.bounds[1:], w.counts())[: n - size + 1]
    at = np.flatnonzero(np.arange(size, n + 1) <= last)
    return total[at], at


def sequence_hash(hashes: np.ndarray) -> int:
    """The hash that ``window_hashes`` gives a run of exactly these words."""
    with np.errstate(over="ignore"):
        total = (hashes * _PLACE_FACTORS[: len(hashes)]).sum(dtype=_U) + _U(len(hashes))
    return int(mix(np.array([total], _U))[0])


def shingle_sets(w: Words, size: int) -> Iterator[np.ndarray]:
    """Per row the sorted distinct shingle hashes.

    A row with fewer than ``size`` words has its whole word sequence as its one
    shingle; a row without words has none.
    """
    hashes, at = window_hashes(w, size)
    cut = np.searchsorted(at, w.bounds)
    for k, n in enumerate(w.counts()):
        if n >= size:
            yield np.unique(hashes[cut[k] : cut[k + 1]])
        elif n:
            yield np.array([sequence_hash(w.hashes[w.bounds[k] : w.bounds[k + 1]])], _U)
        else:
            yield np.zeros(0, _U)
