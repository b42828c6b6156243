"""Benchmark decontamination by a prefix-filtered set join.

Every item gives its windows of ``size`` words (a shorter item is one window).
All of a window's shingles must stand in a text that holds the window, so its
necessary prefix is one shingle: the rarest over the whole corpus, by a first
pass that counts the items' shingles in all documents. The join looks up the
documents' shingles among these prefix shingles; a partner's place in its
window bounds where the window would begin, which must lie inside the text
(position and length bounds), and the words there are compared, first by hash,
then letter by letter.

The window index is broadcast in blocks of at most ``block_windows`` windows
(about 300 bytes each); a larger benchmark takes several blocks, one map over
the documents each, written before the next begins, so that one index at a time
is in memory. No document is ever shuffled.

Results by case: null texts, and texts without words, have no words and no
hits; items without words or without an id are passed over; equal items each
count under their id, repeated item rows once; an empty benchmark hits nothing;
repeated documents keep their rows; very long texts are searched whole; an empty
table gives an empty one; further columns are passed on, one called
like an output column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from touchline.llm._arrow import discard, map_columns, written
from touchline.llm._words import ALNUM, Words, sequence_hash, text_slices, window_hashes, words

SIZE = 13
SHINGLE = 4
BLOCK_WINDOWS = 100_000
_U = np.uint64

HITS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def item_windows(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """``item_id`` and each distinct window: ``words`` (its words' hashes, as bytes), ``spelled`` and ``spans`` (its letters, and how many each word has)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_slices(batch.column(1)):
                w = words(piece, ALNUM)
                ids, out = [], []
                spans = (w.ends - w.starts).astype(np.uint32)
                at = np.concatenate([[0], np.cumsum(spans, dtype=np.int64)])
                for k, n in enumerate(w.counts()):
                    lo = int(w.bounds[k])
                    windows = [(lo, lo + n)] if 0 < n < size else [(lo + i, lo + i + size) for i in range(n - size + 1)]
                    seen = dict.fromkeys((w.hashes[a:b].tobytes(), w.packed[at[a] : at[b]].tobytes(), spans[a:b].tobytes()) for a, b in windows)
                    ids += [batch.column(0)[piece.first + k].as_py()] * len(seen)
                    out += list(seen)
                columns = [pa.array([x[j] for x in out], pa.binary()) for j in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *columns], names=["item_id", "words", "spelled", "spans"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    return rows.mapInArrow(run, "item_id long, words binary, spelled binary, spans binary").distinct()


def _shingles(window: np.ndarray, shingle: int) -> list[int]:
    s = min(shingle, len(window))
    return [sequence_hash(window[i : i + s]) for i in range(len(window) - s + 1)]


class Index:
    """Windows of a block, to be found by their prefix shingle."""

    def __init__(self, rows: list[tuple[int, bytes, bytes, bytes]], counts: dict[int, int], shingle: int):
        by_words: dict[tuple[bytes, bytes, bytes], list[int]] = {}
        for item, *window in rows:
            by_words.setdefault(tuple(window), []).append(item)
        self.windows = [np.frombuffer(raw, _U) for raw, _, _ in by_words]
        self.spelled = [(letters, spans) for _, letters, spans in by_words]
        self.items = [np.array(sorted(set(x)), np.int64) for x in by_words.values()]
        self.lengths = np.array([len(w) for w in self.windows], np.int64)
        self.matrix = np.zeros((len(self.windows), int(self.lengths.max(initial=1))), _U)
        keyed: dict[int, list[tuple[int, int, int]]] = {}
        for k, w in enumerate(self.windows):
            self.matrix[k, : len(w)] = w
            found = _shingles(w, shingle)
            place = min(range(len(found)), key=lambda i: (counts.get(found[i], 0), found[i]))
            keyed.setdefault(min(shingle, len(w)), []).append((found[place], k, place))
        self.by_size = {}
        for s, entries in keyed.items():
            entries.sort()
            keys = np.array([e[0] for e in entries], _U)
            self.by_size[s] = (keys, _bitmap(keys), np.array([e[1] for e in entries], np.int64), np.array([e[2] for e in entries], np.int64))

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """First word and window of every occurrence in a slice."""
        starts, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        row_end = np.repeat(w.bounds[1:], w.counts())
        row_start = np.repeat(w.bounds[:-1], w.counts())
        for s, (keys, bitmap, window, place) in self.by_size.items():
            h, at = window_hashes(w, s)
            maybe = np.flatnonzero(bitmap[(h & _U(len(bitmap) - 1)).astype(np.int64)])
            h, at = h[maybe], at[maybe]
            lo, hi = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
            n = hi - lo
            at = np.repeat(at, n)
            entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            start, win = at - place[entry], window[entry]
            fits = (start >= row_start[at]) & (start + self.lengths[win] <= row_end[at])
            start, win = start[fits], win[fits]
            for a in range(0, len(start), 50_000):
                b, v = start[a : a + 50_000], win[a : a + 50_000]
                same = np.ones(len(b), bool)
                for j in range(self.matrix.shape[1]):
                    inside = j < self.lengths[v]
                    same &= ~inside | (w.hashes[np.minimum(b + j, len(w.hashes) - 1)] == self.matrix[v, j])
                starts.append(b[same])
                found.append(v[same])
        start, win = np.concatenate(starts), np.concatenate(found)
        if not len(start):
            return start, win
        spans = (w.ends - w.starts).astype(np.uint32)
        at = np.concatenate([[0], np.cumsum(spans, dtype=np.int64)])
        end = start + self.lengths[win]
        letters, lengths = w.packed.tobytes(), spans.tobytes()
        equal = np.array([(letters[i:j], lengths[4 * a : 4 * b]) == self.spelled[k] for i, j, a, b, k in zip(at[start].tolist(), at[end].tolist(), start.tolist(), end.tolist(), win.tolist())])
        return start[equal], win[equal]


def _bitmap(keys: np.ndarray) -> np.ndarray:
    """A table by a hash's low bits, sparse enough that few foreign hashes pass."""
    size = 1 << max(16, (16 * len(keys)).bit_length())
    table = np.zeros(size, bool)
    table[(keys & _U(size - 1)).astype(np.int64)] = True
    return table


def shingle_counts(docs: DataFrame, by_size: dict[int, np.ndarray], text: str = "text") -> dict[int, int]:
    """How often each of the given shingles (sorted hashes by size) occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast({s: (keys, _bitmap(keys)) for s, keys in by_size.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {s: np.zeros(len(keys), np.int64) for s, (keys, _) in shared.value.items()}
        for batch in batches:
            for piece in text_slices(batch.column(0)):
                w = words(piece, ALNUM)
                for s, (keys, bitmap) in shared.value.items():
                    h, _ = window_hashes(w, s)
                    h = h[bitmap[(h & _U(len(bitmap) - 1)).astype(np.int64)]]
                    at = np.searchsorted(keys, h)
                    at[at == len(keys)] = 0
                    totals[s] += np.bincount(at[keys[at] == h], minlength=len(keys))
        for s, (keys, _) in shared.value.items():
            some = totals[s] > 0
            yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(totals[s][some])], names=["shingle", "n"])

    parts = docs.select(F.col(text).cast("string").alias(text)).mapInArrow(run, "shingle long, n long")
    # at most as many rows as the block has shingles
    return {r["shingle"] & (2**64 - 1): r["n"] for r in parts.groupBy("shingle").agg(F.sum("n").alias("n")).collect()}


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, shingle: int = SHINGLE, block_windows: int = BLOCK_WINDOWS, text: str = "text") -> DataFrame:
    """Adds ``n_words``, ``hits`` (ranges of words inside an occurrence) and ``items`` (ids that occur, sorted)."""
    windows = written(item_windows(benchmark, size), "benchmark-windows")
    blocks = max(1, -(-windows.count() // block_windows))
    out, before = docs, None
    for b in range(blocks):
        part = windows if blocks == 1 else windows.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == b)
        rows = [(r["item_id"], bytes(r["words"]), bytes(r["spelled"]), bytes(r["spans"])) for r in part.collect()]  # about block_windows rows
        wanted: dict[int, set[int]] = {}
        for _, raw, _, _ in rows:
            w = np.frombuffer(raw, _U)
            wanted.setdefault(min(shingle, len(w)), set()).update(_shingles(w, shingle))
        counts = shingle_counts(docs, {s: np.array(sorted(x), _U) for s, x in wanted.items()}, text) if rows else {}
        out = _with_hits(out, Index(rows, counts, shingle), text, first=not b)
        if b < blocks - 1:
            out = written(out, "decontaminated")
            if before is not None:
                discard(before)
            before = out
    discard(windows)
    return out


def _with_hits(docs: DataFrame, index: Index, text: str, first: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batch: pa.RecordBatch) -> Iterator:
        ix = shared.value
        before = None if first else [batch.column(batch.schema.get_field_index(c)) for c in ("hits", "items")]
        for piece in text_slices(batch.column(batch.schema.get_field_index(text))):
            w = words(piece, ALNUM)
            start, window = ix.hits(w)
            end = start + ix.lengths[window]
            hits: list[list] = [[] for _ in range(piece.rows)]
            items: list[list[int]] = [[] for _ in range(piece.rows)]
            row = np.searchsorted(w.bounds, start, "right") - 1
            if before is not None:
                for k in range(piece.rows):
                    hits[k] = [(x["start"], x["end"]) for x in before[0][piece.first + k].as_py()]
                    items[k] = before[1][piece.first + k].as_py()
            touched = np.unique(row)
            for k in touched.tolist():
                own = row == k
                base = int(w.bounds[k])
                spans = sorted(hits[k] + list(zip((start[own] - base).tolist(), (end[own] - base).tolist())))
                merged = [list(spans[0])]
                for a, b in spans[1:]:
                    if a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                hits[k] = merged
                ids = np.unique(np.concatenate([ix.items[x] for x in np.unique(window[own])]))
                items[k] = sorted({*items[k], *ids.tolist()})
            arrays = [
                pa.array(w.counts().astype(np.int64)),
                pa.array([[{"start": a, "end": b} for a, b in x] for x in hits], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array(items, pa.list_(pa.int64())),
            ]
            yield piece.first, piece.first + piece.rows, arrays

    fields = [T.StructField("n_words", T.LongType()), T.StructField("hits", HITS), T.StructField("items", T.ArrayType(T.LongType()))]
    return map_columns(docs, run, fields)


def verdict(annotated: DataFrame) -> DataFrame:
    """``n_hit`` and ``contaminated``: at least a twentieth of the words are hit."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x.end - x.start)
    return annotated.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def digests(annotated: DataFrame) -> DataFrame:
    ids = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return verdict(annotated).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), "contaminated"
    )
