"""SentencePiece (BPE with byte fallback) encoding and decoding in numpy.

Encoding runs in merge rounds over flat symbol arrays: all distinct words of a
batch lie one after the other; each round looks up the rank of every adjacent
pair, takes the least rank of each word (a segmented minimum), merges its
occurrences from the left at once and compacts the arrays, until no pair is
left. A merged piece that could take part in a pair of equal or better rank is
*unstable*: of such a piece only the leftmost occurrence is merged in a round,
which keeps the result equal to merging one pair at a time.

Words (a run of spaces and what follows up to the next space) are encoded once
for each worker; no piece of the vocabulary crosses their bounds.

Results by case: null and empty texts give the end id only and decode to the
empty text; U+2581 in a text counts as a space, as it does in the library;
characters outside the vocabulary become byte pieces; repeated rows each keep
their row; any further columns, whatever their names, are passed on untouched
unless they are called like an output column, which is then replaced.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from touchline.llm._arrow import map_columns

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: A worker keeps at most so many encoded words, then starts anew.
CACHED_WORDS = 600_000
#: Texts of so many characters together are encoded at a time.
BATCH_CHARS = 1 << 20
_NO_RANK = np.int32(2**31 - 1)
_SPREAD = np.int64(0x1E3779B97F4A7C15)


def _fields(raw: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """The fields of one protocol-buffer message: number and raw value."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value, at
            shift += 7

    at = 0
    while at < len(raw):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            n, at = varint(at)
            value, at = raw[at : at + n], at + n
        else:
            n = 8 if kind == 1 else 4
            value, at = raw[at : at + n], at + n
        yield tag >> 3, value


class PieceModel:
    """The vocabulary of a model file, laid out for array look-ups."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = memoryview(f.read())
        self.pieces: list[str] = []
        scores, kinds = [], []
        prefix = True
        for number, value in _fields(raw):
            if number == 1:
                piece = {n: v for n, v in _fields(value)}
                self.pieces.append(bytes(piece[1]).decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, NORMAL))
            elif number == 3:
                spec = dict(_fields(value))
                if bytes(spec.get(1, b"identity")) != b"identity" or spec.get(4, 1):
                    raise ValueError("only models without normalisation are supported")
                prefix = bool(spec.get(3, 1))
        if not prefix:
            raise ValueError("only models with a leading space are supported")
        self.kinds = np.array(kinds)
        self.unk = kinds.index(UNKNOWN)
        self.end = self.pieces.index("</s>")
        ids = {p: i for i, p in enumerate(self.pieces) if kinds[i] in (NORMAL, USER_DEFINED)}
        if any(SPACE in p.lstrip(SPACE) for p in ids):
            raise ValueError("pieces that cross word bounds are not supported")
        self.bytes_from = [0] * 256
        for i, p in enumerate(self.pieces):
            if kinds[i] == BYTE:
                self.bytes_from[int(p[3:5], 16)] = i
        n = len(self.pieces)
        order = sorted({scores[i] for i in ids.values()}, reverse=True)
        place = {s: k for k, s in enumerate(order)}
        self.rank = np.full(n + 1, _NO_RANK, np.int32)
        self.rank[list(ids.values())] = [place[scores[i]] for i in ids.values()]

        # Symbols: ids of pieces, then one for each further character met.
        self.chars = {p: i for p, i in ids.items() if len(p) == 1}
        keys, merged = [], []
        unstable = np.zeros(n + 1, bool)
        for piece, whole in ids.items():
            for cut in range(1, len(piece)):
                left, right = ids.get(piece[:cut]), ids.get(piece[cut:])
                if left is not None and right is not None:
                    keys.append(left * n + right)
                    merged.append(whole)
                    for part in (left, right):
                        if len(self.pieces[part]) > 1 and self.rank[whole] <= self.rank[part]:
                            unstable[part] = True
        # pairs in an open-addressing table: key left * size + right, value the piece they form
        bits = max(18, (4 * len(keys)).bit_length())
        self.slot_mask = (1 << min(bits, 20)) - 1
        self.slot_keys = np.full(self.slot_mask + 1, -2, np.int64)
        self.slot_ids = np.full(self.slot_mask + 1, n, np.int32)
        self.longest_probe = 1
        with np.errstate(over="ignore"):
            homes = ((np.array(keys, np.int64) * _SPREAD) >> 44) & self.slot_mask
        for key, whole, home in zip(keys, merged, homes.tolist()):
            step = 0
            while self.slot_keys[(home + step) & self.slot_mask] >= 0:
                step += 1
            self.slot_keys[(home + step) & self.slot_mask] = key
            self.slot_ids[(home + step) & self.slot_mask] = whole
            self.longest_probe = max(self.longest_probe, step + 1)
        self.bmp = np.arange(1 << 16, dtype=np.uint32) + np.uint32(n)
        for c, i in self.chars.items():
            if ord(c) < 1 << 16:
                self.bmp[ord(c)] = i
        self.unstable = unstable
        self.size = n

        # Decoding: the bytes of each piece.
        outs = []
        for i, p in enumerate(self.pieces):
            if kinds[i] == BYTE:
                outs.append(bytes([int(p[3:5], 16)]))
            elif kinds[i] == CONTROL:
                outs.append(b"")
            elif kinds[i] == UNKNOWN:
                outs.append(" ⁇ ".encode())
            else:
                outs.append(p.replace(SPACE, " ").encode())
        self.out_len = np.array([len(x) for x in outs], np.int64)
        self.out_at = np.concatenate([[0], np.cumsum(self.out_len)[:-1]])
        self.out = np.frombuffer(b"".join(outs), np.uint8)
        self.leads_space = np.array([p.startswith(SPACE) and kinds[i] in (NORMAL, USER_DEFINED) for i, p in enumerate(self.pieces)])
        self.cache: dict[str, bytes] = {}

    # -- encoding ---------------------------------------------------------

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols form, or ``size`` where they form none."""
        key = left.astype(np.int64) * self.size + right
        key[(left >= self.size) | (right >= self.size)] = -1
        slot = ((key * _SPREAD) >> 44) & self.slot_mask
        whole = np.full(len(key), self.size, np.int32)
        for step in range(self.longest_probe):
            place = (slot + step) & self.slot_mask
            np.copyto(whole, self.slot_ids[place], where=self.slot_keys[place] == key)
        return whole

    def merge_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word (its spaces written as U+2581), as int32 bytes."""
        if not words:
            return []
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        # A character without a piece is the symbol size + code point.
        symbols = np.where(points < 1 << 16, self.bmp[points & 0xFFFF], points + np.uint32(self.size)).astype(np.int32)
        for c in np.unique(points[points >= 1 << 16]):
            if chr(c) in self.chars:
                symbols[points == c] = self.chars[chr(c)]
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        # whole[i]: the piece of the pair that starts at i; the last symbol of a word starts none
        whole = np.full(len(symbols), self.size, np.int32)
        inner = np.flatnonzero(word[1:] == word[:-1])
        whole[inner] = self._pair(symbols[inner], symbols[inner + 1])
        piece = np.empty(len(words), np.int32)
        only = np.empty(len(words), bool)
        done_symbols, done_word = [], []
        while len(symbols):
            rank = self.rank[whole]
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, first)
            size = np.diff(np.r_[first, len(word)])
            open_words = least != _NO_RANK
            if not open_words.all():
                # words without a pair are finished
                still = np.repeat(open_words, size)
                done_symbols.append(symbols[~still])
                done_word.append(word[~still])
                symbols, word, whole, rank = symbols[still], word[still], whole[still], rank[still]
                least, size = least[open_words], size[open_words]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == np.repeat(least, size))
            # the leftmost best pair of each word decides the piece of this round
            owner = word[at]
            is_head = np.r_[True, owner[1:] != owner[:-1]]
            head = at[is_head]
            piece[word[head]] = whole[head]
            only[word[head]] = self.unstable[whole[head]]
            at = at[(whole[at] == piece[owner]) & (is_head | ~only[owner])]
            # leftmost of overlapping pairs: every other one of a run of neighbours
            run = np.r_[True, at[1:] != at[:-1] + 1]
            start = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - start) % 2 == 0]
            symbols[at] = whole[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            now = at - np.arange(len(at))  # where the merged symbols stand after compaction
            symbols, word, whole = symbols[keep], word[keep], whole[keep]
            # only pairs that touch a merged symbol have changed
            near = np.zeros(len(symbols), bool)
            near[now] = True
            near[np.maximum(now - 1, 0)] = True
            whole[near] = self.size
            near[:-1] &= word[1:] == word[:-1]
            near[-1] = False
            touched = np.flatnonzero(near)
            whole[touched] = self._pair(symbols[touched], symbols[touched + 1])
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_word)
        by = np.argsort(word, kind="stable")
        symbols, word = symbols[by], word[by]
        strange = symbols >= self.size
        if strange.any():
            spread: list[int] = []
            counts = np.ones(len(symbols), np.int64)
            for k in np.flatnonzero(strange):
                counts[k] = len(chr(symbols[k] - self.size).encode())
            out = np.repeat(symbols, counts)
            for k in np.flatnonzero(strange):
                spread += [self.bytes_from[b] for b in chr(symbols[k] - self.size).encode()]
            out[np.repeat(strange, counts)] = spread
            symbols, word = out, np.repeat(word, counts)
        raw = symbols.astype("<i4").tobytes()
        cuts = (np.searchsorted(word, np.arange(len(words) + 1)) * 4).tolist()
        return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def split(self, text: str) -> list[str]:
        """The words of a text, each without the one space before it.

        ``" a  b"`` gives ``[SPACE + "a", SPACE + "b"]``: what is left out is the
        first space of each word, the leading one that the model adds included.
        """
        if SPACE not in text and "  " not in text and text[:1] != " " and text[-1:] != " ":
            return text.split(" ") if text else []
        spaced = (SPACE + text.replace(" ", SPACE)) if text else ""
        return [x[1:] for x in re.findall(f"{SPACE}+[^{SPACE}]*", spaced)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids (each text's end id included) and the n + 1 offsets."""
        cache = self.cache
        if len(cache) > CACHED_WORDS:
            cache.clear()
        end = struct.pack("<i", self.end)
        split = [self.split(t) for t in texts]
        found = [list(map(cache.get, ws)) for ws in split]
        short = [k for k, got in enumerate(found) if None in got]
        if short:
            missing = list(dict.fromkeys(w for k in short for w, x in zip(split[k], found[k]) if x is None))
            cache.update(zip(missing, self.merge_words([SPACE + w for w in missing])))
            for k in short:
                found[k] = [cache[w] for w in split[k]]
        rows = [b"".join(got) + end for got in found]
        offsets = np.zeros(len(rows) + 1, np.int64)
        np.cumsum([len(r) // 4 for r in rows], out=offsets[1:])
        return np.frombuffer(b"".join(rows), "<i4"), offsets

    # -- decoding ---------------------------------------------------------

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The UTF-8 bytes of all rows and the n + 1 offsets. Ill-formed byte pieces give U+FFFD."""
        ids = np.asarray(ids, np.int64)
        lengths, at = self.out_len[ids], self.out_at[ids].copy()
        # the space that encoding puts before a text is taken off again
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        seen = np.flatnonzero(self.kinds[ids] != CONTROL)
        if len(seen):
            lead = seen[np.r_[True, row[seen][1:] != row[seen][:-1]]]
            lead = lead[self.leads_space[ids[lead]]]
            lengths = lengths.copy()
            lengths[lead] -= 1
            at[lead] += 1
        total = np.concatenate([[0], np.cumsum(lengths)])
        where = np.arange(total[-1]) + np.repeat(at - total[:-1], lengths)
        data, bounds = self.out[where], total[offsets]
        try:
            bytes(data).decode()
            return data, bounds
        except UnicodeDecodeError:
            rows = [_lenient(bytes(data[a:b])).encode() for a, b in zip(bounds[:-1], bounds[1:])]
            return np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)


def _lenient(raw: bytes) -> str:
    """Decodes UTF-8; each byte that starts no character becomes U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def _batches(column: pa.Array) -> Iterator[tuple[int, int]]:
    sizes = np.cumsum(pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + BATCH_CHARS, "right")))
        yield lo, hi
        lo = hi


def encode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds ``ids`` (array of int): the pieces of the whole text, then the end id."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        column = batch.column(batch.schema.get_field_index(text))
        for lo, hi in _batches(column):
            flat, offsets = m.encode([t or "" for t in column.slice(lo, hi - lo).to_pylist()])
            yield lo, hi, [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))]

    return map_columns(docs, run, [T.StructField(ids, T.ArrayType(T.IntegerType()))])


def decode(encoded: DataFrame, model_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds ``decoded``: the text that the ids stand for. Null ids give the empty text."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        column = batch.column(batch.schema.get_field_index(ids))
        step = 256
        for lo in range(0, len(column), step):
            part = column.slice(lo, step)
            lengths = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
            data, bounds = m.decode(pc.list_flatten(part).to_numpy(zero_copy_only=False), offsets)
            texts = pa.LargeStringArray.from_buffers(len(part), pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes()))
            yield lo, lo + len(part), [texts.cast(pa.string())]

    return map_columns(encoded, run, [T.StructField(decoded, T.StringType())])


def round_trip(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """Encodes and decodes in one pass over the data: adds ``ids`` and ``decoded``."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        column = batch.column(batch.schema.get_field_index(text))
        for lo, hi in _batches(column):
            flat, offsets = m.encode([t or "" for t in column.slice(lo, hi - lo).to_pylist()])
            data, bounds = m.decode(flat, offsets)
            texts = pa.LargeStringArray.from_buffers(hi - lo, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes()))
            yield lo, hi, [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat)), texts.cast(pa.string())]

    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    return map_columns(docs, run, fields)


def digests(round_tripped: DataFrame, *more: str) -> DataFrame:
    """Per document: how many ids, and digests of the ids and of the decoded text; ``more`` names columns to keep."""
    spelled = F.array_join(F.col("ids").cast("array<string>"), " ")
    return round_tripped.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(spelled, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *more,
    )
