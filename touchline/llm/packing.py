"""Packing documents into sequences of a fixed size by cutting-stock column generation.

A document's token ids are cut at every ``SIZE``; whole cuts are sequences of their
own. What remains of each document has a length below ``SIZE``, and only the
histogram of these lengths, at most 2047 numbers, reaches the driver. There a
linear program finds how often to use which pattern of lengths:

* a pattern fills a sequence exactly, at ``SIZE`` or at a smaller power of two, where
  a sequence needs no padding (``SHORT`` is the price of such a small one);
* a document that no pattern takes is laid end to end with the others left and cut
  where a sequence ends, at the price of its tokens;
* the restricted program is solved by the revised simplex method; a knapsack over
  the duals, by dynamic programming over totals, prices new patterns, the best
  ones for many lengths at once, until none improves it or after ``PIVOTS``.

Counts of patterns are rounded down, then up where documents are left. Documents of
a length are ranked by slice (the partition that read them) and place in it; a
pattern takes a range of ranks, and so a document finds its sequence and offset by
arithmetic from its rank, without a shuffle of texts or a group of any length, however
many documents share it. Those left are placed by arithmetic as well. So no
sequence has padding: the last of those left are cut to powers of two.

Results by case: null and empty texts are the end id alone; repeated rows and rows
without an id are documents of their own; a very long text is one row of one task;
further columns are left out; an empty table gives no pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from touchline.llm._arrow import written

#: Tokens of a sequence, and the id that ends a document.
SIZE, END = 2048, 1
#: Price of a sequence at a smaller power of two, in tokens.
SHORT = 16.0
#: Rounds of pricing and pivots, patterns tried in a round, and the least gain that is still an improvement, in tokens.
ROUNDS, PIVOTS, TRIED, LEAST_GAIN = 100, 3000, 600, 1.0
#: Rows (slice, length) whose first ranks are broadcast, about 24 bytes each; beyond, they are joined by a shuffle.
MOST_BROADCAST = 500_000
#: Words whose ids a worker keeps, and bytes of text whose words are looked up at once.
CACHE_WORDS, TEXT_BYTES = 1_000_000, 1 << 20


# -- tokens --------------------------------------------------------------------


#: Between an ASCII letter and ASCII punctuation or a digit the vocabulary never joins either; but an apostrophe may begin an ending.
PARTS = re.compile(rb"(?<=[A-Za-z])(?=[!-&(-@[-`{-~])|(?<=[!-&(-@[-`{-~])(?=[A-Za-z])")
#: Special tokens are spelled with it, so such words are not taken apart.
SPECIAL = b"<|"
#: New words that go through the tokenizer as one text.
AT_ONCE = 512


class WordIds(dict):
    """Ids of words as packed integers; new words go through the tokenizer, many at once. It never joins over ASCII white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.end = np.array([END], self.kind).tobytes()
        closing = self.tokenizer.model.end_of_word_suffix
        vocabulary = self.tokenizer.get_vocab()
        #: Ids that end a run of letters, where the vocabulary marks them.
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        if closing:
            self.closes[[i for t, i in vocabulary.items() if t.endswith(closing)]] = True

    def learn(self, new: set[bytes]) -> None:
        """Keeps the ids of new words."""
        letters, others, composed = set(), set(), []
        for w in new:
            # letters of either case have the same ids; only ASCII is lowered here, as composing comes before lowering
            own = [w.lower()] if w.isalpha() else [w] if SPECIAL in w else [p.lower() if p.isascii() else p for p in PARTS.split(w)]
            for p in own:
                if p not in self:
                    (letters if p.isalpha() or p.decode().isalpha() else others).add(p)
            if len(own) > 1 or own[0] != w:
                composed.append((w, own))
        for group, one_each in ((list(letters), True), (list(others), False)):
            for at in range(0, len(group), AT_ONCE):
                words = group[at : at + AT_ONCE]
                if not (one_each and self._letters(words)):
                    self._any(words)
        for w, own in composed:
            self[w] = self[own[0]] if len(own) == 1 else b"".join([self[p] for p in own])

    def _keep(self, words: list[bytes], ids: np.ndarray, cuts: list[int]) -> None:
        raw, size = ids.astype(self.kind).tobytes(), self.kind.itemsize
        cuts = [c * size for c in cuts]
        self.update(zip(words, [raw[a:b] for a, b in zip(cuts, cuts[1:])]))

    def _letters(self, words: list[bytes]) -> bool:
        """Words of letters alone, told apart by the ids that end one; False if these are not one each."""
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, np.int64)
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return False
        self._keep(words, ids, [0, *ends.tolist()])
        return True

    def _any(self, words: list[bytes]) -> None:
        """Any words, told apart by their places in the text."""
        spelled = [w.decode() for w in words]
        starts = np.cumsum([0, *[len(w) + 1 for w in spelled]])
        coded = self.tokenizer.encode(" ".join(spelled), add_special_tokens=False)
        begins = np.array([a for a, _ in coded.offsets], np.int64)
        self._keep(words, np.array(coded.ids, np.int64), np.searchsorted(begins, starts).tolist())

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids and the end id of each of some texts, about a megabyte of them."""
        if len(self) > CACHE_WORDS:
            self.clear()
        words = [t.split() for t in texts]
        found = [list(map(self.get, own)) for own in words]
        lost = [[k for k, x in enumerate(got) if x is None] for got in found]
        self.learn({own[k] for own, at in zip(words, lost) for k in at})
        for own, got, at in zip(words, found, lost):
            for k in at:
                got[k] = self[own[k]]
            got.append(self.end)
        return [b"".join(got) for got in found]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


TOKENS = "slice int, doc_id long, ids binary, width int, n long, rest int, rank long, blocks_before long"


def tokens(docs: DataFrame, path: str) -> DataFrame:
    """Written ids of each document with its rank among those of its slice with an equal rest, and the whole cuts before it there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, words = TaskContext.get().partitionId(), word_ids(path)
        width = words.kind.itemsize
        seen, blocks = np.zeros(SIZE, np.int64), 0
        for b in batches:
            texts = b.column(1).cast(pa.large_binary())
            sizes = np.cumsum(pc.binary_length(texts).to_numpy())
            at = 0
            while at < b.num_rows:
                until = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + TEXT_BYTES)))
                some = texts.slice(at, until - at).to_pylist()
                out = []
                for doc, ids in zip(b.column(0).slice(at, until - at).to_pylist(), words.encode(some)):
                    n = len(ids) // width
                    rest = n % SIZE
                    out.append((number, doc, ids, width, n, rest, int(seen[rest]), blocks))
                    seen[rest] += 1
                    blocks += n // SIZE
                yield _batch(out, TOKENS)
                at = until

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return written(rows.mapInArrow(run, TOKENS), "pack-tokens")


_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), _KINDS[k]) for c, (_, k) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


# -- patterns --------------------------------------------------------------------


def powers(size: int = SIZE) -> list[int]:
    return [1 << k for k in range(size.bit_length() - 1)]


def knapsack(lengths: np.ndarray, values: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """For each total, the most that lengths of that very sum are worth, and the one to take first (-1: no such sum)."""
    best, take = np.full(size + 1, -np.inf), np.full(size + 1, -1, np.int64)
    best[0] = 0.0
    upto = np.searchsorted(lengths, np.arange(size + 1), "right")
    for t in range(1, size + 1):
        k = upto[t]
        if k:
            worth = best[t - lengths[:k]] + values[:k]
            j = int(worth.argmax())
            best[t], take[t] = worth[j], j if worth[j] > -np.inf else -1
    return best, take


def _trace(total: int, lengths: np.ndarray, take: np.ndarray) -> dict[int, int]:
    counts: dict[int, int] = {}
    while total:
        j = int(take[total])
        counts[j] = counts.get(j, 0) + 1
        total -= int(lengths[j])
    return counts


class Program:
    """The restricted linear program: patterns, each with a price, that use no more documents of a length than there are.

    What patterns leave of a length costs its tokens. The basis is kept as its
    inverse; a pivot changes only the rows and columns that it meets.
    """

    def __init__(self, lengths: np.ndarray, demand: np.ndarray):
        m = len(lengths)
        self.lengths = lengths
        self.inverse = np.eye(m)
        # a little noise, so that no pivot moves nothing and the first knapsacks' equal fillings differ
        self.noise = np.random.default_rng(3)
        self.level = demand + self.noise.random(m) * 1e-3
        self.duals = lengths.astype(float)
        self.basis: list[tuple[dict[int, int], float] | None] = [None] * m

    def gain(self, pattern: dict[int, int], price: float) -> float:
        return sum(self.duals[j] * a for j, a in pattern.items()) - price

    def enter(self, pattern: dict[int, int], price: float, leaves: bool = False) -> bool:
        """Takes a pattern into the basis if it gains; ``leaves``: it stands for leaving one document out."""
        gain = self.gain(pattern, price)
        if gain < LEAST_GAIN:
            return False
        d = self.inverse[:, list(pattern)] @ np.fromiter(pattern.values(), float)
        up = np.flatnonzero(d > 1e-9)
        if not len(up):
            return False
        out = up[np.argmin(self.level[up] / d[up])]
        step = self.level[out] / d[out]
        rows, cols = np.flatnonzero(np.abs(d) > 1e-12), np.flatnonzero(self.inverse[out])
        line = self.inverse[out, cols] / d[out]
        self.duals[cols] -= gain * line
        rows = rows[rows != out]
        self.inverse[np.ix_(rows, cols)] -= np.outer(d[rows], line)
        self.inverse[out, cols] = line
        self.level[rows] -= step * d[rows]
        self.level[out] = step
        np.maximum(self.level, 0.0, out=self.level)
        self.basis[out] = None if leaves else (pattern, price)
        return True

    def solve(self, rounds: int = ROUNDS, size: int = SIZE) -> int:
        """Generates patterns until none gains or ``PIVOTS`` are made; the number of rounds that took."""
        pivots = 0
        for r in range(rounds):
            entered = 0
            for j in np.flatnonzero(self.duals - self.lengths >= LEAST_GAIN).tolist():
                entered += self.enter({j: 1}, float(self.lengths[j]), True)
            duals = np.minimum(self.duals, self.lengths)
            # of equal fillings, one of few documents: short ones are kept for where nothing else fits
            best, take = knapsack(self.lengths, duals * (1 + 1e-6 * self.noise.random(len(self.lengths))) - 0.01, size)
            # the best full pattern that begins with each length, and the best at each power of two
            rest = size - self.lengths
            gains = best[rest] + duals
            for j in np.argsort(-gains, kind="stable")[:TRIED].tolist():
                if gains[j] < LEAST_GAIN / 2:
                    break
                pattern = _trace(int(rest[j]), self.lengths, take)
                pattern[j] = pattern.get(j, 0) + 1
                entered += self.enter(pattern, 0.0)
            for t in powers(size):
                if best[t] - SHORT >= LEAST_GAIN:
                    entered += self.enter(_trace(t, self.lengths, take), SHORT)
            pivots += entered
            if not entered or pivots >= PIVOTS:
                return r + 1
        return rounds


@dataclass
class Plan:
    """How documents of each length are placed by rank.

    ``starts[l]`` .. : first ranks, pattern numbers, uses in a sequence and offsets of the patterns that take length l.
    ``first[p]``: first sequence of a pattern. ``taken[l]``: ranks that patterns take; ``left[l]``: token number of the
    first document of that length among those laid end to end. ``total``: their tokens.
    """

    uses: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    first: np.ndarray
    taken: np.ndarray
    left: np.ndarray
    total: int
    sequences: int
    about: dict

    def tail(self) -> list[tuple[int, int]]:
        """Where the last of those laid end to end are cut: start and length, by falling powers of two."""
        at, out = self.total // SIZE * SIZE, []
        for p in reversed(powers()):
            if self.total % SIZE & p:
                out.append((at, p))
                at += p
        return out


def plan(counts: np.ndarray) -> Plan:
    """Patterns for documents of ``counts[l]`` of each length below ``SIZE``."""
    lengths = np.flatnonzero(counts[1:]) + 1
    demand = counts[lengths].astype(np.int64)
    program = Program(lengths, demand.astype(float))
    rounds = program.solve() if len(lengths) else 0
    found = [(x, p[0]) for x, p in zip(program.level.tolist(), program.basis) if p]
    left = demand.copy()
    used = []
    # rounded down; where a document is short for that, as the noise allows, fewer
    for x, pattern in found:
        n = min([int(x + 1e-6), *[int(left[j] // a) for j, a in pattern.items()]])
        used.append(n)
        for j, a in pattern.items():
            left[j] -= n * a
    for k in sorted(range(len(found)), key=lambda k: used[k] - found[k][0]):
        pattern = found[k][1]
        if all(left[j] >= a for j, a in pattern.items()):
            used[k] += 1
            for j, a in pattern.items():
                left[j] -= a
    patterns = [(n, {int(lengths[j]): a for j, a in p.items()}) for n, (_, p) in zip(used, found) if n]
    uses: dict[int, list] = {}
    taken, first, sequences = np.zeros(SIZE, np.int64), [], 0
    for k, (n, pattern) in enumerate(patterns):
        first.append(sequences)
        sequences += n
        at = 0
        for length in sorted(pattern, reverse=True):
            uses.setdefault(length, []).append((int(taken[length]), k, pattern[length], at))
            taken[length] += n * pattern[length]
            at += length * pattern[length]
    rest = counts - taken
    rest[0] = 0
    mass = rest * np.arange(SIZE)
    about = {"rounds": rounds, "patterns": len(patterns), "documents": int(demand.sum()), "cut": int(rest.sum()), "in_patterns": sequences}
    table = {length: tuple(np.array(c, np.int64) for c in zip(*rows)) for length, rows in uses.items()}
    return Plan(table, np.array(first, np.int64), taken, np.cumsum(mass) - mass, int(mass.sum()), sequences, about)


def place(made: Plan, length: int, rank: int, beyond: int) -> list[tuple[int, int, int, int]]:
    """Pieces of the document of that length and rank: start, length, sequence and offset. ``beyond``: first sequence of those laid end to end."""
    if rank < made.taken[length]:
        starts, pattern, uses, offset = made.uses[length]
        k = int(np.searchsorted(starts, rank, "right")) - 1
        turn, slot = divmod(rank - int(starts[k]), int(uses[k]))
        return [(0, length, int(made.first[pattern[k]]) + turn, int(offset[k]) + slot * length)]
    at = int(made.left[length]) + (rank - int(made.taken[length])) * length
    full, out, done = made.total // SIZE * SIZE, [], 0
    tail = made.tail() if at + length > full else []
    while done < length:
        g = at + done
        if g < full:
            sequence, offset, room = beyond + g // SIZE, g % SIZE, SIZE - g % SIZE
        else:
            j = next(j for j, (a, p) in enumerate(tail) if a <= g < a + p)
            sequence, offset = beyond + full // SIZE + j, g - tail[j][0]
            room = tail[j][1] - offset
        n = min(room, length - done)
        out.append((done, n, sequence, offset))
        done += n
    return out


# -- pieces ----------------------------------------------------------------------


PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(docs: DataFrame, path: str) -> DataFrame:
    """``PIECES`` of all documents: the ids of each piece as little-endian unsigned 32-bit integers, and where they stand."""
    found = tokens(docs, path)
    # ranks and whole cuts of each slice, as counts by slice and length; length 0 counts the whole cuts
    cuts = (F.col("n") / SIZE).cast("long")
    by_length = found.groupBy("slice", F.col("rest").alias("length")).agg(F.count(F.lit(1)).alias("n")).where("length > 0")
    by_slice = found.groupBy("slice").agg(F.sum(cuts).alias("n")).select("slice", F.lit(0).alias("length"), "n")
    counted = written(by_length.unionByName(by_slice), "pack-counts")
    histogram = counted.groupBy("length").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).collect()  # at most SIZE rows
    counts = np.zeros(SIZE, np.int64)
    for r in histogram:
        counts[r["length"]] = r["n"]
    cut_at_size = int(counts[0])
    counts[0] = 0
    made = plan(counts)
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counted.select("slice", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    hint = F.broadcast if sum(r["rows"] for r in histogram) <= MOST_BROADCAST else lambda df: df
    ranks = firsts.where("length > 0").select("slice", F.col("length").alias("rest"), F.col("before").alias("_rank"))
    blocks = firsts.where("length = 0").select("slice", F.col("before").alias("_block"))
    # a slice is one task's rows, so neither join has a hot key
    placed = found.join(hint(ranks), ["slice", "rest"], "left").join(hint(blocks), "slice")
    rows = placed.select("doc_id", "ids", "width", "n", "rest", (F.col("rank") + F.coalesce("_rank", F.lit(0))).alias("rank"), (F.col("blocks_before") + F.col("_block")).alias("block"))
    shared = docs.sparkSession.sparkContext.broadcast(made)
    first_block, beyond = made.sequences, made.sequences + cut_at_size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            out, held = [], 0
            for doc, raw, width, n, rest, rank, block in zip(*(b.column(i) if i == 1 else b.column(i).to_pylist() for i in range(7))):
                ids = np.frombuffer(raw.as_buffer(), f"<u{width}").astype("<u4").tobytes()
                cut = n // SIZE
                pieces = [(k * SIZE, SIZE, first_block + block + k, 0) for k in range(cut)]
                if rest:
                    pieces += [(cut * SIZE + start, length, sequence, offset) for start, length, sequence, offset in place(own, rest, rank, beyond)]
                for start, length, sequence, offset in pieces:
                    out.append((doc, start, length, n, sequence, offset, ids[4 * start : 4 * (start + length)]))
                held += len(ids)
                if held > 4 << 20:
                    yield _batch(out, PIECES)
                    out, held = [], 0
            if out:
                yield _batch(out, PIECES)

    return rows.mapInArrow(run, PIECES)


def sequences(pieces: DataFrame, pad: int = END) -> DataFrame:
    """``sequence_id, ids, length``: sequences laid out, padded with ``pad`` to ``SIZE`` unless their length is a power of two."""
    rows = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("rows"), F.sum("length").alias("length"))
    # hex, as binary pieces are only joined as text
    ids = F.array_join(F.transform("rows", lambda r: F.hex(r.ids)), "")
    n = F.expr("CASE WHEN length & (length - 1) = 0 THEN length ELSE %d END" % SIZE)
    filler = pad.to_bytes(4, "little").hex()
    return rows.select("sequence_id", F.unhex(F.concat(ids, F.repeat(F.lit(filler), (n - F.col("length")).cast("int")))).alias("ids"), "length")


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
