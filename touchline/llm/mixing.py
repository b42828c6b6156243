"""LM scoring by online logistic context mixing.

A text is its words and one end. A word's code is a 64-bit hash; it is told in
``LEVELS`` bits of the code and by what then tells it from the words that share
them. Each bit is predicted in three hashed contexts, from counts of what
training texts held there:

* the word before (exact counts of every pair, kept where the pair's block is);
* the class of the text (a table of fixed size), which is its commonest word;
* none (the same table, summed).

A predictor's counts are a state, its probability is how often the state came
true. The three log odds are added with weights of a gate, chosen by how much
evidence there is; the mixed probability is refined by a table over (log odds,
evidence). Weights are learned online over the table of joint states, which
holds every bit of every training token, each left out of the counts that
predict it. All that is learned rests on integer sums over the corpus, so a score
depends on the training texts and on nothing else: not on partitions or blocks.

Bits done, the word before and the class share out what the words of equal code
bits get, by counts. A word that training has not seen pays for being unknown
and is spelled byte by byte. A text also pays for its class, so that a score is
the log of a (sub-)probability over all texts; ``bits`` is the total and
``bits_per_byte`` the rate.

What is gathered grows with the corpus: every distinct pair of a chunk of texts
goes, once with its count, to the block of its first word, which learns, scores
it once and sends back one answer for the chunk; places stay with the chunk. A
frequent pair is one entry for each chunk. Pairs whose first word is one of the
``HOT`` most frequent (more than one in HOT tokens, so the list is bounded) are
dealt over ``1 << HOT_LEVELS`` blocks by the second word's code; the counts of
those first bits come from a table of fixed size.

Results by case: null and empty texts are one end token; a very long text is one
chunk of its own; repeated rows are each scored; rows with null id are scored like
others (they are learned from unless held out); with nothing to learn from, every
word is unknown; further columns are left out; an empty table gives an empty one.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from touchline.llm._arrow import partitions, written
from touchline.llm._words import mix, span_hashes, text_slices, words

#: Tokens of a chunk, about; it holds at least one text.
CHUNK = 1_250_000
#: Tokens that one block of pairs is meant for.
BLOCK = 2_500_000
CLASSES, LEVELS = 16, 14
HOT, HOT_LEVELS = 1024, 8
LEAVES = 1 << LEVELS
_U = np.uint64
_END = span_hashes(np.frombuffer(b"\n", np.uint8), np.array([1]))[0]  # no word holds a line break
_CODEC = pa.Codec("zstd", compression_level=1)


def pack(x: np.ndarray) -> bytes:
    """An array of whole numbers, narrowed and byte by byte plane, compressed."""
    if not len(x):
        return b""
    width = max(1, -(-int(x.max()).bit_length() // 8))
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + len(x).to_bytes(8, "little") + _CODEC.compress(planes.tobytes(), asbytes=True)


def unpack(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.int64)
    width, n = raw[0], int.from_bytes(raw[1:9], "little")
    planes = np.frombuffer(_CODEC.decompress(raw[9:], width * n, asbytes=True), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<i8")[:, 0]


# -- states ---------------------------------------------------------------------

#: Least counts of the levels of a pair's state; the first are exact.
_PAIR_LEVELS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 12, 18, 28, 48, 96, 256, 1024])
_FEW_LEVELS = np.array([1, 2, 3, 5, 9, 17])
_FEW = 32
PAIR_STATES, CLASS_STATES, PLAIN_STATES = 256, 49 + 64, 16
JOINT = PAIR_STATES * CLASS_STATES * PLAIN_STATES


_PAIR_LEVEL = np.searchsorted(_PAIR_LEVELS, np.arange(_PAIR_LEVELS[-1] + 1), "right").astype(np.int32)


def pair_level(count: np.ndarray) -> np.ndarray:
    return _PAIR_LEVEL[np.minimum(count, len(_PAIR_LEVEL) - 1)]


def pair_state(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    return pair_level(own) << 4 | pair_level(other)


def _odds_level(own: np.ndarray, other: np.ndarray, step: float, half: int) -> np.ndarray:
    """Log odds in steps; mirrored counts give the mirrored level."""
    odds = (np.log(own + 0.4) - np.log(other + 0.4)) / step
    return np.clip(np.where(odds >= 0, np.floor(odds), -np.floor(-odds) - 1), -half, half - 1).astype(np.int64) + half


def class_state(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    few = np.searchsorted(_FEW_LEVELS, own, "right") * 7 + np.searchsorted(_FEW_LEVELS, other, "right")
    return np.where((own < _FEW) & (other < _FEW), few, 49 + _odds_level(own, other, 0.25, 32))


def plain_state(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    return _odds_level(own, other, 0.7, 8)


def joint(pair: np.ndarray, cls: np.ndarray, plain: np.ndarray) -> np.ndarray:
    return (pair * CLASS_STATES + cls) * PLAIN_STATES + plain


def mirrored(states: np.ndarray) -> np.ndarray:
    """The joint states as the other bit value sees them."""
    rest, plain = np.divmod(states, PLAIN_STATES)
    pair, cls = np.divmod(rest, CLASS_STATES)
    few = cls % 7 * 7 + cls // 7
    return joint(pair % 16 * 16 + pair // 16, np.where(cls < 49, few, 49 + 63 - (cls - 49)), PLAIN_STATES - 1 - plain)


# -- the model ------------------------------------------------------------------

GATES, BUCKETS = 32, 33
#: Hashed contexts of two bytes in which the bytes of an unknown word are counted.
SPELLED = 1 << 12


def _stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p) - np.log1p(-p)


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def fit(counts: np.ndarray, rounds: int = 3, pieces: int = 64) -> np.ndarray:
    """Bits that each joint state costs. ``counts``: how often training bits were seen in it.

    Three steps: each predictor's states become probabilities; weights of the gates
    are learned online, a piece of the table at a time in a fixed order, by Newton
    steps over all that was seen so far; a table refines what they give.
    """
    every = np.arange(JOINT)
    other = mirrored(every)
    seen = np.flatnonzero(counts + counts[other])
    mirror = other[seen]
    true = counts[seen].astype(float)
    both = true + counts[mirror]
    rest, plain = np.divmod(every, PLAIN_STATES)
    pair, cls = np.divmod(rest, CLASS_STATES)
    inputs = []
    for state, n in ((pair, PAIR_STATES), (cls, CLASS_STATES), (plain, PLAIN_STATES)):
        t = np.bincount(state[seen], true, n)
        f = np.bincount(state[mirror], true, n)
        # what was never seen is even; pseudo-counts keep odds finite
        inputs.append(_stretch((t + 0.4) / (t + f + 0.8))[state])
    x = np.stack(inputs, 1)
    evidence = np.minimum(np.maximum(pair // 16, pair % 16), 7)
    sure = np.minimum(np.abs(x[:, 0]).astype(int), 1)
    many = (cls >= 49).astype(int)
    gate = (evidence * 2 + sure) * 2 + many
    weights = np.full((GATES, 3), 1 / 3)
    order = np.argsort(mix(seen.astype(_U) + _U(1)))
    for _ in range(rounds):
        hessian = np.tile(np.eye(3), (GATES, 1, 1))
        slope = np.zeros((GATES, 3))
        for part in np.array_split(order, pieces):
            at = seen[part]
            g, xs = gate[at], x[at]
            p = np.clip(_squash((weights[g] * xs).sum(1)), 1e-6, 1 - 1e-6)
            np.add.at(hessian, g, (both[part] * p * (1 - p))[:, None, None] * xs[:, :, None] * xs[:, None, :])
            slope[:] = 0
            np.add.at(slope, g, (true[part] - both[part] * p)[:, None] * xs)
            weights += np.clip(np.linalg.solve(hessian, slope[:, :, None])[:, :, 0], -0.5, 0.5)
    mixed = np.clip((weights[gate] * x).sum(1), -12, 12)
    bucket = np.rint((mixed + 12) / 24 * (BUCKETS - 1)).astype(int)
    cell, back = bucket * GATES + gate, (BUCKETS - 1 - bucket) * GATES + gate
    t = np.bincount(cell[seen], true, BUCKETS * GATES)
    total = np.bincount(cell[seen], both, BUCKETS * GATES)
    own = _squash(mixed)
    refined = (t[cell] + 16 * own) / (total[cell] + 16)
    mirrored_refined = (t[back] + 16 * (1 - own)) / (total[back] + 16)
    refined = refined / (refined + mirrored_refined)
    p = np.clip((own + refined) / 2, 1 / 4096, 1 - 1 / 4096)
    # a state and its mirror share one bit
    return -np.log2(p / (p + p[other]))


@dataclass
class Tables:
    """What every task knows, of fixed size: counts by class and code, by frequent first word and code, and byte pairs."""

    hot: np.ndarray  # codes, sorted
    leaves: np.ndarray  # CLASSES x LEAVES
    hot_leaves: np.ndarray  # len(hot) x (1 << HOT_LEVELS)
    spelling: np.ndarray  # bits of a byte behind two others, these hashed; 0 stands before a word and behind it
    class_bits: np.ndarray
    known_bits: float
    unknown_bits: float

    def trees(self, less: int = 0) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """For each level the class and plain state of a step to a node, by class, and counts by frequent first word. ``less`` is left out of what the step holds."""
        out = []
        for b in range(1, LEVELS + 1):
            by_class = self.leaves.reshape(CLASSES, 1 << b, -1).sum(2)
            other = by_class[:, np.arange(1 << b) ^ 1]
            own, plain = np.maximum(by_class - less, 0), np.maximum(by_class.sum(0) - less, 0)
            states = class_state(own, other) * PLAIN_STATES + plain_state(plain, other.sum(0))
            hot = self.hot_leaves.reshape(len(self.hot), 1 << b, 1 << HOT_LEVELS - b).sum(2) if b <= HOT_LEVELS else None
            out.append((states.astype(np.int32), hot))
        return out


def _spelling(count: np.ndarray) -> np.ndarray:
    """Bits of each byte in each context: its share there, with that among all as a share of two more."""
    plain = count.sum(0) + 0.1
    plain = plain / plain.sum()
    return -np.log2((count + 2 * plain) / (count.sum(1, keepdims=True) + 2))


# -- chunks ---------------------------------------------------------------------

CHUNKS = "chunk long, doc_ids array<long>, held array<boolean>, n_train long, n_tokens long, lengths binary, n_bytes binary, classes binary, blob binary, word_lengths binary, tokens binary"


def _packed_batch(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)


def chunks(docs: DataFrame, size: int = 0) -> DataFrame:
    """Texts as numbers of a chunk's distinct words. ``docs``: doc_id, text, held_out."""
    size = size or CHUNK
    names = [x.split()[0] for x in CHUNKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 24
        n = total = 0
        ids, held, hashes, counts, sizes, blobs, lengths = ([] for _ in range(7))

        def close() -> pa.RecordBatch:
            count = np.concatenate(counts)
            h = np.concatenate(hashes)
            order = np.argsort(h)
            head = np.r_[True, h[order][1:] != h[order][:-1]][: len(h)]
            kind = np.empty(len(h), np.int64)
            kind[order] = np.cumsum(head) - 1
            first = order[head]
            data, span = np.concatenate(blobs), np.concatenate(lengths)
            # frequent words have small numbers; the end is word 0
            often = np.argsort(-np.bincount(kind), kind="stable")
            number = np.empty(len(often), np.int64)
            number[often] = np.arange(1, len(often) + 1)
            first = first[often]
            starts = np.cumsum(span) - span
            own = span[first]
            at = np.arange(own.sum()) + np.repeat(starts[first] - (np.cumsum(own) - own), own)
            ends = np.cumsum(count + 1) - 1
            tokens = np.zeros(len(h) + len(count), np.int64)
            inside = np.ones(len(tokens), bool)
            inside[ends] = False
            tokens[inside] = number[kind] if len(h) else 0
            # a text's class: the commonest of its words, the least code of equals, by its code's last bits
            doc = np.repeat(np.arange(len(count)), count)
            key = np.sort(doc * len(often) + kind)  # kinds are in the order of their codes
            new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
            times = np.diff(np.r_[new, len(h)])
            d, k = np.divmod(key[new], max(len(often), 1))
            most = np.zeros(len(count), np.int64)
            np.maximum.at(most, d, times)
            lead = np.flatnonzero(times == most[d])
            lead = lead[np.r_[True, d[lead][1:] != d[lead][:-1]][: len(lead)]]
            classes = np.zeros(len(count), np.int64)
            classes[d[lead]] = (h[order[head]][k[lead]] % _U(CLASSES)).astype(np.int64)
            out = pa.concat_arrays(held)
            learn = ~out.to_numpy(zero_copy_only=False).astype(bool)
            row = (
                task + n, pa.concat_arrays(ids), out, int((count + 1)[learn].sum()), len(tokens), pack(count + 1), pack(np.concatenate(sizes)), pack(classes),
                data[at].tobytes(), pack(own), pack(tokens),
            )
            cells = [pa.array([x]) if not isinstance(x, pa.Array) else pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in row]
            return pa.RecordBatch.from_arrays(cells, names=names)

        for batch in batches:
            for piece in text_slices(batch.column(1)):
                w = words(piece)
                if total and total + len(w.hashes) + piece.rows > size:
                    yield close()
                    n, total = n + 1, 0
                    ids, held, hashes, counts, sizes, blobs, lengths = ([] for _ in range(7))
                    pa.default_memory_pool().release_unused()
                ids.append(batch.column(0).slice(piece.first, piece.rows))
                held.append(batch.column(2).slice(piece.first, piece.rows))
                counts.append(w.counts())
                sizes.append(np.diff(piece.offsets))
                hashes.append(w.hashes)
                blobs.append(w.packed)
                lengths.append(w.ends - w.starts)
                total += len(w.hashes) + piece.rows
        if ids:
            yield close()

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, CHUNKS)


class Chunk:
    """A chunk's tokens, the word before each, and its distinct pairs and words by class."""

    def __init__(self, row: dict, held: np.ndarray | None = None):
        self.lengths = unpack(row["lengths"])
        self.classes = unpack(row["classes"])
        span = unpack(row["word_lengths"])
        self.blob = np.frombuffer(row["blob"], np.uint8)
        self.codes = np.concatenate([[_END], span_hashes(self.blob, span)])
        self.spans = span
        self.tokens = unpack(row["tokens"])
        self.before = np.concatenate([[0], self.tokens[:-1]])  # each text begins behind an end
        self.learn = ~np.array(row["held"], bool)
        self.token_learn = np.repeat(self.learn, self.lengths)
        self.token_class = np.repeat(self.classes, self.lengths)

    def spelled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Context, byte and word of every byte of the distinct words, stops included; word 0 is the end."""
        full = np.r_[0, self.spans] + 1
        byte = np.zeros(full.sum(), np.int64)
        ends = np.cumsum(full)
        inside = np.ones(len(byte), bool)
        inside[ends - 1] = False
        byte[inside] = self.blob
        word = np.repeat(np.arange(len(full)), full)
        place = np.arange(len(byte)) - (ends - full)[word]
        one = np.where(place > 0, np.r_[0, byte[:-1]], 0)
        two = np.where(place > 1, np.r_[0, 0, byte[:-2]][: len(byte)], 0)
        return (mix((two << 8 | one).astype(_U)) % _U(SPELLED)).astype(np.int64), byte, word

    def _distinct(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(key)
        k = key[order]
        head = np.r_[True, k[1:] != k[:-1]]
        inverse = np.empty(len(key), np.int64)
        inverse[order] = np.cumsum(head) - 1
        return k[head], inverse, np.bincount(inverse, self.token_learn, int(head.sum())).astype(np.int64)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Class, first and second word of each distinct pair, its training count, and each token's pair."""
        n = len(self.codes)
        key, inverse, count = self._distinct((self.token_class * n + self.before) * n + self.tokens)
        rest, word = np.divmod(key, n)
        cls, before = np.divmod(rest, n)
        return cls, before, word, count, inverse

    def class_words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word and class of each distinct such pair, its training count, and each token's."""
        key, inverse, count = self._distinct(self.tokens * CLASSES + self.token_class)
        return key // CLASSES, key % CLASSES, count, inverse


def _hot_place(codes: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Where the codes stand among the frequent ones; -1 for others."""
    if not len(hot):
        return np.full(len(codes), -1)
    at = np.minimum(np.searchsorted(hot, codes), len(hot) - 1)
    return np.where(hot[at] == codes, at, -1)


def contexts(before: np.ndarray, word: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The context that a pair is counted in: its first word, with the second's first bits where that is frequent."""
    with np.errstate(over="ignore"):
        return mix(before + np.where(hot >= 0, (word >> _U(64 - HOT_LEVELS)) + _U(1), _U(0)) * _U(0x9E3779B97F4A7C15))


# -- words: exact counts ----------------------------------------------------------

ASKED = "block int, chunk long, codes binary, classes binary, counts binary"
ANSWERS = "kind int, chunk long, block int, a binary, b binary, code long, n long"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(j)[k].as_py() for j, name in enumerate(batch.schema.names)}


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """The rows of a sorted partition, a key's at a time."""
    rows: list[dict] = []
    for r in _rows(batches):
        if rows and r[key] != rows[0][key]:
            yield rows
            rows = []
            pa.default_memory_pool().release_unused()
        rows.append(r)
    if rows:
        yield rows


def _word_block(codes: np.ndarray, blocks: int) -> np.ndarray:
    return ((codes >> _U(44)).astype(np.int64) * blocks) >> 20


def word_counts(parts: DataFrame, blocks: int, n_train: int) -> DataFrame:
    """``kind`` 0: for a chunk, counts of its words and of its words by class; 1: frequent words; 2: number of words, and of those seen once."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            c = Chunk(row)
            word, cls, count, _ = c.class_words()
            code = c.codes[word]
            block = _word_block(code, blocks)
            out = []
            for b, at in _by_block(block):
                out.append((b, row["chunk"], code[at].tobytes(), pack(cls[at]), pack(count[at])))
            yield _packed_batch([x.split()[0] for x in ASKED.split(", ")], [pa.int32(), pa.int64()] + [pa.binary()] * 3, out)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in ANSWERS.split(", ")]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        for rows in _grouped(batches, "block"):
            codes = np.frombuffer(b"".join(r["codes"] for r in rows), _U)
            cls = np.concatenate([unpack(r["classes"]) for r in rows])
            count = np.concatenate([unpack(r["counts"]) for r in rows])
            order = np.lexsort((cls, codes))
            c, k, n = codes[order], cls[order], count[order]
            new = np.r_[True, c[1:] != c[:-1]]
            pair = np.cumsum(np.r_[True, new[1:] | (k[1:] != k[:-1])]) - 1
            word = np.cumsum(new) - 1
            of_word = np.bincount(word, n).astype(np.int64)
            total, own = np.empty(len(c), np.int64), np.empty(len(c), np.int64)
            total[order] = of_word[word]
            own[order] = np.bincount(pair, n).astype(np.int64)[pair]
            cuts = np.cumsum([0] + [len(r["codes"]) // 8 for r in rows])
            out = [(0, r["chunk"], r["block"], pack(total[a:b]), pack(own[a:b]), None, None) for r, a, b in zip(rows, cuts[:-1], cuts[1:])]
            out.append((2, None, None, None, None, int((of_word == 1).sum()), int((of_word > 0).sum())))
            for at in np.flatnonzero((of_word * HOT > n_train) & (of_word > 0)).tolist():
                out.append((1, None, None, None, None, int(c[new][at].astype(np.int64)), int(of_word[at])))
            yield _packed_batch(names, kinds, out)

    asked = parts.select("chunk", "held", "lengths", "classes", "blob", "word_lengths", "tokens").mapInArrow(ask, ASKED)
    return asked.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "chunk").mapInArrow(answer, ANSWERS)


def _by_block(block: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(block, kind="stable")
    sorted_block = block[order]
    cuts = np.flatnonzero(np.r_[True, sorted_block[1:] != sorted_block[:-1]])
    for a, b in zip(cuts, np.r_[cuts[1:], len(order)]):
        yield int(sorted_block[a]), order[a:b]


# -- tables of fixed size -----------------------------------------------------------


def _sums(df: DataFrame, size: int) -> np.ndarray:
    """Adds up ``cell, n`` rows; there are at most ``size`` cells."""
    out = np.zeros(size, np.int64)
    for cell, n in df.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[cell] = n
    return out


def _cells(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    at = np.flatnonzero(total)
    for part in np.array_split(at, -(-len(at) // 100_000)) if len(at) else ():
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int64)), pa.array(total[part])], names=["cell", "n"])


def tables(parts: DataFrame, hot: np.ndarray, n_words: int, n_once: int, n_train: int) -> Tables:
    ends = np.cumsum([CLASSES * LEAVES, len(hot) << HOT_LEVELS, SPELLED * 256, CLASSES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ends[-1], np.int64)
        for row in _rows(batches):
            c = Chunk(row)
            learn = c.token_learn
            code = c.codes[c.tokens[learn]]
            leaf = (code >> _U(64 - LEVELS)).astype(np.int64)
            total[: ends[0]] += np.bincount(c.token_class[learn] * LEAVES + leaf, minlength=ends[0])
            place = _hot_place(c.codes, hot)[c.before[learn]]
            top = (code >> _U(64 - HOT_LEVELS)).astype(np.int64)
            total[ends[0] : ends[1]] += np.bincount((place << HOT_LEVELS | top)[place >= 0], minlength=ends[1] - ends[0])
            spelled, byte, word = c.spelled()
            times = np.bincount(c.tokens[learn], minlength=len(c.codes))[word]
            times[word == 0] = 0
            total[ends[1] : ends[2]] += np.bincount(spelled << 8 | byte, times, ends[2] - ends[1]).astype(np.int64)
            total[ends[2] :] += np.bincount(c.classes[c.learn], minlength=CLASSES)
        yield from _cells(total)

    columns = parts.select("held", "lengths", "classes", "blob", "word_lengths", "tokens")
    leaves, hot_leaves, spelling, classes = np.split(_sums(columns.mapInArrow(run, "cell long, n long"), int(ends[-1])), ends[:-1])
    classes = (classes + 1) / (classes + 1).sum()
    # as many tokens are unknown as words were seen once
    unknown = (n_once + 1) / (n_train + 2) if n_words else 1.0
    return Tables(
        hot, leaves.reshape(CLASSES, LEAVES), hot_leaves.reshape(len(hot), 1 << HOT_LEVELS), _spelling(spelling.reshape(SPELLED, 256)), -np.log2(classes), float(-np.log2(max(1 - unknown, 1e-9))), float(-np.log2(unknown))
    )


# -- pairs: bits ----------------------------------------------------------------------

PAIRS = "block int, chunk long, context binary, runs binary, classes binary, hot binary, codes binary, counts binary"
_PAIR_NAMES = [x.split()[0] for x in PAIRS.split(", ")]
#: Further code bits that tell words of equal first bits apart in a context.
TELLING = 10


def ask_pairs(parts: DataFrame, blocks: int, hot: np.ndarray) -> DataFrame:
    """Each chunk's distinct pairs, dealt over blocks by context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            c = Chunk(row)
            cls, before, word, count, _ = c.pairs()
            place = _hot_place(c.codes, hot)
            context = contexts(c.codes[before], c.codes[word], place[before])
            out = []
            for b, at in _by_block(((context >> _U(32)).astype(np.int64) * blocks) >> 32):
                key = context[at]
                new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (cls[at][1:] != cls[at][:-1])])
                head = at[new]
                code = (c.codes[word[at]] >> _U(64 - LEVELS - TELLING)).astype(np.int64)
                out.append((b, row["chunk"], context[head].tobytes(), pack(np.diff(np.r_[new, len(at)])), pack(cls[head]), pack(place[before[head]] + 1), pack(code), pack(count[at])))
            yield _packed_batch(_PAIR_NAMES, [pa.int32(), pa.int64()] + [pa.binary()] * 6, out)

    asked = parts.select("chunk", "held", "lengths", "classes", "blob", "word_lengths", "tokens").mapInArrow(run, PAIRS)
    placed = asked.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "chunk")
    lists = ", ".join(f"{x.split()[0]} array<{x.split()[1]}>" for x in PAIRS.split(", ")[1:])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, "block"):
            cells = [pa.array([rows[0]["block"]], pa.int32())] + [pa.array([[r[x] for r in rows]], pa.list_(pa.int64() if x == "chunk" else pa.binary())) for x in _PAIR_NAMES[1:]]
            yield pa.RecordBatch.from_arrays(cells, names=_PAIR_NAMES)

    return placed.mapInArrow(gather, f"block int, {lists}")


class PairBlock:
    """All pairs of a block: counts along the code bits of each, in its context."""

    def __init__(self, row: dict):
        runs = [unpack(x) for x in row["runs"]]
        each = np.concatenate(runs)
        told, place = np.unique(np.frombuffer(b"".join(row["context"]), _U), return_inverse=True)
        head = place << 32 | np.concatenate([unpack(x) for x in row["classes"]])
        code = np.concatenate([unpack(x) for x in row["codes"]])
        key = np.repeat(head, each) | code << 4
        hot = np.repeat(np.concatenate([unpack(x) for x in row["hot"]]).astype(np.int16) - 1, each)
        sizes = np.cumsum([0] + [int(r.sum()) for r in runs])
        self.chunks = list(zip(row["chunk"], sizes[:-1], sizes[1:]))
        order = np.argsort(key)
        key = key[order]
        new = np.r_[True, key[1:] != key[:-1]]
        # events: distinct (context, code, class); pairs: distinct (context, code)
        self.of = np.empty(len(order), np.int32)
        self.of[order] = np.cumsum(new) - 1
        self.hot = hot[order[new]]
        counts = np.concatenate([unpack(x) for x in row["counts"]])
        # wide enough for the sum of all, which is the largest count that ``nodes`` makes
        kind = np.int32 if counts.sum(dtype=np.int64) < 1 << 31 else np.int64
        self.count = np.bincount(self.of, counts, int(new.sum())).astype(kind)  # of the pair in texts of the class
        key = key[new]
        self.cls = (key & 15).astype(np.int32)
        key >>= 4
        new = np.r_[True, key[1:] != key[:-1]]
        self.pair = np.cumsum(new, dtype=np.int32) - 1
        self.pair_key = key[new]
        self.pair_code = (self.pair_key & ((1 << LEVELS + TELLING) - 1)).astype(np.int32)
        self.pair_count = np.bincount(self.pair, self.count, len(self.pair_key)).astype(kind)

    def nodes(self, level: int) -> np.ndarray:
        """For each pair, the count of its context's pairs that share its first ``level`` bits."""
        key = self.pair_key >> (LEVELS + TELLING - level)
        head = np.r_[True, key[1:] != key[:-1]]
        return np.add.reduceat(self.pair_count, np.flatnonzero(head))[np.cumsum(head, dtype=np.int32) - 1]

    def walk(self, trees: list, at: np.ndarray | None = None, less: int = 0) -> Iterator[np.ndarray]:
        """Level by level the joint states of events, ``less`` tokens left out of what each step holds."""
        pair, cls, hot = (x if at is None else x[at] for x in (self.pair, self.cls, self.hot))
        above = self.nodes(0)
        frequent = np.flatnonzero(hot >= 0)
        code = self.pair_code[pair]
        for b, (known, tree) in enumerate(trees):
            below = self.nodes(b + 1)
            state = pair_state(np.maximum(below - less, 0), above - below)[pair]
            node = code >> (LEVELS + TELLING - b - 1)
            if tree is not None and len(frequent):
                f, h = node[frequent], hot[frequent]
                state[frequent] = pair_state(np.maximum(tree[h, f] - less, 0), tree[h, f ^ 1])
            above = below
            yield state * (CLASS_STATES * PLAIN_STATES) + known[cls, node]


#: Cells behind the joint states: by count of a context's leaf, tokens whose pair was seen but for themselves, and all.
SEEN_LEVELS = 16


def learn(blocks: DataFrame, tables: Tables) -> tuple[np.ndarray, np.ndarray]:
    """How often each joint state was seen, and how often a pair's leaf held the pair, over all training tokens."""
    spread = blocks.sparkSession.sparkContext.broadcast(pickle.dumps(tables))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = pickle.loads(spread.value).trees(less=1)
        total = np.zeros(JOINT + 2 * SEEN_LEVELS, np.int64)
        for row in _rows(batches):
            p = PairBlock(row)
            at = np.flatnonzero(p.count)
            if not len(at):
                continue
            n = p.count[at]
            # a token is left out of the counts that predict it
            for states in p.walk(trees, at, less=1):
                total[:JOINT] += np.bincount(states, n, JOINT).astype(np.int64)
            level = pair_level(np.maximum(p.nodes(LEVELS) - 1, 0))[p.pair[at]]
            seen = p.pair_count[p.pair[at]] > 1
            total[JOINT : JOINT + SEEN_LEVELS] += np.bincount(level, n * seen, SEEN_LEVELS).astype(np.int64)
            total[JOINT + SEEN_LEVELS :] += np.bincount(level, n, SEEN_LEVELS).astype(np.int64)
        yield from _cells(total)

    total = _sums(blocks.mapInArrow(run, "cell long, n long"), JOINT + 2 * SEEN_LEVELS)
    return total[:JOINT], total[JOINT:].reshape(2, SEEN_LEVELS)


#: Bits are sent in steps of 1/256, rounded up; shares in steps of 1/65535, rounded down.
STEP, SHARES = 256, 65535
SCORES = "chunk long, block int, bits binary, shares binary, leaf binary"


def pair_scores(blocks: DataFrame, tables: Tables, cost: np.ndarray) -> DataFrame:
    """For each chunk and block: bits of each pair's code, the pair's share of its leaf in the context, and the leaf's level."""
    spread = blocks.sparkSession.sparkContext.broadcast(pickle.dumps((tables, cost)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, costs = pickle.loads(spread.value)
        trees = known.trees()
        for row in _rows(batches):
            p = PairBlock(row)
            bits = np.zeros(len(p.cls))
            for states in p.walk(trees):
                bits += costs[states]
            leaf = p.nodes(LEVELS)
            share = np.floor(SHARES * p.pair_count / np.maximum(leaf, 1)).astype(np.int64)[p.pair]
            bits = np.ceil(bits * STEP).astype(np.int64)
            level = pair_level(leaf)[p.pair]
            out = [(chunk, row["block"], pack(bits[p.of[a:b]]), pack(share[p.of[a:b]]), pack(level[p.of[a:b]])) for chunk, a, b in p.chunks]
            yield _packed_batch([x.split()[0] for x in SCORES.split(", ")], [pa.int64(), pa.int32()] + [pa.binary()] * 3, out)

    return blocks.mapInArrow(run, SCORES)


# -- the whole ------------------------------------------------------------------------

RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits double, bits_per_byte double"


def _finish(rows: list[dict], word_blocks: int, pair_blocks: int, known: Tables, trust: np.ndarray, n_train: int, n_words: int) -> pa.RecordBatch:
    """A chunk's documents from its tokens and the answers for its words and pairs."""
    own = next(r for r in rows if r["kind"] == 0)
    c = Chunk(own)
    word, cls, _, class_word = c.class_words()
    total, in_class = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)
    answers = {r["block"]: r for r in rows if r["kind"] == 1}
    for b, at in _by_block(_word_block(c.codes[word], word_blocks)):
        total[at], in_class[at] = unpack(answers[b]["a"]), unpack(answers[b]["b"])
    p_cls, before, p_word, _, pair = c.pairs()
    context = contexts(c.codes[before], c.codes[p_word], _hot_place(c.codes, known.hot)[before])
    bits, share, level = (np.zeros(len(p_cls), np.int64) for _ in range(3))
    answers = {r["block"]: r for r in rows if r["kind"] == 2}
    for b, at in _by_block(((context >> _U(32)).astype(np.int64) * pair_blocks) >> 32):
        bits[at], share[at], level[at] = (unpack(answers[b][x]) for x in ("a", "b", "c"))
    # what words of equal first bits share: by the word before, then by class, then by all
    leaf = (c.codes[word] >> _U(64 - LEVELS)).astype(np.int64)
    by_class, plain = known.leaves[cls, leaf], known.leaves.sum(0)[leaf]
    low = (in_class + total / np.maximum(plain, 1)) / (by_class + 1)
    n = total[class_word]
    w = trust[level[pair]]
    p = w * (share[pair] / SHARES) + (1 - w) * low[class_word]
    seen = n > 0
    context, byte, word = c.spelled()
    spelled = np.bincount(word, known.spelling[context, byte])[c.tokens]
    each = np.where(seen, known.known_bits + bits[pair] / STEP - np.log2(np.where(seen, p, 1)), known.unknown_bits + spelled)
    starts = np.cumsum(c.lengths) - c.lengths
    score_bits = np.add.reduceat(each, starts) + known.class_bits[c.classes]
    base = np.add.reduceat(np.log10(n + 1), starts) - c.lengths * np.log10(n_train + n_words + 1)
    n_bytes = unpack(own["n_bytes"])
    columns = [
        pa.array(own["doc_ids"], pa.int64()), pa.array(own["held"], pa.bool_()), pa.array(c.lengths), pa.array(np.add.reduceat(seen.astype(np.int64), starts)), pa.array(np.full(len(starts), n_train)),
        pa.array(base), pa.array(-score_bits * np.log10(2)), pa.array(score_bits), pa.array(score_bits / np.maximum(n_bytes, 1)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in RESULT.split(", ")])


def score_texts(docs: DataFrame, chunk: int = 0, block: int = 0) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits, bits_per_byte``. ``docs``: doc_id, text, held_out."""
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce("held_out", F.lit(True)).alias("held_out"))
    # written, so that documents' places in their chunks stay what they are
    parts = written(chunks(rows, chunk), "mixing-chunks")
    size = parts.agg(F.coalesce(F.sum("n_train"), F.lit(0)).alias("train"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("chunks")).first()
    n_train = int(size["train"])
    blocks = max(partitions(spark), -(-int(size["tokens"]) // (block or BLOCK)))
    counted = written(word_counts(parts, blocks, n_train), "mixing-words")
    told = counted.where("kind = 2").agg(F.coalesce(F.sum("code"), F.lit(0)).alias("once"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    n_words = int(told["words"])
    # fewer than HOT rows: each is more than one in HOT tokens
    hot = np.sort(np.array([r["code"] for r in counted.where("kind = 1").select("code").collect()], np.int64).view(_U))
    known = tables(parts, hot, n_words, int(told["once"]), n_train)
    pairs = written(ask_pairs(parts, blocks, hot), "mixing-pairs")
    counts, leaf = learn(pairs, known)
    trust = (leaf[0] + 0.5) / (leaf[1] + 1.0)
    trust[0] = 0
    scored = pair_scores(pairs, known, fit(counts))

    own = ["doc_ids", "held", "lengths", "n_bytes", "classes", "blob", "word_lengths", "tokens"]
    none = {x.split()[0]: F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in CHUNKS.split(", ")}
    no = lambda name, kind: F.lit(None).cast(kind).alias(name)
    left = parts.select("chunk", F.lit(0).alias("kind"), no("block", "int"), *own, no("a", "binary"), no("b", "binary"), no("c", "binary"))
    words_told = counted.where("kind = 0").select("chunk", F.lit(1).alias("kind"), "block", *[none[x] for x in own], "a", "b", no("c", "binary"))
    pairs_told = scored.select("chunk", F.lit(2).alias("kind"), "block", *[none[x] for x in own], F.col("bits").alias("a"), F.col("shares").alias("b"), F.col("leaf").alias("c"))
    n_parts = max(partitions(spark), int(size["chunks"]))
    spread = spark.sparkContext.broadcast(pickle.dumps((known, trust)))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables_, trusted = pickle.loads(spread.value)
        for group in _grouped(batches, "chunk"):
            yield _finish(group, blocks, blocks, tables_, trusted, n_train, n_words)

    together = left.unionByName(words_told).unionByName(pairs_told).repartition(n_parts, "chunk").sortWithinPartitions("chunk", "kind")
    return together.mapInArrow(finish, RESULT)
