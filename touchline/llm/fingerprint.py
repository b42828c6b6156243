"""Document fingerprints: a homomorphic multiset hash, in DataFrame functions only.

A text is the multiset of its paragraphs (lines). Each paragraph is hashed to a
wide vector and the vectors are added lane by lane, modulo a power of two, so
the order of paragraphs does not matter and a paragraph is put in or taken out
by one addition or subtraction (``insert``, ``remove``).

Two kinds of lanes: 16 *exact* lanes modulo 2**32, cut from SHA-512 of the
paragraph, decide equality. 64 *sketch* lanes modulo 2**16 are sums of plus or
minus one for each sentence of the paragraph, by the bits of the sentence's
hash; read as signed numbers, the cosine of two sketches estimates how much of
two texts is the same (``likeness``).

Results by case: null text counts as empty; the empty text is one empty
paragraph; equal texts have equal fingerprints; texts that differ by the order
of paragraphs have equal ones by design; likeness is 1 for equal fingerprints,
between 0 and 1 otherwise; the next document of the last is the first, that of
a lone document is itself; null ids come first in order, rows that repeat an id
(or have none) follow in the order of ``xxhash64`` of their texts; very long
texts are one row each; further columns are left out; an empty table gives an
empty one.

Documents are laid out in blocks of about ``BLOCK_ROWS`` by quantiles of their
ids, whatever these are: dense, sparse or hashed. Where one id (or none) holds
several quantiles, its rows are split further by the hash of their texts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

EXACT, EXACT_BITS = 16, 32
SKETCH, SKETCH_BITS = 64, 16
#: A sentence ends after a full stop, question or exclamation mark before white space, or with its line.
SENTENCE_END = r"(?<=[.!?])\s+|\n"
#: Rows of a block, about, in which each document finds its successor; and most blocks, as their heads are one task's.
BLOCK_ROWS, MOST_BLOCKS = 2048, 1 << 14

_EXACT_MASK, _SKETCH_MASK = (1 << EXACT_BITS) - 1, (1 << SKETCH_BITS) - 1


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once; a lambda's outer expressions are otherwise worked out at each step."""
    return F.element_at(F.transform(F.array(value), body), 1)


def exact_lanes(text: Column) -> Column:
    """The exact lanes of a text, an array of longs."""
    width = EXACT_BITS // 4
    hashed = F.transform(F.split(text, "\n", -1), lambda p: F.sha2(p, 512))
    lane = lambda h, k: F.conv(F.substring(h, 1 + k * width, width), 16, 10).cast("long")
    of = lambda hs, k: F.aggregate(hs, F.lit(0).cast("long"), lambda a, h: (a + lane(h, k)).bitwiseAND(F.lit(_EXACT_MASK)))
    return _let(hashed, lambda hs: F.array(*[of(hs, k) for k in range(EXACT)]))


def sketch_lanes(text: Column) -> Column:
    """The sketch lanes of a text, an array of longs in 0 .. 2**16 - 1."""
    hashes = F.transform(F.split(text, SENTENCE_END, -1), lambda s: F.xxhash64(F.lit(11), s))
    # the sum of signs is twice the number of set bits less the number of sentences
    ones = lambda hs, k: F.size(F.filter(hs, lambda h: F.getbit(h, F.lit(k)) == 1))
    lane = lambda hs, k: (ones(hs, k) * 2 - F.size(hs)).bitwiseAND(F.lit(_SKETCH_MASK)).cast("long")
    return _let(hashes, lambda hs: F.array(*[lane(hs, k) for k in range(SKETCH)]))


def lanes(text: Column) -> Column:
    return F.struct(exact_lanes(text).alias("exact"), sketch_lanes(text).alias("sketch"))


def insert(fingerprint: Column, paragraphs: Column) -> Column:
    """The fingerprint with the paragraphs of another one added."""
    return _combined(fingerprint, paragraphs, lambda a, b: a + b)


def remove(fingerprint: Column, paragraphs: Column) -> Column:
    """The fingerprint with the paragraphs of another one taken out."""
    return _combined(fingerprint, paragraphs, lambda a, b: a - b)


def _combined(a: Column, b: Column, op) -> Column:
    return F.struct(
        F.zip_with(a["exact"], b["exact"], lambda x, y: op(x, y).bitwiseAND(F.lit(_EXACT_MASK))).alias("exact"),
        F.zip_with(a["sketch"], b["sketch"], lambda x, y: op(x, y).bitwiseAND(F.lit(_SKETCH_MASK))).alias("sketch"),
    )


def spelled(fingerprint: Column) -> Column:
    """The fingerprint as hexadecimal digits."""
    digits = lambda xs, n: F.array_join(F.transform(xs, lambda x: F.lpad(F.lower(F.hex(x)), n, "0")), "")
    return F.concat(digits(fingerprint["exact"], EXACT_BITS // 4), digits(fingerprint["sketch"], SKETCH_BITS // 4))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, else the cosine of the sketches, not below 0."""
    signed = lambda x: F.when(x >= 1 << SKETCH_BITS - 1, x - (1 << SKETCH_BITS)).otherwise(x).cast("double")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: signed(u) * signed(v)), F.lit(0.0), lambda s, u: s + u)
    inside = lambda xy, size: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(size > 0, xy / F.sqrt(size)).otherwise(0.0)))
    cosine = inside(dot(a["sketch"], b["sketch"]), dot(a["sketch"], a["sketch"]) * dot(b["sketch"], b["sketch"]))
    return F.when(a["exact"] == b["exact"], F.lit(1.0)).otherwise(cosine)


def _block(rows: DataFrame, block_rows: int) -> Column:
    """A number that ascends with (key, tie) and tells blocks of about ``block_rows`` rows."""
    n = rows.count()
    blocks = max(1, min(MOST_BLOCKS, n // block_rows))
    shares = [k / blocks for k in range(1, blocks)]
    if not shares:
        return F.lit(0).cast("long")
    # at most MOST_BLOCKS numbers
    quantiles = rows.agg(F.percentile_approx("key", shares, 10 * blocks).alias("q")).first()["q"]
    bounds, times = np.unique(np.array(quantiles, np.int64), return_counts=True)
    side = max(1, int(len(bounds) ** 0.5))
    array = lambda x: F.lit(np.asarray(x, np.int64))
    key = F.col("key")
    below = lambda xs: F.size(F.filter(xs, lambda x: x <= key))
    # two steps: which stretch of bounds, then which bound
    fine = lambda coarse: F.when(coarse == 0, 0).otherwise((coarse - 1) * side + below(F.slice(array(bounds), (coarse - 1) * side + 1, F.lit(side))))
    place = _let(below(array(bounds[::side])), fine)
    # rows of a bound's own id, by the hash of their texts; then those behind it
    split = lambda at: F.when(at == 0, 0).otherwise(
        F.when(F.element_at(array(bounds), at) == key, F.shiftright((F.shiftright("tie", 32) + (1 << 31)) * F.element_at(array(times), at), 32)).otherwise(F.element_at(array(times), at))
    )
    return _let(place.cast("int"), lambda at: at.cast("long") * (1 << 32) + split(at).cast("long"))


def _placed(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows by block, and in each block a last row (kind 1) with the head of the following block; the last block's is the first head."""
    told = rows.withColumn("block", _block(rows, block_rows))
    heads = told.groupBy("block").agg(F.min(F.struct("key", "tie", "text")).alias("head"))
    # a row for each block
    w = Window.orderBy("block")
    first = F.first("head.text").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ends = heads.select("block", F.coalesce(F.lead("head.text").over(w), first).alias("text"))
    ends = ends.select("block", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("tie"), "text")
    return told.select("block", F.lit(0).alias("kind"), "key", "tie", "text").unionByName(ends).repartition("block")


def fingerprint_with_next(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``doc_id, text, edited, own, edited_own, next_own``: fingerprints of each text, its edited text and the next text."""
    lowest = -(1 << 62)
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).withColumn("tie", F.xxhash64("text"))
    # fingerprints are taken after the shuffle, so that only texts travel
    placed = _placed(rows, block_rows).withColumn("own", lanes(F.col("text")))
    w = Window.partitionBy("block").orderBy("kind", "key", "tie")
    led = placed.withColumn("next", F.lead("text").over(w)).withColumn("next_own", F.lead("own").over(w)).where("kind = 0")
    n = F.length("text")
    half = (n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half))
    led = led.withColumn("n_chars", n.cast("long")).withColumn("edited", edited).withColumn("edited_own", lanes(F.col("edited")))
    return led.select(F.when(F.col("key") != lowest, F.col("key")).alias("doc_id"), "n_chars", "edited", "own", "edited_own", "next_own")


def digests(fingerprinted: DataFrame) -> DataFrame:
    return fingerprinted.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        spelled(F.col("own")).alias("fingerprint"),
        spelled(F.col("edited_own")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited_own")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
