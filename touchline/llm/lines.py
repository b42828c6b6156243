"""Substring dedup by hashing the sentences of lines and joining what repeats into passages.

A unit is a sentence of a line: it ends behind a run of ``. ! ?`` (or their wide
forms) or at the line break; units tile the text, and one without a word belongs
to the unit before it. Every unit, however short, is normalised (A-Z lowered,
white space collapsed, its ends trimmed) and hashed to 128 bits; digests are
grouped over all documents, and each occurrence but that of the least rank
(document id, then place in the text) is a repeat. Consecutive repeats of a
document join into a passage, which goes if it spans at least ``least_chars``
code points; a shorter one stays, as a single line of boilerplate does. With
``least_chars=1`` every repeat goes. The first occurrence of a unit always
stays. What was removed is kept as ranges of code points in the original text,
with the document that holds the first unit of the passage.

A passage that starts or ends within a line, or spans several, is found by the
sentences it holds whole; only its torn ends stay.

Grouping aggregates on the map side, so a unit of a third of all documents is one
row for each map task. Units of more than a thousandth of all repeats (fewer than
a thousand, so they are broadcast) are dealt over ``SALTS`` tasks in the join that
brings the verdicts back.

Results by case: null texts stay null and lose nothing, empty texts stay empty;
rows of one id and one text count as one document (each keeps its row and what
that document keeps); rows with null id rank after all others; a removed unit
takes its line break along; a very long text is one row of one task, its units
are not; further columns are passed on, one called like an output column is
replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from touchline.llm._arrow import Part, map_columns, written

#: Passages of fewer code points are left alone: longer than two lines of boilerplate, shorter than 50 words.
LEAST_CHARS = 150
#: Tasks over which the occurrences of a frequent unit are dealt; a unit is frequent beyond one in HOT_SHARE repeats.
SALTS, HOT_SHARE = 64, 1000
_LAST = (1 << 63) - 1

UNIT = re.compile(r"[^\n.!?。！？]*[.!?。！？]*[ \t]*\n?")
UNITS = "doc long, tie long, place int, start int, end int, hi long, lo long"


def split(text: str) -> Iterator[tuple[int, int, bytes]]:
    """Start, end and normal form of each unit that holds a word."""
    start, end, words = 0, 0, b""
    for m in UNIT.finditer(text):
        own = b" ".join(m[0].encode().lower().split())
        if own:
            if words:
                yield start, m.start(), words
                start = m.start()
            words = own
        end = m.end()
    if words:
        yield start, end, words


def units(docs: DataFrame) -> DataFrame:
    """Every unit of ``doc, tie, text``: its place, range of code points and digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in UNITS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        out: list[tuple] = []
        raw: list[bytes] = []

        def batch_of() -> pa.RecordBatch:
            halves = np.frombuffer(b"".join(raw), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(zip(*out), kinds)), pa.array(halves[:, 0]), pa.array(halves[:, 1])], names=names)

        for batch in batches:
            for doc, tie, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                for place, (start, end, words) in enumerate(split(text.as_py())):
                    out.append((doc, tie, place, start, end))
                    raw.append(blake2b(words, digest_size=16).digest())
                    if len(out) >= 20_000:
                        yield batch_of()
                        out.clear()
                        raw.clear()
        if out:
            yield batch_of()

    return docs.mapInArrow(run, UNITS)


def repeated(found: DataFrame) -> DataFrame:
    """The digests that occur more than once, with the occurrence of least rank and their number."""
    rank = F.struct("doc", "tie", "place")
    return found.groupBy("hi", "lo").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")


def repeats(found: DataFrame) -> DataFrame:
    """All occurrences but the first of each digest: ``doc, tie, place, start, end, first_doc``."""
    verdicts = written(repeated(found), "repeated-units")
    most = verdicts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    frequent = F.col("n") * HOT_SHARE > most
    hot = verdicts.where(frequent).select("hi", "lo", F.lit(True).alias("hot"))
    dealt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc", "place"), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.when(frequent, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return (
        found.join(F.broadcast(hot), ["hi", "lo"], "left")
        .withColumn("salt", dealt)
        .join(verdicts.select("hi", "lo", "first", F.explode(salts).alias("salt")), ["hi", "lo", "salt"])
        .where(F.struct("doc", "tie", "place") > F.col("first"))
        .select("doc", "tie", "place", "start", "end", F.nullif(F.col("first.doc"), F.lit(_LAST)).alias("first_doc"))
    )


def passages(again: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """Runs of consecutive repeats of at least ``least_chars``, as one sorted list ``removed`` for each ``doc, tie``."""
    # rows of one id and text give the same units
    in_text = Window.partitionBy("doc", "tie").orderBy("place")
    once = again.dropDuplicates(["doc", "tie", "place"])
    runs = once.withColumn("run", F.col("place") - F.row_number().over(in_text)).groupBy("doc", "tie", "run")
    whole = runs.agg(F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end"), F.min_by("first_doc", "place").alias("first_doc"))
    return whole.where(F.col("end") - F.col("start") >= least_chars).groupBy("doc", "tie").agg(F.sort_array(F.collect_list(F.struct("start", "end", "first_doc"))).alias("removed"))


def _without(batch: pa.RecordBatch) -> Iterable[Part]:
    """The texts of a batch without their removed ranges."""
    texts = batch.column(batch.schema.get_field_index("_text"))
    gone = batch.column(batch.schema.get_field_index("removed"))
    out = []
    for text, ranges in zip(texts, gone):
        text = text.as_py()
        if len(ranges):
            at, kept = 0, []
            for r in ranges.as_py():
                kept.append(text[at : r["start"]])
                at = r["end"]
            text = "".join(kept) + text[at:]
        out.append(text)
    yield 0, batch.num_rows, [pa.array(out, pa.string())]


def dedup(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """Replaces ``text`` by what stays of it and adds ``removed``: start, end and the document that keeps the passage."""
    kept = [c for c in docs.columns if c not in ("text", "removed", "_text")]
    own = docs.select(*kept, F.col("text").cast("string").alias("_text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("_doc"), F.xxhash64("text").alias("_tie"))
    keyed = own.where("_text is not null").select(F.col("_doc").alias("doc"), F.col("_tie").alias("tie"), F.col("_text").alias("text"))
    lists = passages(repeats(units(keyed)), least_chars).select(F.col("doc").alias("_doc"), F.col("tie").alias("_tie"), "removed")
    none = F.array().cast("array<struct<start:long,end:long,first_doc:long>>")
    joined = own.join(lists, ["_doc", "_tie"], "left").select(*kept, "_text", F.coalesce("removed", none).alias("removed"))
    return map_columns(joined, _without, [T.StructField("text", T.StringType())]).select(*kept, "text", "removed")


def report(deduped: DataFrame) -> DataFrame:
    spans = F.array_join(F.transform("removed", lambda r: F.concat_ws(":", r.start, r.end, r.first_doc)), ",")
    chars = F.aggregate("removed", F.lit(0).cast("long"), lambda s, r: s + r.end - r.start)
    return deduped.select("doc_id", "text", F.size("removed").cast("long").alias("n_removed"), chars.alias("chars_removed"), spans.alias("removed"))
