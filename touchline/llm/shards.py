"""Token-id shards in training order.

Every document is one sequence of token ids, closed by an end id. A keyed
Feistel permutation with cycle walking gives each of the N sequences a slot in
0 .. N - 1; a shard is a range of slots. One shuffle brings the sequences to
their shards, a partition each, sorted by slot; each shard's ids are laid end to end and cut into
rows of a fixed stride (the last row is filled with end ids), so a reader can
seek to any row and go on from there.

A sequence's number is the place of its id among all ids, in every case. Ids are
ranked without a shuffle of texts where a bitmap of them, 4 kB for 32 768 ids, can
be broadcast (up to ``most_buckets`` buckets, 16 MB); else by a range partitioning
of the ids alone, which the rows are joined with, hot ids by broadcast. Of the rows
that repeat an id the one of least text has the id's number; the others and rows
without an id are numbered behind all ids, so they move no other document. Those
are counted by kind first, then dealt over buckets by hash, so neither a repeated
row nor a missing id gathers anywhere.

Files are written under another name and moved into place, so a task that runs
twice leaves the same shard.

Results by case: null and empty texts are a sequence of the end id alone; rows
that repeat an id, or have none, are sequences of their own; an empty table
gives no shard; a very long text is one row of one task; further columns are
left out. A vocabulary whose ids need more than 16 bits is an error.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window, functions as F

from touchline.llm._arrow import join_counted, partitions, shared_folder, written

#: Ids in a row of a shard.
STRIDE = 2048
#: Text of a shard where their number is not given; ids take about half of it.
SHARD_BYTES = 256 << 20
ROUNDS = 6
#: Buckets of 2**15 ids whose bitmaps are broadcast.
MOST_BUCKETS = 1 << 12
#: Rows of a bucket, about, and most buckets, where rows behind all ids are numbered.
BUCKET_ROWS, MOST_COUNTS = 1 << 14, 1 << 16
#: The pattern that splits texts before merging, as published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256
_U = np.uint64


class Permutation:
    """A keyed bijection of 0 .. n - 1: a balanced Feistel network over the next even power of two, walked until inside."""

    def __init__(self, n: int, key: bytes):
        self.n = n
        self.half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
        self.keys = [_U(int.from_bytes(hashlib.blake2b(bytes([r]), key=key, digest_size=8).digest(), "little")) for r in range(ROUNDS)]

    def _round(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (x ^ key) * _U(0x9E3779B97F4A7C15)
            x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
        return (x ^ (x >> _U(32))) & _U((1 << self.half) - 1)

    def _once(self, x: np.ndarray, keys: list) -> np.ndarray:
        left, right = x >> _U(self.half), x & _U((1 << self.half) - 1)
        for k in keys:
            left, right = right, left ^ self._round(right, k)
        return right << _U(self.half) | left  # halves change sides, so the inverse is the same walk with the keys reversed

    def _walk(self, x: np.ndarray, keys: list) -> np.ndarray:
        x = self._once(np.asarray(x).astype(_U), keys)
        while (out := x >= _U(self.n)).any():
            x[out] = self._once(x[out], keys)
        return x.astype(np.int64)

    def slot(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, self.keys)

    def index(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self.keys[::-1])


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if max(ranks.values(), default=0) > 0xFFFF:
        raise ValueError(f"{path}: ids above 65535 do not fit the shards' 16 bits")
    return tiktoken.Encoding("shards", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _files(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def numbered(docs: DataFrame, most_buckets: int = MOST_BUCKETS) -> tuple[DataFrame, int]:
    """``number, doc_id, text`` with dense numbers, and how many rows there are."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bucket, bit = F.bitmap_bucket_number("doc_id"), F.bitmap_bit_position("doc_id")
    ids = rows.select("doc_id")
    size = ids.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(bucket).alias("buckets")).first()

    def bitmaps(of: DataFrame) -> dict[int, np.ndarray] | None:
        """Bits of the ids by bucket; None where there are too many buckets."""
        found = of.where("doc_id is not null").groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(bit).alias("bitmap")).orderBy("bucket").limit(most_buckets + 1).collect()  # 4 kB each
        return None if len(found) > most_buckets else {r["bucket"]: np.frombuffer(r["bitmap"], np.uint8) for r in found}

    every = bitmaps(ids) if size["buckets"] <= 2 * most_buckets else None
    if every is None:
        placed, distinct = _ranked_by_range(rows)
    else:
        distinct = sum(int(np.bitwise_count(b).sum()) for b in every.values())
        repeated = ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        placed = _ranked_by_bitmaps(rows, every, bitmaps(repeated) if distinct < size["n"] else {})
    if distinct < size["n"]:
        return _with_odd_rows(placed, distinct, size["n"] - distinct), size["n"]
    return placed.select("number", "doc_id", "text"), size["n"]


def _ranked_by_bitmaps(rows: DataFrame, every: dict[int, np.ndarray], repeated: dict[int, np.ndarray]) -> DataFrame:
    """``number, doc_id, text, odd``: the id's rank, and whether other rows have the id or there is none."""
    bases = np.cumsum([0, *(int(np.bitwise_count(b).sum()) for b in every.values())]).tolist()
    shared = rows.sparkSession.sparkContext.broadcast({k: (first, bits.tobytes(), repeated[k].tobytes() if k in repeated else b"") for (k, bits), first in zip(every.items(), bases)})
    ones = lambda bits: np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = np.asarray(batch.column(0).is_valid())
            at, bits = (batch.column(k).fill_null(0).to_numpy() for k in (2, 3))
            out, odd = np.zeros(len(at), np.int64), ~known
            for b in np.unique(at[known]).tolist():
                own = known & (at == b)
                first, bitmap, more = shared.value[b]
                out[own] = first + (np.cumsum(ones(bitmap)) - 1)[bits[own]]
                if more:
                    odd[own] = ones(more)[bits[own]] == 1
            yield pa.RecordBatch.from_arrays([pa.array(out, mask=~known), batch.column(0), batch.column(1), pa.array(odd)], names=["number", "doc_id", "text", "odd"])

    bucket, bit = F.bitmap_bucket_number("doc_id"), F.bitmap_bit_position("doc_id")
    return rows.select("doc_id", "text", bucket.alias("bucket"), bit.alias("bit")).mapInArrow(run, "number long, doc_id long, text string, odd boolean")


def _ranked_by_range(rows: DataFrame) -> tuple[DataFrame, int]:
    """The same by ranges of the ids, and how many ids there are."""
    spark = rows.sparkSession
    copies = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    # a partition's number and a row's place in it are the halves of the id that Spark gives; written, so they stay
    ranges = written(copies.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id").withColumn("at", F.monotonically_increasing_id()), "id-ranks")
    part = F.shiftright("at", 33)
    counts = sorted((r["part"], r["count"]) for r in ranges.groupBy(part.alias("part")).count().collect())  # one for each partition
    bases = spark.createDataFrame([(p, int(first)) for (p, _), first in zip(counts, np.cumsum([0] + [c for _, c in counts]))], "part long, base long")
    ranks = ranges.join(F.broadcast(bases), part == F.col("part")).select("doc_id", "n", (F.col("base") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("number"), (F.col("n") > 1).alias("odd"))
    found = join_counted(rows.where("doc_id is not null"), ranks, ["doc_id"], F.col("text")).select("number", "doc_id", "text", "odd")
    none = rows.where("doc_id is null").select(F.lit(None).cast("long").alias("number"), "doc_id", "text", F.lit(True).alias("odd"))
    return found.unionByName(none), sum(c for _, c in counts)


def _with_odd_rows(placed: DataFrame, distinct: int, more: int) -> DataFrame:
    """Rows of ids of their own by rank, one row of each repeated id too; the others behind all ids."""
    odd = written(placed.where("odd"), "odd-rows")
    first = odd.where("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("number").alias("number"))
    each = odd.select("doc_id", "text", F.lit(1).alias("copies")).unionByName(first.select("doc_id", "text", F.lit(-1).alias("copies")))
    kinds = each.groupBy("doc_id", "text").agg(F.sum("copies").alias("copies")).where("copies > 0")
    columns = ["number", "doc_id", "text"]
    return placed.where("not odd").select(*columns).unionByName(first.select(*columns)).unionByName(_numbered_by_count(kinds, distinct, more))


def _numbered_by_count(kinds: DataFrame, base: int, n: int) -> DataFrame:
    """Numbers from ``base`` on for n rows, given as kinds with their copies; a bucket begins where those before it end."""
    buckets = max(1, min(MOST_COUNTS, n // BUCKET_ROWS))
    kinds = kinds.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)))
    counts = sorted((r["bucket"], r["n"]) for r in kinds.groupBy("bucket").agg(F.sum("copies").alias("n")).collect())  # at most MOST_COUNTS
    bases = kinds.sparkSession.createDataFrame([(b, base + int(first)) for (b, _), first in zip(counts, np.cumsum([0] + [c for _, c in counts]))], "bucket long, base long")
    before = Window.partitionBy("bucket").orderBy("doc_id", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = kinds.withColumn("first", F.coalesce(F.sum("copies").over(before), F.lit(0))).join(bases, "bucket")
    return placed.select(F.explode(F.sequence(F.col("base") + F.col("first"), F.col("base") + F.col("first") + F.col("copies") - 1)).alias("number"), "doc_id", "text")


INDEX = "shard int, slot long, doc_id long, start long, n_tokens long, path string"


def materialise(docs: DataFrame, vocabulary: str, key: bytes, shards: int | None = None, stride: int = STRIDE, folder: str | None = None) -> DataFrame:
    """Writes the shards and gives their index: each sequence's slot, shard, first id in the shard and length.

    Without ``shards`` there is one for each ``SHARD_BYTES`` of text, and no fewer than the session's shuffle partitions.
    """
    spark = docs.sparkSession
    rows, n = numbered(docs)
    if shards is None:
        shards = max(partitions(spark), -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES))
    folder = folder or f"{shared_folder(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"
    size = max(1, -(-n // shards))
    permutation = Permutation(max(n, 1), key)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoding(vocabulary)
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                slots = permutation.slot(part.column(0).to_numpy())
                ids = [e.encode_to_numpy(t.as_py()).astype("<u2").tobytes() for t in part.column(2)]
                yield pa.RecordBatch.from_arrays([pa.array((slots // size).astype(np.int32)), pa.array(slots), part.column(1), pa.array(ids, pa.binary())], names=["shard", "slot", "doc_id", "ids"])

    sequences = rows.mapInArrow(encode, "shard int, slot long, doc_id long, ids binary")
    end = np.array([END], "<u2").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _files(folder)
        fs.create_dir(root, recursive=True)
        now, out, temporary, at = None, None, "", 0

        def close() -> None:
            out.write(end * (-at % stride))
            out.close()
            fs.move(temporary, f"{root}/{now:06d}.ids")

        for batch in batches:
            index = []
            for shard, slot, doc, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != now:
                    if now is not None:
                        close()
                    now, at = shard, 0
                    temporary = f"{root}/.{shard:06d}-{uuid.uuid4().hex}"
                    out = fs.open_output_stream(temporary)
                out.write(ids + end)
                count = len(ids) // 2 + 1
                index.append((shard, slot, doc, at, count, f"{folder}/{shard:06d}.ids"))
                at += count
            if index:
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*index), kinds)], names=["shard", "slot", "doc_id", "start", "n_tokens", "path"])
        if now is not None:
            close()

    placed = sequences.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "slot")
    return written(placed.mapInArrow(write, INDEX), "shard-index")


def read_rows(path: str, first_row: int = 0, stride: int = STRIDE) -> Iterator[np.ndarray]:
    """The rows of a shard from ``first_row`` on."""
    fs, place = _files(path)
    with fs.open_input_file(place) as f:
        f.seek(first_row * stride * 2)
        while row := f.read(stride * 2):
            yield np.frombuffer(row, "<u2")


def read_back(index: DataFrame, shards: int | None = None) -> DataFrame:
    """Reads every shard from its start to its end: each sequence with a digest of its ids as they stand in the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, f = None, None
        for batch in batches:
            digests = []
            for start, n, path in zip(*(batch.column(k).to_pylist() for k in (3, 4, 5))):
                if path != now:
                    if f:
                        f.close()
                    fs, place = _files(path)
                    now, f = path, fs.open_input_file(place)
                if f.tell() != start * 2:
                    f.seek(start * 2)
                digests.append(hashlib.sha256(f.read(n * 2)).hexdigest())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (2, 1, 0, 3, 4)), pa.array(digests)], names=["doc_id", "slot", "shard", "start", "n_tokens", "ids_sha256"])
        if f:
            f.close()

    shards = shards or (index.agg(F.max("shard").alias("s")).first()["s"] or 0) + 1
    placed = index.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "slot")
    return placed.mapInArrow(run, "doc_id long, slot long, shard int, start long, n_tokens long, ids_sha256 string")
