"""N-gram Jaccard join by blocked sparse matrix products.

The rows of the incidence matrix are documents, its columns 5-word shingles.
Nothing is ever exchanged row by row; columns travel as packed blocks:

1.  Equal shingle sets form a class; from here on a row is a distinct set.
2.  Column blocks find the shingles that two rows or more hold. A row that
    shares fewer than 3/4 of its own shingles cannot link (an intersection of at
    least 3/4 of the larger set is needed) and drops out. A shingle that several
    rows of one map-side chunk hold is counted there and sent once.
3.  What is left is ordered by rarity. A row needs a common shingle among its
    first ``n - ceil(3n/4) + 1``; rows of its candidates meet in the group of the
    least row that holds such a shingle.
4.  A group of more rows than a tile meets ``PIVOTS`` of its rows first, which
    ties most of a group of near copies in one pass over it. Rows that are tied
    already need not be compared: the largest tied part meets only the rest.
5.  A group is cut into tiles of bounded size; each pair of tiles is one block
    of the product: overlaps add up over column blocks, pairs outside the size
    bounds are discarded, and pairs that reach the threshold leave as the edges
    of a spanning forest.
6.  Connected components over the edges, spread back over the classes.

The bounds are exact: no pair that links is lost, and every overlap is counted
in full. Shingles are told apart by all 64 bits of their hash at every step, sets by
128 bits, rows in the product by 64 bits. Blocks are sized by the number of shingles.

Results by case: texts that are null or without words have an empty set and are
their own component; short texts have one shingle; repeated rows each keep a
row; rows with null ``doc_id`` keep a row with null component; a very long text
is one row of one task, its shingles are dealt over all blocks; further columns
are left out; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from touchline.llm._arrow import discard, join_counted, partitions, written
from touchline.llm._words import mix, shingle_sets, text_slices, words
from touchline.llm.components import components

SHINGLE = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Shingles that a map task gathers before it sends blocks.
CHUNK = 1_000_000
#: Rows of a tile and columns of a block in the product.
TILE, COLUMNS = 512, 4096
#: Rows of a large group that all others of it are compared with first.
PIVOTS = 8
#: Shingles that one block is meant for.
BLOCK_SHINGLES = 3_000_000
_U = np.uint64


def _needed(n):
    """The least intersection that a set of n can link with: 3/4 of it, rounded up."""
    return -(-PERCENT * n // 100)


def _set_hashes(hashes: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(mix(hashes + _U(0x1234567)).sum(dtype=_U)), int(mix(hashes ^ _U(0xA5A5A5A5A5A5A5A5)).sum(dtype=_U))


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, n_shingles`` and the 128-bit hash of the shingle set (``hi``, ``lo``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_slices(batch.column(1)):
                n, hi, lo = [], [], []
                for s in shingle_sets(words(piece), shingle):
                    a, b = _set_hashes(s)
                    n.append(len(s))
                    hi.append(a)
                    lo.append(b)
                as_long = lambda x: pa.array(np.array(x, _U).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.first, piece.rows), pa.array(n, pa.int64()), as_long(hi), as_long(lo)], names=["doc_id", "n_shingles", "hi", "lo"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, hi long, lo long")


# -- packed blocks --------------------------------------------------------

BLOCK = "block int, kind int, ids binary, sizes binary, counts binary, hashes binary"
_NAMES = ["block", "kind", "ids", "sizes", "counts", "hashes"]


def _packed(block: int, kind: int, ids, sizes, counts, hashes) -> tuple:
    return block, kind, ids.astype(_U).tobytes(), sizes.astype(np.uint32).tobytes(), counts.astype(np.uint32).tobytes(), hashes.astype(_U).tobytes()


def _frame(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=_NAMES)


def _split(blocks: np.ndarray, row: np.ndarray, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray, kind: int) -> Iterator[tuple]:
    """Packs entries (block, row, hash) into one tuple for each block; rows must ascend."""
    by = np.argsort(blocks, kind="stable")
    blocks, row, hashes = blocks[by], row[by], hashes[by]
    cuts = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]]) if len(blocks) else np.zeros(0, np.int64)
    for a, b in zip(cuts, np.r_[cuts[1:], len(blocks)]):
        r = row[a:b]
        first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        yield _packed(int(blocks[a]), kind, ids[r[first]], sizes[r[first]], np.diff(np.r_[first, b - a]), hashes[a:b])


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Groups the rows of a partition that is sorted by block."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and row[0] != now:
                yield now, rows
                rows = []
            now = row[0]
            rows.append(row)
    if rows:
        yield now, rows


def _unpacked(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, sizes, counts and hashes of several packed rows."""
    join = lambda at, kind: np.frombuffer(b"".join(r[at] for r in rows), kind)
    return join(2, _U), join(3, np.uint32), join(4, np.uint32).astype(np.int64), join(5, _U)


def _together(df: DataFrame, blocks: int) -> DataFrame:
    return df.repartitionById(blocks, F.col("block")).sortWithinPartitions("block")


_COLUMN, _ROW, _COMMON = 0, 1, 2


def linkable_sets(docs: DataFrame, blocks: int, shingle: int = SHINGLE) -> DataFrame:
    """Step 2: ``id, n, shingles`` (sorted, shared ones only) of the sets that share 3/4 of their shingles, by ``chunk``."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], None] = {}
        sets: list[np.ndarray] = []
        total = 0

        def flush() -> pa.RecordBatch:
            ids = np.array([hi for hi, _ in seen], _U)
            sizes = np.array([len(s) for s in sets], np.int64)
            h = np.concatenate(sets)
            row = np.repeat(np.arange(len(sets)), sizes)
            column = ((h >> _U(40)) % _U(blocks)).astype(np.int64)
            order = np.argsort(h)
            same = np.zeros(len(h), bool)
            equal = h[order][1:] == h[order][:-1]
            same[1:] |= equal
            head = same.copy()
            same[:-1] |= equal
            common = np.zeros(len(h), bool)
            common[order] = same
            first_common = order[same & ~head]
            rows = list(_split(column[~common], row[~common], h[~common], ids, sizes, _COLUMN))
            if common.any():
                # held by several rows of this chunk: known to be shared, so they go to their rows' blocks at once ...
                rows += _row_blocks(row[common], h[common], ids, sizes)
                # ... and once to the column's block, for the rows of other chunks
                none = np.zeros(0, _U)
                c = column[first_common]
                by = np.argsort(c, kind="stable")
                cuts = np.flatnonzero(np.r_[True, c[by][1:] != c[by][:-1]])
                for a, b in zip(cuts, np.r_[cuts[1:], len(c)]):
                    rows.append(_packed(int(c[by][a]), _COMMON, none, none, none, h[first_common[by][a:b]]))
            return _frame(rows)

        for batch in batches:
            for piece in text_slices(batch.column(0)):
                for s in shingle_sets(words(piece), shingle):
                    if not len(s) or (sig := _set_hashes(s)) in seen:
                        continue
                    seen[sig] = None
                    sets.append(s)
                    total += len(s)
                    if total >= CHUNK:
                        yield flush()
                        seen.clear()
                        sets, total = [], 0
        if sets:
            yield flush()

    def _row_blocks(row, hashes, ids, sizes) -> list[tuple]:
        """Entries on their way to their row's block."""
        to = (ids[row] % _U(blocks)).astype(np.int64)
        by = np.argsort(row, kind="stable")
        return list(_split(to[by], row[by], hashes[by], ids, sizes, _ROW))

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _by_block(batches):
            passed = [r for r in rows if r[1] == _ROW]
            if passed:
                yield _frame(passed)
            ids, sizes, counts, h = _unpacked([r for r in rows if r[1] == _COLUMN])
            _, _, _, common = _unpacked([r for r in rows if r[1] == _COMMON])
            if not len(h):
                continue
            owner = np.repeat(np.arange(len(ids)), counts)
            order = np.argsort(h)
            sorted_h = h[order]
            first = np.flatnonzero(np.r_[True, sorted_h[1:] != sorted_h[:-1]])
            who = ids[owner[order]]
            several = np.minimum.reduceat(who, first) != np.maximum.reduceat(who, first)
            if len(common):
                common = np.unique(common)
                at = np.minimum(np.searchsorted(common, sorted_h[first]), len(common) - 1)
                several |= common[at] == sorted_h[first]
            shared = np.zeros(len(h), bool)
            shared[order] = np.repeat(several, np.diff(np.r_[first, len(h)]))
            entries = np.flatnonzero(shared)
            if len(entries):
                yield _frame(_row_blocks(owner[entries], h[entries], ids, sizes))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _by_block(batches):
            ids, sizes, counts, key = _unpacked(rows)
            owner = np.repeat(np.arange(len(ids)), counts)
            by = np.lexsort((key, ids[owner]))
            who, key, size = ids[owner][by], key[by], sizes[owner][by]
            new = np.r_[True, (who[1:] != who[:-1]) | (key[1:] != key[:-1])]
            who, key, size = who[new], key[new], size[new].astype(np.int64)
            first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
            n_shared = np.diff(np.r_[first, len(who)])
            keep = np.flatnonzero(n_shared >= _needed(size[first]))
            if len(keep):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(keep), block, np.int32)),
                        pa.array(who[first[keep]].view(np.int64)),
                        pa.array(size[first[keep]]),
                        pa.array([key[first[k] : first[k] + n_shared[k]].tobytes() for k in keep.tolist()], pa.binary()),
                    ],
                    names=["chunk", "id", "n", "shingles"],
                )

    at_columns = _together(docs.select("text").mapInArrow(chunks, BLOCK), blocks).mapInArrow(columns, BLOCK)
    return _together(at_columns, blocks).mapInArrow(rows_of, "chunk int, id long, n long, shingles binary")


# -- asking for a value of each column --------------------------------------

ASK = "block int, chunk int, keys binary, vals binary"


def _asked(requests: DataFrame, reduce: Callable, blocks: int) -> DataFrame:
    """Sums (np.add) or takes the least (np.minimum) of ``vals`` by key over all chunks and answers each chunk.

    ``requests``: rows ``block, chunk, keys, vals``; a chunk asks once for a key, however many of its rows hold it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_block(batches):
            keys = np.frombuffer(b"".join(r[2] for r in rows), _U)
            vals = np.frombuffer(b"".join(r[3] for r in rows), np.int64)
            order = np.argsort(keys, kind="stable")
            first = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])
            total = reduce.reduceat(vals[order], first)
            out = np.empty(len(keys), np.int64)
            out[order] = np.repeat(total, np.diff(np.r_[first, len(keys)]))
            cuts = np.cumsum([0] + [len(r[2]) // 8 for r in rows])
            answers = [out[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary()), pa.array(answers, pa.binary())], names=["chunk", "keys", "vals"]
            )

    return _together(requests, blocks).mapInArrow(run, "chunk int, keys binary, vals binary")


def _requests(chunk: int, keys: np.ndarray, vals: np.ndarray, blocks: int) -> pa.RecordBatch:
    to = (mix(keys) % _U(blocks)).astype(np.int32)
    by = np.argsort(to, kind="stable")
    keys, vals, to = keys[by], vals[by], to[by]
    cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, np.int64)
    ends = np.r_[cuts[1:], len(to)] if len(to) else cuts
    return pa.RecordBatch.from_arrays(
        [pa.array(to[cuts]), pa.array(np.full(len(cuts), chunk, np.int32)), pa.array([keys[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()), pa.array([vals[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary())],
        names=["block", "chunk", "keys", "vals"],
    )


def _ask_of_sets(sets: DataFrame, column: str, reduce: Callable, blocks: int) -> DataFrame:
    """Asks, for each chunk of sets, for the number of sets (np.add) or the least id (np.minimum) by shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunk = batch.column(0).to_numpy()
            for c in np.unique(chunk).tolist():
                own = np.flatnonzero(chunk == c).tolist()
                lists = [np.frombuffer(batch.column(2)[k].as_py(), _U) for k in own]
                keys = np.concatenate(lists)
                vals = np.ones(len(keys), np.int64) if reduce is np.add else np.repeat(np.array([batch.column(1)[k].as_py() for k in own], np.int64), [len(x) for x in lists])
                if not len(keys):
                    continue
                order = np.argsort(keys, kind="stable")
                first = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])
                yield _requests(c, keys[order][first], reduce.reduceat(vals[order], first), blocks)

    return _asked(sets.select("chunk", "id", column).mapInArrow(run, ASK), reduce, blocks)


def _with_answers(sets: DataFrame, answers: DataFrame, column: str, use: Callable, schema: str, blocks: int) -> DataFrame:
    """Brings each chunk's answers to its sets: ``use(id, n, list, answers of the list)`` gives a row."""
    left = sets.select(F.col("chunk").alias("block"), F.lit(1).alias("kind"), "id", "n", F.col(column).alias("keys"), F.lit(None).cast("binary").alias("vals"))
    right = answers.select(F.col("chunk").alias("block"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("n"), "keys", "vals")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        for chunk, rows in _by_block(batches):
            told = [r for r in rows if r[1] == 0]
            keys = np.frombuffer(b"".join(r[4] for r in told), _U)
            vals = np.frombuffer(b"".join(r[5] for r in told), np.int64)
            by = np.argsort(keys)
            keys, vals = keys[by], vals[by]
            out = []
            for _, kind, i, n, own, _ in rows:
                if kind:
                    own = np.frombuffer(own, _U)
                    out.append(use(chunk, i, n, own, vals[np.searchsorted(keys, own)]))
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], pa.schema(list(zip(names, [_ARROW[x.split()[1]] for x in schema.split(", ")]))))

    both = left.unionByName(right).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "kind")
    return both.mapInArrow(run, schema)


_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def _prefix(chunk: int, i: int, n: int, shingles: np.ndarray, holders: np.ndarray) -> tuple:
    """The shared shingles among the first n - needed + 1 by rarity; those that only this set holds come first of all."""
    length = n - _needed(n) + 1 - (n - len(shingles))
    lone = holders < 2
    order = np.lexsort((shingles[~lone], holders[~lone]))
    return chunk, i, n, shingles[~lone][order[: max(0, length - int(lone.sum()))]].tobytes()


# -- the product --------------------------------------------------------------


def _edges_of(rows: list[tuple[int, int, np.ndarray, int, int]], cross: bool) -> Iterator[tuple[int, int]]:
    """Spanning edges of the pairs that link among rows (id, n, shingles, side, tied); with ``cross`` only pairs of both sides. Pairs of one ``tied`` are passed over."""
    n = np.array([r[1] for r in rows], np.int64)
    side, tied = np.array([r[3] for r in rows]), np.array([r[4] for r in rows], np.int64)
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if cross else (np.arange(len(rows)),) * 2
    possible = 100 * np.minimum.outer(n[left], n[right]) >= PERCENT * np.maximum.outer(n[left], n[right])
    possible &= tied[left][:, None] != tied[right][None, :]
    if not cross:
        possible = np.triu(possible, 1)
    if not possible.any():
        return
    h = np.concatenate([r[2] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
    order = np.argsort(h, kind="stable")
    h, row = h[order], row[order]
    column = np.cumsum(np.r_[True, h[1:] != h[:-1]]) - 1
    held = np.bincount(column)
    keep = held[column] > 1  # a column of one row adds to no overlap
    column, row = (np.cumsum(held > 1) - 1)[column[keep]], row[keep]
    columns = int(column[-1]) + 1 if len(column) else 0
    overlap = np.zeros(possible.shape, np.float32)
    for a in range(0, columns, COLUMNS):
        lo, hi = np.searchsorted(column, [a, a + COLUMNS])
        part = np.zeros((len(rows), min(COLUMNS, columns - a)), np.float32)
        part[row[lo:hi], column[lo:hi] - a] = 1
        overlap += part[left] @ part[right].T if cross else part @ part.T
    common = overlap.astype(np.int64)
    union = n[left][:, None] + n[right][None, :] - common
    root = list(range(len(rows)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in np.argwhere(possible & (100 * common >= PERCENT * union)).tolist():
        a, b = int(left[a]), int(right[b])
        ra, rb = find(a), find(b)
        if ra != rb:
            root[rb] = ra
            yield rows[a][0], rows[b][0]


def pivot_edges(sets: DataFrame, members: DataFrame, sizes: DataFrame, tile: int) -> DataFrame:
    """Edges ``a, b`` from members of large groups to the pivots of their group that they link with. ``sizes``: rep, size, n."""
    chosen = members.join(sizes.select("rep"), "rep").groupBy("rep").agg(*[F.min_by("id", F.xxhash64("id", F.lit(k))).alias(f"p{k}") for k in range(PIVOTS)])
    tiles = F.ceil(F.col("size") / tile).cast("int")
    placed = join_counted(members, sizes.select("rep", tiles.alias("tiles"), "n"), ["rep"], F.col("id"), "inner")
    placed = placed.select(F.xxhash64("rep", F.pmod(F.xxhash64("id", F.lit(7)), F.col("tiles").cast("long"))).alias("part"), F.lit(1).alias("kind"), "id")
    every = chosen.join(sizes, "rep").select("rep", "size", F.explode(F.array_distinct(F.array(*[F.col(f"p{k}") for k in range(PIVOTS)]))).alias("id"))
    pivots = every.select("rep", "id", F.explode(F.sequence(F.lit(0), tiles - 1)).alias("own")).select(F.xxhash64("rep", F.col("own").cast("long")).alias("part"), F.lit(0).alias("kind"), "id")
    rows = placed.unionByName(pivots).join(sets.select("id", "n", "shingles"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _by_block(batches):
            leads = [(i, n, np.frombuffer(s, _U)) for _, kind, i, n, s in group if not kind]
            others = [r for r in group if r[1]]
            if not others:
                continue
            ids, n = np.array([r[2] for r in others], np.int64), np.array([r[3] for r in others], np.int64)
            h = np.frombuffer(b"".join(r[4] for r in others), _U)
            row = np.repeat(np.arange(len(others)), [len(r[4]) // 8 for r in others])
            out = []
            for lead, size, own in leads:
                at = np.minimum(np.searchsorted(own, h), len(own) - 1)
                common = np.bincount(row[own[at] == h], minlength=len(others))
                links = (100 * common >= PERCENT * (n + size - common)) & (ids != lead)
                out += [(int(i), lead) for i in ids[links]]
            if out:
                yield _edge_batch(out)

    return rows.select("part", "kind", "id", "n", "shingles").repartition("part").sortWithinPartitions("part", "kind").mapInArrow(run, "a long, b long")


def link_edges(sets: DataFrame, members: DataFrame, blocks: int, tile: int = TILE) -> DataFrame:
    """Edges ``a, b`` that connect all linked sets. ``members``: ``rep, id``; candidates meet in a group."""
    sizes = written(members.groupBy("rep").agg(F.count(F.lit(1)).alias("size")).where("size > 1").withColumn("n", F.col("size")), "jaccard-groups")
    large = sizes.where(F.col("size") > tile)
    small = join_counted(members, sizes, ["rep"], F.col("id"), "inner").where(F.col("size") <= tile)
    pairs = small.select(F.xxhash64("rep").alias("pair"), "id", F.lit(0).alias("side"), F.lit(0).alias("crossed"), F.col("id").alias("tied"))
    tied_edges = None
    if large.limit(1).count():
        tied_edges = written(pivot_edges(sets, members, large, tile), "jaccard-pivots")
        tied = components(tied_edges)
        grouped = join_counted(members, large, ["rep"], F.col("id"), "inner").join(tied.withColumnRenamed("node", "id"), "id", "left").select("rep", "id", F.coalesce("root", "id").alias("tied"))
        grouped = written(grouped, "jaccard-large")
        # of each group, the largest part that is tied, and the rest
        most = grouped.groupBy("rep", "tied").agg(F.count(F.lit(1)).alias("held")).groupBy("rep").agg(F.max_by("tied", "held").alias("main"), F.max("held").alias("held"), F.sum("held").alias("n"))
        most = written(most.select("rep", "main", F.ceil(F.col("held") / tile).cast("int").alias("mains"), F.ceil((F.col("n") - F.col("held")) / tile).cast("int").alias("rests"), "n").where("rests > 0"), "jaccard-parts")
        told = join_counted(grouped, most, ["rep"], F.col("id"), "inner").withColumn("is_main", F.col("tied") == F.col("main"))
        own = F.pmod(F.xxhash64("id", F.lit(7)), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("rests"))).cast("int")
        told = told.withColumn("own", own).select("rep", "id", "tied", "is_main", "own", "mains", "rests")
        # tiles of the rest meet each other, and the main part's tiles
        among = told.where("not is_main").select("*", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("other"))
        among = among.select(F.xxhash64("rep", F.lit(0), F.least("own", "other"), F.greatest("own", "other")).alias("pair"), "id", (F.col("own") > F.col("other")).cast("int").alias("side"), (F.col("own") != F.col("other")).cast("int").alias("crossed"), "tied")
        across = told.select("*", F.explode(F.sequence(F.lit(0), F.when(F.col("is_main"), F.col("rests")).otherwise(F.col("mains")) - 1)).alias("other"))
        rest_tile, main_tile = F.when(F.col("is_main"), F.col("other")).otherwise(F.col("own")), F.when(F.col("is_main"), F.col("own")).otherwise(F.col("other"))
        across = across.select(F.xxhash64("rep", F.lit(1), rest_tile, main_tile).alias("pair"), "id", F.col("is_main").cast("int").alias("side"), F.lit(1).alias("crossed"), "tied")
        pairs = pairs.unionByName(among).unionByName(across)
    placed = pairs.join(sets.select("id", "n", "shingles"), "id").repartition(blocks, "pair").sortWithinPartitions("pair")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for _, rows in _by_block(batches):
            out += _edges_of([(i, n, np.frombuffer(s, _U), side, tied) for _, i, n, s, side, _, tied in rows], bool(rows[0][5]))
            if len(out) > 10_000:
                yield _edge_batch(out)
                out = []
        if out:
            yield _edge_batch(out)

    edges = placed.select("pair", "id", "n", "shingles", "side", "crossed", "tied").mapInArrow(run, "a long, b long")
    return edges if tied_edges is None else edges.unionByName(tied_edges)


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*edges)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row; see the module."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = written(signatures(docs, shingle), "jaccard-signatures")
    blocks = max(partitions(docs.sparkSession), (signed.agg(F.sum("n_shingles").alias("n")).first()["n"] or 0) // BLOCK_SHINGLES)
    sets = written(linkable_sets(docs, blocks, shingle), "jaccard-sets")
    holders = _ask_of_sets(sets, "shingles", np.add, blocks)
    prefixes = written(_with_answers(sets, holders, "shingles", _prefix, "chunk int, id long, n long, prefix binary", blocks), "jaccard-prefixes")
    least = _ask_of_sets(prefixes, "prefix", np.minimum, blocks)
    reps = _with_answers(prefixes, least, "prefix", lambda c, i, n, _, rep: (i, np.unique(rep).tolist()), "id long, reps array<long>", blocks)
    members = written(reps.select(F.explode("reps").alias("rep"), "id"), "jaccard-members")
    discard(prefixes)
    roots = components(link_edges(sets, members, blocks))
    discard(sets, members)

    # classes of equal sets, then their components; map-side minima first, so a hot class is a row for each task
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy("hi", "lo").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    classes = written(classes.join(roots.withColumnRenamed("node", "hi"), "hi", "left"), "jaccard-classes")
    joined = written(classes.where("root is not null").groupBy("root").agg(F.min("first").alias("component"), F.count(F.lit(1)).alias("n")), "jaccard-components")
    labels = written(join_counted(classes, joined, ["root"], F.col("lo")).select("hi", "lo", F.coalesce("component", "first").alias("component"), "n"), "jaccard-labels")
    discard(classes, joined)
    return join_counted(signed, labels, ["hi", "lo"], F.col("doc_id")).select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id")
    )
