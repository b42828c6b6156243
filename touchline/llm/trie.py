"""The prefix trie of conversations, as the Cartesian tree over their sorted order's LCP array.

A conversation is a sequence of turns, kept as 20 bytes a turn: 16 of a SHA-256
digest of role and text, 4 of the text's length. Sorted by these bytes (then id),
all conversations that share their first d turns stand together, and ``L[i]``, the
number of turns that conversations i - 1 and i share, tells where such intervals
end: an interval of elements not below a value v, between the nearest smaller
element on its left and on its right, is a branching node of depth v. Elements of
equal value in it are one node; the depths between a node and its parent, where
nothing branches, are filled in; what a conversation shares with neither neighbour
is a chain of its own.

Range partitions of the sorted order are blocks. Nearest smaller values are found
inside each block with a stack, the one element shared with the next block
included. What stays open at a block's edge is resolved by block minima: the
nearest block with a smaller minimum is found in an array of one number for each
block, the element in it among that block's prefix or suffix minima, by a join.
Members, leaves and saved bytes of an interval are differences of prefix sums, so
a node that spans many blocks (a first turn of a third of all conversations)
gathers no rows. The driver holds five numbers for each block. The ids of equal
conversations that span blocks are hashed one packed piece after the other, as
SHA-256 has no other way; no piece is larger than a block's ids.

Results by case: rows without a conversation id are left out; null roles and texts
count as empty; turns of equal number are ordered by role, then by the digest of
their text, and a repeated row is a turn of its own; null turns stand first; a
conversation without turns is a member of the root; a very long text or
conversation is 20 bytes a turn; further columns are left out; an empty table has
no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from touchline.llm._arrow import partitions, written

#: Bytes of a turn: digest and length of the text.
DIGEST, UNIT = 16, 20
#: Bytes of the sequences of a block, about.
BLOCK_BYTES = 16 << 20
NOTHING = hashlib.sha256(b"").hexdigest()
_FAR = (1 << 63) - 1

NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def sequences(turns: DataFrame) -> DataFrame:
    """``conv_id, key``: the turns of each conversation in order, 20 bytes each."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    told = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)
    unit = F.concat(told, F.lpad(F.hex(F.octet_length(text).cast("long")), 2 * (UNIT - DIGEST), "0"))
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), unit.alias("unit")).where("conv_id is not null")
    rows = own.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "unit"))).alias("rows"))
    return rows.select("conv_id", F.unhex(F.array_join(F.transform("rows", lambda r: r.unit), "")).alias("key"))


def joined_prefixes(seqs: DataFrame, base, taken) -> DataFrame:
    """Each conversation with its first ``taken`` turns replaced by those of conversation ``base`` (Columns over ``conv_id``)."""
    seqs = written(seqs, "trie-sequences")
    bases = seqs.select(F.col("conv_id").alias("_base"), F.col("key").alias("_of"))
    own = seqs.select("conv_id", "key", base.cast("long").alias("_base"), (taken * UNIT).cast("int").alias("_cut"))
    head = F.coalesce(F.substring("_of", F.lit(1), F.col("_cut")), F.lit(b""))
    tail = F.substring("key", F.col("_cut") + 1, F.greatest(F.length("key") - F.col("_cut"), F.lit(0)))
    return own.join(bases, "_base", "left").select("conv_id", F.concat(head, tail).alias("key"))


def in_order(seqs: DataFrame) -> DataFrame:
    """``block, row, conv_id, key``: sorted by key, then id; ``row`` counts within the block."""
    spark = seqs.sparkSession
    seqs = written(seqs, "trie-rebuilt")
    size = seqs.agg(F.coalesce(F.sum(F.length("key").cast("long")), F.lit(0)).alias("bytes")).first()["bytes"]
    blocks = max(partitions(spark), -(-size // BLOCK_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block, np.int32)), pa.array(np.arange(at, at + n)), b.column(0), b.column(1)], names=["block", "row", "conv_id", "key"])
            at += n

    ordered = seqs.select("conv_id", "key").repartitionByRange(blocks, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    return written(ordered.mapInArrow(run, "block int, row long, conv_id long, key binary"), "trie-order")


def edges(ordered: DataFrame) -> DataFrame:
    """Each block's neighbours: the sequence before its first and the one behind its last; a row for each block."""
    ends = ordered.groupBy("block").agg(F.min_by("key", "row").alias("first"), F.max_by("key", "row").alias("last"))
    line = Window.orderBy("block")
    return ends.select("block", F.lag("last").over(line).alias("before"), F.lead("first").over(line).alias("behind"))


# -- one block -----------------------------------------------------------------


def shared_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b)) // UNIT
    x, y = (np.frombuffer(k, np.uint8)[: n * UNIT].reshape(n, UNIT)[:, :DIGEST] for k in (a, b))
    other = np.flatnonzero((x != y).any(axis=1))
    return int(other[0]) if len(other) else n


class Block:
    """The sorted conversations 0 .. n - 1 of a block, elements 0 .. n of the LCP array, and their nodes.

    Element n is the next block's first one. An element of value -1 is the end of
    the whole order. Nodes are numbered as the stack meets them: ``value``, ``lo``
    and ``hi`` (nearest smaller elements, -1 and n + 1 where open), ``equal`` (own
    elements of that value), ``at`` (one element) and ``parent``.
    """

    def __init__(self, keys: pa.Array, conv: np.ndarray, before: bytes | None, behind: bytes | None):
        self.n = n = len(conv)
        self.conv = conv
        keys = keys.cast(pa.large_binary())
        offsets = np.frombuffer(keys.buffers()[1], np.int64)[keys.offset : keys.offset + n + 1]
        raw = keys.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        units = data.reshape(-1, UNIT)
        digests = np.ascontiguousarray(units[:, :DIGEST]).view(np.uint64)
        self.first = (offsets - offsets[0]) // UNIT
        self.length = np.diff(self.first)
        self.bytes = np.concatenate([[0], np.cumsum(np.ascontiguousarray(units[:, DIGEST:]).view(">u4").ravel().astype(np.int64))])
        key = lambda i: data[self.first[i] * UNIT : self.first[i + 1] * UNIT].tobytes()
        lcp = np.empty(n + 1, np.int64)
        lcp[0] = -1 if before is None else shared_turns(before, key(0))
        lcp[n] = -1 if behind is None else shared_turns(key(n - 1), behind)
        lcp[1:n] = self._between(digests)
        self.lcp = lcp
        self.last = behind is None
        # same[i]: conversation i equals the one before it
        same = np.zeros(n + 1, bool)
        same[1:n] = (lcp[1:n] == self.length[1:]) & (lcp[1:n] == self.length[:-1])
        same[0] = before is not None and lcp[0] == self.length[0] == len(before) // UNIT
        same[n] = behind is not None and lcp[n] == self.length[n - 1] == len(behind) // UNIT
        self.same = same
        self.leaf = self.length > lcp[1:]
        self.leaves = np.cumsum(self.leaf)
        self.saved = np.cumsum(self.prefix_bytes(np.arange(n), np.maximum(lcp[:n], 0)))
        self.least_to = np.minimum.accumulate(conv)
        self.least_from = np.minimum.accumulate(conv[::-1])[::-1]
        self._nodes()

    def _between(self, digests: np.ndarray) -> np.ndarray:
        most = np.minimum(self.length[1:], self.length[:-1])
        pair = np.repeat(np.arange(len(most)), most)
        inside = np.arange(len(pair)) - np.repeat(np.cumsum(most) - most, most)
        differ = np.flatnonzero((digests[self.first[:-2][pair] + inside] != digests[self.first[1:-1][pair] + inside]).any(axis=1))
        pairs, at = np.unique(pair[differ], return_index=True)
        most[pairs] = inside[differ[at]]
        return most

    def prefix_bytes(self, i: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """Bytes of the first turns of conversations."""
        return self.bytes[self.first[i] + turns] - self.bytes[self.first[i]]

    def _nodes(self) -> None:
        value, lo, hi, equal, at, parent, below = [], [], [], [], [], [], []
        of = []
        stack: list[int] = []  # nodes; their values grow
        latest: list[int] = []  # the latest element of each node on the stack
        for i, v in enumerate(self.lcp.tolist()):
            mine = -1
            popped = []
            while stack and value[stack[-1]] > v:
                node = stack.pop()
                latest.pop()
                hi[node] = i
                popped.append(node)
            if stack and value[stack[-1]] == v:
                mine = stack[-1]
                latest[-1] = i
            else:
                mine = len(value)
                value.append(v)
                lo.append(latest[-1] if latest else -1)
                below.append(stack[-1] if stack else -1)
                hi.append(self.n + 1)
                equal.append(0)
                at.append(i)
                parent.append(-1)
                stack.append(mine)
                latest.append(i)
            for node in popped:
                under = below[node]
                parent[node] = under if under >= 0 and value[under] >= v else mine
            equal[mine] += i < self.n
            of.append(mine)
        self.value, self.lo, self.hi, self.equal, self.at, self.parent = (np.array(x, np.int64) for x in (value, lo, hi, equal, at, parent))
        self.of = np.array(of, np.int64)
        real = self.value >= 0
        self.closed = real & (self.lo >= 0) & (self.hi <= self.n)
        self.open = real & ~self.closed

    # what other blocks ask for: see _Left and _Right for the meaning of the numbers

    def left_record(self, k: int) -> tuple:
        return k, int(self.lcp[k]), int(self.saved[k]), int(self.leaves[k] - self.leaf[k]), int(self.least_from[k]), int(self.of[k])

    def right_record(self, k: int) -> tuple:
        own = (int(self.saved[k - 1]), int(self.leaves[k - 1]), int(self.least_to[k - 1])) if k else (0, 0, _FAR)
        return k, int(self.lcp[k]), *own, int(self.of[k])

    def suffix_minima(self) -> np.ndarray:
        own = self.lcp[: self.n]
        after = np.append(np.minimum.accumulate(own[::-1])[::-1][1:], _FAR)
        return np.flatnonzero(own < after)

    def prefix_minima(self) -> np.ndarray:
        own = self.lcp if self.last else self.lcp[: self.n]
        before = np.append(_FAR, np.minimum.accumulate(own)[:-1])
        return np.flatnonzero(own < before)

    def run_end(self, i: int) -> int:
        """The first conversation behind i that differs from it; n where the block ends first."""
        other = np.flatnonzero(~self.same[i + 1 : self.n])
        return i + 1 + int(other[0]) if len(other) else self.n


def _ids(conv: np.ndarray) -> bytes:
    return ",".join(map(str, conv.tolist())).encode()


#: A record of an element: place in its block, value, prefix sums and least id on its side, its node; from the left or the right.
RECORD = "k long, v long, saved long, leaves long, least long, node long"
NAMES = [x.split()[0] for x in RECORD.split(", ")]
FOUND = f"""kind string, block int, n long, leaves long, saved long, least long, lowest long,
    node long, v long, equal long, lo struct<{RECORD.replace(" long", ":long")}>, hi struct<{RECORD.replace(" long", ":long")}>, told string, ids binary"""


def _block_of(rows: pa.Table, about: pa.Table) -> Block:
    rows = rows.sort_by("row").combine_chunks()
    keys = rows.column("key").combine_chunks()
    keys = keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys
    return Block(keys, rows.column("conv_id").to_numpy(), about.column("before")[0].as_py(), about.column("behind")[0].as_py())


def first_pass(rows: pa.Table, about: pa.Table) -> pa.Table:
    """A block's sums and minimum, its prefix and suffix minima, its open nodes, and its pieces of runs that span blocks."""
    schema = pa.schema([("kind", pa.string()), ("block", pa.int32()), *[(c, pa.int64()) for c in ("n", "leaves", "saved", "least", "lowest", "node", "v", "equal")], *[(c, pa.struct([(x, pa.int64()) for x in NAMES])) for c in ("lo", "hi")], ("told", pa.string()), ("ids", pa.binary())])
    if not rows.num_rows:
        return schema.empty_table()
    number = rows.column("block")[0].as_py()
    b = _block_of(rows, about)
    record = lambda r: dict(zip(NAMES, r))
    lowest = int((b.lcp if b.last else b.lcp[: b.n]).min())
    out = [{"kind": "block", "n": b.n, "leaves": int(b.leaves[-1]), "saved": int(b.saved[-1]), "least": int(b.conv.min()), "lowest": lowest}]
    out += [{"kind": "left", "lo": record(b.left_record(int(k)))} for k in b.suffix_minima()]
    out += [{"kind": "right", "hi": record(b.right_record(int(k)))} for k in b.prefix_minima()]
    for c in np.flatnonzero(b.open).tolist():
        row = {"kind": "open", "node": c, "v": int(b.value[c]), "equal": int(b.equal[c])}
        if b.lo[c] >= 0:
            row["lo"] = record(b.left_record(int(b.lo[c])))
        if b.hi[c] <= b.n:
            row["hi"] = record(b.right_record(int(b.hi[c])))
        out.append(row)
    # runs of equal conversations that go on in another block
    key = lambda i: hashlib.sha256(rows.column("key")[0].as_py() if i is None else i).hexdigest()
    ordered = rows.sort_by("row")
    end = b.run_end(0)
    if b.same[0] or (end == b.n and b.same[b.n]):
        out.append({"kind": "run", "told": key(ordered.column("key")[0].as_py()), "n": end, "ids": _ids(b.conv[:end])})
    if b.same[b.n] and end < b.n:
        start = int(np.flatnonzero(~b.same[: b.n])[-1])
        out.append({"kind": "run", "told": key(ordered.column("key")[b.n - 1].as_py()), "n": b.n - start, "ids": _ids(b.conv[start:])})
    return pa.Table.from_pylist([r | {"block": number} for r in out], schema=schema)


# -- between blocks --------------------------------------------------------------


@dataclass
class Blocks:
    """Five numbers for each block, in order, and the sums before it. Bounded by the number of partitions."""

    number: np.ndarray
    n: np.ndarray
    leaves: np.ndarray
    saved: np.ndarray
    lowest: np.ndarray
    least: list[np.ndarray]

    @classmethod
    def of(cls, found: DataFrame) -> "Blocks":
        t = found.where("kind = 'block'").select("block", "n", "leaves", "saved", "least", "lowest").toArrow().sort_by("block")
        number, n, leaves, saved, least, lowest = (t.column(c).to_numpy() for c in t.column_names)
        before = lambda x: np.cumsum(x) - x
        table = [least]  # least ids over runs of 1, 2, 4 .. blocks
        while 2 << (len(table) - 1) <= len(least):
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        return cls(number, before(n), before(leaves), before(saved), lowest, table)

    def place(self, block: int) -> int:
        return int(np.searchsorted(self.number, block))

    def lower(self, block: int, v: int, step: int) -> int:
        """The nearest block before (-1) or behind (1) one whose minimum is below ``v``."""
        at = self.place(block)
        side = self.lowest[:at][::-1] if step < 0 else self.lowest[at + 1 :]
        return int(self.number[at + step * (1 + int(np.argmax(side < v)))])

    def least_between(self, a: int, b: int) -> int:
        """The least id in the blocks strictly between two."""
        lo, hi = self.place(a) + 1, self.place(b)
        if lo >= hi:
            return _FAR
        k = (hi - lo).bit_length() - 1
        return int(min(self.least[k][lo], self.least[k][hi - (1 << k)]))


ASKED = "block int, node long, v long, target int"
RESOLVED = "block int, node long, v long, equal long, start long, until long, leaves long, saved long, conv_id long, p long, p_block int, p_node long"


def resolve(found: DataFrame, blocks: Blocks) -> DataFrame:
    """What each block must know of its open nodes, a row for each: see ``ANSWER``."""
    shared = found.sparkSession.sparkContext.broadcast(blocks)
    opened = found.where("kind = 'open'").select("block", "node", "v", "equal", "lo", "hi")

    def asked(step: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                number, v = b.column(0).to_pylist(), b.column(2).to_pylist()
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([shared.value.lower(x, y, step) for x, y in zip(number, v)], pa.int32())], names=["block", "node", "v", "target"])

        return run

    sides = {}
    for side, kind, step, pick in (("lo", "left", -1, F.max), ("hi", "right", 1, F.min)):
        ask = opened.where(F.col(side).isNull()).select("block", "node", "v").mapInArrow(asked(step), ASKED)
        have = found.where(F.col("kind") == kind).select(F.col("block").alias("target"), F.col(side).alias("r"))
        met = ask.join(have, "target").where(F.col("r.v") < F.col("v")).groupBy("block", "node").agg(pick(F.struct("r", "target")).alias(f"_{side}"))
        sides[side] = met
    full = opened.join(sides["lo"], ["block", "node"], "left").join(sides["hi"], ["block", "node"], "left")
    full = full.select("block", "node", "v", "equal", *[x for s in ("lo", "hi") for x in (F.coalesce(s, f"_{s}.r").alias(s), F.coalesce(f"_{s}.target", "block").alias(f"{s}_block"))])

    def attributes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about = shared.value
        for b in batches:
            out = []
            for r in b.to_pylist():
                lo, hi = r["lo"], r["hi"]
                x, y = about.place(r["lo_block"]), about.place(r["hi_block"])
                start, until = int(about.n[x]) + lo["k"], int(about.n[y]) + hi["k"]
                leaves = int(about.leaves[y]) + hi["leaves"] - int(about.leaves[x]) - lo["leaves"]
                saved = int(about.saved[y]) + hi["saved"] - int(about.saved[x]) - lo["saved"]
                least = min(lo["least"], hi["least"], about.least_between(r["lo_block"], r["hi_block"]))
                up = (lo, r["lo_block"]) if lo["v"] >= hi["v"] else (hi, r["hi_block"])
                out.append((r["block"], r["node"], r["v"], r["equal"], start, until, leaves, saved, least, up[0]["v"], up[1], up[0]["node"]))
            names = [x.split()[0] for x in RESOLVED.split(", ")]
            kinds = [pa.int32() if "int" in x.split() else pa.int64() for x in RESOLVED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], names=names)

    known = written(full.mapInArrow(attributes, RESOLVED), "trie-open")
    whole = known.groupBy("start", "v").agg(F.sum("equal").alias("equal"), F.min("block").alias("owner"))
    parents = known.select(F.col("block").alias("p_block"), F.col("node").alias("p_node"), F.col("conv_id").alias("parent_conv_id"))
    out = known.drop("equal").join(whole, ["start", "v"]).join(parents, ["p_block", "p_node"], "left")
    return out.select("block", "node", (F.col("owner") == F.col("block")).alias("own"), "equal", (F.col("until") - F.col("start")).alias("n"), "leaves", "saved", "conv_id", "p", "parent_conv_id")


def long_runs(found: DataFrame) -> DataFrame:
    """Runs of equal conversations that span blocks: the block they start in, number and digest of their ids.

    A run's pieces, one for each block, go through one hasher in their order.
    """
    spark = found.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for b in batches:
            for told, block, n, ids in zip(*(b.column(i) for i in range(4))):
                if now is None or now[0] != told.as_py():
                    if now:
                        out.append((now[1], now[2], now[3].hexdigest()))
                    now = [told.as_py(), block.as_py(), 0, hashlib.sha256()]
                else:
                    now[3].update(b",")
                now[2] += n.as_py()
                now[3].update(ids.as_buffer())
        if now:
            out.append((now[1], now[2], now[3].hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string())], names=["block", "n", "sha"])

    pieces = found.where("kind = 'run'").select("told", "block", "n", "ids").repartition(partitions(spark), "told").sortWithinPartitions("told", "block")
    return pieces.mapInArrow(run, "block int, n long, sha string")


# -- nodes ---------------------------------------------------------------------


ANSWER = "block int, before binary, behind binary, opened array<struct<node:long,own:boolean,equal:long,n:long,leaves:long,saved:long,conv_id:long,p:long,parent_conv_id:long>>, run struct<n:long,sha:string>"
NODE_SCHEMA = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in NODES.split(", ")])


def second_pass(rows: pa.Table, about: pa.Table) -> pa.Table:
    """The nodes of a block: those closed in it, its conversations' own chains, and the open ones that it owns."""
    if not rows.num_rows:
        return NODE_SCHEMA.empty_table()
    b = _block_of(rows, about)
    answers = {r["node"]: r for r in about.column("opened")[0].as_py() or []}
    long_run = about.column("run")[0].as_py()
    conv = np.full(len(b.value), -1, np.int64)  # of each node; -1: none, as for the end of the order
    known = np.zeros(len(b.value), bool)
    c = np.flatnonzero(b.closed)
    lo, r = b.lo[c], b.hi[c] - 1
    if len(c):
        pairs = np.stack([lo, r + 1], axis=1).ravel()
        conv[c] = np.minimum.reduceat(np.append(b.conv, _FAR), pairs)[::2]
        known[c] = True
    for node, a in answers.items():
        conv[node], known[node] = a["conv_id"], True

    # a row for each chain: what it spans, its depths (from, to], sums, parent, a conversation that has its turns, and where its ends start
    i = np.arange(b.n)
    near = np.maximum(b.lcp[:-1], b.lcp[1:])
    alone = np.flatnonzero(b.length > near)
    up = np.where(b.lcp[:-1] >= b.lcp[1:], b.of[:-1], b.of[1:])[alone]
    owned = [a for a in answers.values() if a["own"]]
    o = np.array([a["node"] for a in owned], np.int64)
    column = lambda k: np.array([-1 if a[k] is None else a[k] for a in owned], np.int64)
    ids = np.concatenate([conv[c], b.conv[alone], conv[o]])
    top = np.concatenate([np.maximum(b.lcp[lo], b.lcp[b.hi[c]]), near[alone], column("p")])
    deep = np.concatenate([b.value[c], b.length[alone], b.value[o]])
    members = np.concatenate([r - lo + 1, np.ones(len(alone), np.int64), column("n")])
    leaves = np.concatenate([b.leaves[r] - b.leaves[lo] + b.leaf[lo], np.ones(len(alone), np.int64), column("leaves")])
    saved = np.concatenate([b.saved[r] - b.saved[lo], np.zeros(len(alone), np.int64), column("saved")])
    parent = np.concatenate([conv[b.parent[c]], conv[up], column("parent_conv_id")])
    has_parent = np.concatenate([known[b.parent[c]], known[up], np.array([a["parent_conv_id"] is not None for a in owned], bool)])
    equal = np.concatenate([b.equal[c], np.zeros(len(alone), np.int64), column("equal")])
    holder = np.concatenate([lo, alone, np.minimum(b.at[o], b.n - 1)])
    start = np.concatenate([lo, alone, b.lo[o]])
    n_ends, shas = np.zeros(len(ids), np.int64), np.full(len(ids), NOTHING, object)
    for k in np.flatnonzero((start >= 0) & (b.length[start] == deep)).tolist():
        s = int(start[k])
        end = b.run_end(s)
        if end == b.n and b.same[b.n]:
            n_ends[k], shas[k] = long_run["n"], long_run["sha"]
        else:
            n_ends[k], shas[k] = end - s, hashlib.sha256(_ids(b.conv[s:end])).hexdigest()
    is_chain = np.zeros(len(ids), bool)
    is_chain[len(c) : len(c) + len(alone)] = True
    children = np.where(is_chain, 0, equal + 1 - n_ends)

    depths = deep - top
    of = np.repeat(np.arange(len(ids)), depths)
    place = np.arange(len(of)) - np.repeat(np.cumsum(depths) - depths, depths)
    depth = top[of] + 1 + place
    last = place == depths[of] - 1
    above = np.where(place == 0, parent[of], ids[of])
    no_parent = (place == 0) & ~has_parent[of]
    less = (members[of] - 1) * b.prefix_bytes(holder[of], np.maximum(depth - 1, 0))
    return pa.Table.from_arrays(
        [
            pa.array(ids[of]), pa.array(depth), pa.array(above, mask=no_parent), pa.array(members[of]), pa.array(np.where(last, children[of], 1)),
            pa.array(leaves[of]), pa.array(saved[of] - less), pa.array(np.where(last, shas[of], NOTHING), pa.string()),
        ],
        schema=NODE_SCHEMA,
    )


def prefix_trie(seqs: DataFrame) -> DataFrame:
    """All nodes of the trie of ``conv_id, key`` (an id once each; ``sequences``): see the module's text and ``NODES``.

    A node is told by ``conv_id`` (its least member) and ``depth``. ``n_children``
    are its children, ``n_leaves`` the childless nodes of its subtree,
    ``saved_tokens`` the bytes that its subtree shares, ``ends_sha256`` the digest
    of the ids that end there.
    """
    ordered = in_order(seqs)
    beside = written(edges(ordered), "trie-edges")
    found = written(ordered.groupBy("block").cogroup(beside.groupBy("block")).applyInArrow(first_pass, FOUND), "trie-blocks")
    told = resolve(found, Blocks.of(found))
    opened = told.groupBy("block").agg(F.collect_list(F.struct("node", "own", "equal", "n", "leaves", "saved", "conv_id", "p", "parent_conv_id")).alias("opened"))
    runs = long_runs(found).select("block", F.struct("n", "sha").alias("run"))
    about = written(beside.join(opened, "block", "left").join(runs, "block", "left").select("block", "before", "behind", "opened", "run"), "trie-answers")
    return ordered.groupBy("block").cogroup(about.groupBy("block")).applyInArrow(second_pass, NODES)
