"""Centroid clustering by the filtering algorithm over kd-trees, one tree for each block of vectors.

Vectors become integers, so counts and sums are exact and results do not depend on
partitions. Each block of up to ``BLOCK`` vectors of a partition is a kd-tree: a node
splits its vectors in halves along the widest side of its box and keeps the box,
the number of vectors, their sum and the sum of their squares. Trees are written
once and read in each round.

A round takes every tree from its root. The centroid nearest to a box's middle
stands for the node; another one is pruned if it is strictly farther than that one
from the corner of the box that suits it best, so no vector of the box can prefer
it, nor tie with it. A node with one centroid left is assigned whole, by its sums;
the vectors of a leaf with more are compared one by one, ties to the smaller
number. A task returns one row for each centroid, and only ``k`` rows reach the
driver.

Results by case: vectors of another number of components, or with a null, NaN or
infinite one, are left out, as are those with a scaled component beyond ``LIMIT``,
whose distances 64 bits would not hold; equal vectors and repeated ids are rows of
their own; a null id hashes as the empty string; with fewer than ``k`` vectors there
are as many centroids as vectors; an empty table gives an empty one; further
columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from touchline.llm._arrow import written

#: Vectors of a tree and of a leaf.
BLOCK, LEAF = 4096, 32
#: Largest scaled component: squared distances and their sums stay within 64 bits.
LIMIT = 1 << 24

TREES = "n int, ids binary, known binary, points binary, first binary, count binary, low binary, high binary, total binary, squares binary"


def build(points: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The order of the points in the tree, and its nodes level by level: first, count, low, high, total, squares.

    A level has all nodes of it, so children of node j are 2j + 1 and 2j + 2.
    """
    n = len(points)
    order = np.arange(n)
    spans, level = [], [(0, n)]
    while True:
        spans += level
        if max(b - a for a, b in level) <= LEAF:
            break
        below = []
        for a, b in level:
            own = points[order[a:b]]
            middle = (b - a) // 2
            if middle:
                wide = np.argmax(own.max(axis=0) - own.min(axis=0))
                order[a:b] = order[a:b][np.argpartition(own[:, wide], middle, kind="introselect")]
            below += [(a, a + middle), (a + middle, b)]
        level = below
    first, until = np.array(spans, np.int64).T
    sorted_points = points[order]
    sums = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(sorted_points, axis=0, dtype=np.int64)])
    squares = np.append(0, np.cumsum((sorted_points.astype(np.int64) ** 2).sum(axis=1)))
    pairs = np.stack([first, until], axis=1).ravel()
    padded = np.concatenate([sorted_points, sorted_points[-1:]])
    low, high = np.minimum.reduceat(padded, pairs)[::2], np.maximum.reduceat(padded, pairs)[::2]
    return order, {"first": first, "count": until - first, "low": low, "high": high, "total": sums[until] - sums[first], "squares": squares[until] - squares[first]}


def trees(vectors: DataFrame, size: int, scale: float) -> DataFrame:
    """Written kd-trees over ``vec_id, embedding``: components are ``floor(scale * x)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, known, points, held = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal ids, known, points, held
            i, k, p = np.concatenate(ids), np.concatenate(known), np.concatenate(points)
            for at in range(0, len(p), BLOCK):
                own = p[at : at + BLOCK]
                order, t = build(own)
                cells = [i[at : at + BLOCK][order], k[at : at + BLOCK][order], own[order], t["first"], t["count"], t["low"], t["high"], t["total"], t["squares"]]
                yield pa.RecordBatch.from_arrays([pa.array([len(own)], pa.int32()), *[pa.array([c.tobytes()], pa.binary()) for c in cells]], names=[x.split()[0] for x in TREES.split(", ")])
            ids, known, points, held = [], [], [], 0

        for b in batches:
            if not b.num_rows:
                continue
            x = np.floor(scale * b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size))
            fits = (np.abs(x) <= LIMIT).all(axis=1)
            ids.append(b.column(0).fill_null(0).to_numpy(zero_copy_only=False)[fits])
            known.append(b.column(0).is_valid().to_numpy(zero_copy_only=False)[fits])
            points.append(x[fits].astype(np.int32))
            held += int(fits.sum())
            if held >= BLOCK:
                yield from flush()
        if held:
            yield from flush()

    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).where((F.size("embedding") == size) & ~bad)
    return written(kept.mapInArrow(run, TREES), "kd-trees")


class Tree:
    def __init__(self, row: dict, size: int):
        view = lambda c, kind: np.frombuffer(row[c], kind)
        self.ids, self.known, self.points = view("ids", np.int64), view("known", bool), view("points", np.int32).reshape(-1, size).astype(np.int64)
        self.first, self.count, self.squares = view("first", np.int64), view("count", np.int64), view("squares", np.int64)
        self.low, self.high = (view(c, np.int32).reshape(-1, size).astype(np.int64) for c in ("low", "high"))
        self.total = view("total", np.int64).reshape(-1, size)

    def filter(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nodes assigned whole, as pairs node, centroid; and the leaves left, as a mask of candidates by node (rows: node, bits)."""
        k = len(centroids)
        level, alive = np.array([0]), np.ones((1, k), bool)
        whole, leaves = [], []
        norms = (centroids * centroids).sum(axis=1)
        while len(level):
            full = self.count[level] > 0
            level, alive = level[full], alive[full]
            low, high = self.low[level], self.high[level]
            # twice the distance's square to the middle, but for what all centroids share
            far = 2 * norms - 2 * (low + high) @ centroids.T
            star = np.where(alive, far, np.iinfo(np.int64).max).argmin(axis=1)
            best = centroids[star]
            lines = centroids[None, :, :] - best[:, None, :]
            corner = np.where(lines > 0, high[:, None, :], low[:, None, :])
            # distance to the corner: from z minus from the best one
            gap = norms[None, :] - norms[star][:, None] - 2 * np.einsum("nkd,nkd->nk", corner, lines)
            alive = alive & (gap <= 0)
            alone = alive.sum(axis=1) == 1
            whole.append(np.stack([level[alone], star[alone]], axis=1))
            level, alive = level[~alone], alive[~alone]
            inner = 2 * level + 2 < len(self.first)
            leaves.append(np.column_stack([level[~inner], alive[~inner]]))
            level, alive = np.concatenate([2 * level[inner] + 1, 2 * level[inner] + 2]), np.concatenate([alive[inner]] * 2)
        return np.concatenate(whole), np.concatenate(leaves)

    def resolved(self, leaves: np.ndarray, centroids: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Each leaf's vectors (from, to), their centroids and squared distances."""
        for row in leaves:
            a, b = self.first[row[0]], self.first[row[0]] + self.count[row[0]]
            some = np.flatnonzero(row[1:])
            d = self.points[a:b, None, :] - centroids[some][None, :, :]
            d = np.einsum("nkd,nkd->nk", d, d)
            near = d.argmin(axis=1)
            yield a, b, some[near], d[np.arange(b - a), near]

    def sums(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By centroid: vectors, their sum, and their distances' sum."""
        k = len(centroids)
        count, total, squares = np.zeros(k, np.int64), np.zeros(centroids.shape, np.int64), np.zeros(k, np.int64)
        whole, leaves = self.filter(centroids)
        np.add.at(count, whole[:, 1], self.count[whole[:, 0]])
        np.add.at(total, whole[:, 1], self.total[whole[:, 0]])
        np.add.at(squares, whole[:, 1], self.squares[whole[:, 0]])
        for a, b, near, _ in self.resolved(leaves, centroids):
            np.add.at(count, near, 1)
            np.add.at(total, near, self.points[a:b])
            np.add.at(squares, near, (self.points[a:b] ** 2).sum(axis=1))
        inertia = squares - 2 * (total * centroids).sum(axis=1) + count * (centroids * centroids).sum(axis=1)
        return count, total, inertia

    def assigned(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The centroid of each vector and its squared distance."""
        cluster, distance = np.empty(len(self.points), np.int32), np.empty(len(self.points), np.int64)
        whole, leaves = self.filter(centroids)
        for node, z in whole.tolist():
            a, b = self.first[node], self.first[node] + self.count[node]
            cluster[a:b] = z
            distance[a:b] = ((self.points[a:b] - centroids[z]) ** 2).sum(axis=1)
        for a, b, near, d in self.resolved(leaves, centroids):
            cluster[a:b], distance[a:b] = near, d
        return cluster, distance


def _sums(found: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Counts, sums and inertia of each centroid over all trees; each task adds up its own first."""
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, inertia = np.zeros(k, np.int64), np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for b in batches:
            for row in b.to_pylist():
                own = Tree(row, size).sums(centroids)
                count, total, inertia = count + own[0], total + own[1], inertia + own[2]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(count), pa.array(inertia), pa.array(list(total))], names=["cluster", "n", "inertia", "total"])

    parts = found.mapInArrow(run, "cluster int, n long, inertia long, total array<long>")
    exact = lambda c: F.sum(c.cast("decimal(38,0)"))
    row = parts.groupBy("cluster").agg(exact(F.col("n")).alias("n"), exact(F.col("inertia")).alias("inertia"), *[exact(F.get("total", F.lit(j))).alias(f"t{j}") for j in range(size)])
    got = sorted(row.collect(), key=lambda r: r["cluster"])  # k rows
    if not got:
        return np.zeros(k, object), np.zeros((k, size), object), [0] * k
    return np.array([int(r["n"]) for r in got], object), np.array([[int(r[f"t{j}"]) for j in range(size)] for r in got], object), [int(r["inertia"]) for r in got]


def starts(found: DataFrame, k: int, size: int, seed: str) -> np.ndarray:
    """The ``k`` vectors of least SHA-256 of ``seed`` and id, in that order; each task keeps ``k`` of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[str, list[int]]] = []
        for b in batches:
            for row in b.to_pylist():
                t = Tree(row, size)
                told = [hashlib.sha256(f"{seed}{i if ok else ''}".encode()).hexdigest() for i, ok in zip(t.ids.tolist(), t.known.tolist())]
                near = np.argsort(np.array(told), kind="stable")
                edge = told[near[min(k, len(near)) - 1]]
                best = sorted([*best, *[(told[j], t.points[j].tolist()) for j in near.tolist() if told[j] <= edge]])[:k]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in best], pa.string()), pa.array([x[1] for x in best], pa.list_(pa.int64()))], names=["told", "point"])

    rows = found.mapInArrow(run, "told string, point array<long>").orderBy("told", "point").limit(k).collect()
    return np.array([r["point"] for r in rows], np.int64).reshape(len(rows), size)


ASSIGNED = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def cluster(vectors: DataFrame, k: int, size: int, rounds: int, seed: str = "", scale: float = 1.0) -> DataFrame:
    """``ASSIGNED``: every kept vector with its centroid after ``rounds`` rounds, its squared distance and their sums."""
    found = trees(vectors, size, scale)
    centroids = starts(found, k, size, seed)
    for _ in range(rounds if len(centroids) else 0):
        n, total, _ = _sums(found, centroids)
        centroids = np.array([[t // c for t in own] if c else old for c, own, old in zip(n.tolist(), total.tolist(), centroids.tolist())], np.int64)
    inertia = _sums(found, centroids)[2] if len(centroids) else []
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    names = [x.split()[0] for x in ASSIGNED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, whole, told = pa.array(inertia, pa.int64()), sum(inertia), pa.array(digests, pa.string())
        for b in batches:
            for row in b.to_pylist():
                t = Tree(row, size)
                near, far = t.assigned(centroids)
                at = pa.array(near)
                yield pa.RecordBatch.from_arrays([pa.array(t.ids, mask=~t.known), at, pa.array(far), of.take(at), pa.array(np.full(len(near), whole, np.int64)), told.take(at)], names=names)

    return found.mapInArrow(run, ASSIGNED)
