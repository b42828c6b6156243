"""Gradient-boosted trees on histograms: softmax over classes and Poisson rates, as one ensemble each.

Columns become bin codes, by quantile sketches of all columns in one job; NULL and
NaN have a code of their own. Codes are packed in blocks of rows and written once.
A round grows one tree for each output (class or rate) from the gradients and
hessians of the same margins, level by level: every task adds up the histograms of
its blocks, one row for each task, which are summed in a tree of partial sums; the
driver sees one histogram, of a size that depends on bins, columns and nodes alone, and
picks each node's split. Rows without a value go where the gain is larger. A leaf is
``-step * G / (H + penalty)``. Margins are written with the blocks every ``REFRESH``
rounds, so a task replays few trees and a lost executor costs one job.

With rows held back, their loss is measured in each round, and the fit stops when it has
not improved for ``patience`` rounds; the trees up to its best round are kept.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from touchline.session import checkpointed

#: Bins of a column; the last code stands for a missing value.
BINS, MISSING = 64, 255
#: Rows of a block, rounds between two writings of the margins, partial sums that one task adds up.
BLOCK, REFRESH, FAN_IN = 1 << 16, 20, 32
#: What Poisson hessians are scaled by, so that a step stays small where a rate is near 0.
MOST_STEP = 0.7


@dataclass
class Trees:
    """A fitted ensemble. ``trees[round][output]``: feature (-1: a leaf), bin, missing_left and value, by place in the heap."""

    objective: str
    columns: list[str]
    edges: list[list[float]]
    base: list[float]
    depth: int
    trees: list[list[dict]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        spark.createDataFrame([(json.dumps(self.__dict__),)], "trees string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, path: str) -> "Trees":
        return cls(**json.loads(SparkSession.active().read.text(path).first()[0]))

    def codes(self, values: np.ndarray) -> np.ndarray:
        """Bin codes of rows of raw values: how many edges lie below each."""
        out = np.empty(values.shape, np.uint8)
        for j, edges in enumerate(self.edges):
            out[:, j] = np.searchsorted(edges, values[:, j], "left")
            out[np.isnan(values[:, j]), j] = MISSING
        return out

    def margins(self, codes: np.ndarray, trees: list[list[dict]] | None = None) -> np.ndarray:
        """Sums of leaf values, without the base where ``trees`` are given."""
        out = np.tile(self.base if trees is None else [0.0] * len(self.base), (len(codes), 1))
        for one_round in self.trees if trees is None else trees:
            for k, t in enumerate(one_round):
                out[:, k] += np.array(t["value"])[leaf_of(codes, t, self.depth)]
        return out

    def __call__(self, df: DataFrame) -> Column:
        """An array of margins for each row of ``df``."""
        model = self

        @F.pandas_udf("array<double>")
        def score(*columns):
            import pandas as pd

            values = np.column_stack([c.to_numpy(dtype=float, na_value=np.nan) for c in columns])
            return pd.Series(list(model.margins(model.codes(values))))

        return score(*[F.col(c).cast("double") for c in self.columns])


def leaf_of(codes: np.ndarray, tree: dict, depth: int) -> np.ndarray:
    """The node at which each row ends, in a tree whose nodes are still growing or not."""
    feature, cut, left = (np.array(tree[k]) for k in ("feature", "bin", "missing_left"))
    at, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
    for _ in range(depth):
        f = feature[at]
        code = codes[rows, np.maximum(f, 0)]
        right = np.where(code == MISSING, ~left[at].astype(bool), code > cut[at])
        at = np.where(f < 0, at, 2 * at + 1 + right)
    return at


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(objective: str, margins: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if objective == "softmax":
        p = softmax(margins)
        return p - (y == np.arange(margins.shape[1])), np.maximum(2.0 * p * (1.0 - p), 1e-16)
    rate = np.exp(margins)
    return rate - y, rate * np.exp(MOST_STEP)


def losses(objective: str, margins: np.ndarray, y: np.ndarray) -> np.ndarray:
    if objective == "softmax":
        return -np.log(np.maximum(softmax(margins)[np.arange(len(y)), y[:, 0].astype(int)], 1e-15))
    return (np.exp(margins) - y * margins).sum(axis=1)


BLOCKS = "block long, n int, codes binary, y binary, w binary, stop binary, margins binary"


def _blocks(rows: DataFrame, model: Trees, targets: int) -> DataFrame:
    """Packed rows of ``_x`` (array), ``_y`` (array), ``_w``, ``_stop``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        for number, b in enumerate(batches):
            if not b.num_rows:
                continue
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
            y = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, targets)
            cells = [model.codes(x), y, b.column(2).to_numpy().astype(float), b.column(3).to_numpy(zero_copy_only=False), np.tile(model.base, (b.num_rows, 1)).astype(float)]
            yield pa.RecordBatch.from_arrays([pa.array([first + number]), pa.array([b.num_rows], pa.int32()), *[pa.array([c.tobytes()], pa.binary()) for c in cells]], names=[c.split()[0] for c in BLOCKS.split(", ")])

    return rows.select("_x", "_y", "_w", "_stop").mapInArrow(run, BLOCKS)


def _unpacked(row: dict, columns: int, outputs: int) -> tuple[np.ndarray, ...]:
    n = row["n"]
    view = lambda c, kind: np.frombuffer(row[c], kind)
    return view("codes", np.uint8).reshape(n, columns), view("y", float).reshape(n, -1), view("w", float), view("stop", bool), view("margins", float).reshape(n, outputs)


def _summed(parts: DataFrame, tasks: int) -> np.ndarray:
    """The sum of one array for each task, added up in a tree of at most ``FAN_IN`` at a time."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for x in b.column(0):
                own = np.frombuffer(x.as_buffer(), float)
                total = own.copy() if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        parts = parts.repartition(tasks).mapInArrow(add, "sums binary")
    return sum(np.frombuffer(r["sums"], float) for r in parts.collect())


def _histograms(blocks: DataFrame, tasks: int, model: Trees, since: list, growing: list[dict], level: int, sample: tuple[int, int, float]) -> tuple[np.ndarray, float, float]:
    """Gradient and hessian sums by output, node of the level, column and code; and loss and number of rows held back."""
    objective, columns, outputs, depth = model.objective, len(model.columns), len(model.base), model.depth
    nodes, first, codes_of = 1 << level, (1 << level) - 1, MISSING + 1
    seed, number, share = sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = np.zeros((2, outputs, nodes, columns, codes_of)), np.zeros(2)
        for b in batches:
            for row in b.to_pylist():
                codes, y, w, stop, margins = _unpacked(row, columns, outputs)
                margins = margins + model.margins(codes, since)
                if level == 0 and stop.any():
                    held += (losses(objective, margins[stop], y[stop]).sum(), stop.sum())
                used = ~stop
                if share < 1.0:
                    used &= np.random.default_rng([seed, number, row["block"] >> 32, row["block"] & 0xFFFFFFFF]).random(len(w)) < share
                codes, w = codes[used], w[used]
                g, h = gradients(objective, margins[used], y[used])
                for k in range(outputs):
                    at = leaf_of(codes, growing[k], level) - first
                    live = at >= 0
                    cells = at[live] * codes_of
                    for j in range(columns):
                        place = cells + codes[live, j]
                        for z, x in enumerate((g, h)):
                            out[z, k, :, j] += np.bincount(place, x[live, k] * w[live], nodes * codes_of).reshape(nodes, codes_of)
        yield pa.RecordBatch.from_arrays([pa.array([np.append(out.ravel(), held).tobytes()], pa.binary())], names=["sums"])

    total = _summed(blocks.mapInArrow(run, "sums binary"), tasks)
    return total[:-2].reshape(2, outputs, nodes, columns, codes_of), float(total[-2]), float(total[-1])


def best_splits(g: np.ndarray, h: np.ndarray, penalty: float, least: float, allowed: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each node of (nodes, columns, codes): gain, column, bin, whether missing values go left, and the left side's G and H."""
    total_g, total_h = g[:, :1].sum(axis=2, keepdims=True), h[:, :1].sum(axis=2, keepdims=True)
    weight = lambda a, b: a * a / (b + penalty)
    gains, sides = [], []
    for missing in (True, False):
        left_g, left_h = np.cumsum(g[..., :BINS], axis=2), np.cumsum(h[..., :BINS], axis=2)
        if missing:
            left_g, left_h = left_g + g[..., MISSING:], left_h + h[..., MISSING:]
        right_g, right_h = total_g - left_g, total_h - left_h
        gain = weight(left_g, left_h) + weight(right_g, right_h) - weight(total_g, total_h)
        gain[(left_h < least) | (right_h < least)] = -np.inf
        gain[:, ~allowed] = -np.inf
        gains.append(gain)
        sides.append((left_g, left_h))
    every = np.stack(gains, axis=1).reshape(len(g), -1)
    at = every.argmax(axis=1)
    side, column, cut = np.unravel_index(at, (2, g.shape[1], BINS))
    rows = np.arange(len(g))
    pick = lambda z: np.where(side == 0, sides[0][z][rows, column, cut], sides[1][z][rows, column, cut])
    return every[rows, at], column, cut, side == 0, pick(0), pick(1)


def fit(
    rows: DataFrame, objective: str, columns: list[str], targets: list[str], outputs: int, rounds: int, depth: int, step: float, penalty: float, least: float,
    columns_share: float = 1.0, rows_share: float = 1.0, patience: int = 100, seed: int = 0, weight: str | None = None, stop: str | None = None,
) -> Trees:
    """Fits an ensemble. ``weight``: a column of row weights; ``stop``: a boolean column of rows held back. Rows without a target are left out.

    An empty frame gives an ensemble without trees. ``least``: the least sum of hessians of a leaf.
    """
    for t in targets:
        rows = rows.where(F.col(t).isNotNull())
    w, held = F.col(weight).cast("double") if weight else F.lit(1.0), F.col(stop).cast("boolean") if stop else F.lit(False)
    narrow = rows.select(
        F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in columns]).alias("_x"),
        F.array(*[F.col(t).cast("double") for t in targets]).alias("_y"), w.alias("_w"), held.alias("_stop"),
        *[F.nullif(F.col(c).cast("double"), F.lit(float("nan"))).alias(f"_q{j}") for j, c in enumerate(columns)],
    )
    own = narrow.where(~F.col("_stop"))
    quantiles = own.approxQuantile([f"_q{j}" for j in range(len(columns))], [k / BINS for k in range(1, BINS)], 1.0 / (8 * BINS))
    model = Trees(objective, list(columns), [sorted(set(q)) for q in quantiles], [0.0] * outputs, depth)
    if objective == "softmax":
        shares = own.agg(*[F.sum(F.when(F.col("_y")[0] == k, F.col("_w")).otherwise(0.0)).alias(f"s{k}") for k in range(outputs)]).first()
        mass = sum(s or 0.0 for s in shares) or 1.0
        model.base = [float(np.log(max((s or 0.0) / mass, 1e-9))) for s in shares]
    else:
        means = own.agg(*[(F.sum(F.col("_y")[k] * F.col("_w")) / F.sum("_w")).alias(f"m{k}") for k in range(outputs)]).first()
        model.base = [float(np.log(max(m or 0.0, 1e-9))) for m in means]
    spark = rows.sparkSession
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BLOCK))
    try:
        blocks = checkpointed(_blocks(narrow, model, len(targets)))
    finally:
        spark.conf.set(key, before)
    tasks = blocks.rdd.getNumPartitions()
    if not blocks.limit(1).count():
        return model
    draw = np.random.default_rng(seed)
    since: list[list[dict]] = []
    size = (1 << (depth + 1)) - 1
    for number in range(rounds + 1):
        growing = [{"feature": [-1] * size, "bin": [0] * size, "missing_left": [False] * size, "value": [0.0] * size} for _ in range(outputs)]
        allowed = np.zeros((outputs, len(columns)), bool)
        for k in range(outputs):
            allowed[k, draw.choice(len(columns), max(1, round(columns_share * len(columns))), replace=False)] = True
        for level in range(depth):
            total, loss, n = _histograms(blocks, tasks, model, since, growing, level, (seed, number, rows_share))
            if level == 0 and n:
                model.losses.append(loss / n)
            if number == rounds or (n and number - int(np.argmin(model.losses)) >= patience):
                growing = None
                break
            first, any_split = (1 << level) - 1, False
            for k in range(outputs):
                g, h = total[0, k], total[1, k]
                if level == 0:
                    growing[k]["value"][0] = float(-step * g[0, 0].sum() / (h[0, 0].sum() + penalty))
                gain, column, cut, missing_left, left_g, left_h = best_splits(g, h, penalty, least, allowed[k])
                for j in np.flatnonzero(gain > 1e-12).tolist():
                    at, t = first + j, growing[k]
                    all_g, all_h = g[j, 0].sum(), h[j, 0].sum()
                    t["feature"][at], t["bin"][at], t["missing_left"][at] = int(column[j]), int(cut[j]), bool(missing_left[j])
                    t["value"][2 * at + 1] = float(-step * left_g[j] / (left_h[j] + penalty))
                    t["value"][2 * at + 2] = float(-step * (all_g - left_g[j]) / (all_h - left_h[j] + penalty))
                    any_split = True
            if not any_split:
                break
        if growing is None:
            break
        model.trees.append(growing)
        since.append(growing)
        if len(since) == REFRESH:
            blocks, since = checkpointed(_moved(blocks, model, since)), []
    if model.losses:
        model.trees = model.trees[: int(np.argmin(model.losses))]
    return model


def _moved(blocks: DataFrame, model: Trees, since: list) -> DataFrame:
    """The blocks with the trees of some rounds added to their margins."""
    columns, outputs = len(model.columns), len(model.base)
    names = [c.split()[0] for c in BLOCKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = []
            for row in b.to_pylist():
                codes, _, _, _, margins = _unpacked(row, columns, outputs)
                new.append((margins + model.margins(codes, since)).tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(new, pa.binary())], names=names)

    return blocks.mapInArrow(run, BLOCKS)
