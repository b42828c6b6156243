"""Forecast metrics as aggregates: accuracy, log loss, Brier, calibration, subsets, profiles, searches."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from touchline.functions.scalar import argmax, col
from touchline.params import DEFAULT

EPSILON = 1e-15


def _of_class(y, probabilities: list) -> Column:
    return reduce(lambda c, k: c.when(col(y) == k, col(probabilities[k])), range(1, len(probabilities)), F.when(col(y) == 0, col(probabilities[0])))


def log_loss(y, probabilities: list) -> Column:
    p = _of_class(y, probabilities)
    return -F.log(F.least(F.lit(1 - EPSILON), F.greatest(F.lit(EPSILON), p)))


def brier(y, probabilities: list) -> Column:
    return reduce(lambda a, b: a + b, [F.pow(col(p) - F.when(col(y) == k, 1.0).otherwise(0.0), 2) for k, p in enumerate(probabilities)])


def evaluation(y, probabilities: list) -> list[Column]:
    """Aggregates n, accuracy, log_loss and brier; the first greatest probability is the forecast."""
    hit = F.when(argmax(probabilities) == col(y), 1.0).otherwise(0.0)
    return [F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"), F.avg(log_loss(y, probabilities)).alias("log_loss"), F.avg(brier(y, probabilities)).alias("brier")]


def objective(y, probabilities: list, uefa: Column) -> list[Column]:
    """Half the log loss of all rows and half that of the international ones, with both."""
    loss = log_loss(y, probabilities)
    every, some = F.avg(loss), F.avg(F.when(uefa, loss))
    return [(0.5 * (every + some)).alias("objective"), every.alias("log_loss_all"), some.alias("log_loss_uefa")]


def subsets(df: DataFrame, masks: dict[str, Column]) -> DataFrame:
    """One row for each subset a row is in, so that every subset is measured in one pass."""
    return df.withColumn("subset", F.explode(F.array_compact(F.array(*[F.when(m, F.lit(n)) for n, m in masks.items()]))))


def calibration(df: DataFrame, y, probabilities: list, bins: int = 10, labels=DEFAULT.class_labels) -> DataFrame:
    """``target, bin, count, mean_predicted, observed_rate, gap`` for each class and for the top forecast.

    Bins are closed on the left; 1.0 falls into the last one.
    """
    one = lambda name, p, hit: F.struct(F.lit(name).alias("target"), p.alias("p"), hit.cast("double").alias("hit"))
    targets = [one(n, col(p), col(y) == k) for k, (n, p) in enumerate(zip(labels, probabilities))]
    top = F.greatest(*[col(p) for p in probabilities])
    long = df.select(F.inline(F.array(*targets, one("top_label", top, argmax(probabilities) == col(y)))))
    edges = [k / bins for k in range(1, bins)]
    place = reduce(lambda a, b: a + b, [F.when(F.col("p") >= e, 1).otherwise(0) for e in edges])
    table = long.withColumn("bin", place).groupBy("target", "bin").agg(F.count(F.lit(1)).alias("count"), F.avg("p").alias("mean_predicted"), F.avg("hit").alias("observed_rate"))
    return table.withColumn("gap", F.col("observed_rate") - F.col("mean_predicted"))


def calibration_error(table: DataFrame) -> DataFrame:
    """``target, ece``: the mean absolute gap by the bins' counts."""
    return table.groupBy("target").agg((F.sum(F.col("count") * F.abs("gap")) / F.sum("count")).alias("ece"))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, null_rate, n_distinct, usable``: all columns in one aggregate. Unusable: all NULL, or constant."""
    aggs = [F.struct(F.lit(c).alias("column"), F.avg(F.col(c).isNull().cast("int")).alias("null_rate"), F.count_distinct(F.col(c)).alias("n_distinct")) for c in columns]
    rows = df.agg(*[a["null_rate"].alias(f"r{k}") for k, a in enumerate(aggs)], *[a["n_distinct"].alias(f"d{k}") for k, a in enumerate(aggs)])
    long = rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"r{k}").alias("null_rate"), F.col(f"d{k}").alias("n_distinct")) for k, c in enumerate(columns)])))
    return long.withColumn("usable", (F.col("null_rate") < 1) & (F.col("n_distinct") > 1))


def simplex(steps: int = 20) -> list[tuple[int, float, float, float]]:
    """All triples of weights in steps, that sum to 1."""
    triples = [(a, b, steps - a - b) for a in range(steps + 1) for b in range(steps + 1 - a)]
    return [(k, a / steps, b / steps, c / steps) for k, (a, b, c) in enumerate(triples)]


def weight_grid(df: DataFrame, y: str, components: list[list[str]], uefa: Column, steps: int = 20) -> DataFrame:
    """``w1, w2, w3, objective, log_loss_all, log_loss_uefa`` of every triple: a matrix product for each batch of rows, then sums by triple."""
    points = simplex(steps)
    weights = np.array([p[1:] for p in points]).T
    # the probability that each component gives to what happened
    hit = [F.coalesce(*[F.when(F.col(y) == k, F.col(c)) for k, c in enumerate(comp)]).cast("double") for comp in components]

    def run(batches):
        for batch in batches:
            p = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(components))], 1)
            flag = batch.column(len(components)).to_numpy(zero_copy_only=False).astype(bool)
            loss = -np.log(np.clip(p @ weights, EPSILON, 1 - EPSILON))
            n, m = np.full(len(points), len(p)), np.full(len(points), int(flag.sum()))
            yield pa.RecordBatch.from_arrays([pa.array([q[0] for q in points], pa.int32()), pa.array(loss.sum(0)), pa.array(n), pa.array(loss[flag].sum(0)), pa.array(m)], names=["g", "s", "n", "su", "nu"])

    sums = df.select(*[h.alias(f"p{k}") for k, h in enumerate(hit)], F.coalesce(uefa.cast("boolean"), F.lit(False)).alias("u")).mapInArrow(run, "g int, s double, n long, su double, nu long")
    total = sums.groupBy("g").agg(*[F.sum(c).alias(c) for c in ("s", "n", "su", "nu")])
    grid = df.sparkSession.createDataFrame(points, "g int, w1 double, w2 double, w3 double")
    every, some = F.col("s") / F.col("n"), F.when(F.col("nu") > 0, F.col("su") / F.col("nu"))
    return total.join(grid, "g").select("g", "w1", "w2", "w3", (0.5 * (every + some)).alias("objective"), every.alias("log_loss_all"), some.alias("log_loss_uefa"))


def first_least(df: DataFrame, by: str, *ties: str) -> DataFrame:
    return df.orderBy(by, *ties).limit(1)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = DEFAULT.seed) -> DataFrame:
    """n rows by the least hash of key and seed: the same rows for any partitioning."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def range_summary(df: DataFrame, day: str, flag: Column) -> DataFrame:
    return df.agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("n_flagged"))
