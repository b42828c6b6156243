"""Boosting on histograms against a plain booster, and what its parameters do."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import boosting
from touchline.operators.boosting import BINS, MISSING


def plain(model, x, y, w, objective, outputs, rounds, depth, step, penalty, least):
    """Trees of nested dictionaries by recursion over row sets; only bin edges and base are taken from the model."""
    codes = np.column_stack([[MISSING if np.isnan(v) else sum(e < v for e in edges) for v in x[:, j]] for j, edges in enumerate(model.edges)])
    margins = np.tile(np.array(model.base, float), (len(x), 1))
    used = []
    for _ in range(rounds):
        if objective == "softmax":
            p = np.exp(margins) / np.exp(margins).sum(axis=1, keepdims=True)
            g, h = p - np.eye(outputs)[y[:, 0].astype(int)], 2 * p * (1 - p)
        else:
            g, h = np.exp(margins) - y, np.exp(margins + 0.7)
        g, h = g * w[:, None], h * w[:, None]
        for k in range(outputs):

            def grow(rows, left):
                G, H = g[rows, k].sum(), h[rows, k].sum()
                best = (1e-12, None)
                if left:
                    for missing_left in (True, False):
                        for j in range(x.shape[1]):
                            c = codes[rows, j]
                            for cut in range(BINS):
                                to_left = np.where(c == MISSING, missing_left, c <= cut)
                                hl, gl = h[rows[to_left], k].sum(), g[rows[to_left], k].sum()
                                if hl < least or H - hl < least:
                                    continue
                                gain = gl**2 / (hl + penalty) + (G - gl) ** 2 / (H - hl + penalty) - G**2 / (H + penalty)
                                if gain > best[0] + 1e-9:
                                    best = (gain, to_left)
                if best[1] is None:
                    margins[rows, k] += -step * G / (H + penalty)
                    return 1
                return grow(rows[best[1]], left - 1) + grow(rows[~best[1]], left - 1)

            used.append(grow(np.arange(len(x)), depth))
    return margins, used


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(6)
    n = 700
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 6, n).astype(float), rng.normal(size=n)])
    x[rng.random(n) < 0.2, 2] = np.nan
    bent = np.where(np.isnan(x[:, 2]), 0.9, np.abs(x[:, 2])) + 0.7 * (x[:, 0] > 0.3) * (x[:, 1] > 2)
    goals = rng.poisson(np.exp(0.8 * bent - 0.6)[:, None] * [1.0, 0.6])
    target = np.minimum((bent + rng.normal(0, 0.4, n)).astype(int).clip(0), 2)
    return x, target, goals, rng.uniform(0.3, 1.0, n)


@pytest.fixture(scope="module")
def frame(spark, data):
    x, target, goals, w = data
    rows = [(k, *[None if np.isnan(v) else float(v) for v in x[k]], int(target[k]), int(goals[k, 0]), int(goals[k, 1]), float(w[k]), k % 5 == 0) for k in range(len(x))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, target int, home int, away int, w double, stop boolean").repartition(3).persist()


def scored(model, frame):
    return np.array([r["m"] for r in frame.select("id", model(frame).alias("m")).orderBy("id").collect()])


@pytest.mark.parametrize("objective,targets,outputs", [("softmax", ["target"], 3), ("poisson", ["home", "away"], 2)])
def test_against_a_plain_booster(frame, data, objective, targets, outputs, monkeypatch):
    monkeypatch.setattr(boosting, "REFRESH", 2)
    x, target, goals, w = data
    y = target[:, None] if objective == "softmax" else goals
    model = boosting.fit(frame, objective, ["a", "b", "c"], targets, outputs, 3, 2, 0.3, 1.5, 5.0, weight="w")
    want, leaves = plain(model, x, y, w, objective, outputs, 3, 2, 0.3, 1.5, 5.0)
    assert np.allclose(scored(model, frame), want, atol=1e-9)
    assert len(model.trees) == 3 and max(leaves) == 4


def test_rates_beat_a_straight_line(frame, data):
    """On rates that bend, trees lie below the best log-linear fit."""
    x, _, goals, _ = data
    model = boosting.fit(frame, "poisson", ["a", "b", "c"], ["home"], 1, 25, 3, 0.2, 1.0, 5.0)
    deviance = lambda rate: 2 * np.sum(np.where(goals[:, 0] > 0, goals[:, 0] * np.log(np.maximum(goals[:, 0], 1) / rate), 0) - (goals[:, 0] - rate))
    design = np.column_stack([np.ones(len(x)), np.nan_to_num(x), np.isnan(x[:, 2])])
    beta = np.zeros(design.shape[1])
    for _ in range(30):
        rate = np.exp(design @ beta)
        beta += np.linalg.solve(design.T @ (design * rate[:, None]), design.T @ (goals[:, 0] - rate))
    assert deviance(np.exp(scored(model, frame)[:, 0])) < 0.9 * deviance(np.exp(design @ beta))


def test_stopping_penalty_and_shares(frame):
    fit = lambda **more: boosting.fit(frame, "softmax", ["a", "b", "c"], ["target"], 3, **({"rounds": 12, "depth": 3, "step": 0.9, "penalty": 0.1, "least": 1.0} | more))
    stopped = fit(stop="stop", patience=3)
    best = int(np.argmin(stopped.losses))
    assert len(stopped.trees) == best < 12 and len(stopped.losses) <= best + 4
    held = frame.where("stop")
    p = boosting.softmax(scored(stopped, held))
    y = np.array([r["target"] for r in held.orderBy("id").collect()])
    assert -np.log(p[np.arange(len(y)), y]).mean() == pytest.approx(min(stopped.losses))
    one = {"rounds": 1, "step": 0.3}
    assert abs(scored(fit(penalty=50.0, **one), frame) - stopped.base).max() < abs(scored(fit(**one), frame) - stopped.base).max()
    drawn = [fit(columns_share=0.4, rows_share=0.5, seed=4, **one) for _ in range(2)]
    assert drawn[0].trees == drawn[1].trees != fit(**one).trees
    assert fit(rounds=2, least=1e9).trees[0][0]["feature"] == [-1] * 15


def test_odd_frames(spark, frame, tmp_path):
    model = boosting.fit(frame.limit(0), "softmax", ["a"], ["target"], 3, 2, 2, 0.3, 1.0, 1.0)
    assert set(map(tuple, scored(model, frame)[:, :1].round(9).tolist())) <= {(round(model.base[0] + sum(t[0]["value"][0] for t in model.trees), 9),)}
    some = frame.withColumn("target", F.when(F.col("id") < 300, F.col("target"))).withColumn("a", F.when(F.col("id") % 2 == 0, float("nan")).otherwise(F.col("a"))).withColumn("d", F.lit(None).cast("double"))
    model = boosting.fit(some, "softmax", ["a", "d"], ["target"], 3, 1, 2, 0.3, 1.0, 1.0)
    assert np.isfinite(scored(model, some)).all() and model.edges[1] == []
    model.save(str(tmp_path / "trees"))
    assert boosting.Trees.load(str(tmp_path / "trees")) == model
