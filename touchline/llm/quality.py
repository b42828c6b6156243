"""Quality classifier: regularised quadratic discriminant over document statistics.

``statistics`` gives every text a vector of transformed statistics (lengths,
shares of character classes, repetition of words, word runs and lines). ``fit``
sums the moments of all labelled training rows of each class, shrinks the class
covariances towards the pooled diagonal and keeps their Cholesky factors.
A score is the Mahalanobis log-density difference of the classes plus the log
prior, put through a logistic curve whose slope and offset are fitted on a
histogram of all training differences.

Labels, language, source and id never enter a score. Results by case: null and
empty texts have the statistics of an empty text and are scored; rows without a
label or with a null one do not train; with no row of one of the classes every
score is the share of class 1 (one half without any label); repeated rows count
as often as they stand there; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from touchline.llm._arrow import written
from touchline.llm._words import byte_class, text_slices, window_hashes, words

FEATURES = (
    "log_words", "distinct", "distinct_pairs", "distinct_triples", "top_word", "doubled", "word_length", "length_spread",
    "upper", "digit", "point", "sign", "foreign", "line_length", "distinct_lines", "capital_words", "sign_words", "short_words",
)
#: Share of the pooled diagonal in a class covariance.
SHRINKAGE = 0.1
#: Bins of the histogram of log-density differences, and its range.
BINS, SPAN = 400, 40.0

_UPPER = byte_class((0x41, 0x5A))
_LETTER = byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_DIGIT = byte_class((0x30, 0x39))
_POINT = byte_class((0x2C, 0x2C), (0x2E, 0x2E), (0x3B, 0x3B), (0x27, 0x27))
_SIGN = byte_class((0x21, 0x26), (0x28, 0x2B), (0x2F, 0x2F), (0x3A, 0x3A), (0x3C, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
_FOREIGN = byte_class((0x80, 0xFF))
_LINE = ~byte_class((0x0A, 0x0A))


def _sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (total[ends] - total[starts]).astype(float)


def _distinct(hashes: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row how many different hashes, and how often the commonest occurs."""
    if not len(hashes):
        return np.zeros(rows), np.zeros(rows)
    by = np.lexsort((hashes, row))
    h, r = hashes[by], row[by]
    new = np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])]
    at = np.flatnonzero(new)
    count = np.diff(np.r_[at, len(h)])
    most = np.zeros(rows)
    np.maximum.at(most, r[at], count)
    return np.bincount(r[at], minlength=rows).astype(float), most


def _share(part: np.ndarray, whole: np.ndarray, prior: float = 0.0) -> np.ndarray:
    return (part + prior) / (whole + 2 * prior + (whole + prior == 0))


def _logit(p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log odds of a share out of n, kept finite by half an observation on each side."""
    p = (p * n + 0.5) / (n + 1.0)
    return np.log(p / (1.0 - p))


def statistics_of(piece) -> np.ndarray:
    """One row of transformed statistics for each text of a slice."""
    rows = piece.rows
    w = words(piece)
    n = w.counts().astype(float)
    row = w.row_of()
    starts, ends = piece.offsets[:-1], piece.offsets[1:]
    chars = (ends - starts).astype(float)
    data = piece.data
    at = lambda flags: _sums(flags, starts, ends)
    length = (w.ends - w.starts).astype(float)
    mean_length = np.bincount(row, length, rows) / np.maximum(n, 1)
    spread = np.sqrt(np.maximum(np.bincount(row, length**2, rows) / np.maximum(n, 1) - mean_length**2, 0))
    kinds, most = _distinct(w.hashes, row, rows)
    runs = []
    for size in (2, 3):
        h, first = window_hashes(w, size)
        r = row[first] if len(first) else np.zeros(0, np.int64)
        runs.append((_distinct(h, r, rows)[0], np.bincount(r, minlength=rows).astype(float)))
    same = np.zeros(len(w.hashes), bool)
    same[1:] = (w.hashes[1:] == w.hashes[:-1]) & (row[1:] == row[:-1])
    lines = words(piece, _LINE)
    n_lines = lines.counts().astype(float)
    line_kinds, _ = _distinct(lines.hashes, lines.row_of(), rows)
    letters = at(_LETTER[data])
    first_upper = _UPPER[data[w.starts]] if len(data) else np.zeros(0, bool)
    signs = _sums(_SIGN[data], w.starts, w.ends) if len(data) else np.zeros(0)
    out = np.column_stack([
        np.log1p(n),
        np.log1p(kinds) - np.log1p(n),
        _logit(_share(runs[0][0], runs[0][1]), runs[0][1]),
        _logit(_share(runs[1][0], runs[1][1]), runs[1][1]),
        _logit(_share(most, n), n),
        _logit(np.bincount(row[same], minlength=rows) / np.maximum(n, 1), n),
        np.log1p(mean_length),
        np.log1p(spread),
        _logit(_share(at(_UPPER[data]), letters), letters),
        _logit(_share(at(_DIGIT[data]), chars), chars),
        _logit(_share(at(_POINT[data]), chars), chars),
        _logit(_share(at(_SIGN[data]), chars), chars),
        _share(at(_FOREIGN[data]), chars),
        np.log1p(_share(chars, n_lines)),
        _logit(_share(line_kinds, n_lines), n_lines),
        _logit(_share(np.bincount(row, first_upper, rows), n), n),
        _logit(_share(np.bincount(row, signs > 0, rows), n), n),
        _logit(_share(np.bincount(row, length <= 3, rows), n), n),
    ])
    return out


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``stats``, an array of doubles in the order of FEATURES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_slices(batch.column(1)):
                flat = statistics_of(piece)
                arrays = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32)), pa.array(flat.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.first, piece.rows), arrays], names=["doc_id", "stats"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, stats array<double>")


@dataclass
class Model:
    means: list[np.ndarray]
    inverses: list[np.ndarray]
    log_dets: list[float]
    log_prior: float
    slope: float = 1.0
    offset: float = 0.0
    constant: float | None = None

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, with the prior."""
        densities = []
        for mean, inverse, log_det in zip(self.means, self.inverses, self.log_dets):
            z = (x - mean) @ inverse.T
            densities.append(-0.5 * ((z * z).sum(1) + log_det))
        return densities[1] - densities[0] + self.log_prior

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        d = np.clip(self.difference(x), -SPAN, SPAN)
        return 1.0 / (1.0 + np.exp(-(self.slope * d + self.offset)))


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(FEATURES))


def _summed(rows: DataFrame, of, width: int) -> dict[int, np.ndarray]:
    """Adds up one vector of ``width`` numbers for each class over all rows (of: arrays to vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, width))
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            x = _vectors(batch.column(0))
            for k in (0, 1):
                total[k] += of(x[label == k])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["label", "sums"])

    parts = rows.select("stats", "label").mapInArrow(run, "label int, sums array<double>")
    total = parts.select("label", F.posexplode("sums").alias("at", "x")).groupBy("label", "at").agg(F.sum("x").alias("x"))
    out = {0: np.zeros(width), 1: np.zeros(width)}
    for r in total.collect():  # 2 x width numbers, whatever the input
        out[r["label"]][r["at"]] = r["x"]
    return out


def fit(training: DataFrame, shrinkage: float = SHRINKAGE) -> Model:
    """Fits the classes on all rows ``stats, label`` (0 or 1)."""
    d = len(FEATURES)
    upper = np.triu_indices(d)

    def moments(x: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(x)], x.sum(0), (x.T @ x)[upper]])

    sums = _summed(training, moments, 1 + d + len(upper[0]))
    n = [sums[k][0] for k in (0, 1)]
    if not all(n):
        return Model([], [], [], 0.0, constant=float(n[1] / sum(n)) if sum(n) else 0.5)
    means, scatters = [], []
    for k in (0, 1):
        mean = sums[k][1 : 1 + d] / n[k]
        square = np.zeros((d, d))
        square[upper] = sums[k][1 + d :]
        square = square + np.triu(square, 1).T
        means.append(mean)
        scatters.append(square / n[k] - np.outer(mean, mean))
    pooled = np.diag(np.maximum((n[0] * np.diag(scatters[0]) + n[1] * np.diag(scatters[1])) / sum(n), 1e-4))
    inverses, log_dets = [], []
    for k in (0, 1):
        weight = min(1.0, shrinkage + d / (n[k] + d))  # few rows lean more on the pooled diagonal
        factor = np.linalg.cholesky((1 - weight) * scatters[k] + weight * pooled)
        inverses.append(np.linalg.inv(factor))
        log_dets.append(2 * float(np.log(np.diag(factor)).sum()))
    model = Model(means, inverses, log_dets, float(np.log(n[1] / n[0])))

    edges = np.linspace(-SPAN, SPAN, BINS + 1)
    bins = _summed(training, lambda x: np.histogram(np.clip(model.difference(x), -SPAN, SPAN), edges)[0].astype(float) if len(x) else np.zeros(BINS), BINS)
    model.slope, model.offset = _logistic((edges[1:] + edges[:-1]) / 2, bins[1], bins[0])
    return model


def _logistic(x: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through counts by x, with a weak pull to slope 1."""
    a, b = 1.0, 0.0
    n = ones + zeros
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -50, 50)))
        r, v = ones - n * p, n * p * (1 - p) + 1e-9
        gradient = np.array([(r * x).sum() - (a - 1.0), r.sum() - 0.01 * b])
        hessian = np.array([[(v * x * x).sum() + 1.0, (v * x).sum()], [(v * x).sum(), v.sum() + 0.01]])
        step = np.linalg.solve(hessian, gradient)
        size = np.abs(step).max()
        a, b = a + step[0] * min(1, 1 / size if size else 1), b + step[1] * min(1, 1 / size if size else 1)
        if size < 1e-9:
            break
    return float(max(a, 1e-3)), float(b)


def score(stats: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score``: the probability of class 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_vectors(batch.column(1))))], names=["doc_id", "score"])

    return stats.select("doc_id", "stats").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, held_out, threshold: float) -> DataFrame:
    """Statistics of all documents, a fit on the labelled ones that are not held out, and every score.

    ``labels``: ``doc_id, label``. ``held_out``: a Column over ``doc_id``.
    """
    stats = written(statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))), "quality-statistics")
    known = labels.where(F.col("label").isin(0, 1) & ~F.coalesce(held_out, F.lit(True))).select("doc_id", F.col("label").cast("int").alias("label"))
    model = fit(stats.join(known, "doc_id"))
    return score(stats, model).select(
        "doc_id", F.coalesce(held_out, F.lit(True)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
