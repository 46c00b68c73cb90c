"""Per-fold moment matrices: all that linear selectors and models need to know of the rows.

z = [1, features - shift, targets - shift]; M_k = sum of z z' over the rows of fold k. Train moments of a
fold are the sum of all others; test errors follow from M_k. One pass over the rows: each task sends one array for
a fold, with products of features, products of features with targets and squares of targets (a model knows one
target, so products of two targets aren't needed), and a few tasks add the arrays up as they stream by. The shift, a
global mean, is required: without it ill-conditioned spectra lose all digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks that add up the arrays of all others.
ADDERS = 8


@dataclass
class Moments:
    """by_fold: (folds, 1 + p + t, 1 + p + t), 0 for products of two targets; shift: the means taken off features and
    targets."""

    by_fold: np.ndarray
    folds: list[int]
    p: int
    shift: np.ndarray | None = None

    @property
    def total(self) -> np.ndarray:
        return self.by_fold.sum(axis=0)

    def train(self, k: int) -> np.ndarray:
        return self.total - self.by_fold[k]

    def train_folds(self, k: int) -> np.ndarray:
        """The inner folds of a training set: all folds but one."""
        return np.delete(self.by_fold, k, axis=0)

    def for_target(self, t: int) -> Moments:
        keep = np.r_[np.arange(1 + self.p), 1 + self.p + t]
        return Moments(self.by_fold[:, keep][:, :, keep], self.folds, self.p, None if self.shift is None else self.shift[keep[1:] - 1])


def column_means(df: DataFrame, features: str, targets: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Global means: one row a feature, so the result has the table's width, not its length."""
    rows = df.select(F.posexplode(features)).groupBy("pos").agg(F.avg("col").alias("m")).orderBy("pos").collect()
    y = df.agg(*(F.avg(t).alias(t) for t in targets)).first()
    return np.array([r["m"] for r in rows]), np.array([y[t] for t in targets], float)


def usable_rows(df: DataFrame, features: str, targets: list[str], fold: str) -> DataFrame:
    """The rows without a null or non-finite value."""
    usable = df.where(F.col(fold).isNotNull() & F.col(features).isNotNull() & ~F.exists(features, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    for t in targets:
        usable = usable.where(F.col(t).isNotNull() & ~F.isnan(t) & (F.abs(F.col(t)) != float("inf")))
    return usable


#: Columns of a task's arrays: fold, part (which adder) and the sums as bytes.
SUMS = "fold long, part long, sums binary"


def packed(sums: dict[int, np.ndarray], part: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([part] * len(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["fold", "part", "sums"])


def task_sums(parts: Iterator[tuple[pa.Array, np.ndarray, np.ndarray]], shift: np.ndarray, p: int) -> Iterator[pa.RecordBatch]:
    """The arrays of a task, one for a fold, from (features, targets as columns of a matrix, folds) of its rows."""
    sums, upper = {}, np.triu_indices(1 + p)
    for features, targets, of in parts:
        if not len(of):
            continue
        x, y = np.asarray(features.flatten(), float).reshape(len(of), -1) - shift[:p], targets - shift[p:]
        z = np.concatenate((np.ones((len(x), 1)), x), axis=1)
        for k in np.unique(of):
            a, b = z[of == k], y[of == k]
            sums[int(k)] = sums.get(int(k), 0) + np.concatenate(((a.T @ a)[upper], (a.T @ b).ravel(), (b * b).sum(axis=0)))
    if sums:
        yield packed(sums, TaskContext.get().partitionId() % ADDERS)


def fold_moments(df: DataFrame, features: str, targets: list[str], fold: str) -> Moments:
    """Moments of an array<double> column and target columns by an integer fold column; rows with a null or
    non-finite value don't count."""
    usable = usable_rows(df, features, targets, fold)
    mean_x, mean_y = column_means(usable, features, targets)
    shift, p = np.concatenate((mean_x, mean_y)), len(mean_x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = lambda b: np.stack([np.asarray(b.column(1 + i), float) for i in range(len(targets))], axis=1)
        return task_sums(((b.column(0), columns(b), np.asarray(b.column(1 + len(targets)))) for b in batches), shift, p)

    return added_up(usable.select(features, *targets, F.col(fold).cast("long")).mapInArrow(run, SUMS), shift, p)


def added_up(each: DataFrame, shift: np.ndarray, p: int) -> Moments:
    """Moments from the arrays of all tasks."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column("fold").to_pylist(), batch.column("sums"), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(v.as_py())
        if sums:
            yield packed(sums, 0)

    rows = each.repartition(ADDERS, "part").sortWithinPartitions("fold", "part", "sums").mapInArrow(added, SUMS).collect()  # folds x ADDERS arrays
    upper, width = np.triu_indices(1 + p), 1 + len(shift)
    folds, (n, m) = sorted({r["fold"] for r in rows}), (len(upper[0]), (1 + p) * (len(shift) - p))
    out = np.zeros((len(folds), width, width))
    for i, k in enumerate(folds):
        total = sum(np.frombuffer(v) for v in sorted(bytes(r["sums"]) for r in rows if r["fold"] == k))
        out[i][upper] = total[:n]
        out[i][: 1 + p, 1 + p :] = total[n : n + m].reshape(1 + p, -1)
        out[i] = np.triu(out[i]) + np.triu(out[i], 1).T
        out[i][np.arange(1 + p, width), np.arange(1 + p, width)] = total[n + m :]
    return Moments(out, folds, p, shift)


def centred(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray, float, float]:
    """(Sxx, Sxy, Syy, mean of x, mean of y, n) of a moment matrix with one target."""
    n, p = m[0, 0], len(m) - 2
    mean = m[0, 1:] / n
    s = m[1:, 1:] - n * np.outer(mean, mean)
    return s[:p, :p], s[:p, p], s[p, p], mean[:p], mean[p], n


def test_errors(m: np.ndarray, intercept: float, coef: np.ndarray) -> tuple[float, float, float]:
    """(squared error, total squares, n) on the rows of m of the prediction intercept + coef . x, all shifted."""
    v = np.concatenate(([-intercept], -coef, [1.0]))
    return float(v @ m @ v), float(m[-1, -1] - m[0, -1] ** 2 / m[0, 0]), float(m[0, 0])


def r2(sse: float, sst: float) -> float:
    """1 - sse / sst; without spread 1 for no error, else 0."""
    return float(1 - sse / sst) if sst > 1e-12 else float(sse <= 1e-12)
