"""Linear scoring and fitting of embedding tables, and the checks run on their output."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regulus.session import keyed_join


def dot(x: Column, weights: Sequence[float]) -> Column:
    w = F.array(*[F.lit(float(v)) for v in weights])
    return F.aggregate(F.zip_with(x, w, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)


def linear_score(fwd: Column, rc: Column, weights: Sequence[float], bias: float) -> Column:
    """Average of the scores of the forward and reverse features."""
    return (dot(fwd, weights) + dot(rc, weights)) / 2 + bias


@dataclass(frozen=True)
class Sums:
    """Sufficient sums of a least-squares problem with an intercept (last) and one column of ``rhs`` per target."""

    n: float
    gram: np.ndarray
    rhs: np.ndarray
    square: np.ndarray

    def loss(self, w: np.ndarray) -> np.ndarray:
        """Mean squared error of weights (one column per target)."""
        return ((w * (self.gram @ w)).sum(0) - 2 * (w * self.rhs).sum(0) + self.square) / self.n


@dataclass(frozen=True)
class Head:
    """Weights (intercept last, one column per target), their loss on the stop fold, and the epochs that were run."""

    weights: np.ndarray
    loss: np.ndarray
    epochs: np.ndarray
    best_epoch: np.ndarray
    penalty: float


def head_sums(df: DataFrame, fwd: str, rc: str, targets: str, fold: str) -> dict[str, Sums]:
    """Sums of the folds ``train`` (forward and reverse features are two rows) and ``stop`` (their average is one), in one pass.

    ``targets`` is an array column; all targets share the Gram matrices. Rows of other folds are not read, nor
    rows without a fold, features or targets. What reaches the driver is the sums: (d + 1) (d + 1 + targets) numbers a fold.
    """
    rows = df.where(F.col(fold).isin("train", "stop") & F.col(fwd).isNotNull() & F.col(rc).isNotNull() & F.col(targets).isNotNull())
    rows = rows.select(F.col(fwd).cast("array<double>").alias("f"), F.col(rc).cast("array<double>").alias("r"),
                       F.col(targets).cast("array<double>").alias("y"), F.col(fold).alias("fold"))
    shape = rows.select(F.size("f").alias("d"), F.size("y").alias("k")).first()
    if shape is None:
        raise ValueError("no row to train on")
    d, k = shape.d + 1, shape.k

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {f: np.zeros(1 + d * d + d * k + k) for f in ("train", "stop")}
        for b in batches:
            folds = b.column(3).to_numpy(zero_copy_only=False)
            f, r, y = (matrix(b.column(i)) for i in range(3))
            for name in total:
                own = folds == name
                x, t = ((np.concatenate((f[own], r[own])), np.concatenate((y[own], y[own]))) if name == "train" else ((f[own] + r[own]) / 2, y[own]))
                z = np.column_stack((x, np.ones(len(x))))
                total[name] += np.concatenate(([len(z)], (z.T @ z).ravel(), (z.T @ t).ravel(), (t * t).sum(0)))
        for name, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(v)), pa.array(np.arange(len(v)), pa.int32()), pa.array(v)], names=["fold", "cell", "v"])

    sums: dict[str, np.ndarray] = {f: np.zeros(1 + d * d + d * k + k) for f in ("train", "stop")}
    for name, cell, v in rows.mapInArrow(partial, "fold string, cell int, v double").groupBy("fold", "cell").agg(F.sum("v")).collect():
        sums[name][cell] = v
    return {f: Sums(v[0], v[1:1 + d * d].reshape(d, d), v[1 + d * d:1 + d * d + d * k].reshape(d, k), v[1 + d * d + d * k:]) for f, v in sums.items()}


def solve_head(train: Sums, stop: Sums, penalty: float = 0.0) -> Head:
    """Closed ridge solution of every target; the intercept is not penalised."""
    free = np.append(np.ones(len(train.gram) - 1), 0.0)
    w = np.linalg.lstsq(train.gram / train.n + penalty * np.diag(free), train.rhs / train.n, rcond=None)[0]
    none = np.zeros(w.shape[1], np.int64)
    return Head(w, stop.loss(w) if stop.n else np.full(w.shape[1], np.nan), none, none, penalty)


def train_head(train: Sums, stop: Sums, max_epochs: int, patience: int, penalty: float = 0.0, rate: float | None = None,
               least_gain: float = 1e-7) -> Head:
    """Gradient epochs over all training rows from zero weights, every target by itself.

    A target stops after ``patience`` epochs whose loss on the stop fold is not ``least_gain`` below the best so far, and
    keeps the weights of its best epoch. An epoch works on the sums, so it costs the same for any number of rows.
    Without a ``rate`` the step is the reciprocal of the curvature.
    """
    gram, rhs = train.gram / train.n, train.rhs / train.n
    free = np.append(np.ones(len(gram) - 1), 0.0)[:, None] * penalty
    step = rate if rate is not None else 0.5 / (np.linalg.eigvalsh(gram)[-1] + penalty)
    w = np.zeros_like(rhs)
    best_w, k = w.copy(), w.shape[1]
    best, bad, ran, at = np.full(k, np.inf), np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
    live = np.ones(k, bool)
    for epoch in range(1, max_epochs + 1):
        w = w - step * 2 * (gram @ w - rhs + free * w)
        loss = stop.loss(w)
        ran[live] = epoch
        better = live & (loss < best - least_gain)
        best[better], at[better], bad[better] = loss[better], epoch, 0
        best_w[:, better] = w[:, better]
        bad[live & ~better] += 1
        live &= bad < patience
        if not live.any():
            break
    return Head(best_w, best, ran, at, penalty)


def fit_head(df: DataFrame, fwd: str, rc: str, target: str, fold: str, grid: Sequence[float], max_epochs: int = 500,
             patience: int = 10, rate: float | None = None, least_gain: float = 1e-7) -> Head:
    """Linear head with early stop, its penalty chosen by the loss on the stop fold as well.

    ``fold`` holds train / stop / eval; the eval rows are never read. One pass over the table gives the sums that every
    epoch of every penalty runs on.
    """
    one = df.withColumn("_targets", F.when(F.col(target).isNotNull(), F.array(F.col(target).cast("double"))))
    sums = head_sums(one, fwd, rc, "_targets", fold)
    heads = [train_head(sums["train"], sums["stop"], max_epochs, patience, p, rate, least_gain) for p in grid]
    return min(heads, key=lambda h: h.loss[0])


def score_heads(df: DataFrame, fwd: str, rc: str, head: Head, carry: Sequence[str], out: str = "pred", which: str = "target") -> DataFrame:
    """``carry``, number of the target and its score (average of forward and reverse) for every row and target of a head."""
    src = df.select(*carry, F.col(fwd).cast("array<double>").alias("_f"), F.col(rc).cast("array<double>").alias("_r"))
    fields = "".join(f"{c} {src.schema[c].dataType.simpleString()}, " for c in carry)
    w = head.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f, r = (b.column(b.num_columns - i).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for i in (2, 1))
            p = (f + r) / 2 @ w[:-1] + w[-1]
            edge = np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.ListArray.from_arrays(edge, pa.array(p.ravel()))], names=[*carry, "_p"])

    scored = src.where("_f is not null and _r is not null").mapInArrow(run, f"{fields}_p array<double>")
    return scored.select(*carry, F.posexplode("_p").alias(which, out))


def gates(df: DataFrame, groups: Sequence[str], pred: str, measured: str, min_ratio: float) -> DataFrame:
    """Signed-output and collapse gates: predictions must have both signs and enough spread."""
    g = df.groupBy(*groups).agg(F.count(pred).alias("n"), (F.count_if(F.col(pred) < 0) / F.count(pred)).alias("frac_negative"),
                                (F.stddev_pop(pred) / F.stddev_pop(measured)).alias("sd_ratio"))
    ok = (F.col("frac_negative") > 0) & (F.col("frac_negative") < 1) & (F.col("sd_ratio") >= min_ratio)
    return g.withColumn("passes", ok)


def compare_arrays(df: DataFrame, by: Sequence[str], a: Column, b: Column, width: int) -> DataFrame:
    """Shape, non-finite, all-zero and difference audit of two array columns."""
    def bad(v: Column) -> Column:
        return F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))

    rows = df.select(*by, a.cast("array<double>").alias("a"), b.cast("array<double>").alias("b"))
    gap = F.zip_with("a", "b", lambda x, y: F.abs(x - y))
    size = F.transform("a", lambda x: F.abs(x))
    return (rows.withColumn("_gap", F.array_max(gap)).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if((F.size("a") != width) | (F.size("b") != width)).alias("wrong_shape"),
        F.count_if(bad(F.col("a")) | bad(F.col("b"))).alias("non_finite"),
        F.count_if(~F.exists("a", lambda x: x != 0)).alias("all_zero"), F.count_if(F.col("_gap") > 0).alias("differing"),
        (F.sum(F.aggregate(size, F.lit(0.0), lambda s, x: s + x)) / F.sum(F.size("a"))).alias("mean_abs"),
        F.max(F.array_max(size)).alias("max_abs")))


def pool_slice(x: Column, lo: Column, hi: Column, mirrored: bool = False) -> Column:
    """Mean of the bins [lo, hi) of an array, or of their mirror image [size - hi, size - lo) on the reverse strand.

    NULL where the slice is empty or leaves the array; bounds may differ from row to row.
    """
    first, n = (F.size(x) - hi if mirrored else lo), hi - lo
    part = F.slice(x, (first + 1).cast("int"), n.cast("int"))
    mean = F.aggregate(part, F.lit(0.0), lambda s, v: s + v.cast("double")) / n
    return F.when((lo >= 0) & (n > 0) & (hi <= F.size(x)), mean)


def pooling_identity(df: DataFrame, by: Sequence[str], x: str, weights: Sequence[float], bias: float = 0.0, tolerance: float = 1e-9) -> DataFrame:
    """Per group: score of the mean bins, mean of the scores, their difference over the larger of both, and whether it is within
    ``tolerance``. Arrays that are NULL or of another length than the weights take no part."""
    rows = df.where(F.size(x) == len(weights)).select(*by, F.col(x).alias("_x"))
    # one row per group and bin after map-side combine; the scores of rows stay rows
    bins = rows.select(*by, F.posexplode("_x").alias("_i", "_v")).groupBy(*by, "_i").agg(F.avg(F.col("_v").cast("double")).alias("_v"))
    w = F.element_at(F.array(*[F.lit(float(v)) for v in weights]), F.col("_i") + 1)
    pooled = bins.groupBy(*by).agg((F.sum(F.col("_v") * w) + bias).alias("of_mean"))
    scored = rows.groupBy(*by).agg((F.avg(dot(F.col("_x"), weights)) + bias).alias("mean_of"))
    a, b = F.col("of_mean"), F.col("mean_of")
    gap = F.coalesce(F.abs(a - b) / F.nullif(F.greatest(F.abs(a), F.abs(b)), F.lit(0.0)), F.lit(0.0))
    return keyed_join(pooled, scored, by, "inner").withColumn("relative_gap", gap).withColumn("identical", gap <= tolerance)
