"""Sample-by-sample matrices of a region x sample table: correlation, Gram, PCA."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regulus.operators.stats import safe_corr
from regulus.session import cut, lookup_join

# Samples a side of one tile of a Gram matrix, and the most samples for which a task sums a whole one (8 MB).
TILE = 512
WHOLE_SAMPLES = 1024


def dense_rows(df: DataFrame, region: str, sample: str, value: str,
               samples: Sequence[str]) -> DataFrame:
    """Regions with a value in every sample, as one array column ``v`` in ``samples`` order.

    A region has one row per sample, so the array is as long as the sample list, never longer.
    """
    wide = df.groupBy(region).pivot(sample, list(samples)).agg(F.first(value))
    whole = wide.dropna(subset=list(samples))
    return whole.select(region, F.array(*[F.col(s) for s in samples]).alias("v"))


def gram(rows: DataFrame, samples: Sequence[str], upper: bool = False) -> DataFrame:
    """Sums over regions: ``sij`` = sum(vi * vj), ``si``, ``sj``, ``n`` for every sample pair (``upper``: i <= j only).

    No pair of rows is ever formed: a batch of regions is multiplied tile by tile, TILE x TILE samples at a time. Up to
    WHOLE_SAMPLES samples a partition keeps one sum over its batches; beyond that every tile of a batch is sent on at
    once, so a task never holds samples x samples numbers.
    """
    names = list(samples)
    k = len(names)

    def block(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = range(0, k, TILE)
        tiles = [(i, j) for i in at for j in at if i <= j or not upper]

        def frames(tile: tuple[int, int], sij: np.ndarray, si: np.ndarray, sj: np.ndarray, n: int) -> pd.DataFrame:
            r, c = sij.shape
            i, j = np.divmod(np.arange(r * c), c)
            out = pd.DataFrame({"i": tile[0] + i, "j": tile[1] + j, "sij": sij.ravel(), "si": si[i], "sj": sj[j], "n": n})
            return out[out["i"] <= out["j"]] if upper else out

        kept: dict[tuple[int, int], list] = {}
        for pdf in parts:
            if not len(pdf):
                continue
            x = np.stack(pdf["v"].to_numpy()).astype(float)
            for i, j in tiles:
                a, b = x[:, i:i + TILE], x[:, j:j + TILE]
                sums = [a.T @ b, a.sum(axis=0), b.sum(axis=0), len(x)]
                if k > WHOLE_SAMPLES:
                    yield frames((i, j), *sums)
                else:
                    kept[i, j] = [p + q for p, q in zip(kept[i, j], sums)] if (i, j) in kept else sums
        for tile, sums in kept.items():
            yield frames(tile, *sums)

    blocks = rows.select("v").mapInPandas(block, "i int, j int, sij double, si double, sj double, n long")
    label = F.array(*[F.lit(s) for s in names])
    return (blocks.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("sij", "si", "sj", "n")])
            .withColumn("sample_i", F.element_at(label, F.col("i") + 1))
            .withColumn("sample_j", F.element_at(label, F.col("j") + 1)))


def correlation_matrix(rows: DataFrame, samples: Sequence[str]) -> DataFrame:
    """Pearson correlation for every pair i < j from the Gram sums."""
    g = gram(rows, samples)
    var = g.where("i = j").select("i", (F.col("sij") - F.col("si") * F.col("si") / F.col("n")).alias("var"))
    var = cut(var)  # one row per sample
    cov = F.col("sij") - F.col("si") * F.col("sj") / F.col("n")
    return (g.where("i < j").join(var.withColumnRenamed("var", "vi"), "i")
            .join(var.select(F.col("i").alias("j"), F.col("var").alias("vj")), "j")
            .select("sample_i", "sample_j", "n", (cov / F.sqrt(F.col("vi") * F.col("vj"))).alias("r")))


def _times(entries: DataFrame, q: np.ndarray) -> np.ndarray:
    """The symmetric matrix of (i, j, sij), i <= j, times a samples x c block."""
    k, c = q.shape

    def multiply(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        y = np.zeros((k, c))
        for pdf in parts:
            i, j, s = (pdf[name].to_numpy() for name in ("i", "j", "sij"))
            mirror = np.where(i < j, s, 0.0)
            for col in range(c):
                y[:, col] += np.bincount(i, s * q[j, col], k) + np.bincount(j, mirror * q[i, col], k)
        i, col = np.divmod(np.arange(k * c), c)
        yield pd.DataFrame({"i": i, "c": col, "y": y.ravel()})

    out = np.zeros((k, c))
    sums = entries.select("i", "j", "sij").mapInPandas(multiply, "i int, c int, y double").groupBy("i", "c").agg(F.sum("y").alias("y"))
    got = sums.toPandas()  # samples x c numbers
    out[got["i"], got["c"]] = got["y"]
    return out


def leading_pairs(entries: DataFrame, size: int, components: int, extra: int = 10, tolerance: float = 1e-11,
                  rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues and vectors of the positive matrix in the rows (i, j, sij), i <= j, by subspace iteration.

    The matrix stays a table; a round is one job that multiplies it by ``components + extra`` vectors, then a
    Rayleigh-Ritz step on those. Only such size x (components + extra) blocks reach the driver. It ends when the wanted
    vectors' residuals fall below ``tolerance`` of the largest value. In every vector the entry of largest absolute
    value (the first of equal ones) is positive.
    """
    c = min(size, components + extra)
    q, _ = np.linalg.qr(np.random.default_rng(7).standard_normal((size, c)))
    for _ in range(rounds):
        y = _times(entries, q)
        h = q.T @ y
        val, w = np.linalg.eigh((h + h.T) / 2)
        val, w = val[::-1], w[:, ::-1]
        vec = q @ w
        gap = np.linalg.norm(y @ w - vec * val, axis=0)[:components]
        if gap.max(initial=0.0) <= tolerance * max(val[0], 0.0):
            break
        q, _ = np.linalg.qr(y @ w)
    else:
        raise ArithmeticError(f"subspace iteration has not converged after {rounds} rounds")
    val, vec = np.maximum(val[:components], 0.0), vec[:, :components]
    top = np.argmax(np.abs(vec) >= np.abs(vec).max(axis=0) * (1 - 1e-9), axis=0)
    return val, vec * np.where(vec[top, np.arange(vec.shape[1])] < 0, -1.0, 1.0)


def pca_scores(rows: DataFrame, samples: Sequence[str], components: int) -> DataFrame:
    """PCA of samples: each region centred across samples, then the leading pairs of the samples x samples Gram table.

    Returns (sample, component, score, variance_fraction); no component for a table without complete regions. The sign
    of a component is that of ``leading_pairs``. No task or group holds the whole Gram matrix.
    """
    names = list(samples)
    centred = rows.withColumn("_m", F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / len(names))
    centred = centred.select(F.transform("v", lambda x: x - F.col("_m")).alias("v"))
    entries = cut(gram(centred, names, upper=True).select("i", "j", "sij"))
    total = entries.where("i = j").agg(F.sum("sij")).first()[0]
    kind = "sample string, component int, score double, variance_fraction double"
    if total is None:
        return rows.sparkSession.createDataFrame([], kind)
    val, vec = leading_pairs(entries, len(names), min(components, len(names)))
    out = [(s, c + 1, float(vec[i, c] * np.sqrt(val[c])), float(val[c] / total) if total > 0 else 0.0)
           for c in range(len(val)) for i, s in enumerate(names)]
    return rows.sparkSession.createDataFrame(out, kind)


def component_against_stage(rows: DataFrame, stages: Mapping[str, float]) -> DataFrame:
    """First component's score of every sample beside its stage, and their Pearson correlation ``r``."""
    first = pca_scores(rows, list(stages), 1)
    stage = F.create_map(*[F.lit(x) for s, v in stages.items() for x in (s, float(v))])
    out = first.select("sample", F.element_at(stage, F.col("sample")).alias("stage"), F.col("score").alias("pc1"), F.lit(1).alias("_one"))
    return lookup_join(out, out.groupBy("_one").agg(safe_corr("pc1", "stage").alias("r")), ["_one"]).drop("_one")
