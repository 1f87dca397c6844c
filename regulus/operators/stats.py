"""Rank and moment statistics for many groups in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regulus.operators.signal import Contrast
from regulus.plans.ordered import add_average_ranks, exact_percentiles, ordered_values
from regulus.session import cut, keyed_join, lookup_join, spread


def safe_corr(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation, NULL instead of NaN when a side is constant."""
    c = F.corr(x, y)
    return F.when(~F.isnan(c), c)


def correlations(df: DataFrame, groups: Sequence[str], x: str, y: str) -> DataFrame:
    """n, Spearman (average ranks) and Pearson per group over rows where both values are present."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = add_average_ranks(both, groups, {x: "_rx", y: "_ry"})
    return ranked.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), safe_corr("_rx", "_ry").alias("spearman"),
                                       safe_corr(x, y).alias("pearson"))


def pair_thresholds(wide: DataFrame, pairs: Sequence[tuple[str, str]],
                    thresholds: Sequence[float]) -> DataFrame:
    """Rows (pair_a, pair_b, threshold, x, y) with abs(x) >= t or abs(y) >= t."""
    choices = F.array(*[F.struct(F.lit(a).alias("pair_a"), F.lit(b).alias("pair_b"),
                                 F.col(a).alias("x"), F.col(b).alias("y")) for a, b in pairs])
    rows = wide.select(F.explode(choices).alias("_p")).select("_p.*")
    rows = rows.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    rows = rows.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    return rows.where(F.greatest(F.abs("x"), F.abs("y")) >= F.col("threshold"))


def threshold_correlations(wide: DataFrame, pairs: Sequence[tuple[str, str]], thresholds: Sequence[float],
                           contrasts: Sequence[Contrast] = (), min_n: int = 20) -> DataFrame:
    """Thresholded rank correlation of many contrast pairs; statistics are NULL below ``min_n``."""
    # the wide table feeds the sketch, both rank tables and the join back: compute it once
    rows = pair_thresholds(spread(cut(wide), *dict.fromkeys(c for p in pairs for c in p)), pairs, thresholds)
    stats = correlations(rows, ["pair_a", "pair_b", "threshold"], "x", "y")
    arms = {c.name: set(c.off) for c in contrasts}
    shared = [(a, b) for a, b in pairs if arms.get(a, set()) & arms.get(b, set())]
    is_shared = F.lit(False)
    for a, b in shared:
        is_shared = is_shared | ((F.col("pair_a") == a) & (F.col("pair_b") == b))
    ok = F.col("n") >= min_n
    return stats.select("pair_a", "pair_b", "threshold", "n", F.when(ok, F.col("spearman")).alias("spearman"),
                        F.when(ok, F.col("pearson")).alias("pearson"), (~ok).alias("too_few"),
                        is_shared.alias("shares_control"))


def concordance(wide: DataFrame, pairs: Sequence[tuple[str, str]], thresholds: Sequence[float]) -> DataFrame:
    """Of the rows differential in A: how many are differential in B, and how many agree in sign."""
    choices = F.array(*[F.struct(F.lit(a).alias("pair_a"), F.lit(b).alias("pair_b"),
                                 F.col(a).alias("x"), F.col(b).alias("y")) for a, b in pairs])
    rows = wide.select(F.explode(choices).alias("_p")).select("_p.*").where("x is not null and y is not null")
    rows = rows.withColumn("threshold", F.explode(F.filter(
        F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: F.abs(F.col("x")) >= t)))
    both = F.abs("y") >= F.col("threshold")
    same = F.signum("x") == F.signum("y")
    return (rows.groupBy("pair_a", "pair_b", "threshold")
            .agg(F.count(F.lit(1)).alias("n_a"), F.count_if(both).alias("n_both"),
                 F.count_if(both & same).alias("n_both_same"), F.count_if(same).alias("n_same"))
            .withColumn("share_both", F.col("n_both") / F.col("n_a"))
            .withColumn("share_same", F.col("n_same") / F.col("n_a")))


def anova_r2(df: DataFrame, by: Sequence[str], label: str, value: str) -> DataFrame:
    """Share of the sum of squares explained by ``label``; 0 when the value is constant."""
    g = df.groupBy(*by, label).agg(F.count(value).alias("n"), F.avg(value).alias("m"),
                                   F.var_pop(value).alias("v"))
    tot = g.groupBy(*by).agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("_grand"))
    j = lookup_join(g, tot, by)
    ssb = F.sum(F.col("n") * F.pow(F.col("m") - F.col("_grand"), 2))
    ssw = F.sum(F.col("n") * F.col("v"))
    return (j.groupBy(*by).agg(F.sum("n").alias("n"), ssb.alias("_b"), ssw.alias("_w"))
            .select(*by, "n", F.when(F.col("_b") + F.col("_w") > 0, F.col("_b") / (F.col("_b") + F.col("_w")))
                    .otherwise(0.0).alias("r2")))


def rank_sum(df: DataFrame, groups: Sequence[str], value: str, positive: Column, continuity: float = 0.0) -> DataFrame:
    """Mann-Whitney U of the positive rows, AUC, the tie-corrected normal z and the tie sum, from value counts.

    ``continuity`` (0.5 for the usual correction) moves U towards its mean before it is scaled.

    No row is ranked one by one: the distinct-value table already carries counts and running counts.
    """
    groups = list(groups)
    rows = df.where(F.col(value).isNotNull() & positive.isNotNull()).withColumn("_pos", positive.cast("long"))
    ov = ordered_values(rows, groups, value, ["_pos"])
    rank = F.col("cum_n") - (F.col("n") - 1) / 2.0
    agg = ov.groupBy(*groups).agg(
        F.sum("n").alias("n"), F.sum("_pos").alias("n_pos"), F.sum(rank * F.col("_pos")).alias("_r"),
        F.sum(F.pow(F.col("n").cast("double"), 3) - F.col("n")).alias("_ties"))
    n1, n = F.col("n_pos").cast("double"), F.col("n").cast("double")
    n0 = n - n1
    u = F.col("_r") - n1 * (n1 + 1) / 2
    off = u - n1 * n0 / 2
    var = n1 * n0 / 12 * (n + 1 - F.col("_ties") / F.when(n > 1, n * (n - 1)))
    return (agg.withColumn("n_neg", F.col("n") - F.col("n_pos"))
            .withColumn("u", u).withColumn("auc", F.when((n1 > 0) & (n0 > 0), u / F.when(n1 * n0 > 0, n1 * n0)))
            .withColumn("z", F.when(var > 0, F.signum(off) * F.greatest(F.abs(off) - continuity, F.lit(0.0)) / F.sqrt(var)))
            .withColumnRenamed("_ties", "ties").drop("_r"))


def auc_block(df: DataFrame, groups: Sequence[str], score: str, measured: str, cutoff: float,
              min_n: int = 10) -> DataFrame:
    """AUC over rows with abs(measured) >= cutoff; counts of the rest; NULL if too few or one class."""
    pos, neg = F.col(measured) >= cutoff, F.col(measured) <= -cutoff
    counts = df.groupBy(*groups).agg(F.count(measured).alias("n_total"), F.count_if(pos).alias("n_positive"),
                                     F.count_if(neg).alias("n_negative"))
    ranked = rank_sum(df.where(pos | neg), groups, score, pos).select(*groups, F.col("auc").alias("_auc"))
    evaluable = F.col("n_positive") + F.col("n_negative")
    return (keyed_join(counts, ranked, groups, "left")
            .withColumn("n_evaluable", evaluable)
            .withColumn("n_ambiguous", F.col("n_total") - evaluable)
            .withColumn("auc", F.when(evaluable >= min_n, F.col("_auc"))).drop("_auc"))


def roc_points(df: DataFrame, groups: Sequence[str], score: str, positive: Column) -> DataFrame:
    """(threshold, tpr, fpr) at every distinct score, ties collapsed."""
    groups = list(groups)
    rows = df.where(F.col(score).isNotNull()).withColumn("_pos", positive.cast("long"))
    ov = ordered_values(rows, groups, score, ["_pos"])
    tot = rows.groupBy(*groups).agg(F.sum("_pos").alias("_p"), F.count(F.lit(1)).alias("_n"))
    j = lookup_join(ov, tot, groups, "inner")
    tp = F.col("_p") - F.col("cum__pos") + F.col("_pos")
    at_or_above = F.col("_n") - F.col("cum_n") + F.col("n")
    return j.select(*groups, F.col(score).alias("threshold"), (tp / F.col("_p")).alias("tpr"),
                    ((at_or_above - tp) / (F.col("_n") - F.col("_p"))).alias("fpr"))


def quantile_buckets(df: DataFrame, groups: Sequence[str], value: str, buckets: int,
                     out: str = "bucket") -> DataFrame:
    """Right-closed buckets at linear percentiles, lowest value included, duplicate edges dropped."""
    probs = [i / buckets for i in range(buckets + 1)]
    q = exact_percentiles(df, groups, value, probs)
    edges = q.select(*groups, F.array_distinct(F.array(*[F.col(f"q{i}") for i in range(buckets + 1)])).alias("_e"))
    joined = lookup_join(df.where(F.col(value).isNotNull()), edges, groups)
    below = F.size(F.filter("_e", lambda e: e < F.col(value)))
    return joined.withColumn(out, F.greatest(below - 1, F.lit(0)).cast("long")).drop("_e")


def welch(df: DataFrame, groups: Sequence[str], value: str, side: Column) -> DataFrame:
    """Welch t and its degrees of freedom for side (true) minus other (false)."""
    a, b = F.when(side, F.col(value)), F.when(~side, F.col(value))
    g = df.groupBy(*groups).agg(F.count(a).alias("n1"), F.count(b).alias("n0"), F.avg(a).alias("mean1"),
                                F.avg(b).alias("mean0"), F.var_samp(a).alias("_v1"), F.var_samp(b).alias("_v0"))
    e1, e0 = F.col("_v1") / F.col("n1"), F.col("_v0") / F.col("n0")
    ok = (F.col("n1") > 1) & (F.col("n0") > 1) & (e1 + e0 > 0)
    return (g.withColumn("t", F.when(ok, (F.col("mean1") - F.col("mean0")) / F.sqrt(e1 + e0)))
            .withColumn("df", F.when(ok, F.pow(e1 + e0, 2) /
                                     (F.pow(e1, 2) / (F.col("n1") - 1) + F.pow(e0, 2) / (F.col("n0") - 1))))
            .drop("_v1", "_v0"))

