"""Statistics of designed experiments: baselines, paired arms, additivity, dose and presence contrasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regulus.operators.stats import correlations, rank_sum, welch
from regulus.plans.ordered import add_average_ranks, ordered_values
from regulus.session import cut, keyed_join, lookup_join


def subtract_baseline(df: DataFrame, baseline: Column, on: Sequence[str], value: str, out: str = "delta") -> DataFrame:
    """Subtract the baseline row's value with the same ``on`` keys (NULL when there is none)."""
    base = df.where(baseline).groupBy(*on).agg(F.avg(value).alias("_base"))
    return lookup_join(df, base, on).withColumn(out, F.col(value) - F.col("_base")).drop("_base")


def paired_difference(df: DataFrame, unit: Sequence[str], arm: str, plus: str, minus: str, value: str,
                      out: str = "adjusted") -> DataFrame:
    """One row per unit: the two arms side by side and ``plus - minus``; unpaired units are dropped."""
    wide = df.groupBy(*unit).agg(F.avg(F.when(F.col(arm) == plus, F.col(value))).alias("plus"),
                                 F.avg(F.when(F.col(arm) == minus, F.col(value))).alias("minus"))
    return wide.where("plus is not null and minus is not null").withColumn(out, F.col("plus") - F.col("minus"))


def sem(c: str) -> Column:
    return F.stddev_samp(c) / F.sqrt(F.count(c))


def one_sample(df: DataFrame, by: Sequence[str], value: str, mu: float = 0.0) -> DataFrame:
    """n, mean, sd, sem, t against ``mu`` and df."""
    g = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
                            sem(value).alias("sem"))
    return (g.withColumn("t", F.when(F.col("sem") > 0, (F.col("mean") - mu) / F.col("sem")))
            .withColumn("df", (F.col("n") - 1).cast("double")))


def paired_summary(pairs: DataFrame, by: Sequence[str], required: float) -> DataFrame:
    """Means and SEMs of both arms and of their difference, one-sample t, share of a required effect."""
    g = pairs.groupBy(*by).agg(
        F.count("adjusted").alias("n"), F.avg("plus").alias("raw"), sem("plus").alias("raw_sem"),
        F.avg("minus").alias("scrambled"), sem("minus").alias("scrambled_sem"),
        F.avg("adjusted").alias("adjusted"), sem("adjusted").alias("adjusted_sem"))
    return (g.withColumn("t", F.when(F.col("adjusted_sem") > 0, F.col("adjusted") / F.col("adjusted_sem")))
            .withColumn("frac_of_required", F.col("adjusted") / required))


def additivity(summary: DataFrame, label: str, strata: Sequence[str], single_strata: Sequence[str]) -> DataFrame:
    """Observed combination against the mean of its members' single effects, SEM propagated.

    ``summary`` has one row per condition with ``adjusted`` and ``adjusted_sem``.
    """
    parts = F.split(label, r"\+")
    combos = (summary.where(F.size(parts) > 1)
              .withColumn("_share", 1.0 / F.size(parts)).withColumn("_member", F.explode(parts)))
    singles = (summary.where(F.size(parts) == 1).groupBy(F.col(label).alias("_member"), *single_strata)
               .agg(F.avg("adjusted").alias("_one"), F.max("adjusted_sem").alias("_one_sem")))
    j = keyed_join(combos, singles, ["_member", *single_strata])
    return (j.groupBy(label, *strata)
            .agg(F.first("adjusted").alias("observed"), F.first("adjusted_sem").alias("observed_sem"),
                 F.sum(F.col("_one") * F.col("_share")).alias("expected"),
                 F.sqrt(F.sum(F.pow(F.col("_one_sem") * F.col("_share"), 2))).alias("expected_sem"))
            .withColumn("obs_minus_exp", F.col("observed") - F.col("expected"))
            .withColumn("obs_over_exp", F.when(F.col("expected") != 0, F.col("observed") / F.col("expected"))))


def design_arms(members: DataFrame, name: str, most: int, loads: Sequence[int],
                arrangements: Sequence[str] = ("interleaved", "clustered")) -> DataFrame:
    """All arms of 0 to ``most`` members of a table: label, members, n_members, load, arrangement, variant.

    Combinations are the bit masks of the sorted distinct names, which never leave the executors. The empty arm has load 0
    and a real variant only; single members have one arrangement; every other arm comes at each load, arrangement and
    variant. A table of members is short: 16 names at most, else an error. NULL names are no members.
    """
    names = members.agg(F.sort_array(F.collect_set(name)).alias("all"))
    size = F.size("all")
    bounded = F.when(size <= 16, F.pow(F.lit(2), size).cast("int") - 1).otherwise(F.raise_error(F.lit("a design of more than 16 members")).cast("int"))
    masks = names.select("all", F.explode(F.sequence(F.lit(0), bounded)).alias("mask")).where(F.bit_count("mask") <= most)
    chosen = F.filter("all", lambda x, i: F.bit_get(F.col("mask").cast("long"), i) == 1)
    arms = masks.select(chosen.alias("members")).withColumn("n_members", F.size("members"))
    arms = arms.withColumn("label", F.when(F.col("n_members") == 0, "empty").otherwise(F.array_join("members", "+")))

    def choice(none: Column, one: Column, many: Column) -> Column:
        return F.explode(F.when(F.col("n_members") == 0, none).when(F.col("n_members") == 1, one).otherwise(many))

    each = F.array(*[F.lit(int(k)) for k in loads])
    both = F.array(F.lit("real"), F.lit("scrambled"))
    return (arms.withColumn("load", choice(F.array(F.lit(0)), each, each))
            .withColumn("arrangement", choice(F.array(F.lit("none")), F.array(F.lit("single")), F.array(*[F.lit(a) for a in arrangements])))
            .withColumn("variant", choice(F.array(F.lit("real")), both, both))
            .select("label", "members", "n_members", "load", "arrangement", "variant"))


def saturation(curve: DataFrame, by: Sequence[str], load: str, value: str) -> DataFrame:
    """Gain per added copy between consecutive loads. ``curve`` has one row per condition and load."""
    w = Window.partitionBy(*by).orderBy(load)  # a few loads per condition
    gain = (F.col(value) - F.lag(value).over(w)) / (F.col(load) - F.lag(load).over(w))
    return curve.select(*by, F.lag(load).over(w).alias("load_from"), F.col(load).alias("load_to"),
                        gain.alias("gain_per_copy")).where("load_from is not null")


def paired_battery(pairs: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Paired t, Wilcoxon signed-rank sums and sign counts of a difference column."""
    base = one_sample(pairs, by, value)
    d = F.col(value)
    signs = pairs.groupBy(*by).agg(F.count_if(d > 0).alias("n_pos"), F.count_if(d < 0).alias("n_neg"))
    ranked = add_average_ranks(pairs.where(d != 0).withColumn("_abs", F.abs(d)), by, {"_abs": "_rank"})
    w = ranked.groupBy(*by).agg(F.coalesce(F.sum(F.when(d > 0, F.col("_rank"))), F.lit(0.0)).alias("w_plus"),
                                F.coalesce(F.sum(F.when(d < 0, F.col("_rank"))), F.lit(0.0)).alias("w_minus"))
    return keyed_join(keyed_join(base, signs, by), w, by, "left")


def presence_contrast(long: DataFrame, by: Sequence[str], present: Column, value: str, min_side: int = 1) -> DataFrame:
    """With/without means, their difference, Welch t, U, z and tie sum per (motif, readout)."""
    rows = long.withColumn("_present", present)
    t = welch(rows, by, value, F.col("_present"))
    u = rank_sum(rows, by, value, F.col("_present")).select(*by, "u", "z", "ties")
    j = keyed_join(t, u, by).withColumn("delta", F.col("mean1") - F.col("mean0"))
    return j.where((F.col("n1") >= min_side) & (F.col("n0") >= min_side))


def top_share(df: DataFrame, by: Sequence[str], value: str, share: float) -> DataFrame:
    """Share of the total carried by the top ``ceil(share * n)`` values, from cumulative counts."""
    ov = ordered_values(df, by, value)
    tot = df.groupBy(*by).agg(F.count(value).alias("n"), F.sum(value).alias("total"))
    j = lookup_join(ov.withColumnRenamed("n", "copies"), tot, by, "inner")
    k = F.ceil(F.col("n") * share)
    above = F.col("n") - F.col("cum_n")
    taken = F.greatest(F.least(k - above, F.col("copies")), F.lit(0))
    return j.groupBy(*by).agg(F.first("n").alias("n"), (F.sum(taken * F.col(value)) / F.first("total")).alias("top_share"))


def odds_ratio(df: DataFrame, by: Sequence[str], top: Column, present: Column) -> DataFrame:
    """2 x 2 counts of presence in the top and bottom group, fractions, ratio and odds ratio."""
    g = df.groupBy(*by).agg(F.count_if(top & present).alias("top_with"), F.count_if(top & ~present).alias("top_without"),
                            F.count_if(~top & present).alias("bottom_with"), F.count_if(~top & ~present).alias("bottom_without"))
    ft = F.col("top_with") / (F.col("top_with") + F.col("top_without"))
    fb = F.col("bottom_with") / (F.col("bottom_with") + F.col("bottom_without"))
    den = F.col("top_without") * F.col("bottom_with")
    return (g.withColumn("ratio", F.when(fb > 0, ft / fb))
            .withColumn("odds_ratio", F.when(den > 0, F.col("top_with") * F.col("bottom_without") / den)))


def affinity_effect(df: DataFrame, affinity: str, effect: str, mutant: Column, created: Sequence[str] = ()) -> DataFrame:
    """Correlation of affinity with effect over all variants and over the mutants alone, with mean and range of the effect and
    of every ``created`` column (sites made by accident). Rows where affinity or effect is missing do not count."""
    both = df.where(F.col(affinity).isNotNull() & F.col(effect).isNotNull())
    subsets = F.when(mutant, F.array(F.lit("all"), F.lit("mutant"))).otherwise(F.array(F.lit("all")))
    s = cut(both.withColumn("subset", F.explode(subsets)))
    spread = [f(c).alias(f"{c}_{n}") for c in (effect, *created) for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    return correlations(s, ["subset"], affinity, effect).join(s.groupBy("subset").agg(*spread), "subset")
