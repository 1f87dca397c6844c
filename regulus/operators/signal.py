"""Signal quantification, normalisation and contrasts on long (region, sample, value) tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regulus.plans.integrals import integrals_at
from regulus.plans.tiling import TILE
from regulus.session import cut, keyed_join, lookup_join, salted_join


@dataclass(frozen=True)
class Contrast:
    """``name`` = log2 ratio of the mean over arm ``on`` to the mean over arm ``off``."""

    name: str
    on: tuple[str, ...]
    off: tuple[str, ...]


def contig_alias(name: Column) -> Column:
    """One spelling for ``1`` and ``chr1``, to be applied to both sides of a join by contig."""
    return F.regexp_replace(name, "^chr(?=.)", "")


def region_signal(track: DataFrame, regions: DataFrame, keys: Sequence[str], tspan: tuple[str, str],
                  rspan: tuple[str, str], value: str, sample: Sequence[str], region: Sequence[str], scale: int = 6,
                  width: int = TILE) -> DataFrame:
    """Covered-base mean of every sample's track over every region: sum(v * overlap) / sum(overlap).

    One row per (``region``, ``sample``), with ``covered`` (bases under runs, a base under two runs counts twice),
    ``weighted`` and ``mean_signal``; all three are NULL where nothing is covered, the contig has no run, or the
    region is empty. The running integrals of value and coverage are read at the two ends of a region, so no
    (run, region) pair is formed and a region's length costs nothing. Values are rounded to ``scale`` decimals
    first and then summed exactly. Runs without a value or of no length count as not there. NULL contigs meet each other.
    """
    keys, sample = list(keys), list(sample)
    units = F.round(F.col(value).cast("double") * 10**scale).cast("long")
    there = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.col(tspan[0]) < F.col(tspan[1]))
    ends = F.explode(F.array(*[F.struct(F.col(p).cast("long").alias("pos"), F.lit(sign).cast("long").alias("n"), (units * sign).alias("u"))
                               for p, sign in zip(tspan, (1, -1))])).alias("_e")
    steps = track.where(there).select(*keys, *sample, ends).select(*keys, *sample, "_e.*")
    # every sample is asked for every region; the list of samples is one row
    names = cut(track.select(F.sort_array(F.collect_set(F.struct(*sample))).alias("all")))
    wanted = regions.withColumn("_s", F.explode(names.scalar())).select("*", *[F.col(f"_s.{c}").alias(c) for c in sample]).drop("_s")
    points = wanted.select(*keys, *sample, F.explode(F.array(*[F.col(p).cast("long") for p in rspan])).alias("pos"))
    at = cut(integrals_at(steps, points, [*keys, *sample], ["n", "u"], width))
    out = wanted
    for p, tag in zip(rspan, ("0", "1")):
        ends_at = at.withColumnsRenamed({"pos": p, "int_n": f"_n{tag}", "int_u": f"_u{tag}"})
        # every sample has the regions' positions, so hot ones are counted on the regions
        out = salted_join(out, ends_at, [*keys, *sample, p], "left", counted=regions.select(*keys, p))
    covered = F.when(F.col(rspan[0]) < F.col(rspan[1]), (F.col("_n1") - F.col("_n0")).cast("long"))
    out = out.select(*region, *sample, F.nullif(covered, F.lit(0)).alias("covered"), ((F.col("_u1") - F.col("_u0")).cast("double") / 10**scale).alias("weighted"))
    weighted = F.when(F.col("covered").isNotNull(), F.col("weighted"))
    return out.select(*region, *sample, "covered", weighted.alias("weighted"), (weighted / F.col("covered")).alias("mean_signal"))


def mean_one(df: DataFrame, group: Sequence[str], value: str, out: str) -> DataFrame:
    """Divide by the group mean (NULL where the mean is zero)."""
    means = df.groupBy(*group).agg(F.avg(value).alias("_mean"))
    return (lookup_join(df, means, group)
            .withColumn(out, F.when(F.col("_mean") != 0, F.col(value) / F.col("_mean"))).drop("_mean"))


def _arm_means(df: DataFrame, region: str, arm: Column, value: str, contrasts: Sequence[Contrast]) -> DataFrame:
    aggs = [F.avg(F.when(F.col("_arm").isin(*arms), F.col(value))).alias(f"_{side}{i}")
            for i, c in enumerate(contrasts) for side, arms in (("on", c.on), ("off", c.off))]
    return df.withColumn("_arm", arm).groupBy(region).agg(*aggs)


def _log_ratio(i: int, pseudo: float) -> Column:
    return F.log2((F.col(f"_on{i}") + pseudo) / (F.col(f"_off{i}") + pseudo))


def contrast_columns(df: DataFrame, region: str, arm: Column, value: str, contrasts: Sequence[Contrast],
                     pseudo: float) -> DataFrame:
    """All contrasts in one aggregation, one column each; NULL where an arm has no value."""
    means = _arm_means(df, region, arm, value, contrasts)
    return means.select(region, *[_log_ratio(i, pseudo).alias(c.name) for i, c in enumerate(contrasts)])


def log2_contrasts(df: DataFrame, region: str, arm: Column, value: str, contrasts: Sequence[Contrast],
                   pseudo: float, out: str = "lfc") -> DataFrame:
    """The same, long: (region, contrast, lfc) for every region with a value in either arm."""
    means = _arm_means(df, region, arm, value, contrasts)
    rows = F.explode(F.array(*[
        F.struct(F.lit(c.name).alias("contrast"), _log_ratio(i, pseudo).alias(out),
                 (F.col(f"_on{i}").isNotNull() | F.col(f"_off{i}").isNotNull()).alias("seen"))
        for i, c in enumerate(contrasts)])).alias("_r")
    return means.select(region, rows).where("_r.seen").select(region, "_r.contrast", f"_r.{out}")


def distribution(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, mean, sample sd, min, max."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"),
                               F.stddev_samp(value).alias("sd"), F.min(value).alias("lo"),
                               F.max(value).alias("hi"))


def centre_within(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Subtract the mean of each small unit (for example a region within a study)."""
    means = df.groupBy(*by).agg(F.avg(value).alias("_mean"))
    return keyed_join(df, means, by).withColumn(out, F.col(value) - F.col("_mean")).drop("_mean")


def centre_arm_balanced(df: DataFrame, by: Sequence[str], arm: str, on: str, off: str, value: str,
                        out: str) -> DataFrame:
    """Subtract the mid-point of the two arm means; the plain mean where an arm is missing."""
    mid = df.groupBy(*by).agg(F.avg(F.when(F.col(arm) == on, F.col(value))).alias("_on"),
                              F.avg(F.when(F.col(arm) == off, F.col(value))).alias("_off"),
                              F.avg(value).alias("_all"))
    mid = mid.select(*by, F.coalesce(0.5 * (F.col("_on") + F.col("_off")), F.col("_all")).alias("_mid"))
    return keyed_join(df, mid, by).withColumn(out, F.col(value) - F.col("_mid")).drop("_mid")


def equalise_scale(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Divide by the pooled population sd of each group."""
    sd = df.groupBy(*by).agg(F.stddev_pop(value).alias("_sd"))
    return (lookup_join(df, sd, by)
            .withColumn(out, F.when(F.col("_sd") > 0, F.col(value) / F.col("_sd"))).drop("_sd"))
