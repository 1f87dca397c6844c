"""Seeded shuffles, sampled and exhaustive permutation nulls."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regulus.operators.model import head_sums, score_heads, solve_head, train_head
from regulus.operators.stats import correlations
from regulus.plans.tiling import running_sums
from regulus.session import cut, keyed_join, shuffle_partitions, spread, with_size_hint


def seeded_hash(seed: Column, ident: Column) -> Column:
    """md5 of ``seed-id``: a uniform order that any engine can repeat."""
    return F.md5(F.concat_ws("-", seed.cast("string"), ident.cast("string")))


def number_by_hash(df: DataFrame, groups: Sequence[str], key: str, out: str) -> DataFrame:
    """Position (1..n) of each row in md5 order within its group.

    The hash is uniform, so its leading digits cut every group into even tiles without a look at
    the data (as many digits as give one tile per shuffle partition); only a one-row count per
    tile crosses tiles.
    """
    digits = max(1, math.ceil(math.log(shuffle_partitions(df.sparkSession), 16)))
    tiled = (df.withColumn("_tile", F.conv(F.substring(key, 1, digits), 16, 10).cast("long"))
             .withColumn("_one", F.lit(1).cast("long")))
    return running_sums(tiled, groups, key, "_tile", ["_one"]).withColumnRenamed("cum__one", out).drop("_tile", "_one")


def shuffle_within(df: DataFrame, groups: Sequence[str], ident: str, value: str, seeds: Sequence[int],
                   out: str = "shuffled") -> DataFrame:
    """``len(seeds)`` permutations of ``value`` within ``groups`` in one job.

    Row i (in md5 order of the id alone) receives the value of the i-th row in md5 order of the seed, so
    ids may be of any type: strings, decimals, longs beyond 2^53.
    """
    groups = list(groups)
    df = spread(df, ident)
    seed = F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed")
    receivers = number_by_hash(df.withColumn("_key", F.md5(F.col(ident).cast("string"))), groups, "_key", "_i").drop("_key")
    drawn = df.select(*groups, ident, value, seed).withColumn("_key", seeded_hash(F.col("seed"), F.col(ident)))
    drawn = number_by_hash(drawn.select(*groups, "seed", "_key", value), [*groups, "seed"], "_key", "_i")
    # each position has one receiver, which meets one drawn value per seed: only the drawn side is multiplied. The planner
    # takes it for no larger than its table and would broadcast it, so receivers are counted and the drawn side is never sent
    drawn = drawn.select(*groups, "seed", "_i", F.col(value).alias(out)).hint("merge")
    return keyed_join(drawn, with_size_hint(cut(receivers)), [*groups, "_i"]).drop("_i")


def empirical_p(null: DataFrame, real: DataFrame, stat: str, by: Sequence[str]) -> DataFrame:
    """p = (b + 1) / (N + 1) with b = permutations at least as large as the real value, and its floor.

    ``null`` has one row per permutation and ``real`` one row per condition.
    """
    j = keyed_join(null, real.withColumnRenamed(stat, "real"), by)
    g = j.groupBy(*by).agg(F.first("real").alias("real"), F.count(stat).alias("n_perm"), F.avg(stat).alias("null_mean"),
                           F.stddev_samp(stat).alias("null_sd"), F.min(stat).alias("null_min"), F.max(stat).alias("null_max"),
                           F.count_if(F.col(stat) >= F.col("real")).alias("n_beating"))
    return (g.withColumn("p", (F.col("n_beating") + 1) / (F.col("n_perm") + 1))
            .withColumn("p_floor", 1 / (F.col("n_perm") + 1)))


def refit_null(df: DataFrame, ident: str, fwd: str, rc: str, target: str, fold: str, measured: str, seeds: Sequence[int],
               penalty: float = 0.0, epochs: int | None = None, patience: int = 10) -> tuple[DataFrame, DataFrame]:
    """Refit the linear head for every seeded shuffle of the target within its fold; correlate on the eval fold.

    Returns (null, real): (seed, rho) per shuffle, and the same statistic of the unshuffled target. All targets are
    columns of one right-hand side over shared Gram matrices, summed in one pass, and all heads are trained and
    scored together. ``epochs`` None takes the closed solution, else gradient epochs with early stop. ``ident`` is
    distinct; rows without a target are left out of the fit.
    """
    known = cut(df.where(F.col(fold).isin("train", "stop") & F.col(target).isNotNull()))
    drawn = shuffle_within(known.select(fold, ident, F.col(target).cast("double").alias(target)), [fold], ident, target, seeds)
    # a row holds one value per seed, which the planner does not see either
    columns = drawn.groupBy(ident).agg(F.sort_array(F.collect_list(F.struct("seed", "shuffled"))).alias("_s")).hint("merge")
    targets = F.concat(F.array(F.col(target).cast("double")), F.transform("_s", lambda x: x["shuffled"]))
    sums = head_sums(known.join(columns, ident).withColumn("_targets", targets), fwd, rc, "_targets", fold)
    train, stop = sums["train"], sums["stop"]
    head = solve_head(train, stop, penalty) if epochs is None else train_head(train, stop, epochs, patience, penalty)
    scored = score_heads(df.where(F.col(fold) == "eval"), fwd, rc, head, [measured])
    rho = cut(correlations(scored, ["target"], "pred", measured).select("target", F.col("spearman").alias("rho")))
    order = F.create_map(*[F.lit(x) for i, s in enumerate(sorted(seeds)) for x in (i + 1, s)])
    return rho.where("target > 0").select(order[F.col("target")].alias("seed"), "rho"), rho.where("target = 0").select("rho")


MOST_SAMPLES = 24


def label_partitions(df: DataFrame, n: int, k: int) -> DataFrame:
    """All C(n, k) ways to label n samples, as bit masks attached to every row of ``df``.

    The masks are a distributed range; n is a number of samples and may be at most ``MOST_SAMPLES``.
    ``df`` has one row per sample and condition.
    """
    if not 0 < n <= MOST_SAMPLES:
        raise ValueError(f"an exhaustive null over {n} samples has 2^{n} masks; at most {MOST_SAMPLES} samples are enumerated")
    masks = df.sparkSession.range(2**n).where(F.bit_count("id") == k).select(F.col("id").alias("mask"))
    return masks.withColumn("_one", F.lit(1)).join(with_size_hint(df.withColumn("_one", F.lit(1))), "_one").drop("_one")


def exact_null(rows: DataFrame, index: str, value: str, by: Sequence[str], n: int, k: int, real_mask: int) -> DataFrame:
    """Exact p of the mean difference over all label partitions; ties with the real split count.

    ``rows`` has one row per sample (``index`` 0..n-1). Also returns the floor 1 / C(n, k).
    """
    # one row per sample: summed as exact hundredths so that complementary splits tie exactly
    parts = label_partitions(cut(rows), n, k)
    on = F.expr(f"shiftright(mask, cast({index} as int)) & 1") == 1
    stat = (parts.groupBy(*by, "mask").agg(F.sum(F.when(on, F.col(value)).otherwise(0)).alias("_on"),
                                           F.sum(F.when(~on, F.col(value)).otherwise(0)).alias("_off"))
            .withColumn("stat", F.col("_on") * (n - k) - F.col("_off") * k))
    real = stat.where(F.col("mask") == real_mask).select(*by, F.col("stat").alias("real"))
    return (keyed_join(stat, real, by).groupBy(*by)
            .agg(F.count(F.lit(1)).alias("n_partitions"), F.count_if(F.col("stat") >= F.col("real")).alias("n_at_least"))
            .withColumn("p", F.col("n_at_least") / F.col("n_partitions")).withColumn("p_floor", 1 / F.col("n_partitions")))
