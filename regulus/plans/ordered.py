"""Ranks, quantiles and cumulative counts of a numeric column without a whole-group sort.

A group is collapsed to its distinct values with map-side combine, cut into tiles at approximate
quantile edges, and scanned tile by tile. The edges only balance the tiles; every result is exact.
The edges are materialised once, so each use of them sees the same cut after a lost executor.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regulus.plans.tiling import running_sums
from regulus.session import BROADCAST_BYTES, BROADCAST_ROWS, cut, keyed_join, lookup_join, salted_join, shuffle_partitions


@dataclass(frozen=True)
class Edges:
    """Tile edges of one value column: ``_edges`` (ascending, 2**depth - 1 of them) and ``_hot``
    (value -> number of tiles it fills) per group."""

    table: DataFrame
    groups: tuple[str, ...]
    depth: int
    bounded: bool

    def attach(self, df: DataFrame) -> DataFrame:
        """Edges to every row: broadcast when counted as small, else a join that salts hot groups."""
        if self.bounded:
            return keyed_join(df, F.broadcast(self.table), self.groups)
        return salted_join(df, self.table, self.groups)

    def tag(self, df: DataFrame, value: str, tile: str) -> DataFrame:
        """Add ``tile`` = number of edges below the value, by a binary search of ``depth`` steps.

        Each step is a plain projection, so the whole search stays inside generated code.
        """
        out = self.attach(df).withColumn(tile, F.lit(0))
        for d in range(self.depth - 1, -1, -1):
            probe = F.get(F.col("_edges"), F.col(tile) + (2**d - 1))
            out = out.withColumn(tile, F.col(tile) + F.when(probe < F.col(value), 2**d).otherwise(0))
        return out.drop("_edges")


def value_edges(df: DataFrame, groups: Sequence[str], *values: str,
                tiles: int | None = None) -> list[Edges]:
    """Quantile edges per group for each of ``values``, from mergeable sketches in one pass."""
    wanted = tiles or max(16, min(4096, shuffle_partitions(df.sparkSession)))
    depth = max(1, (wanted - 1).bit_length())
    k = 2**depth
    probs = [i / k for i in range(1, k)]
    sketches = cut(df.groupBy(*groups).agg(*[
        F.percentile_approx(F.col(v), probs, max(1_000, 20 * k)).alias(v) for v in values]))
    out = []
    for v in values:
        repeated = F.filter(
            F.transform(F.array_distinct(v), lambda x: F.struct(x.alias("v"), F.size(F.filter(v, lambda e: e == x)).alias("m"))),
            lambda s: s["m"] > 1)
        out.append(sketches.where(F.col(v).isNotNull()).select(
            *groups, F.col(v).alias("_edges"), F.map_from_entries(repeated).alias("_hot")))
    # a row carries k edges, so the bound on rows follows from a bound on bytes
    limit = min(BROADCAST_ROWS, BROADCAST_BYTES // (8 * k))
    bounded = sketches.limit(limit + 1).count() <= limit
    return [Edges(e, tuple(groups), depth, bounded) for e in out]


def ordered_values(df: DataFrame, groups: Sequence[str], value: str, sums: Sequence[str] = (),
                   edges: Edges | None = None) -> DataFrame:
    """One row per (groups, distinct value): ``n``, ``cum_n`` and, per column in ``sums``, its sum
    and running sum ``cum_<col>``, all in ascending value order."""
    groups = list(groups)
    edges = edges or value_edges(df, groups, value)[0]
    distinct = (df.where(F.col(value).isNotNull()).groupBy(*groups, value)
                .agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in sums]))
    tiled = edges.tag(distinct, value, "_tile").drop("_hot")
    return running_sums(tiled, groups, value, "_tile", ["n", *sums]).drop("_tile")


def add_average_ranks(df: DataFrame, groups: Sequence[str], outs: dict[str, str]) -> DataFrame:
    """Rank each value column (``outs``: value -> rank column) with ties averaged.

    Rows with a NULL in any of the columns are dropped first. Each column costs one shuffle of the
    rows, by (groups, tile): the rank is the count in the tiles below plus the rank inside the tile.
    A value that fills several tiles is by construction the greatest of its tile, so its rank
    follows from two counts; its rows only pass through, spread over as many salts as tiles.
    """
    groups = list(groups)
    for value in outs:
        df = df.where(F.col(value).isNotNull())
    edges = value_edges(df, groups, *outs)
    rows, names = df, list(outs)
    for i, (value, e) in enumerate(zip(names, edges, strict=True)):
        salts = F.coalesce(F.element_at("_hot", F.col(value)), F.lit(1))
        rows = (e.tag(rows, value, f"_tile{i}")
                .withColumn(f"_salt{i}", F.when(salts > 1, 1 + F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), salts.cast("long")))
                            .otherwise(0).cast("int")).drop("_hot"))
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("axis"), F.col(f"_tile{i}").alias("tile"), (F.col(f"_salt{i}") > 0).alias("hot"))
                                for i in range(len(names))])).alias("_s")
    below = Window.partitionBy(*groups, "axis").orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    counts = (rows.select(*groups, sides).select(*groups, "_s.*").groupBy(*groups, "axis", "tile")
              .agg(F.count_if(~F.col("hot")).alias("_other"), F.count_if("hot").alias("_same")))
    counts = cut(counts.withColumn("_below", F.coalesce(F.sum(F.col("_other") + F.col("_same")).over(below), F.lit(0))))
    small = counts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    for i, value in enumerate(names):
        c = counts.where(F.col("axis") == i).drop("axis").withColumnRenamed("tile", f"_tile{i}")
        inside = Window.partitionBy(*groups, f"_tile{i}", f"_salt{i}").orderBy(value)
        ties = Window.partitionBy(*groups, f"_tile{i}", f"_salt{i}", value)
        local = F.rank().over(inside) + (F.count(F.lit(1)).over(ties) - 1) / 2.0
        rows = keyed_join(rows.withColumn("_local", local), F.broadcast(c) if small else c, [*groups, f"_tile{i}"])
        rank = F.col("_below") + F.when(F.col(f"_salt{i}") > 0, F.col("_other") + (F.col("_same") + 1) / 2.0).otherwise(F.col("_local"))
        rows = rows.withColumn(outs[value], rank).drop("_local", "_other", "_same", "_below", f"_tile{i}", f"_salt{i}")
    return rows


def exact_percentiles(df: DataFrame, groups: Sequence[str], value: str,
                      probs: Sequence[float]) -> DataFrame:
    """Linearly interpolated percentiles as columns ``q0, q1, ...`` in the order of ``probs``."""
    groups = list(groups)
    ov = ordered_values(df, groups, value)
    totals = df.where(F.col(value).isNotNull()).groupBy(*groups).agg(F.count(F.lit(1)).alias("_total"))
    joined = lookup_join(ov, totals, groups, "inner")
    aggs = []
    for i, p in enumerate(probs):
        at = (F.col("_total") - 1) * F.lit(float(p))
        for name, idx in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            aggs.append(F.min(F.when(F.col("cum_n") > idx, F.col(value))).alias(f"_{name}{i}"))
    out = joined.groupBy(*groups, "_total").agg(*aggs)
    cols = []
    for i, p in enumerate(probs):
        at = (F.col("_total") - 1) * F.lit(float(p))
        frac = at - F.floor(at)
        cols.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * frac).alias(f"q{i}"))
    return out.select(*groups, *cols)
