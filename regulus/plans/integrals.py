"""Running integrals of step functions along a line, read at single points.

A track of (start, end, value) runs is a sum of steps: +value at each start, -value at each end. Its integral up to x
is the sum over the steps before x of step * (x - where). Steps are collapsed to one row per position and cut into
tiles; within a tile the sums are taken relative to the tile's first position, and what a tile needs to know of the
tiles before it (slope and integral at its first position) is one row a tile. Values are held as whole multiples of
10^-scale, so sums are exact, in any order, and a difference of two large integrals loses nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regulus.plans.tiling import TILE, tile_expr
from regulus.session import cut, lookup_join

_EXACT = "decimal(38,0)"


def integrals_at(steps: DataFrame, asked: DataFrame, keys: Sequence[str], cols: Sequence[str], width: int = TILE) -> DataFrame:
    """(keys, pos, int_<col>...) for every distinct (keys, pos) of ``asked``: integrals up to pos of the step functions
    whose changes are the whole numbers ``cols`` at ``pos`` of ``steps``. NULL keys are keys of their own."""
    keys = list(keys)
    both = (steps.select(*keys, "pos", *cols, F.lit(0).alias("_ask"))
            .unionByName(asked.select(*keys, "pos", *[F.lit(0).cast("long").alias(c) for c in cols], F.lit(1).alias("_ask")))
            .where(F.col("pos").isNotNull()))
    rows = cut(both.groupBy(*keys, "pos").agg(*[F.sum(c).alias(c) for c in cols], F.max("_ask").alias("_ask"))
               .withColumn("_tile", tile_expr("pos", width)).withColumn("_rel", F.col("pos") - F.col("_tile") * width))
    inside = Window.partitionBy(*keys, "_tile").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("_tile").cast(_EXACT) * F.lit(width).cast("decimal(10,0)")
    tiles = rows.groupBy(*keys, "_tile").agg(*[x for c in cols for x in (
        F.sum(c).cast("decimal(19,0)").alias(f"_s_{c}"), F.sum(F.col(c) * F.col("_rel")).cast(_EXACT).alias(f"_m_{c}"))])
    # moments about 0 of all steps of earlier tiles give the integral at this tile's first position
    carry = tiles.select(*keys, "_tile", *[x for c in cols for x in (
        F.sum(f"_s_{c}").over(before).cast("decimal(19,0)").alias(f"_slope_{c}"),
        F.sum((F.col(f"_s_{c}") * first + F.col(f"_m_{c}")).cast(_EXACT)).over(before).cast(_EXACT).alias(f"_moment_{c}"))])
    carry = carry.select(*keys, "_tile", *[x for c in cols for x in (
        F.col(f"_slope_{c}"), ((F.col(f"_slope_{c}") * first).cast(_EXACT) - F.col(f"_moment_{c}")).cast(_EXACT).alias(f"_first_{c}"))])
    sums = [x for c in cols for x in (F.sum(c).over(inside).alias(f"_in_{c}"), F.sum(F.col(c) * F.col("_rel")).over(inside).alias(f"_mo_{c}"))]
    read = lookup_join(rows.select("*", *sums).where("_ask = 1"), carry, [*keys, "_tile"])

    zero = F.lit(0).cast(_EXACT)

    def integral(c: str) -> Column:
        slope = F.coalesce(f"_slope_{c}", F.lit(0).cast("decimal(19,0)"))
        # from the tile's first position on; long numbers do where the slope leaves room for the width
        long = F.abs(slope) < (1 << 62) // width
        past = F.when(long, (slope.cast("long") * F.col("_rel")).cast(_EXACT)).otherwise((slope * F.col("_rel").cast(_EXACT)).cast(_EXACT))
        own = F.col(f"_in_{c}") * F.col("_rel") - F.col(f"_mo_{c}")
        return (F.coalesce(f"_first_{c}", zero) + past + own.cast(_EXACT)).cast(_EXACT).alias(f"int_{c}")

    return read.select(*keys, "pos", *[integral(c) for c in cols])
