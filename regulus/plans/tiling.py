"""Ordered scans over position that never put a whole contig into one task.

Rows are first collapsed to one row per (keys, position), then cut into tiles of fixed width.
A tile therefore holds at most ``width`` rows whatever the skew. What a tile must know about the
tiles before (or after) it is a one-row summary per tile, scanned in a second small window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regulus.session import salted_join

TILE = 65_536


def tile_expr(pos: str, width: int = TILE) -> Column:
    """Exact floor division for 64-bit positions, negative ones included."""
    return F.expr(f"({pos} - pmod({pos}, {width}L)) div {width}L")


def running_sums(df: DataFrame, keys: Sequence[str], order: str, tile: str,
                 cols: Sequence[str]) -> DataFrame:
    """Add inclusive running sums ``cum_<col>`` per ``keys`` in ``order``.

    ``tile`` must be monotone in ``order`` and (keys, order) unique. The per-key window sees one
    row per tile; the row-level window is partitioned by (keys, tile). What a tile carries over from
    the tiles before it is an extra first row of the tile, so nothing is joined and NULL keys stay.
    """
    keys = list(keys)
    before = Window.partitionBy(*keys).orderBy(tile).rowsBetween(Window.unboundedPreceding, -1)
    inside = (Window.partitionBy(*keys, tile).orderBy("_lead", order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    carry = (df.groupBy(*keys, tile).agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
             .select(*keys, tile, F.lit(0).alias("_lead"),
                     *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_v_{c}") for c in cols]))
    rows = df.select("*", F.lit(1).alias("_lead"), *[F.col(c).alias(f"_v_{c}") for c in cols])
    out = rows.unionByName(carry, allowMissingColumns=True)
    for c in cols:
        out = out.withColumn(f"cum_{c}", F.sum(f"_v_{c}").over(inside))
    return out.where("_lead = 1").drop("_lead", *[f"_v_{c}" for c in cols])


def neighbours(points: DataFrame, table: DataFrame, keys: Sequence[str], pos: str, tpos: str,
               payload: Sequence[str] = (), width: int = TILE,
               sides: Sequence[str] = ("prev", "next")) -> DataFrame:
    """Per distinct (keys, pos) of ``points``: ``prev`` = last table row with tpos <= pos and
    ``next`` = first table row with tpos >= pos, each a struct (tpos, payload...) or NULL.

    Among table rows with one tpos, ``prev`` takes the greatest payload and ``next`` the least.
    """
    keys = list(keys)
    hit = F.struct(F.col(tpos).alias("at"), *[F.col(c) for c in payload])
    asked = points.select(*keys, F.col(pos).alias("_pos")).where(F.col("_pos").isNotNull())
    known = table.select(*keys, F.col(tpos).alias("_pos"), hit.alias("_hit"))
    rows = asked.withColumn("_ask", F.lit(1)).unionByName(known.withColumn("_ask", F.lit(0)), allowMissingColumns=True)
    # the struct starts with the position, so the running extreme is the row seen last; the forward
    # side runs in descending order because frames that end at "unbounded following" are quadratic
    pick = {"prev": (F.max, lambda c: F.col(c)), "next": (F.min, lambda c: F.col(c).desc())}
    rows = (rows.groupBy(*keys, "_pos").agg(F.max("_ask").alias("_ask"), *[pick[s][0]("_hit").alias(f"_{s}") for s in sides])
            .withColumn("_tile", tile_expr("_pos", width)))
    earlier = (Window.unboundedPreceding, -1)
    so_far = (Window.unboundedPreceding, Window.currentRow)
    carry = rows.groupBy(*keys, "_tile").agg(*[pick[s][0](f"_{s}").alias(f"_t_{s}") for s in sides])
    for s in sides:
        best, order = pick[s]
        carry = carry.withColumn(f"_{s}", best(f"_t_{s}").over(Window.partitionBy(*keys).orderBy(order("_tile")).rowsBetween(*earlier)))
    # what a tile carries over stands before its rows on either side
    carry = carry.select(*keys, "_tile", F.lit(0).alias("_lead"), *[f"_{s}" for s in sides])
    out = rows.withColumn("_lead", F.lit(1)).unionByName(carry, allowMissingColumns=True)
    for s in sides:
        best, order = pick[s]
        inside = Window.partitionBy(*keys, "_tile").orderBy("_lead", order("_pos")).rowsBetween(*so_far)
        out = out.withColumn(s, best(f"_{s}").over(inside))
    return out.where(F.col("_ask") == 1).select(*keys, F.col("_pos").alias(pos), *sides)


def attach_neighbours(points: DataFrame, table: DataFrame, keys: Sequence[str], pos: str,
                      tpos: str, payload: Sequence[str] = (), width: int = TILE,
                      sides: Sequence[str] = ("prev", "next")) -> DataFrame:
    """``neighbours`` joined back to every row of ``points``; piled-up positions are salted."""
    found = neighbours(points, table, keys, pos, tpos, payload, width, sides)
    return salted_join(points, found, [*keys, pos], "left")


def depth_segments(intervals: DataFrame, keys: Sequence[str], start: str, end: str, k: int = 1,
                   touching: bool = False, width: int = TILE) -> DataFrame:
    """Maximal segments of ``keys`` covered by at least ``k`` half-open intervals.

    ``touching=False`` closes before it opens at one position, so segments that only meet stay
    apart; ``touching=True`` opens first, so they merge. Returns keys + (seg, start, end).
    """
    keys = list(keys)
    ends = F.explode(F.array(
        F.struct(F.col(start).cast("long").alias("pos"), F.lit(1).cast("long").alias("up"),
                 F.lit(0).cast("long").alias("down")),
        F.struct(F.col(end).cast("long").alias("pos"), F.lit(0).cast("long").alias("up"),
                 F.lit(1).cast("long").alias("down")))).alias("_e")
    edges = (intervals.where(F.col(start) < F.col(end)).select(*keys, ends)
             .select(*keys, "_e.*").groupBy(*keys, "pos")
             .agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
             .withColumn("net", F.col("up") - F.col("down"))
             .withColumn("_tile", tile_expr("pos", width)))
    after = F.col("cum_net")
    before = after - F.col("net")
    mid = before + F.col("up") if touching else before - F.col("down")
    opens = (before < k) & (mid >= k) if touching else (mid < k) & (after >= k)
    closes = (mid >= k) & (after < k) if touching else (before >= k) & (mid < k)
    flagged = (running_sums(edges, keys, "pos", "_tile", ["net"])
               .withColumn("opens", opens.cast("long")).withColumn("closes", closes.cast("long"))
               .where((F.col("opens") + F.col("closes")) > 0)
               .select(*keys, "pos", "_tile", "opens", "closes"))
    counted = running_sums(flagged, keys, "pos", "_tile", ["opens", "closes"])
    side = F.explode(F.array(
        F.when(F.col("opens") == 1, F.struct(F.col("cum_opens").alias("seg"), F.col("pos").alias("start"),
                                             F.lit(None).cast("long").alias("end"))),
        F.when(F.col("closes") == 1, F.struct(F.col("cum_closes").alias("seg"),
                                              F.lit(None).cast("long").alias("start"),
                                              F.col("pos").alias("end"))))).alias("_s")
    return (counted.select(*keys, side).where("_s is not null").select(*keys, "_s.*")
            .groupBy(*keys, "seg").agg(F.max("start").alias("start"), F.max("end").alias("end")))


def gap_clusters(positions: DataFrame, keys: Sequence[str], pos: str, gap: int,
                 width: int = TILE) -> DataFrame:
    """Number runs of distinct positions whose neighbours are at most ``gap`` apart.

    ``positions`` is unique per (keys, pos). Adds ``cluster`` (1, 2, ... per keys).
    """
    keys = list(keys)
    tiled = positions.withColumn("_tile", tile_expr(pos, width))
    by_tile = Window.partitionBy(*keys).orderBy("_tile")
    carry = (tiled.groupBy(*keys, "_tile").agg(F.max(pos).alias("_m"))
             .select(*keys, "_tile", F.lit(0).alias("_lead"), F.lag("_m").over(by_tile).alias("_at")))
    inside = Window.partitionBy(*keys, "_tile").orderBy("_lead", "_at")
    prev = F.lag("_at").over(inside)
    flagged = (tiled.select("*", F.lit(1).alias("_lead"), F.col(pos).alias("_at")).unionByName(carry, allowMissingColumns=True)
               .withColumn("_new", F.when(prev.isNull() | (F.col("_at") - prev > gap), 1).otherwise(0).cast("long"))
               .where("_lead = 1").drop("_lead", "_at"))
    return (running_sums(flagged, keys, pos, "_tile", ["_new"])
            .withColumnRenamed("cum__new", "cluster").drop("_new", "_tile"))
