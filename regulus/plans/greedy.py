"""Greedy selection along a line ("keep the first, then the next at least ``step`` further").

The choice looks sequential, but what a stretch does depends on the past only through its first kept position. So
each tile reports, for every position it may be entered at, where it would leave. Such maps compose: the maps of up
to ``FAN`` neighbouring nodes give the map of their parent, and so on to the one root of a line. Then the true
entries go down again, parent by parent, and each tile walks from its own. Every group holds the maps of ``FAN``
nodes, at most ``step`` + 1 entries each (a sixteenth of a tile), whatever a line's length; the number of
rounds is the logarithm of the number of tiles to the base ``FAN``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regulus.plans.tiling import TILE, attach_neighbours, tile_expr
from regulus.session import cut, keyed_join, lookup_join

FAN = 32


def _tile_exits(a: np.ndarray, start: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Entry positions of a tile that begins at ``start`` (sorted positions ``a``), and the last position kept from each."""
    after = np.searchsorted(a, a + step)
    leave = a.copy()
    for i in range(len(a) - 1, -1, -1):
        if after[i] < len(a):
            leave[i] = leave[after[i]]
    first = int(np.searchsorted(a, start + step)) + 1
    return a[:first], leave[:first]


def _compose(node: np.ndarray, entry: np.ndarray, leave: np.ndarray, start: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """The map of a parent that begins at ``start`` from the maps of its children, sorted by (node, entry)."""
    edge = np.append(np.unique(node, return_index=True)[1], len(node))
    first = min(int(np.searchsorted(entry, start + step)) + 1, len(entry))
    last = leave[:first].copy()
    for lo, hi in zip(edge[1:-1], edge[2:]):
        # entries of earlier children go on at the first position far enough, if this child has one
        n = min(lo, first)
        at = lo + np.searchsorted(entry[lo:hi], last[:n] + step)
        into = at < hi
        last[:n][into] = leave[at[into]]
    return entry[:first], last


def _descend(node: np.ndarray, entry: np.ndarray, leave: np.ndarray, start: int, step: int) -> list[tuple[int, int]]:
    """(child, its true entry) of a parent entered at ``start``; children that nothing is kept in are left out."""
    edge = np.append(np.unique(node, return_index=True)[1], len(node))
    out, least = [], start
    for lo, hi in zip(edge[:-1], edge[1:]):
        at = lo + int(np.searchsorted(entry[lo:hi], least))
        if at < hi:
            out.append((int(node[lo]), int(entry[at])))
            least = int(leave[at]) + step
    return out


def greedy_positions(points: DataFrame, keys: Sequence[str], pos: str, step: int,
                     width: int = TILE, fan: int = FAN) -> DataFrame:
    """Kept positions per ``keys`` for a minimum spacing of ``step``. NULL keys are a line of their own."""
    keys = list(keys)
    width = max(width, 16 * step)
    distinct = cut(points.where(F.col(pos).isNotNull()).groupBy(*keys, F.col(pos).cast("long").alias("_pos"))
                   .agg(F.lit(1).alias("_one")).drop("_one").withColumn("_tile", tile_expr("_pos", width)))
    least, most = distinct.agg(F.min("_tile"), F.max("_tile")).first()
    base = least or 0
    distinct = distinct.withColumn("_node", F.col("_tile") - F.lit(base)).drop("_tile")
    key_ddl = "".join(f"{k} {distinct.schema[k].dataType.simpleString()}, " for k in keys)

    def framed(pdf: pd.DataFrame, **cols) -> pd.DataFrame:
        out = pd.DataFrame(cols)
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, *cols]]

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        node = int(pdf["_node"].iloc[0])
        entry, leave = _tile_exits(np.sort(pdf["_pos"].to_numpy()), (node + base) * width, step)
        return framed(pdf, _node=np.full(len(entry), node), entry=entry, leave=leave)

    def composed(size: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["_node", "entry"], ignore_index=True)
            parent = int(pdf["_node"].iloc[0]) // fan
            entry, leave = _compose(*(pdf[c].to_numpy() for c in ("_node", "entry", "leave")), (parent * fan * size + base) * width, step)
            return framed(pdf, _node=np.full(len(entry), parent), entry=entry, leave=leave)
        return run

    def descended(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_node", "entry"], ignore_index=True)
        found = _descend(*(pdf[c].to_numpy() for c in ("_node", "entry", "leave")), int(pdf["_from"].iloc[0]), step)
        return framed(pdf, _node=[n for n, _ in found], entry=[e for _, e in found])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.sort(pdf["_pos"].to_numpy())
        kept, i = [], int(np.searchsorted(a, pdf["entry"].iloc[0]))
        while i < len(a):
            kept.append(a[i])
            i = int(np.searchsorted(a, a[i] + step))
        return framed(pdf, **{pos: np.array(kept, dtype="int64")})

    ddl = f"{key_ddl}_node long, entry long"
    parent = F.floor(F.col("_node") / fan)
    levels = [cut(distinct.groupBy(*keys, "_node").applyInPandas(exits, f"{ddl}, leave long"))]
    nodes, size = (most or 0) - base + 1, 1
    while nodes > 1:
        levels.append(cut(levels[-1].groupBy(*keys, parent.alias("_up")).applyInPandas(composed(size), f"{ddl}, leave long")))
        nodes, size = -(-nodes // fan), size * fan
    # the root of every line is entered at its least position
    entries = levels[-1].groupBy(*keys, "_node").agg(F.min("entry").alias("entry"))
    for below in reversed(levels[:-1]):
        known = entries.withColumnsRenamed({"_node": "_up", "entry": "_from"})
        entries = cut(keyed_join(below.withColumn("_up", parent), known, [*keys, "_up"])
                      .groupBy(*keys, "_up").applyInPandas(descended, ddl))
    return (keyed_join(distinct, entries, [*keys, "_node"]).groupBy(*keys, "_node")
            .applyInPandas(walk, f"{key_ddl}{pos} long"))


def cover_points(points: DataFrame, keys: Sequence[str], pos: str, span: int) -> DataFrame:
    """Fewest windows ``[first, first + span)`` that cover all points, opened left to right."""
    return greedy_positions(points, keys, pos, span).withColumnRenamed(pos, "window_start")


def cover_regions(regions: DataFrame, sizes: DataFrame, half: int, span: int,
                  length: int) -> DataFrame:
    """Assign fixed-width regions (contig, center) to clamped windows of ``length``.

    Only the central ``span`` of a window is usable. Adds ``wstart`` (NULL when no window inside
    the contig can hold the region) and the reason ``placed``/``unplaceable``/``no_contig``.
    """
    off = (length - span) // 2
    limit = F.greatest(F.col("size") - off, F.lit(off + span))
    left_out = F.col("center") - half < off
    flagged = (lookup_join(regions, sizes, ["contig"])
               .withColumn("_left", left_out)
               .withColumn("status", F.when(F.col("size").isNull(), "no_contig")
                           .when(left_out | (F.col("center") + half > limit), "unplaceable")
                           .otherwise("placed")))
    # a region lost at the left edge still opens the window at 0 before any other
    opens_zero = (flagged.where("_left and size is not null").select("contig").distinct()
                  .withColumn("_zero", F.lit(True)))
    flagged = (lookup_join(flagged, opens_zero, ["contig"])
               .withColumn("_in_zero", F.coalesce("_zero", F.lit(False)) & (F.col("status") == "placed")
                           & (F.col("center") + half <= off + span)))
    rest = flagged.where("status = 'placed' and not _in_zero")
    heads = greedy_positions(rest.select("contig", "center"), ["contig"], "center", span - 2 * half + 1)
    found = attach_neighbours(rest, heads.withColumnRenamed("center", "head"), ["contig"], "center", "head", sides=["prev"])
    wstart = F.greatest(F.lit(0).cast("long"), F.least(F.col("prev.at") - half - off, F.col("size") - length))
    placed = found.withColumn("wstart", wstart).drop("prev")
    others = (flagged.where("status <> 'placed' or _in_zero")
              .withColumn("wstart", F.when(F.col("_in_zero"), F.lit(0).cast("long"))))
    return placed.unionByName(others).drop("_left", "_zero", "_in_zero")
