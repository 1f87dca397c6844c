"""Binned range joins: an equi-join on (keys, bin) with a residual range predicate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regulus.session import HOT_ROWS, split_hot


def bins_of(start: str, end: str, width: int) -> Column:
    """Bins touched by the half-open ``[start, end)``."""
    return F.explode(F.sequence(F.expr(f"{start} div {width}L"), F.expr(f"({end} - 1) div {width}L")))


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], lspan: tuple[str, str],
                 rspan: tuple[str, str], width: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Pairs of overlapping half-open intervals on the same keys.

    A pair meets in every bin both sides touch; it is kept only in the bin of the later start, so
    nothing needs to be made distinct afterwards. ``left`` is the large side: its crowded bins are
    split over salts. Column names of the two sides must differ outside ``keys``.
    """
    (ls, le), (rs, re) = lspan, rspan
    left = left.where(F.col(ls) < F.col(le)).withColumn("_bin", bins_of(ls, le, width))
    right = right.where(F.col(rs) < F.col(re)).withColumn("_bin", bins_of(rs, re, width))
    left, right, on = split_hot(left, right, [*keys, "_bin"], hot_rows)
    out = (left.join(right, on)
           .where((F.col(ls) < F.col(re)) & (F.col(le) > F.col(rs))
                  & (F.col("_bin") == F.expr(f"greatest({ls}, {rs}) div {width}L"))))
    return out.drop("_bin", "_salt")


def point_join(points: DataFrame, right: DataFrame, keys: Sequence[str], pos: str,
               rspan: tuple[str, str], width: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Pairs of a point and an interval with ``start <= pos < end``."""
    rs, re = rspan
    points = points.withColumn("_bin", F.expr(f"{pos} div {width}L"))
    right = right.where(F.col(rs) < F.col(re)).withColumn("_bin", bins_of(rs, re, width))
    points, right, on = split_hot(points, right, [*keys, "_bin"], hot_rows)
    out = points.join(right, on).where((F.col(pos) >= F.col(rs)) & (F.col(pos) < F.col(re)))
    return out.drop("_bin", "_salt")
