"""Interval consensus, interval joins, coordinate remapping and window placement."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regulus.plans.ordered import exact_percentiles
from regulus.plans.range_join import overlap_join, point_join
from regulus.plans.tiling import (TILE, attach_neighbours, depth_segments, gap_clusters,
                                  running_sums, tile_expr)
from regulus.session import cut, keyed_join, salted_join


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str = "s", end: str = "e") -> DataFrame:
    """Merge overlapping or touching intervals per ``keys``."""
    return depth_segments(df, keys, start, end, 1, touching=True)


def consensus(df: DataFrame, sample: str, contig: str, start: str, end: str, k: int) -> DataFrame:
    """Segments covered by at least ``k`` samples; a sample is merged first so it cannot support itself."""
    merged = merge_intervals(df, [sample, contig], start, end)
    return depth_segments(merged, [contig], "start", "end", k)


def summit_clusters(points: DataFrame, contig: str, pos: str, sample: str, gap: int,
                    min_support: int) -> DataFrame:
    """Clusters of points with neighbour gaps <= ``gap`` and at least ``min_support`` samples.

    Returns contig, cluster, n_points, n_samples and the truncated median position. The median
    comes from cumulative counts, so a cluster as long as a contig is never held in one task.
    """
    per_pos = points.groupBy(contig, pos).agg(F.count(F.lit(1)).alias("n"))
    numbered = gap_clusters(per_pos, [contig], pos, gap).withColumn("_tile", tile_expr(pos, TILE))
    counted = running_sums(numbered, [contig], pos, "_tile", ["n"]).select(contig, pos, "cluster", "n", "cum_n")
    key = [contig, "cluster"]
    size = counted.groupBy(*key).agg(F.sum("n").alias("n_points"), F.min(F.col("cum_n") - F.col("n")).alias("_base"))
    inside = salted_join(counted, size, key)
    at = F.col("cum_n") - F.col("_base")
    median = inside.groupBy(*key, "n_points").agg(
        F.min(F.when(at > F.floor((F.col("n_points") - 1) / 2), F.col(pos))).alias("_lo"),
        F.min(F.when(at > F.ceil((F.col("n_points") - 1) / 2), F.col(pos))).alias("_hi"))
    # positions carry their cluster; samples are made distinct per position before they meet it
    votes = points.select(contig, pos, sample).distinct()
    support = (salted_join(votes, numbered.select(contig, pos, "cluster"), [contig, pos])
               .groupBy(*key).agg(F.count_distinct(sample).alias("n_samples")))
    mid = F.floor((F.col("_lo") + F.col("_hi")) / 2).cast("long")
    return (keyed_join(median, support.where(F.col("n_samples") >= min_support), key)
            .select(contig, "n_points", "n_samples", mid.alias("summit")))


def recentre(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """Fixed-width windows on the integer midpoint; windows before position 0 are dropped."""
    mid = F.expr(f"({start} + {end}) div 2")
    return (df.withColumn("mid", mid).withColumn("win_start", F.col("mid") - width // 2)
            .withColumn("win_end", F.col("mid") + width // 2).where(F.col("win_start") >= 0))


def flag_points(points: DataFrame, intervals: DataFrame, contig: str, pos: str, start: str, end: str,
                out: str) -> DataFrame:
    """Does any interval contain the point? Looked up in the merged union, so no pairs are formed."""
    union = merge_intervals(intervals, [contig], start, end)
    found = attach_neighbours(points, union, [contig], pos, "start", ["end"], sides=["prev"])
    return (found.withColumn(out, F.coalesce(F.col("prev.end") > F.col(pos), F.lit(False)))
            .drop("prev"))


def last_started(points: DataFrame, intervals: DataFrame, contig: str, pos: str, start: str, end: str,
                 payload: Sequence[str]) -> DataFrame:
    """As-of containment: the last interval with start <= pos, kept only if pos < end.

    An earlier, longer interval that also contains the point is not considered.
    """
    found = attach_neighbours(points, intervals, [contig], pos, start, [end, *payload], sides=["prev"])
    inside = F.col(f"prev.{end}") > F.col(pos)
    cols = [F.when(inside, F.col("prev.at")).alias("hit_start"), F.when(inside, F.col(f"prev.{end}")).alias("hit_end"),
            *[F.when(inside, F.col(f"prev.{p}")).alias(p) for p in payload]]
    return found.select(*points.columns, *cols)


def nearest(points: DataFrame, table: DataFrame, contig: str, pos: str, tpos: str) -> DataFrame:
    """Nearest table position and its distance; at equal distance the lower position wins."""
    found = attach_neighbours(points, table, [contig], pos, tpos)
    left, right = F.col(pos) - F.col("prev.at"), F.col("next.at") - F.col(pos)
    lower = right.isNull() | (left <= right)
    return (found.withColumn("nearest", F.when(lower, F.col("prev.at")).otherwise(F.col("next.at")))
            .withColumn("distance", F.abs(F.col("nearest") - F.col(pos))).drop("prev", "next"))


def count_overlaps(loci: DataFrame, intervals: DataFrame, contig: str, lspan: tuple[str, str],
                   ispan: tuple[str, str], out: str) -> DataFrame:
    """Intervals overlapping each locus, as (starts before its end) - (ends at or before its start)."""
    return count_overlaps_of(loci, intervals, contig, {out: lspan}, ispan)


def count_overlaps_of(loci: DataFrame, intervals: DataFrame, contig: str, spans: Mapping[str, tuple[str, str]],
                      ispan: tuple[str, str]) -> DataFrame:
    """``count_overlaps`` for several spans of a locus at once: one count column per name in ``spans``.

    Starts, ends and all asked positions go through one running count, and the counts come back in one join: the
    intervals are read once, and the work does not grow with the number of overlaps.
    """
    edges = F.explode(F.array(*[F.struct(F.col(c).cast("long").alias("_at"), F.lit(b).cast("long").alias("b"), F.lit(e).cast("long").alias("e"))
                                for c, b, e in ((ispan[0], 1, 0), (ispan[1], 0, 1))])).alias("_e")
    steps = intervals.where(F.col(ispan[0]) < F.col(ispan[1])).select(contig, edges).select(contig, "_e.*")
    numbered = cut(loci.withColumn("_row", F.monotonically_increasing_id()))
    # what has begun before the end counts, what has ended up to the start is taken off again
    ends = F.explode(F.array(*[F.struct(F.lit(name).alias("out"), at.cast("long").alias("_at"), F.lit(side).alias("side"))
                               for name, (ls, le) in spans.items() for at, side in ((F.col(le) - 1, "b"), (F.col(ls), "e"))])).alias("_q")
    asked = numbered.select("_row", contig, ends).select("_row", contig, "_q.*").where("_at is not null")
    zero = F.lit(0).cast("long")
    both = (steps.withColumn("ask", F.lit(0)).unionByName(asked.select(contig, "_at", zero.alias("b"), zero.alias("e"), F.lit(1).alias("ask")))
            .where("_at is not null").groupBy(contig, "_at").agg(F.sum("b").alias("b"), F.sum("e").alias("e"), F.max("ask").alias("ask"))
            .withColumn("_tile", tile_expr("_at")))
    run = cut(running_sums(both, [contig], "_at", "_tile", ["b", "e"]).where("ask = 1").select(contig, "_at", "cum_b", "cum_e"))
    met = salted_join(asked, run, [contig, "_at"])
    gain = F.when(F.col("side") == "b", F.col("cum_b")).otherwise(-F.col("cum_e"))
    per = met.groupBy("_row").agg(*[F.sum(F.when(F.col("out") == name, gain)).alias(f"_c_{i}") for i, name in enumerate(spans)])
    counts = [F.coalesce(f"_c_{i}", zero).cast("long").alias(name) for i, name in enumerate(spans)]
    return numbered.join(per, "_row", "left").select(*[f"`{c}`" for c in loci.columns], *counts)


def distance_to(pos: Column, start: Column, end: Column) -> Column:
    """Distance of a point to an interval body; 0 inside."""
    return F.greatest(start - pos, pos - end, F.lit(0).cast("long"))


def locus_class(points: DataFrame, loci: DataFrame, contig: str, pos: str, span: tuple[str, str],
                flank: int, proximal: int, width: int = 8192) -> DataFrame:
    """Points within ``flank`` of a locus, their distance to its body and proximal/distal class."""
    widened = (loci.withColumn("_fs", F.greatest(F.col(span[0]) - flank, F.lit(0).cast("long")))
               .withColumn("_fe", F.col(span[1]) + flank + 1))
    hits = point_join(points, widened, [contig], pos, ("_fs", "_fe"), width).drop("_fs", "_fe")
    d = distance_to(F.col(pos), F.col(span[0]), F.col(span[1]))
    return hits.withColumn("distance", d).withColumn(
        "locus_class", F.when(F.col("distance") <= proximal, "proximal").otherwise("distal"))


def remap(points: DataFrame, blocks: DataFrame, ident: str, contig: str, pos: str,
          width: int = 16_384) -> DataFrame:
    """Map points through (src_contig, src_start, src_end, dst_contig, dst_start, strand, block_id).

    The first hit alone counts: the block with the lowest ``block_id`` (or the highest ``score`` before
    that, where the block table has one). If it lies on another contig the point gets NULL, as do points
    without a hit.
    """
    named = blocks.withColumnRenamed("src_contig", contig)
    hits = point_join(points.select(ident, contig, pos), named, [contig], pos, ("src_start", "src_end"), width)
    offset = F.col(pos) - F.col("src_start")
    span = F.col("src_end") - F.col("src_start")
    moved = F.when(F.col("strand") == "-", F.col("dst_start") + span - 1 - offset).otherwise(F.col("dst_start") + offset)
    rank = -F.col("score") if "score" in blocks.columns else F.lit(0)
    home = F.col("dst_contig") == F.col(contig)
    best = (hits.withColumn("_to", F.when(home, moved)).withColumn("_by", F.when(home, F.col("block_id")))
            .groupBy(ident).agg(F.min(F.struct(rank.alias("r"), F.col("block_id"), F.col("_to"), F.col("_by"))).alias("_b"))
            .select(ident, F.col("_b._to").alias("mapped"), F.col("_b._by").alias("block_id")))
    return points.join(best, ident, "left")


def drop_collisions(mapped: DataFrame, contig: str, pos: str) -> DataFrame:
    """Remove every row whose target coordinate is shared with another row."""
    lone = mapped.where(F.col(pos).isNotNull()).groupBy(contig, pos).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1")
    return mapped.join(lone.drop("_n"), [contig, pos], "left_semi")


def interval_hits(loci: DataFrame, intervals: DataFrame, contig: str, lspan: tuple[str, str],
                  ispan: tuple[str, str], width: int = 8192) -> DataFrame:
    """One row per overlapping (interval, locus) pair."""
    return overlap_join(intervals, loci, [contig], ispan, lspan, width)


def centred_window_reason(df: DataFrame, center: str, size: str, length: int) -> DataFrame:
    """Never clip: a window that does not fit is returned with the first reason it fails."""
    start = F.col(center) - length // 2
    end = start + length
    return (df.withColumn("win_start", start).withColumn("win_end", end)
            .withColumn("reason", F.when(F.col(center).isNull(), "no annotation")
                        .when(F.col(size).isNull(), "contig unknown").when(start < 0, "before start")
                        .when(end > F.col(size), "past end").otherwise("valid")))


def bin_ranges(placed: DataFrame, center: str, half: int, off: int, bin_size: int, n_bins: int) -> DataFrame:
    """Bin range [bin0, bin1) of each placed region, its mirror on the reverse strand, and validity."""
    lo = F.col(center) - half - F.col("wstart") - off
    hi = F.col(center) + half - F.col("wstart") - off
    out = (placed.withColumn("bin0", F.floor(lo / bin_size)).withColumn("bin1", F.ceil(hi / bin_size))
           .withColumn("rc_bin0", n_bins - F.col("bin1")).withColumn("rc_bin1", n_bins - F.col("bin0")))
    return out.withColumn("valid", (F.col("bin0") >= 0) & (F.col("bin1") <= n_bins) & (F.col("bin1") > F.col("bin0")))



def span_integrity(points: DataFrame, blocks: DataFrame, ident: str, contig: str, pos: str, length: int, tolerance: int) -> DataFrame:
    """One row: regions of ``length`` bases from ``pos``, those whose first and last base both map, and those whose
    mapped ends stay ``length`` - 1 apart within ``tolerance``, on either strand. ``ident`` is unique; NULL contigs map nowhere."""
    side = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), (F.col(pos) + d).alias("p")) for i, d in enumerate((0, length - 1))]))
    ends = points.select(ident, contig, side.alias("_x")).select(F.struct(ident, "_x.side").alias("_k"), contig, F.col("_x.p").alias(pos))
    mapped = remap(ends, blocks, "_k", contig, pos)
    first, last = (F.max(F.when(F.col("_k.side") == i, F.col("mapped"))).alias(n) for i, n in enumerate(("_a", "_b")))
    gap = F.abs(F.col("_b") - F.col("_a"))
    return mapped.groupBy(f"_k.{ident}").agg(first, last).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(gap.isNotNull()).alias("both_mapped"), F.count_if(F.abs(gap - (length - 1)) <= tolerance).alias("span_kept"))


def distance_summary(near: DataFrame, keys: Sequence[str], distance: str, limit: float) -> DataFrame:
    """Per ``keys``: rows, those within ``limit``, their share and the median distance (rows without a neighbour count in n only)."""
    g = near.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(distance) <= limit).alias("n_within"))
    q = exact_percentiles(near, keys, distance, [0.5])
    return keyed_join(g, q, keys, "left").select(*keys, "n", "n_within", (F.col("n_within") / F.col("n")).alias("share_within"), F.col("q0").alias("median_distance"))


def promoter(start: Column, end: Column, forward: Column, upstream: int, downstream: int) -> Column:
    """(tss, prom_start, prom_end) of a gene by its strand: the window reaches ``upstream`` before and ``downstream`` behind
    the transcription start; NULL where the strand is not known."""
    known = F.when(forward, F.struct(start.alias("tss"), (start - upstream).alias("prom_start"), (start + downstream).alias("prom_end")))
    return known.when(~forward, F.struct(end.alias("tss"), (end - downstream).alias("prom_start"), (end + upstream).alias("prom_end")))
