"""Mixing sources to target weights along a time-varying curriculum, with built-in functions only.

Sources in code-point order (NULL last) have repeating weights and share all tokens by weight; a target
stops at ``cap`` times its source's size and the excess is shared again among the others. Within a source,
documents stand in hash order and are laid end to end as often as the target asks for. The weight of a
source over the training time t in [0, 1] is a line from its first to its last weight; its integral is the
source's token demand, and inverting that integral at a copy's first token gives the copy's position.
Sorting all copies by position yields the curriculum.

No task holds a source: it is cut into hash tiles of about ``TILE_ROWS`` rows, and only sums per tile meet.
A whole document is taken or not; the last one is taken if at least half of it still fits, so a source's
taken words differ from its target by at most half of one document. Empty and NULL texts have size 0 and are
never taken. Equal rows are told apart by nothing, which of them is taken does not matter. An empty table
gives an empty result. Columns of ``docs`` keep their values; helper columns start with ``_mix``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regulus.llm.textops import unused
from regulus.session import lookup_join

WEIGHTS = (5, 2, 1)
CAP = 3
TILE_ROWS = 2000
# First and last relative weight of the schedule of each weight class: heavy sources early, light ones late.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def n_words(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def _pick(values: Sequence[float], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """One row per source key: rank, size, rows and target, from (``_mix_src``, ``_mix_size``) rows.

    With sources ordered by cap / weight, the capped ones come first: a source is capped while its cap is
    below its share of what the capped ones before it leave. The windows run over one row per source.
    """
    per = sizes.groupBy("_mix_src").agg(F.sum("_mix_size").alias("_mix_total"), F.count(F.lit(1)).alias("_mix_rows"))
    by_name = Window.orderBy("_mix_src")
    per = per.withColumn("_mix_rank", F.row_number().over(by_name) - 1)
    per = (per.withColumn("_w", _pick([float(w) for w in weights], F.col("_mix_rank")))
           .withColumn("_cap", F.col("_mix_total") * F.lit(float(cap))))
    full = Window.orderBy(F.col("_cap") / F.col("_w"), "_mix_src")
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    left = F.sum("_mix_total").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    weight_left = F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    per = per.withColumn("_share", left / weight_left)
    capped = F.col("_cap") < F.col("_share") * F.col("_w")
    per = per.withColumn("_level", F.max(F.when(~capped, F.struct(-F.col("_cap") / F.col("_w"), -F.col("_mix_rank"),
                                                                  F.col("_share").alias("v")))).over(whole)["v"])
    return per.select("_mix_src", "_mix_rank", "_mix_rows", "_mix_total", F.when(
        capped, F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_level") * F.col("_w"))).alias("_mix_target"))


def _position(u: Column, rank: Column, schedules: Sequence[tuple[float, float]]) -> Column:
    """The time at which a source with a linear schedule has handed out the share ``u`` of its tokens."""
    a, b = _pick([s[0] for s in schedules], rank), _pick([s[1] for s in schedules], rank)
    slope, area = b - a, (a + b) / 2
    return F.when(F.abs(slope) < 1e-9, u).otherwise((F.sqrt(F.greatest(
        a * a + 2 * slope * area * u, F.lit(0.0))) - a) / slope)


def plan(docs: DataFrame, size: Column, key: str = "doc_id", source: str = "source",
         weights: Sequence[float] = WEIGHTS, cap: float = CAP, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Every row of ``docs`` with ``_mix_size``, ``_mix_total`` (of its source), ``_mix_target``, ``_mix_copies``
    (how often it is taken) and ``_mix_start`` (its first token within one pass of the source)."""
    rows = docs.select("*", size.alias("_mix_size"),
                       F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source))).alias("_mix_src"))
    rows = rows.withColumn("_mix_hash", F.xxhash64(F.lit("mix"), F.col(key), F.col("_mix_size")))
    src = targets(rows, weights, cap)
    # top bits of the hash: 2^bits tiles, each of about tile_rows rows
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("_mix_rows") / F.lit(tile_rows)))).cast("int")
    rows = lookup_join(rows, src.withColumn("_mix_bits", bits), ["_mix_src"])
    tile = F.when(F.col("_mix_bits") == 0, F.lit(0).cast("long")).otherwise(
        F.expr("shiftrightunsigned(_mix_hash, 64 - _mix_bits)"))
    rows = rows.withColumn("_mix_tile", tile)
    sums = rows.groupBy("_mix_src", "_mix_tile").agg(F.sum("_mix_size").alias("_mix_sum"))
    along = Window.partitionBy("_mix_src").orderBy("_mix_tile").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("_mix_src", "_mix_tile", F.coalesce(F.sum("_mix_sum").over(along), F.lit(0)).alias("_mix_base"))
    rows = lookup_join(rows, base, ["_mix_src", "_mix_tile"])
    unsigned = F.col("_mix_hash").bitwiseXOR(F.lit(-(1 << 63)))
    within = (Window.partitionBy("_mix_src", "_mix_tile").orderBy(unsigned, key, "_mix_size")
              .rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_mix_start", F.col("_mix_base") + F.coalesce(F.sum("_mix_size").over(within), F.lit(0)))
    passes = F.when(F.col("_mix_total") == 0, F.lit(0.0)).otherwise(F.floor(F.col("_mix_target") / F.col("_mix_total")))
    rest = F.col("_mix_target") - passes * F.col("_mix_total")
    extra = F.when(F.col("_mix_start") + F.col("_mix_size") / 2 <= rest, 1).otherwise(0)
    copies = F.when(F.col("_mix_size") == 0, F.lit(0)).otherwise(F.least(passes + extra, F.lit(float(cap)))).cast("int")
    return rows.withColumn("_mix_copies", copies)


def position(copy: Column, schedules: Sequence[tuple[float, float]] = SCHEDULES) -> Column:
    """Training position of copy number ``copy`` (from 0) of a planned row."""
    u = F.least(F.lit(1.0), (copy * F.col("_mix_total") + F.col("_mix_start")) / F.col("_mix_target"))
    return _position(u, F.col("_mix_rank"), schedules)


def mixture(docs: DataFrame, size: Column, schedules: Sequence[tuple[float, float]] = SCHEDULES, **params) -> DataFrame:
    """The mix itself: every taken copy as a row in the columns of ``docs``, sorted by training position.

    Columns of ``docs`` named like the plan's own (``_mix_...``) travel under other names meanwhile.
    """
    clash = {c: unused(docs, f"own{c}") for c in docs.columns if c.lower().startswith("_mix_")}
    given, docs = docs.columns, docs.withColumnsRenamed(clash)
    rows = plan(docs, size, **params).where(F.col("_mix_copies") > 0)
    rows = rows.withColumn("_mix_copy", F.explode(F.sequence(F.lit(0), F.col("_mix_copies") - 1)))
    rows = rows.withColumn("_mix_position", position(F.col("_mix_copy"), schedules))
    return (rows.repartitionByRange("_mix_position", "_mix_src", "_mix_hash")
            .sortWithinPartitions("_mix_position", "_mix_src", "_mix_hash")
            .select(*[F.col(f"`{clash.get(c, c)}`").alias(c) for c in given]))
