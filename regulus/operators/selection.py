"""Splits, candidate choice, curve unions and derived units: rules that pick or label rows, with keys and limits as arguments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regulus.session import cut, keyed_join


def contig_split(contig: Column, splits: Mapping[str, Sequence[str]], rest: str) -> Column:
    """Split of a contig by name, ``rest`` for contigs that no split names; NULL for a NULL contig, which may belong anywhere."""
    named = [c for cs in splits.values() for c in cs]
    if len(named) != len(set(named)):
        raise ValueError("a contig is named in two splits")
    out = F.when(contig.isNull(), F.lit(None).cast("string"))
    for name, contigs in splits.items():
        out = out.when(contig.isin(*contigs), name)
    return out.otherwise(rest)


def split_audit(df: DataFrame, split: str, key: str) -> DataFrame:
    """Per split: rows, distinct keys, and those of its keys that another split holds too (0 everywhere: disjoint).

    A NULL split is a split of its own; NULL keys are counted as rows only.
    """
    pairs = cut(df.groupBy(key, split).agg(F.count(F.lit(1)).alias("n")))
    spread = (pairs.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").select(key, F.lit(1).alias("_shared")))
    return (pairs.join(spread, key, "left").groupBy(split)
            .agg(F.sum("n").alias("n"), F.count(key).alias("n_keys"), F.count("_shared").alias("n_shared")))


def candidates(df: DataFrame, score: str, at_least: float, position: str, center: float | Column, within: float) -> DataFrame:
    """Rows with a finite score of ``at_least`` or more, at most ``within`` from the centre; NULL in either leaves a row out."""
    s = F.col(score).cast("double")
    finite = ~F.isnan(s) & (F.abs(s) != float("inf"))
    mid = center if isinstance(center, Column) else F.lit(center)
    return df.where(finite & (s >= at_least) & (F.abs(F.col(position) - mid) <= within))


def curve_union(old: DataFrame, new: DataFrame, on: Sequence[str], origin: str = "origin", names: tuple[str, str] = ("old", "new")) -> DataFrame:
    """One curve of two result tables: all new rows, and old rows of the conditions that the new table holds.

    NULL is a condition like any other. Columns of ``new`` that ``old`` lacks are an error, more columns of ``old`` are dropped.
    """
    held = new.select(*on).distinct()
    kept = keyed_join(old, held, on, "left_semi").select(*new.columns)
    return kept.withColumn(origin, F.lit(names[0])).unionByName(new.withColumn(origin, F.lit(names[1])))


def keys_near(differential: DataFrame, links: DataFrame, region: str, comparison: str, significant: str, any_of: Sequence[str],
              key: str) -> DataFrame:
    """Distinct keys linked to a region that is significant in at least one of the comparisons; ``links`` holds (region, key)."""
    hit = differential.where(F.col(significant) & F.col(comparison).isin(*any_of)).select(region).distinct()
    return links.select(region, key).join(hit, region, "left_semi").where(F.col(key).isNotNull()).select(key).distinct()


def unit_key(rules: Sequence[tuple[Column, Sequence[Column]]], otherwise: Sequence[Column], sep: str = "|") -> Column:
    """Key of the independent unit behind a row: parts of the first rule that holds, joined; a NULL part reads ``?``."""
    def joined(parts: Sequence[Column]) -> Column:
        return F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("?")) for p in parts])

    out = F.when(F.lit(False), F.lit(""))
    for holds, parts in rules:
        out = out.when(holds, joined(parts))
    return out.otherwise(joined(otherwise))


def replication(df: DataFrame, by: Sequence[str], unit: Column, minimum: int = 3) -> DataFrame:
    """Tasks against independent units per group: both counts, tasks a unit, the largest unit and a flag below ``minimum`` units."""
    # one row per (group, unit) first: a unit with very many tasks weighs no more than others
    per = df.groupBy(*by, unit.alias("_unit")).agg(F.count(F.lit(1)).alias("_n"))
    g = per.groupBy(*by).agg(F.sum("_n").alias("n_tasks"), F.count(F.lit(1)).alias("n_units"), F.max("_n").alias("largest"))
    return g.withColumn("ratio", F.col("n_tasks") / F.col("n_units")).withColumn("under_replicated", F.col("n_units") < minimum)
