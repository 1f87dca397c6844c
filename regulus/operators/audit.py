"""Audits of reported numbers against stored ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parts_equal_total(df: DataFrame, parts: Sequence[str], total: str) -> Column:
    return sum((F.col(p) for p in parts[1:]), F.col(parts[0])) == F.col(total)


def claim_verdict(df: DataFrame, claim: str, stored: str) -> DataFrame:
    """Compare a claimed number, at the precision it is written with, to the stored one."""
    text = F.regexp_replace(F.regexp_extract(claim, r"([+-]?\d[\d,]*(?:\.\d+)?)", 1), ",", "")
    digits = F.length(F.regexp_extract(text, r"\.(\d+)$", 1))
    out = df.withColumn("claimed", text.try_cast("double")).withColumn("digits", digits)
    # half a unit of the last written digit, with room for binary representation
    tol = 0.5 * F.pow(F.lit(10.0), -F.col("digits")) * (1 + 1e-9) + 1e-12
    verdict = (F.when(F.col("claimed").isNull(), "UNPARSED").when(F.col(stored).isNull(), "MISSING")
               .when(F.abs(F.col("claimed") - F.col(stored)) <= tol, "MATCH").otherwise("MISMATCH"))
    return out.withColumn("verdict", verdict)


def sem_to_sd(df: DataFrame, n: str, sem_columns: Sequence[str]) -> DataFrame:
    """Range of every SEM column and of the sd it stands for (sem * sqrt(n))."""
    long = df.select(n, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("sem")) for c in sem_columns])).alias("z")).select(n, "z.*")
    return long.groupBy("column").agg(
        F.min("sem").alias("sem_min"), F.max("sem").alias("sem_max"), F.min(F.col("sem") * F.sqrt(n)).alias("sd_min"),
        F.max(F.col("sem") * F.sqrt(n)).alias("sd_max"))
