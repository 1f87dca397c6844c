"""Sinks: tabular results, BED lines and the annotated-matrix bundle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regulus.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the checkpoints, reachable from every executor."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def bed_lines(df: DataFrame, contig: str, start: str, end: str, *name_fields: str) -> DataFrame:
    """1-based inclusive coordinates to BED text with a composite name field."""
    name = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in name_fields])
    return df.select(F.concat_ws("\t", F.col(contig), (F.col(start) - 1).cast("string"), F.col(end).cast("string"), name).alias("line"))


def write_bed(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "gzip").text(path)


def write_bundle(obs: DataFrame, var: DataFrame, x: DataFrame, meta: dict[str, str], path: str) -> None:
    """Annotated matrix as Parquet: ``obs`` (tasks), ``var`` (regions, by split), ``x`` (long values).

    Missing values stay NULL; filling with 0 is the explicit ``filled`` step of the reader.
    """
    spark = obs.sparkSession
    obs.write.mode("overwrite").parquet(f"{path}/obs")
    var.write.mode("overwrite").partitionBy("split").parquet(f"{path}/var")
    x.write.mode("overwrite").parquet(f"{path}/x")
    spark.createDataFrame(sorted(meta.items()), "key string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def read_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (spark.read.parquet(f"{path}/obs"), spark.read.parquet(f"{path}/var"), spark.read.parquet(f"{path}/x"))


def filled(x: DataFrame, value: str) -> DataFrame:
    """The step that turns missing into 0.0, kept apart because later statistics then count more rows."""
    return x.withColumn(value, F.coalesce(value, F.lit(0.0)))
