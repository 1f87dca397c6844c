"""Session helpers: checkpoint folder, lineage cuts and size-checked joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A derived lookup table is broadcast only when it is known to hold at most this many rows.
BROADCAST_ROWS = 200_000
# Tables with long array columns are held to a size in bytes instead.
BROADCAST_BYTES = 64 * 1024 * 1024
# A join key with more rows than this on the large side is split over several salts.
HOT_ROWS = 2_000_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; only a local session may fall back to /tmp."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ckpt-", dir="/tmp"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and continue from the written table.

    The lineage ends there, every later use reads the same rows after a lost executor, and the
    planner sees the real file size.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Hash-partition a compact table before a step that multiplies its rows.

    A partition that is read comfortably may not be once every row becomes hundreds.
    """
    return df.repartition(shuffle_partitions(df.sparkSession), *cols)


def with_size_hint(small: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a materialised table for broadcast if, and only if, its counted size is bounded."""
    if small.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(small)
    return small


def keyed_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys meet each other, as they do in a window's partitions."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("keyed_join keeps the keys of its left side: use inner, left, left_semi or left_anti")
    names = {k: f"_right_{k}" for k in on}
    same = [F.col(k).eqNullSafe(F.col(r)) for k, r in names.items()]
    out = left.join(right.withColumnsRenamed(names), same, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*names.values())


def lookup_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "left",
                max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Attach an aggregated dimension to ``big``.

    The dimension is materialised once and counted. Within the bound it is broadcast, so ``big``
    is never shuffled on a possibly hot key; beyond the bound hot keys are split over salts. NULL keys
    meet each other. ``how`` is inner or left, whatever the size.
    """
    if how not in ("inner", "left"):
        raise ValueError("lookup_join keeps rows of the large side only: use inner or left")
    small = cut(small)
    if small.limit(max_rows + 1).count() <= max_rows:
        return keyed_join(big, F.broadcast(small), on, how)
    return salted_join(big, small, on, how)


def split_hot(big: DataFrame, small: DataFrame, on: Sequence[str], hot_rows: int = HOT_ROWS,
              counted: DataFrame | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Salt both sides on the keys that hold more than ``hot_rows`` rows of ``big``.

    Rows of ``big`` spread over ``ceil(n / hot_rows)`` salts and the matching rows of ``small``
    are repeated once per salt, so every pair still meets exactly once. Other keys keep one salt.
    ``counted`` stands for ``big`` where that is dear to count: a table with some of the keys, and as many
    rows for them as ``big`` has for each key they are part of.
    """
    on = list(on)
    source = big if counted is None else counted
    by = [k for k in on if k in source.columns]
    hot = cut(source.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
              .where(F.col("_n") > hot_rows)
              .select(*by, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts")))
    if hot.isEmpty():
        return big, small, on
    hot = with_size_hint(hot)
    row_hash = F.xxhash64(*[F.col(c) for c in big.columns if not _is_map(big, c)])
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    big = (keyed_join(big, hot, by, "left")
           .withColumn("_salt", F.pmod(row_hash, salts.cast("long")).cast("int")).drop("_salts"))
    small = (keyed_join(small, hot, by, "left")
             .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts"))
    return big, small, [*on, "_salt"]


def salted_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner",
                hot_rows: int = HOT_ROWS, counted: DataFrame | None = None) -> DataFrame:
    """Equi-join in which a hot key of ``big`` is spread over several tasks (inner or left)."""
    if how not in ("inner", "left"):
        raise ValueError("salted_join keeps rows of the large side only: use inner or left")
    big, small, keys = split_hot(big, small, on, hot_rows, counted)
    out = keyed_join(big, small, keys, how)
    return out.drop("_salt") if "_salt" in keys else out


def _is_map(df: DataFrame, name: str) -> bool:
    return "map<" in df.schema[name].dataType.simpleString()
