"""Genome stored as fixed-size chunks (contig, chunk_id, seq) and window extraction from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regulus.session import lookup_join, salted_join


def fetch_windows(windows: DataFrame, chunks: DataFrame, ident: str, length: int, chunk: int) -> DataFrame:
    """Sequence of ``[ws, ws + length)`` per window (``ident``, contig, ws), clamped by the caller.

    A window needs at most ``length / chunk + 2`` chunks; chunks asked for by very many windows
    are salted.
    """
    first = F.expr(f"ws div {chunk}L")
    asked = windows.withColumn("chunk_id", F.explode(F.sequence(first, F.expr(f"(ws + {length} - 1) div {chunk}L"))))
    got = salted_join(asked, chunks, ["contig", "chunk_id"])
    parts = got.groupBy(ident, "contig", "ws").agg(F.sort_array(F.collect_list(F.struct("chunk_id", "seq"))).alias("_p"))
    text = F.array_join(F.transform("_p", lambda p: p["seq"]), "")
    offset = (F.col("ws") - F.expr(f"ws div {chunk}L") * chunk + 1).cast("int")
    return parts.select(ident, "contig", "ws", F.substring(text, offset, F.lit(length)).alias("seq"))


def split_chunks(seqs: DataFrame, keys: Sequence[str], seq: Column, chunk: int) -> DataFrame:
    """Whole sequences to chunks (keys, chunk_id, seq); a NULL or empty sequence has none."""
    n = F.length("_s").cast("long")
    whole = seqs.select(*keys, seq.alias("_s")).where(n > 0)
    ids = whole.withColumn("chunk_id", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length(_s) - 1) div {chunk}L"))))
    return ids.select(*keys, "chunk_id", F.substring("_s", (F.col("chunk_id") * chunk + 1).cast("int"), F.lit(chunk)).alias("seq"))


def with_halo(chunks: DataFrame, keys: Sequence[str], chunk: int, halo: int) -> DataFrame:
    """Every chunk filled up to ``chunk`` bases and followed by the next ``halo`` bases of its contig; N where unknown.

    Only the first ``halo`` bases of a chunk travel, to the chunk (or, with a halo longer than a chunk, chunks) before it.
    """
    if halo < 1:
        return chunks
    steps = range(1, -(-halo // chunk) + 1)
    widths = {d: min(chunk, halo - (d - 1) * chunk) for d in steps}
    full = chunks.withColumn("seq", F.rpad(F.coalesce("seq", F.lit("")), chunk, "N"))
    heads = full.select(*keys, "chunk_id", F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.substring("seq", 1, w).alias("h")) for d, w in widths.items()])).alias("_p"))
    heads = heads.groupBy(*keys, (F.col("chunk_id") - F.col("_p.d")).alias("chunk_id")).agg(
        *[F.max(F.when(F.col("_p.d") == d, F.col("_p.h"))).alias(f"_h{d}") for d in steps])
    after = [F.coalesce(F.col(f"_h{d}"), F.lit("N" * w)) for d, w in widths.items()]
    return lookup_join(full, heads, [*keys, "chunk_id"]).select(*keys, "chunk_id", F.concat("seq", *after).alias("seq"))
