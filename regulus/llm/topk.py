"""Exact top-k inner products by a bit-sliced index.

Rows are cut into blocks. A block keeps, per dimension, the leading bits of its (shifted) integer values as
bitmaps over its rows, one bitmap per bit: the slices. The score of a query is a weighted sum of slices:
every set bit of a weight adds the slices of its dimension, shifted, with bitmap full adders; a negative
weight adds the complement. The k best rows are then read off the sum's slices from the most significant
one downward. Because trailing bits were left out, a sum is off by less than a known width; all rows within
that width of the k-th sum are the boundary rows and get their exact score from the stored integers. Nothing
is cut off: the result is exact for every query and block, and the best k of all blocks are the best k.

Every (block, block of queries) pair is one bounded group. A vector that is NULL, empty, or holds a NULL or non-finite
component takes no part, nor do pairs of different length. Components may be of any size: rows of like magnitude share a
block, so a few large ones do not blunt the slices of the others, and where a score could leave 62 bits the block is
searched by floating sums with an error bound and its boundary rows are scored in Python integers. The score is a
bigint if all scores of the result fit one, else a decimal(38, 0), else the digits as a string. A query's own row is any row with its id; equal candidate rows each keep a rank.
A query id with several vectors gets a list for each of them. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regulus.session import cut

BLOCK_VALUES = 8192 * 64
QUERIES_PER_BLOCK = 256
SLICES = 6
LARGEST = math.inf     # scaled components need only be finite
# Products and sums below this stay in 64-bit integers.
SAFE = 1 << 62


def quantised(df: DataFrame, vector: str, scale: float = 256.0) -> Column:
    """floor(scale * component) as an array of (whole) doubles, or NULL for a vector that takes no part."""
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == math.inf))

    def whole(v: Column) -> Column:
        y = v.cast("double") * F.lit(scale)
        return (F.when(F.abs(y) < float(1 << 52), F.floor(y).cast("double"))
                .when(F.abs(y) == math.inf, F.raise_error(F.lit("a finite component overflows double when scaled")).cast("double"))
                .otherwise(y))

    return F.when(x.isNotNull() & (F.size(x) > 0) & ~bad, F.transform(x, whole))


def _planes(values: np.ndarray, bits: int) -> np.ndarray:
    """(dimensions, bits, words): bitmap of every bit of every dimension; rows padded to whole words."""
    n, dims = values.shape
    out = np.zeros((dims, bits, (n + 63) // 64 * 8), np.uint8)
    for b in range(bits):
        packed = np.packbits(((values >> b) & 1).astype(np.uint8), axis=0, bitorder="little")
        out[:, b, :packed.shape[0]] = packed.T
    return out.view(np.uint64)


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bit-sliced sum of stacked numbers: (..., slices, words) each, one slice more in the result."""
    n = max(a.shape[-2], b.shape[-2])
    out = np.empty((*a.shape[:-2], n + 1, a.shape[-1]), np.uint64)
    carry = np.zeros((*a.shape[:-2], a.shape[-1]), np.uint64)
    for i in range(n):
        x = a[..., i, :] if i < a.shape[-2] else None
        y = b[..., i, :] if i < b.shape[-2] else None
        if x is None or y is None:
            z = y if x is None else x
            out[..., i, :] = z ^ carry
            carry = z & carry
        else:
            t = x ^ y
            out[..., i, :] = t ^ carry
            carry = (x & y) | (t & carry)
    out[..., n, :] = carry
    return out


def _total(parts: np.ndarray) -> np.ndarray:
    """Sum of all (k, slices, words) parts by pairs."""
    while len(parts) > 1:
        odd = parts[-1:] if len(parts) % 2 else None
        parts = _add(parts[0:len(parts) - 1:2], parts[1::2])
        if odd is not None:
            pad = np.zeros((1, parts.shape[1] - odd.shape[1], odd.shape[2]), np.uint64)
            parts = np.concatenate([parts, np.concatenate([odd, pad], axis=1)])
    return parts[0]


def weighted_sum(planes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Slices of sum(|w| * u) over positive and sum(|w| * complement of u) over negative weights."""
    size = np.abs(weights)
    total = np.zeros((1, planes.shape[2]), np.uint64)
    for b in range(int(size.max()).bit_length() if len(size) else 0):
        on = np.flatnonzero((size >> b) & 1)
        if len(on):
            parts = planes[on]
            flip = weights[on] < 0
            parts[flip] = ~parts[flip]
            s = _total(parts)
            total = _add(total, np.concatenate([np.zeros((b, s.shape[1]), np.uint64), s]))
    return total


def _count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def kth_value(slices: np.ndarray, rows: np.ndarray, k: int) -> int:
    """The k-th largest number among the set bits of ``rows``, found from the most significant slice down."""
    equal, above, value = rows.copy(), 0, 0
    for i in range(len(slices) - 1, -1, -1):
        ones = equal & slices[i]
        n = _count(ones)
        value <<= 1
        if above + n >= k:
            equal, value = ones, value | 1
        else:
            above += n
            equal &= ~slices[i]
    return value


def at_least(slices: np.ndarray, rows: np.ndarray, value: int) -> np.ndarray:
    """Bitmap of the numbers among ``rows`` that are ``value`` or more."""
    if value <= 0:
        return rows
    if value >> len(slices):
        return np.zeros_like(rows)
    above, equal = np.zeros_like(rows), rows.copy()
    for i in range(len(slices) - 1, -1, -1):
        if (value >> i) & 1:
            equal &= slices[i]
        else:
            above |= equal & slices[i]
            equal &= ~slices[i]
    return above | equal


def search_block(ids: np.ndarray, exact: np.ndarray, planes: np.ndarray, shift: int, queries: np.ndarray,
                 query_ids: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(number of the query, id, score) of the k best rows of one block for every query."""
    n = len(ids)
    for q in range(len(queries)):
        w = queries[q]
        own = np.zeros(planes.shape[2] * 8, np.uint8)
        mask = np.packbits(ids != query_ids[q], bitorder="little")
        own[:len(mask)] = mask
        rows = own.view(np.uint64)
        there = _count(rows)
        if not there:
            continue
        s = weighted_sum(planes, w)
        width = ((1 << shift) - 1) * int(np.abs(w).sum())
        least = kth_value(s, rows, min(k, there)) - -(-width >> shift)
        near = at_least(s, rows, least)
        at = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little")[:n])
        score = exact[at].astype(np.int64) @ w
        best = np.lexsort((ids[at], -score))[:k]
        for i in best:
            yield q, int(ids[at[i]]), int(score[i])


def search_wide(ids: np.ndarray, exact: np.ndarray, queries: np.ndarray, query_ids: np.ndarray,
                k: int) -> Iterator[tuple[int, int, int]]:
    """As ``search_block``, for numbers of any size: floating sums choose the boundary rows, Python integers score them."""
    v = exact.astype(np.float64)
    dim = v.shape[1]
    v = np.ldexp(v, -int(np.frexp(np.abs(v).max())[1]))
    size = np.abs(v)
    for q in range(len(queries)):
        rows = np.flatnonzero(ids != query_ids[q])
        if not len(rows):
            continue
        whole = [int(x) for x in queries[q]]
        w = queries[q].astype(np.float64)
        w = np.ldexp(w, -int(np.frexp(np.abs(w).max())[1]))
        about = (v @ w)[rows]
        error = (size @ np.abs(w))[rows] * ((4 * dim + 8) * 2.0 ** -53) + dim * 1e-300
        least = np.sort(about - error)[-min(k, len(rows))]
        at = rows[about + error >= least]
        score = [sum(int(a) * b for a, b in zip(exact[i].tolist(), whole)) for i in at]
        for i, s in sorted(zip(ids[at].tolist(), score), key=lambda x: (-x[1], x[0]))[:k]:
            yield q, i, s


def build_index(vectors: DataFrame, parts: int) -> DataFrame:
    """Blocks of the rows (id, v): part, length, ids, exact integers, slices, bits left out."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(key: tuple[int, int]) -> pa.RecordBatch:
            dim = key[0]
            ids = np.concatenate([x for x, _ in held[key]])
            v = np.concatenate([y for _, y in held[key]])
            held[key] = []
            if np.abs(v).max() >= SAFE:
                return pa.RecordBatch.from_pydict({
                    "part": [part], "dim": [dim], "n": [len(ids)], "ids": [ids.tobytes()],
                    "exact": [v.astype(np.float64).tobytes()], "slices": [b""], "bits": [0], "shift": [0]}, schema=_INDEX)
            v = v.astype(np.int64)
            base = v.min(axis=0)
            spread = int((v - base).max())
            shift = max(0, spread.bit_length() - SLICES)
            planes = _planes((v - base) >> shift, min(SLICES, max(1, spread.bit_length())))
            largest = np.abs(v).max()
            small = v.astype(np.int16 if largest < 1 << 15 else np.int32 if largest < 1 << 31 else np.int64)
            return pa.RecordBatch.from_pydict({
                "part": [part], "dim": [dim], "n": [len(ids)], "ids": [ids.tobytes()], "exact": [small.tobytes()],
                "slices": [planes.tobytes()], "bits": [planes.shape[1]], "shift": [shift]}, schema=_INDEX)

        for b in batches:
            v = b.column(1)
            lengths = np.diff(v.offsets.to_numpy())
            flat, starts = v.values.to_numpy(zero_copy_only=False), v.offsets.to_numpy()[:-1]
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                step = max(64, BLOCK_VALUES // int(dim))
                for lo in range(0, len(at), step):
                    own = at[lo:lo + step]
                    rows = flat[starts[own][:, None] + np.arange(dim)]
                    bits = np.frexp(np.abs(rows.astype(np.float64)).max(axis=1))[1]
                    grade = np.maximum(0, -((18 - bits) // SLICES))
                    for g in np.unique(grade):
                        key, of = (int(dim), int(g)), grade == g
                        held.setdefault(key, []).append((ids[own[of]], rows[of]))
                        if sum(len(x) for x, _ in held[key]) >= step:
                            yield block(key)
        for key in list(held):
            if held[key]:
                yield block(key)

    return vectors.mapInArrow(build, _INDEX_DDL)


_INDEX = pa.schema([("part", pa.int32()), ("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("exact", pa.binary()),
                    ("slices", pa.binary()), ("bits", pa.int32()), ("shift", pa.int32())])
_INDEX_DDL = "part int, dim int, n int, ids binary, exact binary, slices binary, bits int, shift int"


def _block_dtype(size: int, bits: int) -> type:
    return {2: np.int16, 4: np.int32, 8: np.int64 if bits else np.float64}[size]


def _search(k: int, width: int):
    """Best rows of a group's blocks; with ``width``, scores are their digits and a key of so many bytes in their order."""
    def run(blocks: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(blocks) and len(queries):
            dim = int(blocks["dim"].iloc[0])
            q = np.stack(queries["v"].to_numpy())
            qid, qkey = queries["id"].to_numpy(np.int64), queries["qkey"].to_numpy(np.int64)
            largest = np.abs(q.astype(np.float64)).max(axis=1)
            for b in blocks.itertuples():
                ids = np.frombuffer(b.ids, np.int64)
                exact = np.frombuffer(b.exact, _block_dtype(len(b.exact) // (b.n * dim), b.bits)).reshape(b.n, dim)
                most = max(1, int(np.abs(exact.astype(np.float64)).max()))
                safe = np.array([dim * most * max(1, int(x)) < SAFE for x in largest]) & (b.bits > 0)
                if safe.any():
                    planes = np.frombuffer(b.slices, np.uint64).reshape(dim, b.bits, -1)
                    out += [(int(qid[safe][i]), int(qkey[safe][i]), v, s) for i, v, s in
                            search_block(ids, exact, planes, b.shift, q[safe].astype(np.int64), qid[safe], k)]
                if not safe.all():
                    out += [(int(qid[~safe][i]), int(qkey[~safe][i]), v, s) for i, v, s in
                            search_wide(ids, exact, q[~safe], qid[~safe], k)]
        if not width:
            return pd.DataFrame(out, columns=["query_id", "qkey", "vec_id", "score"]).astype("int64")
        middle = 1 << (8 * width - 1)
        rows = [(i, j, v, str(s), (s + middle).to_bytes(width, "big")) for i, j, v, s in out]
        return pd.DataFrame(rows, columns=["query_id", "qkey", "vec_id", "score", "key"]).astype(
            {"query_id": "int64", "qkey": "int64", "vec_id": "int64"})
    return run


def top_k(table: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding",
          scale: float = 256.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best rows, ties to the smaller id."""
    spark = table.sparkSession
    rows = (table.select(F.col(key).cast("long").alias("id"), quantised(table, vector, scale).alias("v"), is_query.alias("is_query"))
            .where(F.col("v").isNotNull() & F.col("id").isNotNull()))
    rows = cut(rows)
    values, dims, largest = rows.agg(
        F.coalesce(F.sum(F.size("v")), F.lit(0)), F.coalesce(F.max(F.size("v")), F.lit(0)),
        F.coalesce(F.max(F.greatest(F.array_max("v"), -F.array_min("v"))), F.lit(0.0))).first()
    bound = dims * int(largest) ** 2
    width = bound.bit_length() // 8 + 1 if bound >= SAFE else 0
    if not width:
        rows = rows.withColumn("v", F.col("v").cast("array<int>" if largest < 1 << 31 else "array<long>"))
    parts = max(1, -(-values // BLOCK_VALUES))
    index = build_index(rows.select("id", "v").repartition(parts), parts)
    asked = (rows.where("is_query").select("id", "v", F.size("v").alias("dim"), F.xxhash64("id", "v").alias("qkey"))
             .dropDuplicates(["id", "qkey"]))
    groups = max(1, -(-rows.where("is_query").count() // QUERIES_PER_BLOCK))
    asked = (asked.withColumn("group", F.pmod("qkey", F.lit(groups)).cast("int"))
             .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))))
    blocks = index.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    on = ["part", "dim", "group"]
    found = blocks.groupBy(*on).cogroup(asked.groupBy(*on)).applyInPandas(
        _search(k, width), "query_id long, qkey long, vec_id long, " + ("score string, key binary" if width else "score long"))
    best = Window.partitionBy("query_id", "qkey").orderBy(F.desc("key" if width else "score"), "vec_id")
    found = (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
             .select("query_id", "rank", "vec_id", "score"))
    if width:
        found = cut(found)
        for kind in ("long", "decimal(38,0)"):
            if found.where(F.col("score").try_cast(kind).isNull()).isEmpty():
                return found.withColumn("score", F.col("score").cast(kind))
    return found
