"""The bit-sliced index against a full comparison."""

from collections import Counter
import math

import numpy as np
from pyspark.sql import functions as F

from regulus.llm import topk
from regulus.llm.queries import QUERIES


def brute(rows, asked, k=5):
    ok = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows
          if i is not None and v and all(x is not None and math.isfinite(x) and abs(256 * x) < topk.LARGEST for x in v)]
    out = []
    for i, v in {(i, tuple(v)) for i, v in ok if asked(i)}:
        c = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in ok if j != i and len(w) == len(v))[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(c)]
    return Counter(out)


def test_odd_vectors(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(0, 0.2, 8).astype(np.float32)]) for i in range(300)]
    rows += [(400 + i, [0.25] * 8) for i in range(12)] + [(500, None), (501, []), (502, [None] * 8), (503, [float("nan")] * 8),
             (504, [float("inf")] + [0.0] * 7), (None, [0.1] * 8), (505, [0.5] * 3), (510, [1.0, -2.0, 3.0]), (506, [2e6] * 8),
             (507, [900.0] * 8), (510, [0.0] * 8), (3, [0.1] * 8), (7, rows[7][1])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = topk.top_k(d, F.col("vec_id") % 10 == 0)
    f32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert Counter(map(tuple, got.collect())) == brute(f32, lambda i: i % 10 == 0)
    assert topk.top_k(d.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert topk.top_k(d.limit(2), F.col("vec_id") >= 0).count() == 2


def test_op3(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert Counter(map(tuple, QUERIES["op3_topk"](spark, sf).collect())) == brute(rows, lambda i: i % 50 == 0)


def whole_brute(rows, k=5):
    out = []
    scaled = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    for i, v in scaled:
        c = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in scaled if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(c)]
    return Counter(out)


def test_large_components(spark):
    r = np.random.default_rng(2)
    small = [(i, [float(x) for x in r.normal(0, 0.2, 8).astype(np.float32)]) for i in range(100)]
    for power, kind in ((11, "bigint"), (20, "bigint"), (30, "decimal(38,0)"), (120, "string")):
        big = [(100 + i, [float(np.float32(x) * 2.0 ** power) for x in r.normal(0, 1, 8)]) for i in range(12)]
        big += [(200 + i, big[0][1]) for i in range(7)] + [(300, [2.0 ** power] + [0.0] * 7)]
        rows = small + big
        got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.lit(True))
        assert got.schema["score"].dataType.simpleString() == kind
        assert Counter((q, n, v, int(s)) for q, n, v, s in got.collect()) == whole_brute(rows)
    # Scores that fit 64 bits keep their type though the bound does not.
    rows = small + [(300, [2.0 ** 30] + [0.0] * 7)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.lit(True))
    assert got.schema["score"].dataType.simpleString() == "bigint"
    assert Counter(map(tuple, got.collect())) == whole_brute(rows)
