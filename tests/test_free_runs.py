"""Free positions as runs against trying every position."""

import random

from pyspark.sql import functions as F

from regulus.operators.motifs import free_runs, nearest_free


def test_runs_equal_trying_every_position(spark):
    r = random.Random(4)
    regions = [("a", 60), ("b", 9), ("c", 7), (None, 200), ("d", 400), ("e", None), ("f", 50)]
    sites = [(k, s := r.randrange(-5, n), s + r.randrange(0, 12)) for k, n in regions if n for _ in range(n // 20) if k != "f"]
    sites += [("unknown", 1, 5), ("a", 50, 400), (None, 10, 20), (None, 10, 20)]
    df = spark.createDataFrame(sites, "k string, s long, e long")
    got = {}
    for x in free_runs(df, spark.createDataFrame(regions, "k string, n int"), ["k"], "s", "e", "n", 7).collect():
        got.setdefault(x.k, []).extend(range(x.free_start, x.free_end))
    want = {}
    for k, n in regions:
        free = [p for p in range((n or 0) - 7) if not any(q == k and s < e and s < p + 7 and e > p for q, s, e in sites)]
        if free:
            want[k] = free
    assert {k: sorted(v) for k, v in got.items()} == want
    assert all(len(v) == len(set(v)) for v in got.values())
    runs = free_runs(df, spark.createDataFrame(regions, "k string, n int"), ["k"], "s", "e", "n", 7)
    for centre in (-4.0, 11.5, 20.0, 300.5):
        near = {x.k: x.position for x in nearest_free(runs, ["k"], centre).collect()}
        assert near == {k: min(v, key=lambda p: (abs(p - centre), p)) for k, v in want.items()}
    assert free_runs(df.limit(0), spark.createDataFrame(regions, "k string, n int").limit(0), ["k"], "s", "e", "n", 7).count() == 0


def test_a_region_of_a_million_bases(spark):
    sites = spark.range(5000).select(F.lit(1).alias("k"), (F.col("id") * 200 + 100).alias("s"), (F.col("id") * 200 + 110).alias("e"))
    runs = free_runs(sites, spark.createDataFrame([(1, 1_000_000)], "k int, n long"), ["k"], "s", "e", "n", 7).collect()
    # 16 positions around each site are barred
    assert sum(x.free_end - x.free_start for x in runs) == 1_000_000 - 7 - 5000 * 16 and len(runs) == 5001


def test_arms_of_any_size(spark):
    from regulus.operators.design import design_arms
    members = spark.createDataFrame([("b",), ("a",), ("c",), ("a",), (None,)], "name string")
    rows = design_arms(members, "name", 3, (2, 5)).collect()
    assert len(rows) == len(set(map(str, rows))) == 1 + 3 * 2 * 2 + 4 * 2 * 2 * 2
    assert {r.label for r in rows} == {"empty", "a", "b", "c", "a+b", "a+c", "b+c", "a+b+c"}
    empty = [r for r in rows if r.label == "empty"]
    assert [(r.members, r.load, r.arrangement, r.variant) for r in empty] == [([], 0, "none", "real")]
    assert {r.arrangement for r in rows if r.n_members == 1} == {"single"}
    assert [r.label for r in design_arms(members, "name", 0, (2,)).collect()] == ["empty"]
    assert [r.label for r in design_arms(members.limit(0), "name", 3, (2,)).collect()] == ["empty"]
