"""Region signal by running integrals against summing every base, with tiles small enough to matter."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from regulus.operators.signal import contig_alias, region_signal
from regulus.session import salted_join, split_hot


def by_hand(runs, regions, samples):
    out = {}
    for rid, c, s, e in regions:
        for name in samples:
            covered = weighted = 0
            for rc, rs, re_, v, rn in runs:
                if rc == c and rn == name and v is not None and v == v and None not in (s, e) and s < e and rs < re_:
                    n = max(0, min(e, re_) - max(s, rs))
                    covered, weighted = covered + n, weighted + n * v
            out[rid, name] = (covered or None, round(weighted, 6) if covered else None)
    return out


@pytest.mark.parametrize("width", [7, 64, 65_536])
def test_signal_equals_summing_bases(spark, width):
    r = random.Random(width)
    contigs = ["a", "b", None]
    runs = [(r.choice(contigs), s := r.randrange(-200, 900), s + r.randrange(0, 90), round(r.uniform(-3, 3), 4), r.choice("xyz")) for _ in range(400)]
    runs += [("a", 5, 300, None, "x"), ("a", 5, 300, float("nan"), "y"), ("b", 10, 10, 9.0, "x")]
    regions = [(i, r.choice(contigs), s := r.randrange(-250, 1000), s + r.randrange(-5, 400)) for i in range(120)]
    regions += [(200, "unknown", 0, 10), (201, "a", None, 10), (202, "a", 3, None), (203, "a", 5000, 5001), (204, "a", -10**9, 10**9)]
    regions += [(205 + i, "a", 40, 80) for i in range(5)]
    track = spark.createDataFrame(runs, "contig string, ts long, te long, value double, sample string")
    asked = spark.createDataFrame(regions, "rid int, contig string, s long, e long").withColumn("value", F.lit("other"))
    got = region_signal(track, asked, ["contig"], ("ts", "te"), ("s", "e"), "value", ["sample"], ["rid"], width=width).collect()
    found = {(x.rid, x.sample): (x.covered, None if x.weighted is None else round(x.weighted, 6)) for x in got}
    assert len(got) == len(found) and found == by_hand(runs, regions, "xyz")
    assert all((x.mean_signal is None) == (x.covered is None) for x in got)


def test_no_pairs_are_formed_and_length_is_free(spark):
    track = spark.range(2000).select(F.lit("chr1").alias("contig"), (F.col("id") * 3).alias("ts"), (F.col("id") * 3 + 2).alias("te"),
                                     F.lit(0.5).alias("value"), F.lit("x").alias("sample"))
    asked = spark.range(50).select("id", F.lit("1").alias("contig"), F.lit(0).cast("long").alias("s"), F.lit(6000).cast("long").alias("e"))
    one = contig_alias(F.col("contig"))
    out = region_signal(track.withColumn("contig", one), asked.withColumn("contig", one), ["contig"], ("ts", "te"), ("s", "e"), "value", ["sample"], ["id"])
    rows = out.collect()
    assert {(x.covered, x.weighted, x.mean_signal) for x in rows} == {(4000, 2000.0, 0.5)} and len(rows) == 50
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_alias_keeps_other_names(spark):
    names = ["chr1", "1", "chrX", "chr", "scaffold_chr2", None]
    got = [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(contig_alias(F.col("n"))).collect()]
    assert got == ["1", "1", "X", "chr", "scaffold_chr2", None]


def test_large_positions_lose_nothing(spark):
    far = 3_000_000_000
    d = defaultdict(list)
    for i in range(500):
        d["rows"].append(("a", far + 10 * i, far + 10 * i + 7, 0.1, "x"))
    track = spark.createDataFrame(d["rows"], "contig string, ts long, te long, value double, sample string")
    asked = spark.createDataFrame([(1, "a", far + 4985, far + 4992)], "rid int, contig string, s long, e long")
    row = region_signal(track, asked, ["contig"], ("ts", "te"), ("s", "e"), "value", ["sample"], ["rid"]).first()
    assert (row.covered, row.weighted) == (4, pytest.approx(0.4, abs=1e-12))


def test_hot_positions_are_counted_on_the_regions(spark):
    big = spark.range(60).select((F.col("id") % 2).alias("pos"), F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("z")), (F.col("id") % 3 + 1).cast("int")).alias("sample"), "id")
    small = spark.createDataFrame([(p, s, f"{p}{s}") for p in (0, 1, 2) for s in "xyz"], "pos long, sample string, v string")
    counted = spark.createDataFrame([(0,)] * 10 + [(1,)] * 3, "pos long")
    unread = big.withColumn("id", F.raise_error(F.lit("the large side was run")).cast("long"))
    _, copies, on = split_hot(unread, small, ["pos", "sample"], 4, counted)
    assert on == ["pos", "sample", "_salt"] and copies.groupBy("pos").count().orderBy("pos").collect() == [(0, 9), (1, 3), (2, 3)]
    got = salted_join(big, small, ["pos", "sample"], "left", 4, counted).collect()
    assert len(got) == 60 and all(x.v == f"{x.pos}{x.sample}" for x in got)


def test_high_levels_lose_nothing(spark):
    # levels above 2^62 / width are carried in decimals, lower ones in long numbers
    rows = [("a", 0, 1_000_000, v, s) for v, s in ((1e8, "x"), (1e8, "x"), (6e7, "y"), (-3e8, "z"))]
    track = spark.createDataFrame(rows, "contig string, ts long, te long, value double, sample string")
    asked = spark.createDataFrame([(1, "a", 10, 900_000), (2, "a", 200_000, 200_007)], "rid int, contig string, s long, e long")
    got = region_signal(track, asked, ["contig"], ("ts", "te"), ("s", "e"), "value", ["sample"], ["rid"]).collect()
    assert {(x.rid, x.sample): (x.covered, x.weighted) for x in got} == {
        (i, s): (n * k, float(n * v)) for i, n in ((1, 899_990), (2, 7)) for s, k, v in (("x", 2, 2 * 10**8), ("y", 1, 6 * 10**7), ("z", 1, -3 * 10**8))}
