"""NULL group keys and odd rows survive the plan patterns, with the rows a SQL window would give."""

import pytest
from pyspark.sql import functions as F

from regulus.functions import special as P
from regulus.operators import intervals as I
from regulus.operators import motifs as M
from regulus.operators import nulls as N
from regulus.operators import signal as S
from regulus.operators import stats as ST
from regulus.plans.ordered import add_average_ranks, exact_percentiles, ordered_values
from regulus.plans.tiling import depth_segments, gap_clusters, neighbours
from regulus.session import keyed_join, lookup_join, salted_join
from regulus.sources import readers as R


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([("a", 1, 5.0), ("a", 2, 7.0), (None, 3, 1.0), (None, 4, 1.0), (None, 5, 9.0)], "g string, id long, v double")


def got(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_ranks_percentiles_and_centres_keep_null_groups(rows):
    assert got(add_average_ranks(rows, ["g"], {"v": "r"}), "id", "r") == [(1, 1.0), (2, 2.0), (3, 1.5), (4, 1.5), (5, 3.0)]
    assert got(exact_percentiles(rows, ["g"], "v", [0.5]), "g", "q0") == [("a", 6.0), (None, 1.0)]
    assert got(ordered_values(rows, ["g"], "v"), "g", "v", "cum_n") == [("a", 5.0, 1), ("a", 7.0, 2), (None, 1.0, 2), (None, 9.0, 3)]
    assert got(S.centre_within(rows, ["g"], "v", "c"), "id", "c")[0] == (1, -1.0) and S.centre_within(rows, ["g"], "v", "c").count() == 5
    assert S.mean_one(rows, ["g"], "v", "m").where("m is null").count() == 0
    assert [r.bucket for r in ST.quantile_buckets(rows, ["g"], "v", 2).where("g is null").collect()] == [0, 0, 0]
    assert N.shuffle_within(rows, ["g"], "id", "v", (1, 2)).count() == 10


def test_scans_over_position_keep_null_keys(spark):
    iv = spark.createDataFrame([(None, 1, 5), (None, 4, 9), ("c", 2, 3), (None, 200_000, 200_010)], "k string, s long, e long")
    assert got(depth_segments(iv, ["k"], "s", "e"), "k", "start", "end") == [("c", 2, 3), (None, 1, 9), (None, 200_000, 200_010)]
    p = spark.createDataFrame([(None, 1), (None, 3), (None, 100_000), ("c", 3)], "k string, p long")
    assert got(gap_clusters(p, ["k"], "p", 5, width=2), "k", "p", "cluster") == [("c", 3, 1), (None, 1, 1), (None, 100_000, 2), (None, 3, 1)]
    n = neighbours(p, p.withColumn("p", F.col("p") + 1).withColumnRenamed("p", "q"), ["k"], "p", "q", width=2)
    assert got(n, "k", "p", "prev.at", "next.at") == [("c", 3, None, 4), (None, 1, None, 2), (None, 100_000, 4, 100_001), (None, 3, 2, 4)]


def test_joins_on_null_keys(spark, rows):
    names = spark.createDataFrame([("a", "x"), (None, "y")], "g string, name string")
    for j in (keyed_join(rows, names, ["g"]), lookup_join(rows, names, ["g"]), salted_join(rows, names, ["g"], "left", hot_rows=1)):
        assert j.columns == ["g", "id", "v", "name"] and {r.name for r in j.where("g is null").collect()} == {"y"} and j.count() == 5
    assert keyed_join(rows, names, ["g"], "left_anti").count() == 0
    for bad in ("full", "right"):
        with pytest.raises(ValueError):
            lookup_join(rows, names, ["g"], bad)


def test_ranks_of_long_values_and_ids_of_any_type(spark):
    big = spark.createDataFrame([(1, 2**53), (1, 2**53 + 1), (1, 2**53 + 2)], "g int, v long")
    assert got(add_average_ranks(big, ["g"], {"v": "r"}), "r") == [(1.0,), (2.0,), (3.0,)]
    named = spark.createDataFrame([("chr1:5-9", 1.0), ("chr1:7-8", 2.0), ("x", 3.0)], "id string, v double").withColumn("g", F.lit(1))
    out = N.shuffle_within(named, ["g"], "id", "v", (0,))
    assert sorted(r.shuffled for r in out.collect()) == [1.0, 2.0, 3.0]
    with pytest.raises(ValueError):
        N.label_partitions(named, 40, 20)


def test_motif_rules(spark):
    cebp, short = M.motif_from_word("CEBPB", "TTGCGCAA"), M.motif_from_word("E", "AGGAAGT")
    seqs = spark.createDataFrame([(1, "CCCTTGCGCAACCC"), (2, "cccttgcgcaaccc"), (3, None), (4, ""), (5, "NNNN")], "id long, seq string")
    rows = {(r.id, r.motif): r for r in M.scan_best(seqs, "id", [cebp, short], (0.9,)).collect()}
    assert len(rows) == 10
    for i in (1, 2):
        assert rows[i, "CEBPB"].n_90 == 1 and rows[i, "CEBPB"].best_pos == 3
    for i in (3, 4, 5):
        assert rows[i, "CEBPB"].best_rel is None and rows[i, "CEBPB"].n_90 == 0
    rate = M.hit_rates(M.scan_hits(seqs, "id", [cebp], 0.9), seqs, "id", ["CEBPB"], (0.9,)).first()
    assert rate.n_regions == 2 and rate.mean_hits == pytest.approx(2 / 5)


def test_remap_takes_the_first_block_only(spark):
    blocks = spark.createDataFrame([("a", 0, 100, "b", 500, "+", 1), ("a", 0, 100, "a", 700, "+", 2)],
                                   "src_contig string, src_start long, src_end long, dst_contig string, dst_start long, strand string, block_id long")
    points = spark.createDataFrame([(1, "a", 10)], "id long, contig string, pos long")
    assert I.remap(points, blocks, "id", "contig", "pos").first().mapped is None
    scored = blocks.withColumn("score", F.col("block_id"))
    assert I.remap(points, scored, "id", "contig", "pos").first().mapped == 710


def test_log_names_with_blanks(spark):
    lines = spark.createDataFrame([("I1 IR vs replicative (shared denom)  rho +0.5642  n=110,699",)], "value string")
    assert tuple(R.metrics_from_logs(lines).first()) == ("I1 IR vs replicative (shared denom)", 0.5642, 110699)


def test_tails_for_any_n():
    import time
    t0 = time.time()
    assert P.binomial_two_sided(400_000, 1_000_000) == pytest.approx(0, abs=1e-300)
    assert P.binomial_two_sided(499_000, 1_000_000) == pytest.approx(0.0456, abs=2e-4)
    assert P.wilcoxon_two_sided(255_000, 1_030) == pytest.approx(0.27, abs=0.03)
    assert P.fisher_two_sided(1_000_000, 1_001_500, 999_800, 1_000_100) == pytest.approx(0.5, abs=0.2)
    assert time.time() - t0 < 1
    for n in (5, 12, 30):
        w = n * (n + 1) // 2 // 3
        count = [1]
        for r in range(1, n + 1):
            grown = [0] * (len(count) + r)
            for i, c in enumerate(count):
                grown[i] += c
                grown[i + r] += c
            count = grown
        assert P.wilcoxon_two_sided(w, n) == pytest.approx(min(1.0, 2 * sum(count[: w + 1]) / 2**n))
    import math
    for a, b, c, d in ((3, 1, 1, 3), (0, 5, 7, 2), (10, 90, 30, 70), (0, 0, 3, 4)):
        p = lambda k: math.comb(a + c, k) * math.comb(b + d, a + b - k) / math.comb(a + b + c + d, a + b)  # noqa: B023,E731
        ks = range(max(0, a - d), min(a + b, a + c) + 1)
        assert P.fisher_two_sided(a, b, c, d) == pytest.approx(sum(p(k) for k in ks if p(k) <= p(a) * (1 + 1e-7)))
