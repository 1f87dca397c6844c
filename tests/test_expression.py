"""Operators on expression and annotation tables with other column names, NULLs and odd rows."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from regulus.operators import expression as X


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def test_text_fields(spark):
    d = spark.createDataFrame([("chrX:5-9", "a7", "b7"), ("x", "a7", "b8"), (None, "", None)], "r string, u string, h string")
    assert rows(X.region_columns(d, "r", ("c", "s", "e")), "c", "s", "e") == [("chrX", 5, 9)]
    assert [r.bad for r in X.label_mismatch(d, ("u", r"(\d+)"), ("h", r"(\d+)"), ("i", "j", "bad")).collect()] == [False, True, False]
    c = d.select(X.canonical_label(F.col("u"), {"a7": "A"}).alias("c"), X.prefix_tag(F.col("r"), {"chr": "contig"}, "other").alias("p"))
    assert rows(c) == [("A", "contig"), ("A", "other"), ("UNMAPPED", "other")]
    with pytest.raises(PySparkException):
        d.select(X.canonical_label(F.col("u"), {"a7": "A"}, None)).collect()
    assert X.family_counts(d, "u", {"letters": "^a"}).first().letters == 2


def test_keys(spark):
    d = spark.createDataFrame([("g", 1), ("g", 1), ("g", 2), (None, 3)], "s string, k int")
    assert rows(X.membership(d, d.where("k = 2"), "k", ["s"])) == [("g", 2, 1, 50.0), (None, 1, 0, 0.0)]
    assert rows(X.where_found(d.where("k < 3"), d.where("k > 1"), "k")) == [(1, "first only"), (2, "both"), (3, "second only")]
    assert rows(X.kept_counts(d, ["s"], F.col("k") > 1)) == [("g", 1, 2), (None, 1, 0)]
    e = spark.createDataFrame([("f", "p", 5.0), ("f", "q", 9.0), ("h", "p", 9.0), ("h", "q", None)], "f string, st string, x double")
    assert rows(X.expressed(e, "f", "st", F.col("x") > 8, F.col("x") > 4, 2)) == [("f", True, True, True), ("h", True, False, False)]
    assert rows(X.complete_cases(e, "f", "st", "x")) == [("f", 2)]


def test_values(spark):
    e = spark.createDataFrame([("s", "a", 10.0, 2.0), ("s", "b", 30.0, 1.0), ("z", "a", 0.0, 2.0)], "smp string, ft string, n double, len double")
    u = {(r.smp, r.ft): r for r in X.unit_conversions(e, "smp", "n", "len").collect()}
    assert u["s", "a"].cpm == 250_000 and u["s", "a"].tpm == pytest.approx(5 / 35 * 1e6) and u["s", "b"].rpkm == pytest.approx(0.75e9)
    lib = X.library_size(e, "smp", "n", 5, 40).where("smp = 's'").first()
    assert (lib.total, lib.detected, lib.pct_detected, lib.near_target) == (40.0, 2, 100.0, True)
    z = X.zscore(e.withColumn("g", F.lit(None).cast("string")), ["g"], "n", "zz")
    assert z.count() == 3 and sum(r.zz for r in z.collect()) == pytest.approx(0)
    assert X.zscore(e, ["smp"], "n", "zz").where("smp = 'z'").first().zz is None
    c = X.composite_score(e, "smp", "ft", "n", ["a"], ["b"]).where("smp = 's'").first()
    assert c.up == pytest.approx(1.0) and c.composite == pytest.approx(1.0)
    h = X.histogram(e, [], {"b": X.log_bin("n", 1)})
    assert rows(h) == [(1, 2)]


def test_comparisons(spark):
    d = spark.createDataFrame([(1, "early", 1.0, 0.01, True), (1, "late", -1.0, 0.2, False), (2, "late", 2.0, 0.01, True)], "r int, c string, e double, p double, s boolean")
    assert rows(X.differential_summary(d, "c", "e", "p", "s")) == [("early", 1, 1, 1, 0, 100.0), ("late", 2, 1, 1, 0, 50.0)]
    assert rows(X.late_set(d, "r", "c", "e", "s", ("late",))) == [(2, 1, 1, 0)]
    gate = spark.createDataFrame([("m1", True), ("m2", False)], "m string, ok boolean")
    assert X.require_markers(gate.where("ok"), "m", "ok").collect()
    with pytest.raises(PySparkException):
        X.require_markers(gate, "m", "ok").collect()
    assert rows(X.range_test(d, "c", "e", ["late"]), "c", "n_inside") == [("early", 1), ("late", 2)]
    w = spark.createDataFrame([(1.0, 2.0, None), (2.0, 4.0, 6.0), (3.0, 6.0, 9.0)], "a double, b double, c double")
    assert {r.held: r.n for r in X.leave_one_out(w, ["a", "b", "c"]).collect()} == {"a": 3, "b": 3, "c": 2}
    t = spark.createDataFrame([("g", 1, 1.0), ("g", 2, 2.0), ("g", 3, 4.0)], "f string, st int, v double")
    assert rows(X.trajectory(t, "f", "st", "v", 1), "means", "last_over_first") == [("1.0,2.0,4.0", 2.0)]


def test_u_distribution_against_counting_and_published_values():
    import itertools
    import math

    from regulus.functions import special as P
    for m, n in ((1, 1), (2, 5), (4, 4), (3, 6), (5, 5)):
        us = [sum(c) + m - m * (m + 1) // 2 for c in itertools.combinations(range(m + n), m)]
        for u in range(m * n + 1):
            low = min(u, m * n - u)
            assert math.isclose(P.u_two_sided(u, m, n), min(1.0, 2 * sum(x <= low for x in us) / len(us)))
    # critical values of the published two-sided 5 % table: U is at most 2, 13 and 55 for 5 x 5, 8 x 8 and 8 x 24
    for m, n, crit in ((5, 5, 2), (8, 8, 13)):
        assert P.u_two_sided(crit, m, n) <= 0.05 < P.u_two_sided(crit + 1, m, n)
    assert P.u_two_sided(3, 0, 4) != P.u_two_sided(3, 0, 4)  # not a number without values
    assert P.u_two_sided(7.5, 3, 5, ties=6.0) == 1.0


def test_tails_of_a_million_values_are_quick():
    import time

    from regulus.functions import special as P
    t = time.time()
    assert 0 < P.u_two_sided(4.9e11, 10**6, 10**6) < 1e-10
    assert 0 < P.hypergeom_upper(500_400, 499_600, 499_900, 500_100) < 1
    assert 0 < P.u_two_sided(30_000, 8, 24_000) < 1
    assert time.time() - t < 3


def test_upper_tail_against_counting(spark):
    import math

    from pyspark.sql import functions as F

    from regulus.functions import special as P
    for a, b, c, d in ((3, 1, 1, 3), (0, 5, 4, 1), (10, 2, 3, 15), (2, 0, 0, 0)):
        r, k, n = a + b, a + c, a + b + c + d
        want = sum(math.comb(k, i) * math.comb(n - k, r - i) for i in range(a, min(r, k) + 1)) / math.comb(n, r)
        assert math.isclose(P.hypergeom_upper(a, b, c, d), want)
    assert math.isclose(P.hypergeom_upper(3, 1, 1, 3), 17 / 70)  # the tea tasting of eight cups
    rows = spark.createDataFrame([(1.0, 2, 3, 0.0), (None, 2, 3, 0.0), (1.0, None, 3, 0.0)], "u double, a int, b int, t double")
    assert [x.p is None for x in rows.select(P.u_p("u", "a", "b", "t").alias("p")).collect()] == [False, True, True]
    none = rows.select(P.binomial_p("a", "b").alias("x"), P.wilcoxon_p("u", "a").alias("y"), P.fisher_p("a", "b", "a", "b").alias("z"),
                       P.hypergeom_upper_p("a", "a", "b", "b").alias("w"), P.t_p(P.spearman_t(F.lit(1.0), F.col("a")), F.lit(3.0)).alias("v")).collect()
    assert [n.x is None for n in none] == [False, False, True] and none[1].y is None and none[2].z is None and none[2].w is None
