"""Splits, candidates, curves, units, slices, roles and gates on small tables with NULLs."""

import pytest
from pyspark.sql import functions as F

from regulus.operators import design as D
from regulus.operators import expression as X
from regulus.operators import metadata as M
from regulus.operators import model as U
from regulus.operators import selection as S


def test_split_and_audit(spark):
    rows = [("c0", "a"), ("c0", "a"), ("c1", "a"), ("c1", "b"), ("c9", None), ("c9", "d"), (None, "d")]
    d = spark.createDataFrame(rows, "contig string, k string").withColumn("split", S.contig_split(F.col("contig"), {"test": ["c0"], "val": ["c1"]}, "train"))
    assert {r.split: (r.n, r.n_keys, r.n_shared) for r in S.split_audit(d, "split", "k").collect()} == {
        "test": (2, 1, 1), "val": (2, 2, 1), "train": (2, 1, 1), None: (1, 1, 1)}
    with pytest.raises(ValueError):
        S.contig_split(F.col("contig"), {"test": ["c0"], "val": ["c0"]}, "train")


def test_candidates(spark):
    rows = [(1, 0.9, 10), (2, 0.7, 10), (3, float("nan"), 10), (4, float("inf"), 10), (5, None, 10), (6, 0.8, 21), (7, 0.8, 20), (8, 0.8, None)]
    d = spark.createDataFrame(rows, "i int, score double, pos int")
    assert sorted(r.i for r in S.candidates(d, "score", 0.8, "pos", 15, 5).collect()) == [1, 7]


def test_curve_union_keeps_null_conditions(spark):
    old = spark.createDataFrame([("x", None, 4, 1.0, 0), ("x", "F", 4, 2.0, 0), ("y", "F", 4, 3.0, 0)], "label string, arr string, load int, v double, more int")
    new = spark.createDataFrame([("x", None, 12, 5.0), ("x", None, 12, 5.0), ("y", "F", 12, 6.0)], "label string, arr string, load int, v double")
    got = sorted((r.origin, r.label, r.arr or "", r.v) for r in S.curve_union(old, new, ["label", "arr"]).collect())
    assert got == [("new", "x", "", 5.0), ("new", "x", "", 5.0), ("new", "y", "F", 6.0), ("old", "x", "", 1.0), ("old", "y", "F", 3.0)]


def test_keys_near(spark):
    diff = spark.createDataFrame([(1, "A", True), (1, "B", False), (2, "B", True), (3, "A", None), (4, "A", True)], "r int, c string, s boolean")
    links = spark.createDataFrame([(1, "g"), (1, "g"), (2, "h"), (3, "i"), (4, None), (None, "j")], "r int, gene string")
    assert [r.gene for r in S.keys_near(diff, links, "r", "c", "s", ["A"], "gene").collect()] == ["g"]


def test_units_and_replication(spark):
    rows = [("a", "l1", 1), ("a", "l1", 2), ("a", None, 3), ("b", "l1", 4), (None, "l1", 5)]
    d = spark.createDataFrame(rows, "study string, line string, id int")
    unit = S.unit_key([(F.col("study") == "a", [F.col("study"), F.col("line")])], [F.col("study"), F.col("id")])
    got = {r.study: (r.n_tasks, r.n_units, r.largest, r.under_replicated) for r in S.replication(d, ["study"], unit, 2).collect()}
    assert got == {"a": (3, 2, 2, False), "b": (1, 1, 1, True), None: (1, 1, 1, True)}


def test_slices(spark):
    d = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0], 0, 2), ([1.0, 2.0, 3.0, 4.0], 1, 1), ([1.0, 2.0], 1, 3), ([1.0], -1, 1), (None, 0, 1)], "x array<double>, lo int, hi int")
    x, lo, hi = F.col("x"), F.col("lo"), F.col("hi")
    got = d.select(U.pool_slice(x, lo, hi), U.pool_slice(x, lo, hi, mirrored=True)).collect()
    assert [tuple(r) for r in got] == [(1.5, 3.5)] + 4 * [(None, None)]


def test_pooling_identity(spark):
    rows = [("a", [1.0, 2.0]), ("a", [3.0, 6.0]), (None, [0.0, 0.0]), ("b", None), ("b", [1.0])]
    d = spark.createDataFrame(rows, "g string, x array<double>")
    got = {r.g: (r.of_mean, r.mean_of, r.identical) for r in U.pooling_identity(d, ["g"], "x", [0.5, 0.25], 1.0).collect()}
    assert got == {"a": (3.0, 3.0, True), None: (1.0, 1.0, True)}


def test_roles_by_arm(spark):
    rows = [("RIS", 0), ("RIS", 10), ("RIS", None), ("CD", 1), ("CD", 9), ("T", 0), ("new", 1), (None, 1)]
    d = spark.createDataFrame(rows, "arm string, day int")
    base, early = F.col("day") == 0, F.col("day") < 5
    arms = [M.Arm("RIS", "as_on", "ris_senescent", base, "ris_baseline"), M.Arm("CD", "third_class", "quiescent", early, "not_yet"), M.Arm("T", "as_off", "t")]
    got = [(r.cls, r.role) for r in M.roles_by_arm(d, "arm", arms, "off", "on").collect()]
    e, out = "train_eligible", ("UNKNOWN ARM", "excluded")
    assert got == [("off", e), ("on", e), ("on", e), ("not_yet", "excluded"), ("quiescent", e), ("off", e), out, out]
    held = [M.Arm("RIS", "holdout", "ris_senescent", base, "ris_baseline"), M.Arm("CD", "exclude", "quiescent")]
    assert [(r.cls, r.role) for r in M.roles_by_arm(d.limit(4), "arm", held, "off", "on").collect()] == [
        ("ris_baseline", "holdout"), ("ris_senescent", "holdout"), ("ris_senescent", "holdout"), ("quiescent", "excluded")]


def test_gate_stops_or_lets_through(spark):
    rows = [(m, on, v and v + (5.0 if on and m == "up1" else 0.0)) for m in ("up1", "flat") for on in (True, False) for v in (1.0, 1.1, 0.9, None)]
    d = spark.createDataFrame(rows, "m string, is_on boolean, v double")
    gate = X.marker_gate(d, "m", "v", F.col("is_on"), ["up1"], ["flat", "absent"], 1.96)
    assert {r.m: (r.direction, r.passes) for r in gate.collect()} == {"up1": ("UP", True), "flat": ("NONE", False), "absent": ("NONE", False)}
    assert X.behind_gate(d, gate.where("m = 'up1'"), "m", "passes").count() == len(rows)
    for bad, text in ((gate, "absent, flat"), (gate.where("false"), "no marker")):
        with pytest.raises(Exception, match=text):
            X.behind_gate(d, bad, "m", "passes").collect()


def test_affinity_effect(spark):
    rows = [(1.0, 3.0, True, 0), (2.0, 2.0, True, 1), (3.0, 1.0, True, 5), (9.0, 9.0, False, 7), (None, 1.0, True, 9), (1.0, None, True, 9)]
    d = spark.createDataFrame(rows, "a double, e double, mut boolean, made int")
    got = {r.subset: r for r in D.affinity_effect(d, "a", "e", F.col("mut"), ["made"]).collect()}
    assert got["mutant"].n == 3 and got["mutant"].spearman == -1.0 and got["mutant"].made_mean == 2.0
    assert got["all"].n == 4 and got["all"].e_max == 9.0 and got["all"].made_max == 7 and abs(got["all"].spearman - 0.2) < 1e-12
