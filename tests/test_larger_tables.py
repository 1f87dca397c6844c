"""Queries against their SQL on rows that the generated tables at small sizes do not have."""

import random

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from regulus.catalog.metadata import differential
from regulus.operators import expression as X
from regulus.operators import intervals as I
from regulus.operators import nulls as N
from regulus.sources.fixtures import Tables


def same_as_sql(spark, path, key, table, rows, ddl):
    spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{path}/{table}.parquet")
    df = entry.queries()[key](spark, str(path))
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{path}/{table}.parquet/*.parquet'")
    rel = con.sql(entry.oracle_sql()[key])
    at = [list(rel.columns).index(c) for c in df.columns]
    got = sorted(tuple(r) for r in df.collect())
    assert got and got == sorted(tuple(r[i] for i in at) for r in rel.fetchall())
    return got


def test_rules_for_large_keys_and_odd_names(spark, tmp_path):
    names = [f"Customer#{k:09d}" for k in (0, 7, 99, 100, 117, 9999, 10000, 11127, 90010, 123456789, 100000077)]
    names += ["", "Customer", "Customer#0000000", "Customer#00000000", "Customer#000000017\n", "Customer#000012348\n", "7", "x" * 14 + "\n\n", None]
    got = same_as_sql(spark, tmp_path, "p03_ordered_rules", "customer", list(enumerate(names)), "c_custkey long, c_name string")
    assert dict(got)[6] == "twin"


def orders():
    """Two labels, one load, ten seeds; for some seeds both arrangements have the same prices, so their difference is 0."""
    for label in (0, 1):
        for cust in range(0, 30, 3):
            for status in "FO":
                for variant in (0, 1):
                    same = cust % 10 in (1, 4, 8 - label)
                    price = 1000.0 * (1 + variant) + 37.25 * cust * (1 + variant) + (0.0 if same or status == "F" else (1 + variant) * (3.5 * cust * cust - 400))
                    yield 14 * cust + label + 7 * variant, cust, status, price


def test_zero_differences_are_no_pairs(spark, tmp_path):
    for i, key in enumerate(("a39_paired_battery", "u03_sign_and_wilcoxon_p")):
        same_as_sql(spark, tmp_path / str(i), key, "orders", list(orders()), "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double")


def test_averages_on_a_threshold_do_not_depend_on_partitions(spark, tmp_path):
    # one discount of every part in each of eight files; their sums differ in the last digit with the order of the additions
    r = random.Random(1)
    rows = [(part, "N", 40000.0, r.randrange(11) / 100) for _ in range(8) for part in range(200)]
    ddl = "l_partkey long, l_returnflag string, l_extendedprice double, l_discount double"
    spark.createDataFrame(spark.sparkContext.parallelize(rows, 8), ddl).write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {part: sum_in_order([x[3] for x in rows if x[0] == part]) / 8 for part in range(200)}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "4m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = {r.region: r.p for r in differential(Tables(spark, str(tmp_path))).collect()}
            assert got == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def sum_in_order(values):
    total = 0.0
    for v in values:
        total += v
    return total


def test_means_are_added_in_the_given_order(spark):
    rows = [(i, g, v) for g in range(5) for i, v in enumerate([0.1, 1e16, -1e16, 0.7, None, 0.3])]
    df = spark.createDataFrame(rows, "i int, g int, v double").repartition(7)
    want = sum_in_order([0.1, 1e16, -1e16, 0.7, 0.3]) / 5
    assert {r.m for r in X.means_in_order(df, ["g"], [F.col("i")], m=F.col("v")).collect()} == {want}


def test_counts_of_several_spans_at_once(spark):
    loci = [(1, "a", 0, 10, 5, 6), (1, "a", 0, 10, 5, 6), (2, "a", 200_000, 300_000, -50, 3), (3, "b", 0, 9, 0, 1), (4, None, 0, 9, 0, 9), (5, "a", None, 9, 0, 9)]
    runs = [("a", -60, -40), ("a", 2, 4), ("a", 5, 5), ("a", 5, 8), ("a", 250_000, 250_001), ("a", 70_000, 270_000), ("c", 0, 9)]
    lo = spark.createDataFrame(loci, "locus int, contig string, ls long, le long, ps long, pe long")
    iv = spark.createDataFrame(runs, "contig string, s long, e long")
    got = I.count_overlaps_of(lo, iv, "contig", {"x": ("ls", "le"), "y": ("ps", "pe")}, ("s", "e")).select("locus", "x", "y").collect()

    def hits(contig, a, b):
        return sum(c == contig and s < b and e > a and s < e for c, s, e in runs)

    assert sorted(map(tuple, got))[:5] == sorted((k, hits(c, ls, le), hits(c, ps, pe)) for k, c, ls, le, ps, pe in loci[:5])


def test_equal_predictions_of_one_arrangement_leave_the_exact_distribution(spark, tmp_path):
    # ten groups of one order each; all of F have one price, none of O has it
    rows = [(14 * c + label, c, s, 250000.0 if s == "F" else 200000.0 + 12345.5 * c * (label + 1)) for label in (0, 1) for c in range(0, 15, 3) for s in "FO"]
    rows += [(14 * c, c, s, p) for c, s, p in ((1, "F", 1e5), (11, "F", 1e5), (4, "O", 3e5), (12 + 10, "O", 3e5))]
    same_as_sql(spark, tmp_path, "u03_exact_u_p", "orders", rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double")


def test_predictions_are_summed_in_the_order_of_the_table(spark, tmp_path):
    # the same prices for every customer, in another order; averages differ in their last digits only, and with the order of the additions
    r = random.Random(2)
    prices = [r.randrange(100, 50_000_000) / 100 for _ in range(64)]
    rows = [(14 * i, c, "F", p) for i in range(8) for c in range(30) for p in (prices[c:] + prices[:c])[8 * i:8 * i + 8]]
    ddl = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double"
    spark.createDataFrame(spark.sparkContext.parallelize(rows, 8), ddl).write.parquet(f"{tmp_path}/orders.parquet")
    want = {(c % 3 * 4 + 4, c % 10): sum_in_order([x[3] for x in rows if x[1] == c]) / 64 / 100000 for c in range(30)}
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    rel = con.sql(entry.oracle_sql()["a44_dose_response"])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "4m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert {(x.load, x.seed): x.pred for x in Tables(spark, str(tmp_path))("v_combo").collect()} == want
            got = entry.queries()["a44_dose_response"](spark, str(tmp_path))
            assert [tuple(x) for x in got.select(*rel.columns).collect()] == rel.fetchall()
            rel = con.sql(entry.oracle_sql()["a44_dose_response"])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_values_drawn_for_many_seeds_are_not_broadcast(spark, monkeypatch):
    # the planner takes the drawn side for as small as its table, whatever the number of seeds
    df = spark.range(60).select((F.col("id") % 2).alias("g"), "id", (F.col("id") * 10).alias("v"))
    few = N.shuffle_within(df, ["g"], "id", "v", range(50))
    monkeypatch.setattr(N, "with_size_hint", lambda x: x)
    many = N.shuffle_within(df, ["g"], "id", "v", range(50))
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
    rows = sorted(map(tuple, many.select("g", "id", "seed", "shuffled").collect()))
    assert len(rows) == 3000 and rows == sorted(map(tuple, few.select("g", "id", "seed", "shuffled").collect()))
