"""Remapped spans, distance summaries and promoter windows on small tables with NULLs."""

from pyspark.sql import functions as F

from regulus.operators import intervals as I


def test_span_integrity(spark):
    blocks = spark.createDataFrame([(1, "c", 0, 100, "c", 1000, "+"), (2, "c", 100, 200, "c", 5000, "+"), (3, "c", 300, 400, "c", 0, "-")],
                                   "block_id int, src_contig string, src_start long, src_end long, dst_contig string, dst_start long, strand string")
    # inside one block, over two blocks far apart, one end unmapped, on the reverse strand, unknown contig
    points = spark.createDataFrame([(1, "c", 10), (2, "c", 95), (3, "c", 195), (4, "c", 320), (5, None, 10)], "pid int, contig string, pos long")
    assert tuple(I.span_integrity(points, blocks, "pid", "contig", "pos", 11, 2).first()) == (5, 3, 2)


def test_distance_summary_and_promoter(spark):
    near = spark.createDataFrame([("a", 1), ("a", 5), ("a", 100), ("a", None), (None, 7), ("b", None)], "k string, d long")
    got = {r.k: tuple(r)[1:] for r in I.distance_summary(near, ["k"], "d", 5).collect()}
    assert got == {"a": (4, 2, 0.5, 5.0), None: (1, 0, 0.0, 7.0), "b": (1, 0, 0.0, None)}
    genes = spark.createDataFrame([(100, 900, True), (100, 900, False), (1, 2, None)], "s long, e long, plus boolean")
    rows = genes.select(I.promoter(F.col("s"), F.col("e"), F.col("plus"), 50, 10).alias("p")).collect()
    assert [r.p and tuple(r.p) for r in rows] == [(100, 50, 110), (900, 890, 950), None]
