"""Sites over chunk borders against whole sequences; alias classes and statistics against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from regulus.operators import metadata as M
from regulus.operators.motifs import motif_from_word, scan_chunks, scan_hits
from regulus.sources.genome import split_chunks

MOTIFS = [motif_from_word("a", "TGACTCA"), motif_from_word("b", "GGGACTTTCC")]


def rows(df):
    return Counter((r.contig, r.motif, r.start, r.strand, round(r.rel, 9)) for r in df.collect())


@pytest.mark.parametrize("chunk", [3, 9, 10, 64, 1000])
def test_sites_do_not_depend_on_chunks(spark, chunk):
    r = random.Random(5)
    seqs = [(k, "".join(r.choice("ACGTNacgt") for _ in range(n))) for k, n in (("c1", 400), ("c2", 64), ("c3", 7), (None, 200), ("c4", 130))]
    seqs += [("c5", "TGACTCA" * 30), ("c6", ""), ("c7", None)]
    df = spark.createDataFrame(seqs, "contig string, seq string").withColumn("d", F.lit("clash"))
    got = rows(scan_chunks(split_chunks(df, ["contig"], F.col("seq"), chunk), ["contig"], chunk, MOTIFS, 0.6))
    want = rows(scan_hits(df, "contig", MOTIFS, 0.6))
    assert got == want and len(want) > 50 and any(k[0] is None for k in want)


def test_missing_and_short_chunks_are_unknown(spark):
    # the site TGACTCA lies over a border; with the middle chunk gone, or cut short, nothing may be joined over the gap
    parts = [("x", 0, "AAAATGAC"), ("x", 1, "TCAAAAAA"), ("y", 0, "AAAATGAC"), ("y", 2, "TCAAAAAA"), ("z", 0, "AAATGAC"), ("z", 1, "TCAAAAAA"), ("w", 1, None)]
    got = rows(scan_chunks(spark.createDataFrame(parts, "contig string, chunk_id long, seq string"), ["contig"], 8, MOTIFS[:1], 0.99))
    assert [k[:4] for k in got] == [("x", "a", 4, "+")]


REG = [("A", "a1|a2", "x", "Approved"), ("B", "b1", "x|a2", "Approved"), ("C", "A|c1 | c2", None, "Approved"), ("W", "w1|b1", "old", "Withdrawn"), ("V", "", " ", None), (None, "n1", None, "Approved")]
OBS = [("s", "a1", 1.0), ("s", "A", 2.0), ("t", "a1", 5.0), ("t", "a1", 3.0), ("t", "b1", 1.0), ("t", "B", 1.0), ("t", "x", 1.0), ("s", "c2", 1.0), ("s", "c1", 4.0),
       ("s", "old", 1.0), ("s", "never", 1.0), ("s", "W", 1.0), (None, "c1", 1.0), (None, "C", 2.0), ("s", None, 1.0)]


def test_old_names(spark):
    reg = spark.createDataFrame(REG, "symbol string, prev string, alias string, status string")
    got = {r.old: (r.kind, r.target) for r in M.old_name_classes(reg, "symbol", ["prev", "alias"], "status").collect()}
    assert got == {"A": ("approved", None), "B": ("approved", None), "C": ("approved", None), "a1": ("unique", "A"), "a2": ("ambiguous", None), "x": ("ambiguous", None),
                   "b1": ("unique", "B"), "c1": ("unique", "C"), "c2": ("unique", "C"), "W": ("withdrawn", None), "w1": ("withdrawn", None), "old": ("withdrawn", None),
                   "V": ("withdrawn", None), "n1": ("withdrawn", None)}
    # without a status the withdrawn record is a target like any other
    plain = {r.old: r.kind for r in M.old_name_classes(reg, "symbol", ["prev", "alias"]).collect()}
    assert plain["b1"] == "ambiguous" and plain["w1"] == "unique" and plain["W"] == "approved"


def test_statistics(spark):
    reg = spark.createDataFrame(REG, "symbol string, prev string, alias string, status string")
    obs = spark.createDataFrame(OBS, "source string, symbol string, v double")
    args = (obs, "source", "symbol", "v", reg, "symbol", ["prev", "alias"], "status")
    got = {r.source: r.asDict() for r in M.harmonise_statistics(*args).collect()}
    # s: a1 meets its own A (collision); c1 and c2 both become C (one merged); t: a1 twice becomes A (one merged), b1 meets B
    assert got["s"] == dict(source="s", n_rows=8, merged=1, renamed=2, collisions=1, not_approved=5, ambiguous=0, withdrawn=2, unknown=2)
    assert got["t"] == dict(source="t", n_rows=5, merged=1, renamed=2, collisions=1, not_approved=2, ambiguous=1, withdrawn=0, unknown=0)
    assert got[None] == dict(source=None, n_rows=2, merged=0, renamed=0, collisions=1, not_approved=1, ambiguous=0, withdrawn=0, unknown=0)
    h = {(r.source, r.symbol): (r.v, r.n_merged, r.action) for r in M.harmonise(*args).collect()}
    assert h["s", "C"] == (4.0, 2, "renamed") and h["t", "A"] == (5.0, 2, "renamed") and h[None, "C"] == (2.0, 1, "kept") and h["s", "a1"] == (1.0, 1, "collision")
    assert M.harmonise_statistics(obs.limit(0), *args[1:]).count() == 0
