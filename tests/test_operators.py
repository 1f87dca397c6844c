"""Edge fixtures of the operators, published values and distribution tails."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from regulus.functions import sequence as Q
from regulus.functions import special as P
from regulus.operators import design as D
from regulus.operators import intervals as I
from regulus.operators import metadata as M
from regulus.operators import motifs as MO
from regulus.operators import nulls as N
from regulus.operators import stats as ST
from regulus.sources import readers as R
from regulus.sources import sinks as K

# Published per-seed effects of the best pair and the best single condition.
PAIR = [0.41664999999999996, 0.7569614000000001, 0.6382003, 0.7830469999999999, 0.5618259, 0.59175906, 0.93370814, 0.80386174, 0.51914137, 0.65147206]
SINGLE = [0.4932333, 0.46062636, 0.60462567, 0.6531057, 0.44478384, 0.5884967, 0.95849518, 0.5577639, 0.51417676, 0.742624]


def test_paired_battery_matches_published(spark):
    df = spark.createDataFrame([("k", i, a - b) for i, (a, b) in enumerate(zip(PAIR, SINGLE))], "g string, seed int, d double")
    r = D.paired_battery(df, ["g"], "d").select("*", P.t_p("t", "df").alias("p_t"), P.t_crit("df").alias("crit"),
                                                P.wilcoxon_p("w_plus", "n").alias("p_w"), P.binomial_p("n_pos", "n").alias("p_s")).collect()[0]
    assert r["mean"] == pytest.approx(0.06386955599999997, abs=1e-7) and r.sd == pytest.approx(0.13086023404308691, abs=1e-7)
    assert r.t == pytest.approx(1.5434273947360635, abs=1e-5) and r.p_t == pytest.approx(0.15712236210186695, rel=1e-5)
    assert min(r.w_plus, r.w_minus) == 14.0 and r.p_w == pytest.approx(0.193359375)
    assert r.n_pos == 7 and r.p_s == pytest.approx(0.34375)
    assert r["mean"] - r.crit * r.sem == pytest.approx(-0.02974221613965973, abs=1e-6)


def test_saturation_matches_published(spark):
    # Adjusted effect at four loads of two motifs, and the published gains.
    curve = [("CEBPB", 6, 0.1876606792211532), ("CEBPB", 12, 0.5836732983589172), ("CEBPB", 18, 0.35845547914505005), ("CEBPB", 20, 0.25758495926856995),
             ("ETS1", 6, 0.2277075052261352), ("ETS1", 12, 0.2146761864423751), ("ETS1", 18, 0.15405242145061493)]
    got = {(r.c, r.load_from): r.gain_per_copy for r in D.saturation(spark.createDataFrame(curve, "c string, k int, v double"), ["c"], "k", "v").collect()}
    assert got["CEBPB", 6] == pytest.approx(0.06600210318962733) and got["CEBPB", 18] == pytest.approx(-0.05043525993824005)
    assert got["ETS1", 12] == pytest.approx(-0.010103960831960029) and len(got) == 5


def test_additivity_matches_published(spark):
    # Two single conditions and one combination at load 6.
    s = spark.createDataFrame([("CEBPB", "single", 6, 0.18766067922115326, 0.048006600095391296), ("ETS1", "single", 6, 0.22770750522613525, 0.06300941833800788),
                               ("CEBPB+ETS1", "clustered", 6, 0.12614408135414124, 0.05564159662257036)], "label string, arr string, k int, adjusted double, adjusted_sem double")
    r = D.additivity(s, "label", ["arr", "k"], ["k"]).collect()[0]
    assert r.expected == pytest.approx(0.20768409222364426, abs=1e-7) and r.expected_sem == pytest.approx(0.03960688214191098, abs=1e-7)
    assert r.obs_over_exp == pytest.approx(0.6073844173789834, abs=1e-6)


def test_enrichment_matches_published(spark):
    # In-motif over out-motif importance of 18 regions.
    v = [2.6916132306439313, 1.8399745682140258, 1.7050510494017757, 3.9850770692738284, 0.8925289325828643, 1.1192448845882383, 1.1492801427543458, 2.4813621090099574, 2.0108326059937696,
         2.0539732308861947, 1.720355682508737, 1.7745258329511728, 4.361991945799131, 1.3994619227796743, 1.4932074765232546, 1.6613527656116114, 1.804950736273973, 1.77035441964021]
    r = D.one_sample(spark.createDataFrame([("g", x) for x in v], "g string, v double"), ["g"], "v", 1.0).withColumn("p", P.t_p("t", "df")).collect()[0]
    assert round(r["mean"], 3) == 1.995
    assert 0.908 in (round(r.sd, 3), round(r.sd * math.sqrt(17 / 18), 3))
    assert round(r.p, 4) == 0.0002


def test_permutation_p_floor(spark):
    null = spark.createDataFrame([("g", i, i / 1000) for i in range(200)], "g string, seed int, rho double")
    r = N.empirical_p(null, spark.createDataFrame([("g", 0.5484)], "g string, rho double"), "rho", ["g"]).collect()[0]
    assert r.n_beating == 0 and r.p == pytest.approx(1 / 201) and round(r.p, 5) == 0.00498 and r.p_floor == r.p


def test_exhaustive_null_of_three_against_three(spark):
    rows = spark.createDataFrame([("g", i, v) for i, v in enumerate([10, 9, 3, 4, 1, 2])], "g string, i int, v long")
    r = N.exact_null(rows, "i", "v", ["g"], 6, 3, 0b000111).collect()[0]
    assert (r.n_partitions, r.p_floor) == (20, 0.05)
    # {10, 9, 3} is beaten by {10, 9, 4} only
    assert r.n_at_least == 2 and r.p == pytest.approx(0.1)


def test_shuffle_is_a_permutation_within_groups(spark):
    df = spark.range(300).select((F.col("id") % 2).alias("g"), "id", (F.col("id") * 10).alias("v"))
    out = N.shuffle_within(df, ["g"], "id", "v", (1, 2)).collect()
    for seed in (1, 2):
        for g in (0, 1):
            got = [r for r in out if r.seed == seed and r.g == g]
            assert sorted(r.shuffled for r in got) == [i * 10 for i in range(300) if i % 2 == g]
            assert any(r.shuffled != r.v for r in got)


def test_tails():
    assert P.t_two_sided(2.0, 10) == pytest.approx(0.07338803477074037, rel=1e-9)
    assert P.t_two_sided(0.0, 5) == pytest.approx(1.0) and math.isnan(P.t_two_sided(math.nan, 5))
    assert P.t_quantile(0.975, 9) == pytest.approx(2.2621571628, rel=1e-8)
    assert P.normal_two_sided(1.96) == pytest.approx(0.04999579, rel=1e-6)
    assert P.fisher_two_sided(8, 2, 1, 5) == pytest.approx(0.03496503496503495, rel=1e-9)


def test_asof_is_not_containment(spark):
    iv = spark.createDataFrame([("a", 0, 100, 1), ("a", 40, 50, 2)], "contig string, s long, e long, id long")
    pt = spark.createDataFrame([("a", 60), ("a", 45), ("b", 5)], "contig string, pos long")
    flag = {(r.contig, r.pos): r.hit for r in I.flag_points(pt, iv, "contig", "pos", "s", "e", "hit").collect()}
    asof = {(r.contig, r.pos): r.id for r in I.last_started(pt, iv, "contig", "pos", "s", "e", ["id"]).collect()}
    assert flag == {("a", 60): True, ("a", 45): True, ("b", 5): False}
    assert asof == {("a", 60): None, ("a", 45): 2, ("b", 5): None}


def test_nearest_tie_and_missing_contig(spark):
    t = spark.createDataFrame([("a", 10), ("a", 20)], "contig string, s long")
    p = spark.createDataFrame([("a", 15), ("a", 18), ("b", 1)], "contig string, pos long")
    got = {(r.contig, r.pos): (r.nearest, r.distance) for r in I.nearest(p, t, "contig", "pos", "s").collect()}
    assert got == {("a", 15): (10, 5), ("a", 18): (20, 2), ("b", 1): (None, None)}


def test_same_sample_cannot_support_itself(spark):
    df = spark.createDataFrame([("s1", "a", 0, 10), ("s1", "a", 5, 15), ("s2", "a", 12, 20)], "sample string, contig string, s long, e long")
    assert [(r.start, r.end) for r in I.consensus(df, "sample", "contig", "s", "e", 2).collect()] == [(12, 15)]


def test_summit_median_is_truncated(spark):
    df = spark.createDataFrame([("a", 10, "x"), ("a", 15, "y"), ("a", 500, "x"), ("a", 505, "x")], "contig string, pos long, sample string")
    assert [(r.summit, r.n_points, r.n_samples) for r in I.summit_clusters(df, "contig", "pos", "sample", 20, 2).collect()] == [(12, 2, 2)]


def test_remap_rules(spark):
    blocks = spark.createDataFrame([(1, "a", 100, 200, "a", 1000, "+"), (2, "a", 150, 250, "a", 5000, "-"), (3, "b", 0, 50, "a", 0, "+")],
                                   "block_id long, src_contig string, src_start long, src_end long, dst_contig string, dst_start long, strand string")
    pts = spark.createDataFrame([(1, "a", 160), (2, "a", 240), (3, "b", 10), (4, "a", 99)], "id long, contig string, pos long")
    got = {r.id: r.mapped for r in I.remap(pts, blocks, "id", "contig", "pos").collect()}
    assert got == {1: 1060, 2: 5009, 3: None, 4: None}
    two = spark.createDataFrame([(1, "a", 5), (2, "a", 5), (3, "a", 6)], "id long, contig string, target long")
    assert [r.id for r in I.drop_collisions(two, "contig", "target").collect()] == [3]


def test_minimum_n_and_one_class(spark):
    wide = spark.createDataFrame([(float(i), float(i * i)) for i in range(19)], "a double, b double")
    r = ST.threshold_correlations(wide, [("a", "b")], [0.0]).collect()[0]
    assert r.n == 19 and r.spearman is None and r.too_few
    wide = spark.createDataFrame([(float(i), float(i * i)) for i in range(20)], "a double, b double")
    r = ST.threshold_correlations(wide, [("a", "b")], [0.0]).collect()[0]
    assert r.spearman == pytest.approx(1.0) and not r.too_few
    one = spark.createDataFrame([("g", float(i), 1.0) for i in range(30)], "g string, s double, m double")
    assert ST.auc_block(one, ["g"], "s", "m", 0.5).collect()[0].auc is None


def test_quantile_buckets_drop_repeated_edges(spark):
    df = spark.createDataFrame([("g", v) for v in [0.0] * 6 + [1.0, 2.0, 3.0, 4.0]], "g string, v double")
    got = {(r.v, r.bucket) for r in ST.quantile_buckets(df, ["g"], "v", 4).collect()}
    # edges 0, 0, 0, 1.75, 4 -> 0, 1.75, 4
    assert got == {(0.0, 0), (1.0, 0), (2.0, 1), (3.0, 1), (4.0, 1)}


def naive_hits(seq, m, cutoff):
    out = []
    for strand in "+-":
        s = seq if strand == "+" else seq[::-1].translate(str.maketrans("ACGTN", "TGCAN"))
        for i in range(len(s) - m.length + 1):
            word = s[i:i + m.length]
            if set(word) <= set("ACGT"):
                rel = (sum(m.weights["ACGT".index(b), j] for j, b in enumerate(word)) - m.low) / (m.high - m.low)
                if rel >= cutoff:
                    out.append((i if strand == "+" else len(seq) - i - m.length, strand, round(rel, 9)))
    return sorted(out)


def test_motif_scan_edges(spark):
    m = MO.motif_from_word("NFKB", "GGGACTTTCC")
    rng = np.random.default_rng(5)
    seqs = {1: "N" * 40, 2: "ACGT" * 5 + "GGGACTTTCC" + "ACGT" * 5, 3: "TTTT" + "GGAAAGTCCC" + "TTTT", 4: "GGGACTNTCCAAAA", 5: "ACG",
            **{i: "".join(rng.choice(list("ACGTN"), 300, p=[.24, .24, .24, .24, .04])) for i in range(6, 16)}}
    df = spark.createDataFrame(list(seqs.items()), "id long, seq string").coalesce(1)
    hits = MO.scan_hits(df, "id", [m], 0.6).collect()
    best = {r.id: r for r in MO.scan_best(df, "id", [m], [0.6, 0.9]).collect()}
    for i, s in seqs.items():
        want = naive_hits(s, m, 0.6)
        assert sorted((r.start, r.strand, round(r.rel, 9)) for r in hits if r.id == i) == want
        assert best[i].n_60 == len({start for start, _, _ in want})  # the better strand of a position counts
        if want:
            top = max(w[2] for w in want)
            assert round(best[i].best_rel, 9) == top and best[i].best_pos == min(w[0] for w in want if w[2] == top)
    assert best[1].best_rel is None and best[5].best_pos is None and best[3].best_pos == 4


def test_sequence_expressions(spark):
    df = spark.createDataFrame([("ACGTN", "AAAAAAAAAAAA")], "s string, bg string")
    r = df.select(Q.reverse_complement(F.col("s")).alias("rc"), Q.replace_at(F.col("bg"), F.lit(3), F.lit("CGT")).alias("over"),
                  Q.scramble(F.lit("AACCGT"), F.lit(3)).alias("mix"), Q.sanitise(F.lit("ACRYn")).alias("clean"),
                  Q.build_cassette(F.col("bg"), F.array(F.lit("CC"), F.lit("GG")), F.lit(4), F.lit("clustered"), F.lit("real"), F.lit(1)).alias("clustered"),
                  Q.build_cassette(F.col("bg"), F.array(F.lit("CC"), F.lit("GG")), F.lit(4), F.lit("interleaved"), F.lit("real"), F.lit(1)).alias("inter")).collect()[0]
    assert r.rc == "NACGT" and r.over == "AAACGTAAAAAA" and sorted(r.mix) == sorted("AACCGT") and r.clean == "ACNNN"
    assert r.clustered == "CCACCAGGAGGA" and r.inter == "CCAGGACCAGGA"


def test_aliases(spark):
    reg = spark.createDataFrame([("CXCL8", "IL8"), ("B", "OLD|SHARED"), ("C", "SHARED|CXCL8")], "symbol string, prev string")
    al = {r.old: r.target for r in M.alias_table(reg, "symbol", ["prev"]).collect()}
    assert al == {"IL8": "CXCL8", "OLD": "B"}  # SHARED is ambiguous, CXCL8 is itself approved
    obs = spark.createDataFrame([("s1", "IL8", 2.0), ("s2", "IL8", 2.0), ("s2", "CXCL8", 1.0)], "src string, symbol string, v double")
    got = {(r.src, r.symbol): r.action for r in M.harmonise(obs, "src", "symbol", "v", reg.withColumnRenamed("symbol", "sym"), "sym", ["prev"]).collect()}
    assert got == {("s1", "CXCL8"): "renamed", ("s2", "IL8"): "collision", ("s2", "CXCL8"): "kept"}


def test_keyword_presets(spark):
    df = spark.createDataFrame([("Etoposide treated, RAS line",), ("uncommitted cells",), ("committed cells",), ("young",), ("x",)], "t string")
    got = [tuple(r) for r in df.select(M.keyword_tags(F.col("t"), M.INDUCTION_KEYWORDS), M.negated_status(
        F.col("t"), "uncommitted", M.SENESCENT_KEYWORDS, M.PROLIFERATING_KEYWORDS, ("not senescent", "senescent", "proliferating"))).collect()]
    assert got[0][0] == "oncogene-induced (OIS);therapy-induced (TIS)"
    assert [g[1] for g in got] == ["", "not senescent", "senescent", "proliferating", ""]


def test_readers_from_files(spark, tmp_path):
    (tmp_path / "peaks").mkdir()
    (tmp_path / "peaks" / "s1.narrowPeak").write_text("chr1\t10\t20\tp\t0\t.\t1\t1\t1\t4\nchrUn\t1\t2\tp\t0\t.\t1\t1\t1\t1\nchr2\t5\n")
    assert [tuple(r) for r in R.read_summits(spark, str(tmp_path / "peaks")).collect()] == [("s1", "chr1", 14)]
    assert R.read_intervals(spark, str(tmp_path / "peaks")).count() == 1
    (tmp_path / "soft.txt").write_text("^SERIES = S\n!Series_title = t\n^SAMPLE = G1\n!Sample_title = one\n!ch = a: 1\n!ch = b: 2\n^SAMPLE = G2\n!Sample_title = two\n")
    e = {(r.entity, r.key): r["values"] for r in R.entities_from_blocks(R.read_entity_blocks(spark, str(tmp_path / "soft.txt")), "SAMPLE").collect()}
    assert e == {("G1", "Sample_title"): ["one"], ("G1", "ch"): ["a: 1", "b: 2"], ("G2", "Sample_title"): ["two"]}
    (tmp_path / "t.bg").write_text("chr1\t0\t10\t1.5\nchr1\t10\t20\tNaN\n")
    assert [r.value for r in R.read_track(spark, str(tmp_path / "t.bg")).collect()] == [1.5, None]


def test_bed_and_bundle(spark, tmp_path):
    df = spark.createDataFrame([("chr1", 1, 10, "g", None)], "c string, s long, e long, a string, b string")
    K.write_bed(K.bed_lines(df, "c", "s", "e", "a", "b"), str(tmp_path / "bed"))
    assert spark.read.text(str(tmp_path / "bed")).collect()[0][0] == "chr1\t0\t10\tg|NA"
    var = spark.createDataFrame([(1, "train"), (2, "test")], "region_id long, split string")
    x = spark.createDataFrame([(1, "k", 0.5), (2, "k", None)], "region_id long, task string, v double")
    K.write_bundle(spark.createDataFrame([("k",)], "task string"), var, x, {"a": "b"}, str(tmp_path / "bundle"))
    _, v, xx = K.read_bundle(spark, str(tmp_path / "bundle"))
    assert v.count() == 2 and xx.where("v is null").count() == 1 and K.filled(xx, "v").where("v = 0").count() == 1
