"""Signal, contrast and reproducibility queries over the lineitem-derived signal matrix."""

from pyspark.sql import functions as F

from regulus.catalog.registry import query, rd
from regulus.operators import expression as X
from regulus.operators import signal as S
from regulus.operators import stats as ST
from regulus.session import cut

STUDIES = ("A", "N", "R")
CONTRASTS = tuple(S.Contrast(s, (s + "O",), (s + "F",)) for s in STUDIES)
PAIRS = (("A", "N"), ("A", "R"), ("N", "R"))
THRESHOLDS = (0.0, 0.25, 0.5, 1.0)


def normalised(t):
    # means and values both need the signal table, which is itself an aggregation: write it once
    return S.mean_one(cut(t("v_signal")), ["sample"], "signal", "norm")


def lfc_long(t, contrasts=CONTRASTS):
    return S.log2_contrasts(normalised(t), "region_id", F.concat("study", "arm"), "norm", contrasts, 0.05)


def lfc_wide(t, contrasts=CONTRASTS):
    """One row per region, one column per contrast."""
    return S.contrast_columns(normalised(t), "region_id", F.concat("study", "arm"), "norm", contrasts, 0.05)


NORM = """norm as (select region_id, study, arm, sample, signal / avg(signal) over (partition by sample) norm from v_signal)"""
LFC = NORM + """, lfc as (select region_id, study contrast, log2((avg(case when arm = 'O' then norm end) + 0.05)
  / (avg(case when arm = 'F' then norm end) + 0.05)) lfc from norm group by 1, 2)"""
WIDE = LFC + """, wide as (select region_id, max(lfc) filter (contrast = 'A') A, max(lfc) filter (contrast = 'N') N,
  max(lfc) filter (contrast = 'R') R from lfc group by 1)"""
PAIRED = WIDE + """, paired as (select 'A' pair_a, 'N' pair_b, A x, N y from wide union all select 'A', 'R', A, R from wide
  union all select 'N', 'R', N, R from wide)"""


@query("a02_mean_one_normalisation", "A2", f"""with {NORM}
select region_id, sample, round(norm, 6) + 0.0 norm from norm""", ("v_signal",))
def _(t):
    return normalised(t).select("region_id", "sample", rd("norm").alias("norm"))


@query("a03_log2_contrast", "A3", f"with {LFC} select region_id, contrast, round(lfc, 6) + 0.0 lfc from lfc", ("v_signal",))
def _(t):
    return lfc_long(t).select("region_id", "contrast", rd("lfc").alias("lfc"))


@query("a04_difference_of_differences", "A4", """with w as (select region_id, study,
   avg(signal) filter (arm = 'O') o, avg(signal) filter (arm = 'F') f from v_signal group by 1, 2),
 c as (select region_id, log2(max(o) filter (study = 'A')) - log2(max(f) filter (study = 'A')) tested,
   avg(case when study <> 'A' then log2(o) - log2(f) end) control from w group by 1)
select region_id, round(tested - control, 6) + 0.0 dod from c where tested is not null and control is not null""", ("v_signal",))
def _(t):
    out = X.difference_of_differences(t("v_signal"), "region_id", "study", "arm", "signal", "O", "F", "A")
    return out.withColumn("dod", rd("dod"))


@query("a05_distribution_summary", "A5", f"""with {LFC} select contrast, count(lfc) n, round(avg(lfc), 6) + 0.0 mean,
 round(stddev_samp(lfc), 6) sd, round(min(lfc), 6) lo, round(max(lfc), 6) hi from lfc group by 1""", ("v_signal",))
def _(t):
    return S.distribution(lfc_long(t), ["contrast"], "lfc").select(
        "contrast", "n", *[rd(c).alias(c) for c in ("mean", "sd", "lo", "hi")])


@query("a06_thresholded_rank_correlation", "A6", f"""with {PAIRED},
 ts(threshold) as (values (0.0::double), (0.25), (0.5), (1.0)),
 f as (select pair_a, pair_b, threshold, x, y from paired, ts where x is not null and y is not null
   and (abs(x) >= threshold or abs(y) >= threshold)),
 r as (select *, rank() over (partition by pair_a, pair_b, threshold order by x)
     + (count(*) over (partition by pair_a, pair_b, threshold, x) - 1) / 2.0 rx,
   rank() over (partition by pair_a, pair_b, threshold order by y)
     + (count(*) over (partition by pair_a, pair_b, threshold, y) - 1) / 2.0 ry from f)
select pair_a, pair_b, threshold, count(*) n, case when count(*) >= 20 then round(corr(rx, ry), 6) + 0.0 end spearman,
 case when count(*) >= 20 then round(corr(x, y), 6) + 0.0 end pearson, count(*) < 20 too_few, false shares_control
from r group by 1, 2, 3""", ("v_signal",))
def _(t):
    out = ST.threshold_correlations(lfc_wide(t), PAIRS, THRESHOLDS, CONTRASTS)
    return out.withColumn("spearman", rd("spearman")).withColumn("pearson", rd("pearson"))


@query("p11_threshold_pair_filter", "P11", f"""with {PAIRED}, ts(threshold) as (values (0.0::double), (0.25), (0.5), (1.0))
select pair_a, pair_b, threshold, count(*) n from paired, ts where x is not null and y is not null
 and (abs(x) >= threshold or abs(y) >= threshold) group by 1, 2, 3""", ("v_signal",))
def _(t):
    return ST.pair_thresholds(lfc_wide(t), PAIRS, THRESHOLDS).groupBy("pair_a", "pair_b", "threshold").agg(
        F.count(F.lit(1)).alias("n"))


@query("a25_concordance", "A25", f"""with {PAIRED}, ts(threshold) as (values (0.25::double), (0.5), (1.0)),
 f as (select * from paired, ts where x is not null and y is not null and abs(x) >= threshold)
select pair_a, pair_b, threshold, count(*) n_a, count(*) filter (abs(y) >= threshold) n_both,
 count(*) filter (abs(y) >= threshold and sign(x) = sign(y)) n_both_same, count(*) filter (sign(x) = sign(y)) n_same,
 round(count(*) filter (abs(y) >= threshold) / count(*), 6) share_both,
 round(count(*) filter (sign(x) = sign(y)) / count(*), 6) share_same from f group by 1, 2, 3""", ("v_signal",))
def _(t):
    out = ST.concordance(lfc_wide(t), PAIRS, (0.25, 0.5, 1.0))
    return out.withColumn("share_both", rd("share_both")).withColumn("share_same", rd("share_same"))


@query("w11_average_rank", "W11", """select o_custkey, o_orderkey, rank() over (partition by o_orderpriority order by o_custkey)
 + (count(*) over (partition by o_orderpriority, o_custkey) - 1) / 2.0 avg_rank from orders""")
def _(t):
    df = t("orders").select("o_orderkey", "o_orderpriority", "o_custkey")
    return ST.add_average_ranks(df, ["o_orderpriority"], {"o_custkey": "avg_rank"}).select(
        "o_custkey", "o_orderkey", "avg_rank")


@query("a49_shared_denominator_null", "A49", f"""with {NORM}, mm as (select region_id, study || arm arm, avg(norm) v from norm group by 1, 2),
 w as (select region_id, max(v) filter (arm = 'AO') ao, max(v) filter (arm = 'NO') no_, max(v) filter (arm = 'RO') ro,
   max(v) filter (arm = 'AF') af, max(v) filter (arm = 'NF') nf, max(v) filter (arm = 'RF') rf from mm group by 1),
 p as (select 'N_vs_Af' pair_a, 'R_vs_Af' pair_b, log2((no_ + 0.05) / (af + 0.05)) x, log2((ro + 0.05) / (af + 0.05)) y from w
  union all select 'N_vs_Nf', 'R_vs_Rf', log2((no_ + 0.05) / (nf + 0.05)), log2((ro + 0.05) / (rf + 0.05)) from w),
 f as (select * from p where x is not null and y is not null),
 r as (select *, rank() over (partition by pair_a order by x) + (count(*) over (partition by pair_a, x) - 1) / 2.0 rx,
  rank() over (partition by pair_a order by y) + (count(*) over (partition by pair_a, y) - 1) / 2.0 ry from f)
select pair_a, pair_b, count(*) n, round(corr(rx, ry), 6) + 0.0 spearman, round(corr(x, y), 6) + 0.0 pearson,
 pair_a = 'N_vs_Af' shares_control from r group by 1, 2""", ("v_signal",))
def _(t):
    cs = (S.Contrast("N_vs_Af", ("NO",), ("AF",)), S.Contrast("R_vs_Af", ("RO",), ("AF",)),
          S.Contrast("N_vs_Nf", ("NO",), ("NF",)), S.Contrast("R_vs_Rf", ("RO",), ("RF",)))
    pairs = (("N_vs_Af", "R_vs_Af"), ("N_vs_Nf", "R_vs_Rf"))
    out = ST.threshold_correlations(lfc_wide(t, cs), pairs, (0.0,), cs)
    return out.select("pair_a", "pair_b", "n", rd("spearman").alias("spearman"), rd("pearson").alias("pearson"),
                      "shares_control")


@query("a64_alternative_control_specificity", "A64", f"""with {NORM}, mm as (select region_id, study || arm arm, avg(norm) v from norm group by 1, 2),
 w as (select region_id, max(v) filter (arm = 'AO') ao, max(v) filter (arm = 'AF') af, max(v) filter (arm = 'NF') nf,
   max(v) filter (arm = 'RO') ro, max(v) filter (arm = 'RF') rf from mm group by 1),
 l as (select log2((ro + 0.05) / (rf + 0.05)) x, log2((ao + 0.05) / (af + 0.05)) y1, log2((ao + 0.05) / (nf + 0.05)) y2 from w),
 p as (select 'A_vs_own' alt, x, y1 y from l union all select 'A_vs_other', x, y2 from l),
 f as (select * from p where x is not null and y is not null),
 r as (select *, rank() over (partition by alt order by x) + (count(*) over (partition by alt, x) - 1) / 2.0 rx,
  rank() over (partition by alt order by y) + (count(*) over (partition by alt, y) - 1) / 2.0 ry from f)
select 'R' pair_a, alt pair_b, count(*) n, round(corr(rx, ry), 6) + 0.0 spearman from r group by 2""", ("v_signal",))
def _(t):
    cs = (S.Contrast("R", ("RO",), ("RF",)), S.Contrast("A_vs_own", ("AO",), ("AF",)),
          S.Contrast("A_vs_other", ("AO",), ("NF",)))
    out = ST.threshold_correlations(lfc_wide(t, cs), (("R", "A_vs_own"), ("R", "A_vs_other")), (0.0,), cs)
    return out.select("pair_a", "pair_b", "n", rd("spearman").alias("spearman"))


@query("a10_per_study_centring", "A10", f"""with {NORM} select region_id, sample,
 round(norm - avg(norm) over (partition by region_id, study), 6) + 0.0 centred from norm""", ("v_signal",))
def _(t):
    return S.centre_within(normalised(t), ["region_id", "study"], "norm", "c").select(
        "region_id", "sample", rd("c").alias("centred"))


@query("a11_arm_balanced_centring", "A11", f"""with {NORM}, m as (select region_id, study, avg(norm) filter (arm = 'O') o,
 avg(norm) filter (arm = 'F') f, avg(norm) a from norm group by 1, 2)
select region_id, sample, round(norm - coalesce(0.5 * (o + f), a), 6) + 0.0 centred from norm join m using (region_id, study)""", ("v_signal",))
def _(t):
    return S.centre_arm_balanced(normalised(t), ["region_id", "study"], "arm", "O", "F", "norm", "c").select(
        "region_id", "sample", rd("c").alias("centred"))


@query("a12_per_study_scale", "A12", """select region_id, sample,
 round(signal / stddev_pop(signal) over (partition by study), 6) + 0.0 scaled from v_signal""", ("v_signal",))
def _(t):
    return S.equalise_scale(t("v_signal"), ["study"], "signal", "scaled").select(
        "region_id", "sample", rd("scaled").alias("scaled"))


@query("a13_library_size", "A13", """with g as (select sample, sum(signal) total, count(*) filter (signal > 20000) detected,
 count(*) features from v_signal group by 1)
select sample, round(total, 2) total, detected, features, round(100.0 * detected / features, 6) pct_detected,
 total between 0.9 * 5e7 and 1.1 * 5e7 near_target from g""", ("v_signal",))
def _(t):
    return X.library_size(t("v_signal"), "sample", "signal", 20000, 5e7).withColumn("total", rd("total", 2)).withColumn("pct_detected", rd("pct_detected"))


@query("a14_unit_conversions", "A14", """with g as (select l_partkey gene, l_returnflag sample, sum(l_quantity) counts from lineitem group by 1, 2),
 r as (select *, p_size * 100.0 len from g join part on p_partkey = gene),
 s as (select *, sum(counts) over (partition by sample) lib, sum(counts / len) over (partition by sample) rate from r)
select gene, sample, round(counts / lib * 1e6, 4) cpm, round(counts / len / rate * 1e6, 4) tpm,
 round(counts / lib / len * 1e9, 4) rpkm, round(log2(counts / len / rate * 1e6 + 1), 6) log2_tpm,
 round(ln(counts / len / rate * 1e6 + 1), 6) log1p_tpm from s""")
def _(t):
    counts = (t("lineitem").groupBy(F.col("l_partkey").alias("gene"), F.col("l_returnflag").alias("sample"))
              .agg(F.sum("l_quantity").alias("counts"))
              .join(t("part").select(F.col("p_partkey").alias("gene"), (F.col("p_size") * 100.0).alias("len")), "gene"))
    u = X.unit_conversions(counts, "sample", "counts", "len")
    return u.select("gene", "sample", *[rd(c, d).alias(c) for c, d in (("cpm", 4), ("tpm", 4), ("rpkm", 4), ("log2_tpm", 6), ("log1p_tpm", 6))])


@query("p13_expressed_filters", "P13", """with g as (select l_partkey gene, count(*) filter (l_quantity > 40) k, bool_or(l_quantity > 49) any_high,
 count(distinct case when l_quantity > 40 then l_returnflag end) studies from lineitem group by 1)
select gene, any_high, k >= 3 at_least_3, studies = (select count(distinct l_returnflag) from lineitem) in_every_study from g""")
def _(t):
    li = t("lineitem").withColumnRenamed("l_partkey", "gene")
    return X.expressed(li, "gene", "l_returnflag", F.col("l_quantity") > 49, F.col("l_quantity") > 40, 3)


@query("p14_complete_cases", "P14", """select region_id, count(*) n_values from v_signal group by 1
 having count(signal) = (select count(distinct sample) from v_signal)""", ("v_signal",))
def _(t):
    return X.complete_cases(t("v_signal"), "region_id", "sample", "signal")


@query("p17_masked_response", "P17", f"""with {LFC}, flagged as (select distinct l_partkey region_id from lineitem where l_discount >= 0.09)
select region_id, contrast, round(case when f.region_id is not null or contrast <> 'A' then lfc end, 6) + 0.0 lfc
from lfc left join flagged f using (region_id)""", ("v_signal",))
def _(t):
    flagged = (t("lineitem").where("l_discount >= 0.09").select(F.col("l_partkey").alias("region_id")).distinct()
               .withColumn("in_assay", F.lit(True)))
    keep = F.coalesce("in_assay", F.lit(False)) | (F.col("contrast") != "A")
    return lfc_long(t).join(flagged, "region_id", "left").select(
        "region_id", "contrast", rd(F.when(keep, F.col("lfc"))).alias("lfc"))


@query("p08_study_status_tags", "P8", """select sample, case when sample like 'A%' then 'own' when sample like 'N%' then 'neighbour' else 'other' end study_tag,
 case when substring(sample, 2, 1) = 'O' then 'on' else 'off' end status, count(*) n from v_signal group by 1""", ("v_signal",))
def _(t):
    s = F.col("sample")
    return (t("v_signal").groupBy("sample").agg(F.count(F.lit(1)).alias("n"))
            .select("sample", X.prefix_tag(s, {"A": "own", "N": "neighbour"}, "other").alias("study_tag"),
                    X.prefix_tag(F.substring(s, 2, 1), {"O": "on"}, "off").alias("status"), "n"))
