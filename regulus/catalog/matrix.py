"""Matrix statistics, ROC/AUC, buckets and model evaluation."""

from pyspark.sql import functions as F

from regulus.catalog.registry import query, rd
from regulus.operators import expression as X
from regulus.catalog.signal import LFC, NORM, PAIRED, WIDE, lfc_wide, normalised
from regulus.operators import matrix as M
from regulus.operators import stats as ST
from regulus.plans.ordered import add_average_ranks, exact_percentiles
from regulus.session import cut, lookup_join

SAMPLES = tuple(f"{s}{a}{k}" for s in "ANR" for a in "FO" for k in "01")
SIG = ("v_signal",)
WHOLE = NORM + """, whole as (select * from norm where region_id in (select region_id from norm group by 1 having count(*) = 12))"""


def whole(t):
    return M.dense_rows(normalised(t), "region_id", "sample", "norm", SAMPLES)


def ranked_whole(t):
    """Rank per sample first; the ranked table is dense again because ranks keep every row."""
    n = normalised(t).select("region_id", "sample", "norm")
    full = n.join(n.groupBy("region_id").agg(F.count("norm").alias("k")).where("k = 12").drop("k"), "region_id", "left_semi")
    ranks = add_average_ranks(cut(full), ["sample"], {"norm": "rnk"})
    return M.dense_rows(ranks, "region_id", "sample", "rnk", SAMPLES)


@query("a07_sample_correlation_matrix", "A7", f"""with {WHOLE},
 r as (select region_id, sample, rank() over (partition by sample order by norm) + (count(*) over (partition by sample, norm) - 1) / 2.0 k from whole)
select a.sample sample_i, b.sample sample_j, count(*) n, round(corr(a.k, b.k), 6) + 0.0 spearman
from r a join r b on a.region_id = b.region_id and a.sample < b.sample group by 1, 2""", SIG)
def _(t):
    return M.correlation_matrix(ranked_whole(t), SAMPLES).select("sample_i", "sample_j", "n", rd("r").alias("spearman"))


@query("a07_within_between_groups", "A7", f"""with {WHOLE},
 r as (select region_id, sample, rank() over (partition by sample order by norm) + (count(*) over (partition by sample, norm) - 1) / 2.0 k from whole),
 c as (select a.sample si, b.sample sj, corr(a.k, b.k) r from r a join r b on a.region_id = b.region_id and a.sample < b.sample group by 1, 2)
select case when left(si, 2) = left(sj, 2) then 'within' else 'between' end kind, count(*) n_pairs, round(avg(r), 6) + 0.0 mean_r from c group by 1""", SIG)
def _(t):
    c = M.correlation_matrix(ranked_whole(t), SAMPLES)
    kind = F.when(F.substring("sample_i", 1, 2) == F.substring("sample_j", 1, 2), "within").otherwise("between")
    return c.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n_pairs"), rd(F.avg("r")).alias("mean_r"))


@query("a08_sample_gram", "A8", f"""with {WHOLE}, c as (select region_id, sample, norm - avg(norm) over (partition by region_id) z from whole)
select a.sample sample_i, b.sample sample_j, round(sum(a.z * b.z), 5) + 0.0 g from c a join c b using (region_id) group by 1, 2""", SIG)
def _(t):
    rows = whole(t)
    mean = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / len(SAMPLES)
    z = rows.withColumn("m", mean).select(F.transform("v", lambda x: x - F.col("m")).alias("v"))
    return M.gram(z, SAMPLES).select("sample_i", "sample_j", rd("sij", 5).alias("g"))


def pairs_sql(rows: str, k: int, components: int) -> str:
    """CTEs ``pairs(component, value, total, v)`` of the leading eigenpairs of ``rows(i, row)``, the rows of a k x k matrix.

    A symmetric matrix squared over and over (divided by its trace) becomes the projection on its leading vector.
    """
    idx = f"range(1, {k + 1})"
    out = [f"g1 as (select list(row order by i) m from {rows})"]
    for c in range(1, components + 1):
        trace = f"list_sum(list_transform({idx}, lambda i: m[i][i]))"
        out.append(f"""p{c} as (select 0 n, m from g{c} union all
  select n + 1, list_transform({idx}, lambda i: list_transform({idx}, lambda j: list_dot_product(m[i], m[j])
   / list_sum(list_transform({idx}, lambda h: list_dot_product(m[h], m[h]))))) from p{c} where n < 30),
 d{c} as (select m, list_position(list_transform({idx}, lambda i: round(m[i][i], 9)), list_max(list_transform({idx}, lambda i: round(m[i][i], 9)))) w from p{c} where n = 30),
 v{c} as (select list_transform({idx}, lambda i: m[w][i] / sqrt(m[w][w])) v from d{c}),
 l{c} as (select v, m, list_dot_product(v, list_transform({idx}, lambda i: list_dot_product(m[i], v))) l from v{c}, g{c}),
 g{c + 1} as (select list_transform({idx}, lambda i: list_transform({idx}, lambda j: m[i][j] - l * v[i] * v[j])) m from l{c})""")
    every = " union all ".join(f"select {c} component, l, v from l{c}" for c in range(1, components + 1))
    return ",\n ".join(out) + f",\n pairs as (select e.*, {trace} total from ({every}) e, g1)"


CENTRED = f"""{WHOLE}, z as (select region_id, sample, norm - avg(norm) over (partition by region_id) z from whole),
 gr as (select a.sample sa, b.sample sb, sum(a.z * b.z) g from z a join z b using (region_id) group by 1, 2),
 gl as (select sa i, list(g order by sb) as row from gr group by 1)"""


@query("a08_sample_pca", "A8", f"""with recursive {CENTRED}, {pairs_sql("gl", 12, 5)},
 s as (select list(sample order by sample) s from (select distinct sample from whole))
select component, s[i] sample, round(v[i] * sqrt(l), 4) + 0.0 score, round(l / total, 6) variance_fraction from (select *, unnest(range(1, 13)) i from pairs, s)""", SIG)
def _(t):
    out = M.pca_scores(whole(t), SAMPLES, 5)
    return out.select("component", "sample", rd("score", 4).alias("score"), rd("variance_fraction").alias("variance_fraction"))


@query("a08_gram_from_scores", "A8", f"""with {WHOLE}, c as (select region_id, sample, norm - avg(norm) over (partition by region_id) z from whole)
select a.sample sample_i, b.sample sample_j, round(sum(a.z * b.z), 5) + 0.0 g from c a join c b using (region_id) group by 1, 2""", SIG)
def _(t):
    """The scores of all components give the centred Gram matrix back."""
    s = M.pca_scores(whole(t), SAMPLES, len(SAMPLES))
    a, b = (s.select("component", F.col("sample").alias(f"sample_{x}"), F.col("score").alias(x)) for x in "ij")
    return a.join(b, "component").groupBy("sample_i", "sample_j").agg(rd(F.sum(F.col("i") * F.col("j")), 5).alias("g"))


@query("a08_variance_total", "A8", f"""with {WHOLE}, c as (select sample, norm - avg(norm) over (partition by region_id) z from whole)
select sample, round(sum(z * z) / sum(sum(z * z)) over (), 6) share from c group by 1""", SIG)
def _(t):
    """Share of the total variance carried by each sample, from the PCA scores of all components."""
    s = M.pca_scores(whole(t), SAMPLES, len(SAMPLES)).withColumn("sq", F.col("score") * F.col("score"))
    per = s.groupBy("sample").agg(F.sum("sq").alias("sq")).withColumn("g", F.lit(1))
    return lookup_join(per, per.groupBy("g").agg(F.sum("sq").alias("total")), ["g"]).select(
        "sample", rd(F.col("sq") / F.col("total")).alias("share"))


@query("a09_anova_r2", "A9", f"""with {NORM}, g as (select avg(norm) m from norm), s as (select study, count(*) n, avg(norm) sm, var_pop(norm) v from norm group by 1)
select cast(sum(n) as bigint) n, round(sum(n * (sm - m) ** 2) / (sum(n * (sm - m) ** 2) + sum(n * v)), 9) + 0.0 r2 from s, g""", SIG)
def _(t):
    out = ST.anova_r2(normalised(t).withColumn("g", F.lit(1)), ["g"], "study", "norm")
    return out.select("n", rd("r2", 9).alias("r2"))


@query("a09_anova_r2_by_region_class", "A9", """with c as (select p_brand, p_type, p_retailprice v from part),
 g as (select p_brand, avg(v) m from c group by 1), s as (select p_brand, p_type, count(*) n, avg(v) sm, var_pop(v) w from c group by 1, 2)
select p_brand, cast(sum(n) as bigint) n, round(case when sum(n * (sm - m) ** 2) + sum(n * w) > 0
 then sum(n * (sm - m) ** 2) / (sum(n * (sm - m) ** 2) + sum(n * w)) else 0 end, 6) + 0.0 r2 from s join g using (p_brand) group by 1""")
def _(t):
    out = ST.anova_r2(t("part").select("p_brand", "p_type", "p_retailprice"), ["p_brand"], "p_type", "p_retailprice")
    return out.select("p_brand", "n", rd("r2").alias("r2"))


@query("a28_roc_auc", "A28", """with r as (select source, y, rank() over (partition by source order by score) + (count(*) over (partition by source, score) - 1) / 2.0 k from v_scores)
select source, count(*) n, sum(y)::bigint n_pos, count(*) - sum(y)::bigint n_neg,
 case when sum(y) > 0 and sum(y) < count(*) then round((sum(k * y) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) + 0.0 end auc
from r group by 1""", ("v_scores",))
def _(t):
    return ST.rank_sum(t("v_scores"), ["source"], "score", F.col("y") == 1).select("source", "n", "n_pos", "n_neg", rd("auc").alias("auc"))


@query("a29_roc_curve", "A29", """with g as (select score, sum(y) p, count(*) n from v_scores group by 1),
 c as (select score, sum(p) over w tp, sum(n) over w nn from g window w as (order by score desc rows unbounded preceding)), tt as (select sum(y) p, count(*) n from v_scores)
select score threshold, round(tp / tt.p, 6) tpr, round((nn - tp) / (tt.n - tt.p), 6) + 0.0 fpr from c, tt""", ("v_scores",))
def _(t):
    out = ST.roc_points(t("v_scores").withColumn("g", F.lit(1)), ["g"], "score", F.col("y") == 1)
    return out.select("threshold", rd("tpr").alias("tpr"), rd("fpr").alias("fpr"))


@query("p12_evaluable_labels", "P12", f"""with {LFC} select contrast, count(*) filter (lfc >= 0.5) n_positive, count(*) filter (lfc <= -0.5) n_negative,
 count(*) filter (abs(lfc) < 0.5) n_ambiguous from lfc group by 1""", SIG)
def _(t):
    from regulus.catalog.signal import lfc_long
    v = F.col("lfc")
    return lfc_long(t).groupBy("contrast").agg(F.count_if(v >= 0.5).alias("n_positive"), F.count_if(v <= -0.5).alias("n_negative"),
                                               F.count_if(F.abs(v) < 0.5).alias("n_ambiguous"))


@query("a30_model_evaluation", "A30", f"""with {PAIRED}, s as (select pair_a || '>' || pair_b target, case when region_id % 4 = 0 then 'held' else 'seen' end split, x pred, y meas
  from (select 'A' pair_a, 'N' pair_b, region_id, A x, N y from wide union all select 'A', 'R', region_id, A, R from wide) q where x is not null and y is not null),
 k as (select *, rank() over (partition by split, target order by pred) + (count(*) over (partition by split, target, pred) - 1) / 2.0 rp,
   rank() over (partition by split, target order by meas) + (count(*) over (partition by split, target, meas) - 1) / 2.0 rm from s),
 e as (select split, target, count(*) n, corr(rp, rm) sp, corr(pred, meas) pe, stddev_pop(pred) / stddev_pop(meas) sd_ratio from k group by 1, 2),
 a as (select split, target, meas >= 0.5 pos, rank() over (partition by split, target order by pred) + (count(*) over (partition by split, target, pred) - 1) / 2.0 k
   from s where abs(meas) >= 0.5),
 u as (select split, target, count(*) n_evaluable, (sum(k) filter (pos) - count(*) filter (pos) * (count(*) filter (pos) + 1) / 2.0)
   / (count(*) filter (pos) * count(*) filter (not pos)) auc from a group by 1, 2)
select split, target, n, n_evaluable, round(sp, 6) + 0.0 spearman, round(pe, 6) + 0.0 pearson, round(sp / 0.637, 6) + 0.0 frac_of_ceiling, round(sd_ratio, 6) sd_ratio,
 round(auc, 6) + 0.0 auc from e join u using (split, target)""", SIG)
def _(t):
    w = cut(lfc_wide(t))
    s = (w.select("region_id", F.explode(F.array(F.struct(F.lit("A>N").alias("target"), F.col("A").alias("pred"), F.col("N").alias("meas")),
                                                 F.struct(F.lit("A>R").alias("target"), F.col("A").alias("pred"), F.col("R").alias("meas")))).alias("z"))
         .select(F.when(F.col("region_id") % 4 == 0, "held").otherwise("seen").alias("split"), "z.*").where("pred is not null and meas is not null"))
    g = ["split", "target"]
    c = ST.correlations(s, g, "pred", "meas")
    a = ST.auc_block(s, g, "pred", "meas", 0.5)
    sd = s.groupBy(*g).agg((F.stddev_pop("pred") / F.stddev_pop("meas")).alias("sd_ratio"))
    return c.join(a, g).join(sd, g).select(*g, "n", "n_evaluable", rd("spearman").alias("spearman"), rd("pearson").alias("pearson"),
                                           rd(F.col("spearman") / 0.637).alias("frac_of_ceiling"), rd("sd_ratio").alias("sd_ratio"), rd("auc").alias("auc"))


@query("a31_prediction_percentiles", "A31", f"""with {LFC} select contrast, round(quantile_cont(lfc, 0.05), 6) + 0.0 p05, round(quantile_cont(lfc, 0.25), 6) + 0.0 p25,
 round(quantile_cont(lfc, 0.5), 6) + 0.0 p50, round(quantile_cont(lfc, 0.75), 6) + 0.0 p75, round(quantile_cont(lfc, 0.95), 6) + 0.0 p95,
 round(quantile_cont(lfc, 0.75) - quantile_cont(lfc, 0.25), 6) iqr, round(quantile_cont(lfc, 0.95) - quantile_cont(lfc, 0.5), 6) needed_delta
 from lfc where lfc is not null group by 1""", SIG)
def _(t):
    from regulus.catalog.signal import lfc_long
    q = exact_percentiles(lfc_long(t), ["contrast"], "lfc", [0.05, 0.25, 0.5, 0.75, 0.95])
    return q.select("contrast", *[rd(f"q{i}").alias(n) for i, n in enumerate(("p05", "p25", "p50", "p75", "p95"))],
                    rd(F.col("q3") - F.col("q1")).alias("iqr"), rd(F.col("q4") - F.col("q2")).alias("needed_delta"))


@query("a32_topk_sign_agreement", "A32", f"""with {WIDE}, k as (select A, N from wide where A is not null and N is not null order by abs(A) desc, region_id limit 100)
select count(*) n, round(avg(case when sign(A) = sign(N) then 1.0 else 0.0 end), 6) agreement from k""", SIG)
def _(t):
    top = lfc_wide(t).where("A is not null and N is not null").orderBy(F.abs("A").desc(), "region_id").limit(100)
    return top.agg(F.count(F.lit(1)).alias("n"), rd(F.avg(F.when(F.signum("A") == F.signum("N"), 1.0).otherwise(0.0))).alias("agreement"))


@query("a50_cross_study_deltas", "A50", f"""with {PAIRED}, f as (select pair_a, pair_b, x, y from paired where x is not null and y is not null),
 r as (select *, rank() over (partition by pair_a, pair_b order by x) + (count(*) over (partition by pair_a, pair_b, x) - 1) / 2.0 rx,
  rank() over (partition by pair_a, pair_b order by y) + (count(*) over (partition by pair_a, pair_b, y) - 1) / 2.0 ry from f)
select pair_a, pair_b, count(*) n, round(corr(rx, ry), 6) + 0.0 spearman, count(*) filter (abs(x) > 1) n_big_a, count(*) filter (abs(y) > 1) n_big_b from r group by 1, 2""", SIG)
def _(t):
    from regulus.catalog.signal import PAIRS
    rows = ST.pair_thresholds(cut(lfc_wide(t)), PAIRS, (0.0,)).drop("threshold")
    return X.delta_agreement(rows, ["pair_a", "pair_b"], "x", "y").withColumn("spearman", rd("spearman"))


@query("a51_range_test", "A51", """with m as (select p_brand, p_type, avg(p_retailprice) v from part group by 1, 2),
 r as (select min(v) lo, max(v) hi from m where p_brand = 'Brand#1' or p_brand = 'Brand#11')
select p_brand, count(*) n, count(*) filter (v between lo and hi) n_inside, bool_and(v between lo and hi) all_inside from m, r group by 1""")
def _(t):
    m = t("part").groupBy("p_brand", "p_type").agg(F.avg("p_retailprice").alias("v"))
    return X.range_test(m, "p_brand", "v", ("Brand#1", "Brand#11"))


@query("a52_histogram", "A52", f"""with {LFC} select contrast, cast(floor(lfc / 0.25) as bigint) bin, count(*) n from lfc where lfc is not null group by 1, 2""", SIG)
def _(t):
    from regulus.catalog.signal import lfc_long
    return X.histogram(lfc_long(t), ["contrast"], {"bin": X.linear_bin("lfc", 0.25)})


@query("a52_log_histogram", "A52", """select cast(floor(log10(value) * 5) as bigint) bin, count(*) n, event_type from events where value > 0 group by 1, 3""")
def _(t):
    return X.histogram(t("events"), ["event_type"], {"bin": X.log_bin("value", 5)})


@query("a52_density_2d", "A52", f"""with {WIDE} select cast(floor(A / 0.5) as bigint) bin_x, cast(floor(N / 0.5) as bigint) bin_y, count(*) n from wide where A is not null and N is not null group by 1, 2""", SIG)
def _(t):
    return X.histogram(lfc_wide(t), [], {"bin_x": X.linear_bin("A", 0.5), "bin_y": X.linear_bin("N", 0.5)})


BUCKETS = """q as (select source, list_distinct(quantile_cont(score, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) e from v_scores group by 1),
 b as (select s.*, greatest(len(list_filter(e, lambda x: x < score)) - 1, 0)::bigint bucket from v_scores s join q using (source))"""


@query("w08_quantile_buckets", "W8", f"with {BUCKETS} select doc_id, source, bucket from b", ("v_scores",))
def _(t):
    return ST.quantile_buckets(t("v_scores"), ["source"], "score", 10).select("doc_id", "source", "bucket")


@query("w10_zscore", "W10", """select o_orderkey, round((o_totalprice - (select avg(o_totalprice) from orders)) / (select stddev_samp(o_totalprice) from orders), 6) + 0.0 z_all,
 round((o_totalprice - avg(o_totalprice) over (partition by o_orderpriority)) / stddev_samp(o_totalprice) over (partition by o_orderpriority), 6) + 0.0 z_group from orders""")
def _(t):
    o = X.zscore(t("orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), [], "o_totalprice", "z_all")
    o = X.zscore(o, ["o_orderpriority"], "o_totalprice", "z_group")
    return o.select("o_orderkey", rd("z_all").alias("z_all"), rd("z_group").alias("z_group"))


@query("a53_residual_by_level", "A53", f"""with {WIDE}, p as (select region_id, A x, N y from wide where A is not null and N is not null),
 c as (select regr_slope(y, x) b, regr_intercept(y, x) a from p), e as (select x, abs(y - a - b * x) r from p, c),
 q as (select list_distinct(quantile_cont(x, [0, 1/3, 2/3, 1])) e from p), k as (select r, x, greatest(len(list_filter(q.e, lambda z: z < x)) - 1, 0)::bigint tercile from e, q)
select tercile, count(*) n, round(avg(r), 6) mean_abs_residual, round(avg(x), 6) + 0.0 mean_level, (select round(corr(r, x), 6) + 0.0 from e) corr_residual_level from k group by 1""", SIG)
def _(t):
    e = X.residual_by_level(lfc_wide(t), "A", "N", 3).withColumnRenamed("level", "tercile")
    return e.select("tercile", "n", *[rd(c).alias(c) for c in ("mean_abs_residual", "mean_level", "corr_residual_level")])


RESIDUAL = """p as (select region_id, A x, N y from wide where A is not null and N is not null),
 c as (select regr_slope(y, x) b, regr_intercept(y, x) a from p), e as (select region_id, x, y, abs(y - a - b * x) r from p, c)"""


@query("a53_residual_by_class", "A53", f"""with {WIDE}, {RESIDUAL}
select p_type as "class", count(*) n, round(avg(r), 6) mean_abs_residual, round(corr(r, x), 6) + 0.0 corr_residual_level, round(corr(y, x), 6) + 0.0 corr_x_y
 from e join part on p_partkey = region_id group by 1""", SIG)
def _(t):
    cls = t("part").select(F.col("p_partkey").alias("region_id"), F.col("p_type").alias("class"))
    e = X.residual_by_class(lookup_join(lfc_wide(t), cls, ["region_id"], "inner"), "class", "A", "N")
    return e.select("class", "n", *[rd(c).alias(c) for c in ("mean_abs_residual", "corr_residual_level", "corr_x_y")])


@query("a54_balanced_study_contrast", "A54", """with m as (select region_id, study, arm, avg(ln(signal)) v from v_signal where study in ('A', 'R') group by 1, 2, 3),
 k as (select region_id, arm, max(v) filter (study = 'A') - max(v) filter (study = 'R') d, max(v) filter (study = 'A') a, max(v) filter (study = 'R') b from m group by 1, 2)
select region_id, count(d) n_status, case when count(d) = 2 then round(avg(d), 6) + 0.0 end contrast,
 round((select avg(v) from (select avg(ln(signal)) v from v_signal s where s.region_id = k.region_id and study = 'A'))
  - (select avg(v) from (select avg(ln(signal)) v from v_signal s where s.region_id = k.region_id and study = 'R')), 6) + 0.0 unbalanced from k group by 1""", SIG)
def _(t):
    out = X.balanced_contrast(t("v_signal").withColumn("signal", F.ln("signal")), ["region_id"], "study", ("A", "R"), "arm", ("F", "O"), "signal")
    return out.select("region_id", "n_status", rd("contrast", 6).alias("contrast"), rd("unbalanced", 6).alias("unbalanced"))


@query("a54_leave_one_group_out", "A54", f"""with {LFC}, h as (select distinct contrast held from lfc),
 tr as (select held, region_id, avg(lfc) pred from lfc join h on contrast <> held where lfc is not null group by 1, 2),
 te as (select contrast held, region_id, lfc meas from lfc where lfc is not null)
select held, count(*) n, round(corr(pred, meas), 6) + 0.0 pearson, round(sum(pred * meas) / sqrt(sum(pred * pred)), 6) + 0.0 projection from tr join te using (held, region_id) group by 1""", SIG)
def _(t):
    from regulus.catalog.signal import STUDIES
    return X.leave_one_out(lfc_wide(t), STUDIES).withColumn("pearson", rd("pearson")).withColumn("projection", rd("projection"))


@query("a60_group_separation", "A60", """with g as (select source, y, avg(score) m, stddev_samp(score) s from v_scores group by 1, 2)
select source, round(abs(max(m) filter (y = 1) - max(m) filter (y = 0)) / avg(s), 6) separation,
 abs(max(m) filter (y = 1) - max(m) filter (y = 0)) / avg(s) > 2 separated from g group by 1""", ("v_scores",))
def _(t):
    return X.group_separation(t("v_scores"), ["source"], "y", "score").withColumn("separation", rd("separation"))
