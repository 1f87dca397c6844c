"""Permutation nulls, control models and embedding scoring."""

from pyspark.sql import functions as F

from regulus.catalog.registry import query, rd
from regulus.operators import model as U
from regulus.operators import nulls as N
from regulus.operators import stats as ST
from regulus.plans.ordered import add_average_ranks
from regulus.session import cut

N_PERM = 200
SEEDS = tuple(range(N_PERM))


@query("w09_seeded_shuffle", "W9", """with b as (select *, row_number() over (partition by source order by md5(doc_id::varchar)) i from v_scores),
 s as (select source, seed, score, row_number() over (partition by source, seed order by md5(seed::varchar || '-' || doc_id::varchar)) i from v_scores, range(0, 3) r(seed))
select b.source, b.doc_id, s.seed::int seed, s.score shuffled from b join s on b.source = s.source and b.i = s.i""", ("v_scores",))
def _(t):
    out = N.shuffle_within(t("v_scores").select("source", "doc_id", "score"), ["source"], "doc_id", "score", (0, 1, 2))
    return out.select("source", "doc_id", "seed", "shuffled")


def scored(t):
    """Score and measured label value, split in folds."""
    v = t("v_scores").withColumn("fold", F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd"))
    return v.select("doc_id", "fold", "score", (F.col("y") * 2.0 + F.col("toxic")).alias("measured"))


NULLSQL = f"""sc as (select doc_id, case when doc_id % 2 = 0 then 'even' else 'odd' end fold, score, y * 2.0 + toxic measured from v_scores),
 k as (select *, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 rx, rank() over (order by measured) + (count(*) over (partition by measured) - 1) / 2.0 ry,
   row_number() over (partition by fold order by md5(doc_id::varchar)) i from sc),
 s as (select fold, seed, ry, row_number() over (partition by fold, seed order by md5(seed::varchar || '-' || doc_id::varchar)) i from k, range(0, {N_PERM}) r(seed)),
 nul as (select seed, corr(k.rx, s.ry) rho from k join s on k.fold = s.fold and k.i = s.i group by 1), real as (select corr(rx, ry) rho from k)"""


@query("a46_permutation_null", "A46", f"""with {NULLSQL} select round(any_value(real.rho), 6) + 0.0 real, count(*) n_perm, round(avg(nul.rho), 6) + 0.0 null_mean, round(stddev_samp(nul.rho), 6) null_sd,
 round(min(nul.rho), 6) + 0.0 null_min, round(max(nul.rho), 6) + 0.0 null_max, count(*) filter (nul.rho >= real.rho) n_beating,
 round((count(*) filter (nul.rho >= real.rho) + 1) / (count(*) + 1), 9) p, round(1 / (count(*) + 1), 9) p_floor from nul, real""", ("v_scores",))
def _(t):
    return permutation_null(scored(t))


def permutation_null(rows, seeds=SEEDS):
    """Ranks do not change under a shuffle, so they are computed once and the ranks are shuffled."""
    r = cut(add_average_ranks(rows.withColumn("g", F.lit(1)), ["g"], {"score": "rx", "measured": "ry"}).select("doc_id", "fold", "rx", "ry", "g"))
    sh = N.shuffle_within(r, ["fold"], "doc_id", "ry", seeds)
    null = sh.groupBy("g", "seed").agg(ST.safe_corr("rx", "shuffled").alias("rho"))
    real = r.groupBy("g").agg(ST.safe_corr("rx", "ry").alias("rho"))
    out = N.empirical_p(null, real, "rho", ["g"])
    return out.select(*[rd(c).alias(c) for c in ("real",)], "n_perm", *[rd(c).alias(c) for c in ("null_mean", "null_sd", "null_min", "null_max")], "n_beating",
                      rd("p", 9).alias("p"), rd("p_floor", 9).alias("p_floor"))


@query("a46_permutation_auc_null", "A46", f"""with b as (select doc_id, source, score, y, rank() over (partition by source order by score) + (count(*) over (partition by source, score) - 1) / 2.0 k,
   row_number() over (partition by source order by md5(doc_id::varchar)) i from v_scores),
 s as (select source, seed, y, row_number() over (partition by source, seed order by md5(seed::varchar || '-' || doc_id::varchar)) i from b, range(0, {N_PERM}) r(seed)),
 n as (select b.source, seed, sum(b.k * s.y) - sum(s.y) * (sum(s.y) + 1) / 2.0 u from b join s on b.source = s.source and b.i = s.i group by 1, 2),
 r as (select source, sum(k * y) - sum(y) * (sum(y) + 1) / 2.0 u from b group by 1)
select source, round(any_value(r.u), 1) u_real, count(*) n_perm, count(*) filter (n.u >= r.u) n_beating, round((count(*) filter (n.u >= r.u) + 1) / (count(*) + 1), 9) p from n join r using (source) group by 1""", ("v_scores",))
def _(t):
    r = cut(add_average_ranks(t("v_scores").select("doc_id", "source", "score", "y"), ["source"], {"score": "k"}))
    sh = N.shuffle_within(r, ["source"], "doc_id", "y", SEEDS)
    def u(label):
        pos = F.sum(label).cast("double")
        return F.sum(F.col("k") * F.col(label)) - pos * (pos + 1) / 2
    null = sh.groupBy("source", "seed").agg(u("shuffled").alias("u"))
    out = N.empirical_p(null, r.groupBy("source").agg(u("y").alias("u")), "u", ["source"])
    return out.select("source", rd("real", 1).alias("u_real"), "n_perm", "n_beating", rd("p", 9).alias("p"))


@query("a47_exhaustive_partition_null", "A47", """with s as (select p_type, row_number() over (order by p_type) - 1 i, sum((p_retailprice * 100)::bigint) v from part group by 1), n as (select count(*) n from s),
 m as (select m from n, generate_series(0, (2 ** n)::bigint - 1) g(m) where bit_count(m) = n // 2),
 st as (select m, sum(case when (m >> i::int) & 1 = 1 then v else 0 end) * (any_value(n) - any_value(n) // 2) - sum(case when (m >> i::int) & 1 = 0 then v else 0 end) * (any_value(n) // 2) d from m, s, n group by 1),
 r as (select d from st, n where m = (2 ** (n // 2))::bigint - 1)
select count(*) n_partitions, count(*) filter (st.d >= r.d) n_at_least, round(count(*) filter (st.d >= r.d) / count(*), 9) p, round(1 / count(*), 9) p_floor from st, r""")
def _(t):
    per = cut(t("part").groupBy("p_type").agg(F.sum(F.round(F.col("p_retailprice") * 100).cast("long")).alias("v")))
    names = [r[0] for r in per.select("p_type").orderBy("p_type").collect()]  # O(samples)
    rows = per.withColumn("i", F.array_position(F.array(*[F.lit(x) for x in names]), F.col("p_type")) - 1).withColumn("g", F.lit(1))
    n = len(names)
    out = N.exact_null(rows, "i", "v", ["g"], n, n // 2, 2 ** (n // 2) - 1)
    return out.select("n_partitions", "n_at_least", rd("p", 9).alias("p"), rd("p_floor", 9).alias("p_floor"))


# Fixed rule for a reproducible weight vector of any width.
def weights(n, a=37):
    return [((i * i * 7 + i * a) % 11 - 5) / 10 for i in range(n)]


def wsql(a=37):
    return f"list_transform(range(0, 64), lambda i: ((i * i * 7 + i * {a}) % 11 - 5) / 10.0)"


PRED = """p as (select vec_id, label, (list_dot_product(embedding::double[], {w}) + list_dot_product(list_reverse(embedding)::double[], {w})) / 2 + 0.25 pred from embeddings)"""


def predictions(t, a=37):
    e = F.col("embedding")
    return t("embeddings").select("vec_id", "label", U.linear_score(e, F.reverse(e), weights(64, a), 0.25).alias("pred"))


@query("u01_linear_scoring", "U1", f"with {PRED.format(w=wsql())} select vec_id, round(pred, 6) + 0.0 pred from p")
def _(t):
    return predictions(t).select("vec_id", rd("pred").alias("pred"))


@query("u04_output_gates", "U4", f"with {PRED.format(w=wsql())} select label, count(*) n, round(count(*) filter (pred < 0) / count(*), 6) frac_negative from p group by 1")
def _(t):
    g = U.gates(predictions(t).withColumn("m", F.col("pred") * 2), ["label"], "pred", "m", 0.1)
    return g.select("label", "n", rd("frac_negative").alias("frac_negative"))


@query("u04_collapse_ratio", "U4", f"with {PRED.format(w=wsql())} select count(*) n, round(stddev_pop(pred) / stddev_pop(label), 6) sd_ratio, stddev_pop(pred) / stddev_pop(label) >= 0.1 and min(pred) < 0 and max(pred) >= 0 passes from p")
def _(t):
    g = U.gates(predictions(t).withColumn("g", F.lit(1)), ["g"], "pred", "label", 0.1)
    return g.select("n", rd("sd_ratio").alias("sd_ratio"), "passes")


@query("u02_linear_head_fit", "U2")
def _(t):
    """Fit on labels 0-5, choose the penalty on 6-7, evaluate on 8-9 with a target that is linear plus a residue."""
    e = F.col("embedding")
    truth = U.linear_score(e, F.reverse(e), weights(64, 29), 0.0)
    df = t("embeddings").select("vec_id", "label", e.alias("fwd"), F.reverse(e).alias("rc"), (truth + (F.col("vec_id") % 7 - 3) / 50.0).alias("target"),
                                F.when(F.col("label") <= 5, "train").when(F.col("label") <= 7, "stop").otherwise("eval").alias("fold"))
    df = cut(df)
    head = U.fit_head(df, "fwd", "rc", "target", "fold", (0.0, 0.01, 0.1))
    scored_rows = U.score_heads(df, "fwd", "rc", head, ["fold", "target"], which="head")
    return ST.correlations(scored_rows, ["fold"], "pred", "target").withColumn("penalty", F.lit(float(head.penalty)))


# a target without noise gives back the weights it was made with: forward and reverse features share the mean of a weight and its mirror
@query("u02_head_known_weights", "U2", f"""with w as (select unnest({wsql(29)}) w, unnest(range(0, 64)) i)
select a.i::int i, round((a.w + b.w) / 2, 3) + 0.0 weight from w a join w b on b.i = 63 - a.i union all select 64, 0.5""")
def _(t):
    e = F.col("embedding")
    df = t("embeddings").select(e.alias("fwd"), F.reverse(e).alias("rc"), U.linear_score(e, F.reverse(e), weights(64, 29), 0.5).alias("target"),
                                F.when(F.col("label") <= 5, "train").when(F.col("label") <= 7, "stop").otherwise("eval").alias("fold"))
    head = U.fit_head(df, "fwd", "rc", "target", "fold", (0.0,), max_epochs=50_000, least_gain=1e-15)
    rows = [(i, round(float(w), 3) + 0.0) for i, w in enumerate(head.weights[:, 0])]
    return t("embeddings").sparkSession.createDataFrame(rows, "i int, weight double")


# the stop fold follows half the slope of the training fold, so its loss falls, turns, and ends the training
@query("u02_head_early_stop", "U2", """with recursive x as (select o_orderkey % 10 k, o_totalprice::double / 100000 - 1.5 f from orders),
 r as (select k, f, f * 0.9 + 0.1 g, case when k <= 5 then 2 * f + 1 else f + 0.7 end t from x where k <= 7),
 tr as (select 2.0 * count(*) n, sum(f) + sum(g) sx, sum(f * f) + sum(g * g) sxx, sum(f * t) + sum(g * t) sxy, 2 * sum(t) sy from r where k <= 5),
 st as (select count(*) n, sum(f + g) / 2 sx, sum((f + g) * (f + g)) / 4 sxx, sum((f + g) * t) / 2 sxy, sum(t) sy, sum(t * t) syy from r where k > 5),
 ep(e, w, b) as (select 0, 0.0::double, 0.0::double union all
   select e + 1, w - 0.05 * 2 * (sxx * w + sx * b - sxy) / n, b - 0.05 * 2 * (sx * w + n * b - sy) / n from ep, tr where e < 300),
 loss as (select e, w, b, (w * w * sxx + 2 * w * b * sx + b * b * n - 2 * w * sxy - 2 * b * sy + syy) / n l from ep, st where e > 0),
 run(e, best, bad, found) as (select 0, 1e300::double, 0, 0 union all
   select loss.e, case when l < best - 1e-7 then l else best end, case when l < best - 1e-7 then 0 else bad + 1 end, case when l < best - 1e-7 then loss.e else found end
   from run join loss on loss.e = run.e + 1 where bad < 5),
 done as (select max(e) epochs, max(found) found, min(best) best from run)
select epochs::bigint epochs, found::bigint best_epoch, round(best, 6) loss, round(w, 6) weight, round(b, 6) bias from done join loss on loss.e = found""")
def _(t):
    f, k = F.col("o_totalprice").cast("double") / 100000 - 1.5, F.col("o_orderkey") % 10
    df = t("orders").select(F.array(f).alias("fwd"), F.array(f * 0.9 + 0.1).alias("rc"), F.when(k <= 5, 2 * f + 1).when(k <= 7, f + 0.7).alias("target"),
                            F.when(k <= 5, "train").when(k <= 7, "stop").otherwise("eval").alias("fold"))
    head = U.fit_head(df, "fwd", "rc", "target", "fold", (0.0,), max_epochs=300, patience=5, rate=0.05)
    row = (int(head.epochs[0]), int(head.best_epoch[0]), round(float(head.loss[0]), 6), *[round(float(w), 6) for w in head.weights[:, 0]])
    return t("orders").sparkSession.createDataFrame([row], "epochs long, best_epoch long, loss double, weight double, bias double")


REFITS = 100


@query("a46_refit_null", "A46", f"""with v as (select vec_id, embedding[1]::double a1, embedding[2]::double a2, embedding[3]::double b1, embedding[4]::double b2,
   vec_id % 7 + 3 * embedding[1]::double y, label + 2 * embedding[1]::double m, case when vec_id % 10 < 6 then 'train' when vec_id % 10 < 8 then 'stop' else 'eval' end fold from embeddings),
 k as (select *, row_number() over (order by md5(vec_id::varchar)) i from v where fold = 'train'),
 s as (select seed, y, row_number() over (partition by seed order by md5(seed::varchar || '-' || vec_id::varchar)) i from v, range(0, {REFITS}) r(seed) where fold = 'train'),
 yy as (select seed, a1, a2, b1, b2, s.y from k join s using (i) union all select -1, a1, a2, b1, b2, y from v where fold = 'train'),
 x as (select seed, a1 p, a2 q, y from yy union all select seed, b1, b2, y from yy),
 c as (select seed, covar_pop(p, y) cp, covar_pop(q, y) cq, var_pop(p) + 0.01 vp, var_pop(q) + 0.01 vq, covar_pop(p, q) cpq from x group by 1),
 w as (select seed, (cp * vq - cq * cpq) / (vp * vq - cpq * cpq) w1, (cq * vp - cp * cpq) / (vp * vq - cpq * cpq) w2 from c),
 sc as (select seed, w1 * (a1 + b1) / 2 + w2 * (a2 + b2) / 2 pred, m from v, w where fold = 'eval'),
 rk as (select seed, rank() over (partition by seed order by pred) + (count(*) over (partition by seed, pred) - 1) / 2.0 rx, rank() over (partition by seed order by m) + (count(*) over (partition by seed, m) - 1) / 2.0 ry from sc),
 rho as (select seed, corr(rx, ry) rho from rk group by 1), nul as (select rho from rho where seed >= 0), real as (select rho from rho where seed = -1)
select round(any_value(real.rho), 6) + 0.0 real, count(*) n_perm, round(avg(nul.rho), 6) + 0.0 null_mean, round(stddev_samp(nul.rho), 6) null_sd, count(*) filter (nul.rho >= real.rho) n_beating,
 round((count(*) filter (nul.rho >= real.rho) + 1) / (count(*) + 1), 9) p, round(1 / (count(*) + 1), 9) p_floor from nul, real""")
def _(t):
    def e(i):
        return F.col("embedding")[i].cast("double")

    k = F.col("vec_id") % 10
    df = t("embeddings").select("vec_id", F.array(e(0), e(1)).alias("fwd"), F.array(e(2), e(3)).alias("rc"), (F.col("vec_id") % 7 + 3 * e(0)).alias("target"),
                                (F.col("label") + 2 * e(0)).alias("measured"), F.when(k < 6, "train").when(k < 8, "stop").otherwise("eval").alias("fold"))
    null, real = N.refit_null(df, "vec_id", "fwd", "rc", "target", "fold", "measured", tuple(range(REFITS)), penalty=0.01)
    out = N.empirical_p(null.withColumn("g", F.lit(1)), real.withColumn("g", F.lit(1)), "rho", ["g"])
    return out.select(rd("real").alias("real"), "n_perm", rd("null_mean").alias("null_mean"), rd("null_sd").alias("null_sd"), "n_beating",
                      rd("p", 9).alias("p"), rd("p_floor", 9).alias("p_floor"))


@query("a48_untrained_scorer", "A48", f"""with {PRED.format(w=wsql())}, q as (select vec_id, label meas, pred from p), u as (select vec_id, (list_dot_product(embedding::double[], {wsql(53)}) + list_dot_product(list_reverse(embedding)::double[], {wsql(53)})) / 2 + 0.25 upred from embeddings),
 j as (select q.*, upred from q join u using (vec_id)), l as (select 'fitted' control, meas, pred v from j union all select 'untrained', meas, upred from j),
 r as (select control, rank() over (partition by control order by v) + (count(*) over (partition by control, v) - 1) / 2.0 a, rank() over (partition by control order by meas) + (count(*) over (partition by control, meas) - 1) / 2.0 b from l)
select control, count(*) n, round(corr(a, b), 5) + 0.0 spearman from r group by 1""")
def _(t):
    both = predictions(t).join(predictions(t, 53).select("vec_id", F.col("pred").alias("upred")), "vec_id")
    l = both.select(F.col("label").alias("meas"), F.explode(F.array(F.struct(F.lit("fitted").alias("control"), F.col("pred").alias("v")),
                                                                    F.struct(F.lit("untrained").alias("control"), F.col("upred").alias("v")))).alias("z")).select("meas", "z.*")
    return ST.correlations(l, ["control"], "v", "meas").select("control", "n", rd("spearman", 5).alias("spearman"))


@query("a48_shuffled_features", "A48", f"""with {PRED.format(w=wsql())}, k as (select *, row_number() over (order by md5(vec_id::varchar)) i from p),
 s as (select pred, seed, row_number() over (partition by seed order by md5(seed::varchar || '-' || vec_id::varchar)) i from p, range(0, 5) r(seed)),
 l as (select seed, k.label meas, s.pred v from k join s using (i)),
 r as (select seed, rank() over (partition by seed order by v) + (count(*) over (partition by seed, v) - 1) / 2.0 a, rank() over (partition by seed order by meas) + (count(*) over (partition by seed, meas) - 1) / 2.0 b from l)
select seed::int seed, count(*) n, round(corr(a, b), 5) + 0.0 spearman from r group by 1""")
def _(t):
    """Assigning feature rows to other targets equals assigning their scores, so scores are moved."""
    p = cut(predictions(t).withColumn("g", F.lit(1)))
    sh = N.shuffle_within(p, ["g"], "vec_id", "pred", range(5))
    return ST.correlations(sh, ["seed"], "shuffled", "label").select("seed", "n", rd("spearman", 5).alias("spearman"))


@query("a55_paired_array_check", "A55", """with r as (select label, embedding::double[] a, list_reverse(embedding)::double[] b from embeddings)
select label, count(*) n, count(*) filter (len(a) <> 64 or len(b) <> 64) wrong_shape, count(*) filter (list_bool_or(list_transform(a, lambda x: isnan(x) or isinf(x)))) non_finite,
 count(*) filter (not list_bool_or(list_transform(a, lambda x: x <> 0))) all_zero, count(*) filter (a <> b) differing,
 round(sum(list_sum(list_transform(a, lambda x: abs(x)))) / sum(len(a)), 6) mean_abs, round(max(list_max(list_transform(a, lambda x: abs(x)))), 6) max_abs from r group by 1""")
def _(t):
    e = F.col("embedding")
    out = U.compare_arrays(t("embeddings"), ["label"], e, F.reverse(e), 64)
    return out.withColumn("mean_abs", rd("mean_abs")).withColumn("max_abs", rd("max_abs"))


@query("f16_pooling_identity", "F16", f"""with p as (select label, list_dot_product(embedding::double[], {wsql()}) s, embedding::double[] e from embeddings),
 u as (select label, unnest(range(1, 65)) i, unnest(e) x from p), m as (select label, i, avg(x) x from u group by 1, 2), d as (select label, sum(x * (((i - 1) * (i - 1) * 7 + (i - 1) * 37) % 11 - 5) / 10.0) a from m group by 1),
 b as (select label, avg(s) b from p group by 1)
select label, abs(a - b) <= 1e-9 identical, round(a, 6) + 0.0 score from d join b using (label)""")
def _(t):
    """Score of the pooled bins against the pooled score of the bins."""
    out = U.pooling_identity(t("embeddings"), ["label"], "embedding", weights(64))
    return out.select("label", "identical", rd("of_mean").alias("score"))
