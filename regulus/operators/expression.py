"""Operators on expression, annotation and comparison tables; keys and parameters are arguments.

Tables are long unless said otherwise. NULL group keys form a group. Nothing is collected: shares, totals
and reference values are aggregated tables that are joined back within their counted size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regulus.operators.stats import correlations, quantile_buckets, safe_corr, welch
from regulus.session import cut, keyed_join, lookup_join


# ---- text fields

def region_columns(df: DataFrame, region: str, names: tuple[str, str, str] = ("contig", "start", "end")) -> DataFrame:
    """``chr:start-end`` as three columns; rows of another form are dropped."""
    pattern = r"^(chr\w+):(\d+)-(\d+)$"
    part = [F.regexp_extract(region, pattern, i) for i in (1, 2, 3)]
    return df.where(F.col(region).rlike(pattern)).select(
        "*", part[0].alias(names[0]), part[1].cast("long").alias(names[1]), part[2].cast("long").alias(names[2]))


def first_rule(text: Column, rules: Sequence[tuple[Column, str]], otherwise: Column) -> Column:
    """Label of the first condition that holds; ``otherwise`` may quote the text it could not place."""
    out = None
    for condition, label in rules:
        out = F.when(condition, label) if out is None else out.when(condition, label)
    return otherwise if out is None else out.otherwise(otherwise)


def prefix_tag(name: Column, tags: Mapping[str, str], otherwise: str) -> Column:
    """Tag of the first prefix that the name starts with."""
    return first_rule(name, [(name.startswith(p), tag) for p, tag in tags.items()], F.lit(otherwise))


def family_counts(df: DataFrame, ident: str, families: Mapping[str, str], by: Sequence[str] = ()) -> DataFrame:
    """How many identifiers match each family's pattern (column per family), and how many there are."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(ident).rlike(p)).alias(name) for name, p in families.items()])


def canonical_label(label: Column, table: Mapping[str, str], unmapped: str | None = "UNMAPPED") -> Column:
    """Label through a map. ``unmapped=None`` makes a label without an entry an error when it is evaluated."""
    known = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), label)
    if unmapped is not None:
        return F.coalesce(known, F.lit(unmapped))
    return F.coalesce(known, F.raise_error(F.concat(F.lit("no canonical label for "), F.coalesce(label, F.lit("NULL")))).cast("string"))


def label_mismatch(df: DataFrame, first: tuple[str, str], second: tuple[str, str],
                   names: tuple[str, str, str] = ("in_name", "in_content", "mismatch")) -> DataFrame:
    """Number found by a (column, pattern) pair on either side, and whether the two differ (NULL equals NULL)."""
    a, b = (F.regexp_extract(c, p, 1).try_cast("long") for c, p in (first, second))
    return df.select("*", a.alias(names[0]), b.alias(names[1]), (~a.eqNullSafe(b)).alias(names[2]))


def manual_note(df: DataFrame, keys: Sequence[str], notes: Mapping[tuple[str, ...], str], fallback: Column, out: str = "note") -> DataFrame:
    """Note of a hand-made table on several keys, else ``fallback``."""
    table = F.create_map(*[F.lit(x) for k, v in notes.items() for x in ("|".join(k), v)])
    at = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    return df.withColumn(out, F.coalesce(F.element_at(table, at), fallback))


# ---- rows and keys

def kept_counts(df: DataFrame, by: Sequence[str], keep: Column) -> DataFrame:
    """Rows kept and dropped by a predicate."""
    return df.groupBy(*by).agg(F.count_if(keep).alias("n_kept"), F.count_if(~keep).alias("n_dropped"))


def membership(df: DataFrame, members: DataFrame, key: str, by: Sequence[str]) -> DataFrame:
    """Distinct keys per group, how many are members, and the share in percent (0 where none is)."""
    pairs = df.select(*by, key).distinct()
    known = members.select(key).distinct().withColumn("_in", F.lit(1))
    g = lookup_join(pairs, known, [key]).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count("_in").alias("n_in"))
    return g.withColumn("pct", 100.0 * F.col("n_in") / F.col("n"))


def where_found(first: DataFrame, second: DataFrame, key: str, out: str = "where_found") -> DataFrame:
    """Each distinct key of two tables with 'both', 'first only' or 'second only'."""
    both = first.select(key, F.lit(1).alias("_f")).union(second.select(key, F.lit(2).alias("_f"))).groupBy(key)
    g = both.agg(F.count_if(F.col("_f") == 1).alias("_a"), F.count_if(F.col("_f") == 2).alias("_b"))
    return g.select(key, F.when(F.col("_b") == 0, "first only").when(F.col("_a") == 0, "second only").otherwise("both").alias(out))


def expressed(df: DataFrame, feature: str, study: str, any_high: Column, high: Column, at_least: int) -> DataFrame:
    """Per feature: any value passes ``any_high``; at least k values pass ``high``; every study has one that does."""
    studies = df.agg(F.count_distinct(study).alias("_n")).withColumn("_one", F.lit(1))
    g = df.groupBy(feature).agg(F.bool_or(any_high).alias("any_high"), (F.count_if(high) >= at_least).alias(f"at_least_{at_least}"),
                                F.count_distinct(F.when(high, F.col(study))).alias("_s")).withColumn("_one", F.lit(1))
    return lookup_join(g, studies, ["_one"]).withColumn("in_every_study", F.col("_s") == F.col("_n")).drop("_one", "_s", "_n")


def complete_cases(df: DataFrame, feature: str, sample: str, value: str) -> DataFrame:
    """Features with a value in every sample."""
    n = df.agg(F.count_distinct(sample).alias("_n")).withColumn("_one", F.lit(1))
    g = df.groupBy(feature).agg(F.count(value).alias("n_values")).withColumn("_one", F.lit(1))
    return lookup_join(g, n, ["_one"]).where("n_values = _n").drop("_one", "_n")


# ---- values

def library_size(df: DataFrame, sample: str, value: str, detected_above: float, target: float, tolerance: float = 0.1) -> DataFrame:
    """Total, detected features, features, percent detected, and whether the total is near its target."""
    g = df.groupBy(sample).agg(F.sum(value).alias("total"), F.count_if(F.col(value) > detected_above).alias("detected"), F.count(F.lit(1)).alias("features"))
    return (g.withColumn("pct_detected", 100.0 * F.col("detected") / F.col("features"))
            .withColumn("near_target", F.col("total").between((1 - tolerance) * target, (1 + tolerance) * target)))


def unit_conversions(df: DataFrame, sample: str, counts: str, length: str) -> DataFrame:
    """CPM, TPM and RPKM of counts with lengths, and log2 and natural log of TPM + 1; NULL for an empty sample."""
    rate = F.try_divide(F.col(counts), F.col(length))
    j = lookup_join(df, df.groupBy(sample).agg(F.sum(counts).alias("_lib"), F.sum(rate).alias("_rate")), [sample])
    tpm = F.try_divide(rate, F.col("_rate")) * 1e6
    return (j.withColumn("cpm", F.try_divide(F.col(counts), F.col("_lib")) * 1e6).withColumn("tpm", tpm)
            .withColumn("rpkm", F.try_divide(rate, F.col("_lib")) * 1e9)
            .withColumn("log2_tpm", F.log2(F.col("tpm") + 1)).withColumn("log1p_tpm", F.log1p("tpm")).drop("_lib", "_rate"))


def difference_of_differences(df: DataFrame, region: str, study: str, arm: str, value: str, on: str, off: str, tested: str,
                              out: str = "dod") -> DataFrame:
    """log2 on/off of the tested study minus the mean of the other studies; regions that lack a side are left out."""
    arms = df.groupBy(region, study).agg(*[F.avg(F.when(F.col(arm) == a, F.col(value))).alias(n) for a, n in ((on, "_on"), (off, "_off"))])
    d = F.log2("_on") - F.log2("_off")
    g = arms.groupBy(region).agg(F.max(F.when(F.col(study) == tested, d)).alias("_t"), F.avg(F.when(F.col(study) != tested, d)).alias("_c"))
    return g.where("_t is not null and _c is not null").select(region, (F.col("_t") - F.col("_c")).alias(out))


def zscore(df: DataFrame, by: Sequence[str], value: str, out: str, sample_sd: bool = True) -> DataFrame:
    """Z-score within groups (none: over all rows); NULL stays NULL, a constant group gives NULL."""
    sd = F.stddev_samp(value) if sample_sd else F.stddev_pop(value)
    keyed = df.withColumn("_one", F.lit(1))
    keys = [*by] or ["_one"]
    j = lookup_join(keyed, keyed.groupBy(*keys).agg(F.avg(value).alias("_m"), sd.alias("_sd")), keys)
    return j.withColumn(out, (F.col(value) - F.col("_m")) / F.when(F.col("_sd") > 0, F.col("_sd"))).drop("_one", "_m", "_sd")


def composite_score(df: DataFrame, sample: str, feature: str, value: str, up: Sequence[str], down: Sequence[str]) -> DataFrame:
    """Per sample: mean z of the up features, of the down features, and their difference (z over samples, population sd)."""
    m = df.groupBy(feature).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_sd"))
    z = (F.col(value) - F.col("_m")) / F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0)
    side = lambda names: F.avg(F.when(F.col(feature).isin(*names), z))
    g = lookup_join(df, m, [feature]).groupBy(sample).agg(side(up).alias("up"), side(down).alias("down"))
    return g.withColumn("composite", F.col("up") - F.col("down"))


def above_control(df: DataFrame, stage: str, score: str, control, out: str = "above_control") -> DataFrame:
    """Whether each stage's score exceeds that of the control stage."""
    one = cut(df).withColumn("_one", F.lit(1))
    ref = one.where(F.col(stage) == control).groupBy("_one").agg(F.max(score).alias("_ref"))
    return lookup_join(one, ref, ["_one"]).withColumn(out, F.col(score) > F.col("_ref")).drop("_one", "_ref")


# ---- comparisons

def means_in_order(df: DataFrame, by: Sequence[str], order: Sequence[Column], **values: Column) -> DataFrame:
    """Mean of each of ``values`` per ``by``, its rows added one by one in ``order``.

    A mean of doubles that lies on a threshold falls on either side of it with the order of the additions; here that does
    not depend on how rows are dealt to tasks. The window adds as it goes, so no group is held as a list.
    """
    by = list(by)
    rows = df.select(*by, F.struct(*order).alias("_at"), *[x.alias(name) for name, x in values.items()])
    so_far = Window.partitionBy(*by).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = rows.select(*by, "_at", *[F.avg(name).over(so_far).alias(name) for name in values])
    last = run.groupBy(*by).agg(F.max_by(F.struct(*values), "_at").alias("_last"))
    return last.select(*by, "_last.*")


def differential_summary(df: DataFrame, comparison: str, effect: str, p: str, significant: str) -> DataFrame:
    """Tested, significant, gained and lost per comparison, and the significant share in percent."""
    s = F.col(significant)
    g = df.groupBy(comparison).agg(F.count(p).alias("n_tested"), F.count_if(s).alias("n_significant"), F.count_if(s & (F.col(effect) > 0)).alias("n_gained"),
                                   F.count_if(s & (F.col(effect) < 0)).alias("n_lost"))
    return g.withColumn("pct", F.try_divide(100.0 * F.col("n_significant"), F.col("n_tested")))


def late_set(df: DataFrame, region: str, comparison: str, effect: str, significant: str, late: Sequence[str]) -> DataFrame:
    """Regions significant anywhere and in a late comparison; gains and losses by the last late effect there is."""
    last = F.coalesce(*[F.max(F.when(F.col(comparison) == c, F.col(effect))) for c in reversed(list(late))])
    s = F.col(significant)
    r = df.groupBy(region).agg(F.bool_or(s).alias("_any"), F.bool_or(s & F.col(comparison).isin(*late)).alias("_late"), last.alias("_rep"))
    return r.agg(F.count_if("_any").alias("n_union"), F.count_if("_late").alias("n_late"), F.count_if(F.col("_late") & (F.col("_rep") > 0)).alias("n_gained"),
                 F.count_if(F.col("_late") & (F.col("_rep") < 0)).alias("n_lost"))


def category_share(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows per category and their fraction of all rows."""
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).withColumn("_one", F.lit(1))
    return lookup_join(g, g.groupBy("_one").agg(F.sum("n").alias("_t")), ["_one"]).withColumn("fraction", F.col("n") / F.col("_t")).drop("_one", "_t")


def marker_directions(df: DataFrame, study: str, marker: str, value: str, on: Column, up: Sequence[str]) -> DataFrame:
    """Mean difference on minus off per study and marker, and whether its sign is the expected one."""
    off = ~on
    g = df.groupBy(study, marker).agg(F.avg(F.when(on, F.col(value))).alias("_a"), F.avg(F.when(off, F.col(value))).alias("_b"))
    gap = F.col("_a") - F.col("_b")
    want = F.when(F.col(marker).isin(*up), 1).otherwise(-1)
    return g.select(study, marker, gap.alias("difference"), (F.signum(gap) == want).alias("expected"))


def require_markers(gate: DataFrame, marker: str, passes: str) -> DataFrame:
    """The gate table itself, with an error when it is evaluated and a marker does not pass."""
    stop = F.raise_error(F.concat(F.lit("marker gate failed: "), F.coalesce(F.col(marker).cast("string"), F.lit("NULL")))).cast("boolean")
    return gate.withColumn(passes, F.when(F.coalesce(F.col(passes), F.lit(False)), F.lit(True)).otherwise(stop))


def marker_gate(df: DataFrame, marker: str, value: str, on: Column, up: Sequence[str], down: Sequence[str], least_t: float) -> DataFrame:
    """One row per listed marker: group means, Welch t and df, direction found and expected, and whether it passes.

    A marker passes when it moves as expected with abs(t) of at least ``least_t``; one without rows, or without a t, fails.
    """
    listed = df.sparkSession.createDataFrame([(m, "UP") for m in up] + [(m, "DOWN") for m in down], f"`{marker}` string, expected string")
    w = welch(df.where(F.col(marker).isin(*up, *down)), [marker], value, on)
    found = F.when(F.col("mean1") > F.col("mean0"), "UP").when(F.col("mean1") < F.col("mean0"), "DOWN").otherwise("NONE")
    out = listed.join(w, marker, "left").withColumn("direction", found)
    good = (F.col("direction") == F.col("expected")) & (F.abs("t") >= least_t)
    return out.select(marker, F.col("mean1").alias("on_mean"), F.col("mean0").alias("off_mean"), "t", "df", "direction", "expected",
                      F.coalesce(good, F.lit(False)).alias("passes"))


def behind_gate(df: DataFrame, gate: DataFrame, marker: str, passes: str) -> DataFrame:
    """The rows of ``df``, if every marker of the gate passes; else an error that names those that fail, when the rows are read.

    The gate holds one row per marker of a list given by the caller, so its summary is one small row. An empty gate stops too.
    """
    bad = F.when(~F.coalesce(F.col(passes), F.lit(False)), F.coalesce(F.col(marker).cast("string"), F.lit("NULL")))
    verdict = gate.agg(F.array_join(F.array_sort(F.collect_list(bad)), ", ").alias("_failed"), F.count(F.lit(1)).alias("_listed")).withColumn("_one", F.lit(1))
    stop = F.raise_error(F.concat(F.lit("marker gate failed: "), F.when(F.col("_listed") == 0, "no marker").otherwise(F.col("_failed")))).cast("boolean")
    through = F.when((F.col("_failed") == "") & (F.col("_listed") > 0), F.lit(True)).otherwise(stop)
    return lookup_join(df.withColumn("_one", F.lit(1)), verdict, ["_one"]).where(through).select(*df.columns)


def range_test(df: DataFrame, group: str, value: str, reference: Sequence[str]) -> DataFrame:
    """Values of each group inside the reference groups' range."""
    one = df.withColumn("_one", F.lit(1))
    r = one.where(F.col(group).isin(*reference)).groupBy("_one").agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    inside = F.col(value).between(F.col("_lo"), F.col("_hi"))
    return lookup_join(one, r, ["_one"]).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(inside).alias("n_inside"), F.bool_and(inside).alias("all_inside"))


def histogram(df: DataFrame, by: Sequence[str], bins: Mapping[str, Column]) -> DataFrame:
    """Row counts over one or more bin columns (1-D, log or 2-D); rows with a NULL bin are left out."""
    binned = df.withColumns(dict(bins))
    for name in bins:
        binned = binned.where(F.col(name).isNotNull())
    return binned.groupBy(*by, *bins).agg(F.count(F.lit(1)).alias("n"))


def linear_bin(value: str, width: float) -> Column:
    return F.floor(F.col(value) / width)


def log_bin(value: str, per_decade: int) -> Column:
    """NULL for values that are not positive."""
    return F.floor(F.log10(F.when(F.col(value) > 0, F.col(value))) * per_decade)


def _residuals(df: DataFrame, x: str, y: str, *more: str) -> DataFrame:
    """x, y, the absolute residual ``r`` of the least-squares line over all rows with both, and a constant ``g``."""
    p = cut(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*more, F.col(x).alias("x"), F.col(y).alias("y"), F.lit(1).alias("g")))
    fit = p.groupBy("g").agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"))
    return lookup_join(p, fit, ["g"]).withColumn("r", F.abs(F.col("y") - F.col("a") - F.col("b") * F.col("x")))


def residual_by_level(df: DataFrame, x: str, y: str, levels: int) -> DataFrame:
    """Mean absolute residual of the least-squares line per quantile level of x, and its correlation with x."""
    e = _residuals(df, x, y)
    per = quantile_buckets(e, ["g"], "x", levels, "level").groupBy("g", "level").agg(
        F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean_abs_residual"), F.avg("x").alias("mean_level"))
    return lookup_join(per, e.groupBy("g").agg(safe_corr("r", "x").alias("corr_residual_level")), ["g"]).drop("g")


def residual_by_class(df: DataFrame, label: str, x: str, y: str) -> DataFrame:
    """Residuals of one line over all rows, per class: mean size, correlation with the level, and the correlation of x and y.

    Rows without a class are a class of their own; correlations that do not exist are NULL.
    """
    return _residuals(df, x, y, label).groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean_abs_residual"), safe_corr("r", "x").alias("corr_residual_level"),
        safe_corr("y", "x").alias("corr_x_y"))


def balanced_contrast(df: DataFrame, by: Sequence[str], study: str, pair: tuple[str, str], status: str, levels: Sequence[str], value: str) -> DataFrame:
    """Difference of two studies with every status weighing the same, whatever each study's numbers of rows.

    ``contrast`` is the mean over the statuses of the difference of means, NULL unless both studies have all of them;
    ``n_status`` counts the statuses both have; ``unbalanced`` is the plain difference of means. One aggregation, one row
    per ``by``; NULL keys are keys of their own, rows of other studies or statuses take no part.
    """
    def mean(s: str, lv: str | None = None) -> Column:
        mine = F.col(study) == s if lv is None else (F.col(study) == s) & (F.col(status) == lv)
        return F.avg(F.when(mine, F.col(value)))

    used = df.where(F.col(study).isin(*pair) & F.col(status).isin(*levels))
    g = used.groupBy(*by).agg(F.array(*[mean(pair[0], lv) - mean(pair[1], lv) for lv in levels]).alias("_d"), (mean(pair[0]) - mean(pair[1])).alias("unbalanced"))
    total = F.aggregate("_d", F.lit(0.0), lambda a, d: a + d)  # NULL if any difference is
    have = F.size(F.filter("_d", lambda d: d.isNotNull())).cast("long")
    return g.select(*by, have.alias("n_status"), (total / len(levels)).alias("contrast"), "unbalanced")


def leave_one_out(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Predict each column by the mean of the others: n, Pearson, and the projection on the predicted axis."""
    def mean_of(cols: list[Column]) -> Column:
        got = sum(F.when(c.isNotNull(), 1).otherwise(0) for c in cols)
        return sum(F.coalesce(c, F.lit(0.0)) for c in cols) / F.when(got > 0, got)

    rows = wide.select(F.explode(F.array(*[F.struct(F.lit(h).alias("held"), F.col(h).alias("meas"), mean_of([F.col(c) for c in columns if c != h]).alias("pred"))
                                           for h in columns])).alias("z")).select("z.*").where("meas is not null and pred is not null")
    return rows.groupBy("held").agg(F.count(F.lit(1)).alias("n"), safe_corr("pred", "meas").alias("pearson"),
                                    F.try_divide(F.sum(F.col("pred") * F.col("meas")), F.sqrt(F.sum(F.col("pred") * F.col("pred")))).alias("projection"))


def delta_agreement(pairs: DataFrame, by: Sequence[str], x: str, y: str, big: float = 1.0) -> DataFrame:
    """Spearman of two studies' deltas per pair, with the number of large deltas on either side."""
    n = pairs.groupBy(*by).agg(F.count_if(F.abs(x) > big).alias("n_big_a"), F.count_if(F.abs(y) > big).alias("n_big_b"))
    return keyed_join(correlations(pairs, by, x, y).select(*by, "n", "spearman"), n, by)


def trajectory(df: DataFrame, feature: str, stage: str, value: str, digits: int = 3) -> DataFrame:
    """Mean per ordered stage as text, log2 of last over first, and the correlation with the stage.

    One entry per stage: the list is as long as the number of stages.
    """
    m = df.groupBy(feature, stage).agg(F.avg(value).alias("_v"))
    means = F.transform(F.sort_array(F.collect_list(F.struct(stage, "_v"))), lambda x: F.round(x["_v"], digits).cast(f"decimal(18,{digits})").cast("string"))
    return m.groupBy(feature).agg(F.array_join(means, ",").alias("means"), F.log2(F.try_divide(F.max_by("_v", stage), F.min_by("_v", stage))).alias("last_over_first"),
                                  safe_corr("_v", stage).alias("r"))


def group_separation(df: DataFrame, by: Sequence[str], label: str, score: str, limit: float = 2.0) -> DataFrame:
    """Distance of the two label means over the mean of their sds."""
    g = df.groupBy(*by, label).agg(F.avg(score).alias("_m"), F.stddev_samp(score).alias("_s"))
    mean = lambda v: F.max(F.when(F.col(label) == v, F.col("_m")))
    gap = F.try_divide(F.abs(mean(1) - mean(0)), F.avg("_s"))
    return g.groupBy(*by).agg(gap.alias("separation")).withColumn("separated", F.col("separation") > limit)
