"""Metadata harmonisation: characteristics, ordered rules, keyword tags, identifiers and policies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regulus.session import cut, keyed_join, lookup_join

# Keyword lists of the induction classes and of the sample status.
INDUCTION_KEYWORDS = {
    "replicative": ["replicative", "serial passage", "population doubling"],
    "oncogene-induced (OIS)": ["ras", "raf", "oncogen", "4oht", "tamoxifen", "er-ras"],
    "therapy-induced (TIS)": ["doxorubicin", "etoposide", "chemo", "therapy-induced", "bleomycin"],
    "irradiation-induced": ["irradiat", "ir-induced", "gamma", "x-ray"],
}
SENESCENT_KEYWORDS = ["senescent", "senescence-committed", "committed"]
PROLIFERATING_KEYWORDS = ["proliferat", "uncommitted", "young", "growing", "presenescent", "quiescent"]


def characteristics_map(entries: Column) -> Column:
    """``key: value`` entries to a map with lower-cased keys; no colon means an empty value; last wins."""
    def entry(c: Column) -> Column:
        at = F.instr(c, ":")
        key = F.when(at > 0, F.substring(c, F.lit(1), at - 1)).otherwise(c)
        return F.struct(F.lower(F.trim(key)).alias("key"),
                        F.when(at > 0, F.trim(F.substring(c, at + 1, F.length(c)))).otherwise("").alias("value"))

    pairs = F.transform(entries, entry)
    # keep the last entry of each key
    keep = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(keep)


def first_rule(text: Column, rules: Sequence[tuple[str, str]], default: str = "UNPARSED") -> Column:
    """Label of the first pattern that matches."""
    out = F.lit(default)
    for pattern, label in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(label)).otherwise(out)
    return out


def keyword_tags(text: Column, groups: Mapping[str, Sequence[str]]) -> Column:
    """All labels with a keyword in the lower-cased text, joined by ``;``."""
    low = F.lower(text)
    hits = [F.when(_any_in(low, words), F.lit(label)) for label, words in groups.items()]
    return F.concat_ws(";", *hits)


def _any_in(low: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return out


def longest_keyword(text: Column, labels: Mapping[str, str], default: Column) -> Column:
    """Longest key first, so a key that is part of another cannot shadow it."""
    low, out = F.lower(text), default
    for key in sorted(labels, key=len):
        out = F.when(F.contains(low, F.lit(key)), F.lit(labels[key])).otherwise(out)
    return out


def negated_status(text: Column, negation: str, positive: Sequence[str], other: Sequence[str],
                   names: tuple[str, str, str]) -> Column:
    """Negation beats positive beats other; empty when nothing matches."""
    low = F.lower(text)
    return (F.when(F.contains(low, F.lit(negation)), names[0]).when(_any_in(low, positive), names[1])
            .when(_any_in(low, other), names[2]).otherwise(""))


def first_extract(default: Column, *attempts: tuple[Column, str, int]) -> Column:
    """First non-empty capture of (text, pattern, group), else the default."""
    return F.coalesce(*[F.nullif(F.regexp_extract(t, p, g), F.lit("")) for t, p, g in attempts], default)


def assign_roles(df: DataFrame, arm: str, level: str, off_max: float, on_min: float,
                 policies: Mapping[str, str]) -> DataFrame:
    """Class and role per sample. The time-course arm splits at two levels with a transition policy;
    the other arms follow their policy: exclude, as_off, as_on, third_class or holdout."""
    lv = F.col(level)
    course = policies["transition"]
    middle = {"exclude": ("transition_ambiguous", "excluded"), "assign_off": ("proliferating", "train_eligible"),
              "assign_on": ("senescent", "train_eligible")}[course]
    kinds = {"exclude": ("{}_control", "excluded"), "as_off": ("proliferating", "train_eligible"),
             "as_on": ("senescent", "train_eligible"), "third_class": ("{}", "train_eligible"), "holdout": ("{}", "holdout")}
    cls = F.when(F.col(arm) == "course", F.when(lv <= off_max, "proliferating").when(lv >= on_min, "senescent").otherwise(middle[0]))
    role = F.when(F.col(arm) == "course", F.when((lv <= off_max) | (lv >= on_min), "train_eligible").otherwise(middle[1]))
    for name, policy in policies.items():
        if name != "transition":
            c, r = kinds[policy]
            cls = cls.when(F.col(arm) == name, c.format(name))
            role = role.when(F.col(arm) == name, r)
    return df.withColumn("cls", cls.otherwise("UNKNOWN ARM")).withColumn("role", role.otherwise("excluded"))


@dataclass(frozen=True)
class Arm:
    """An arm of a study and the policy that places its samples.

    ``inner`` marks samples of the arm that are something else, such as a baseline of day 0 or a time point before the
    arrest: under ``as_on`` they are off, under ``third_class`` they are left out, and else they only keep their own label.
    """

    name: str
    policy: str                 # exclude, as_off, as_on, third_class or holdout
    label: str
    inner: Column | None = None
    inner_label: str | None = None


def roles_by_arm(df: DataFrame, arm: str, arms: Sequence[Arm], off: str, on: str, unknown: str = "UNKNOWN ARM") -> DataFrame:
    """``cls`` and ``role`` per sample by its arm's policy; samples of no listed arm are ``unknown`` and excluded.

    A NULL in ``inner`` counts as outside it.
    """
    eligible = "train_eligible"
    row = lambda cls, role: F.struct(F.lit(cls).alias("cls"), F.lit(role).alias("role"))
    out = F.when(F.lit(False), row(unknown, "excluded"))
    for a in arms:
        own = a.inner_label or a.label
        inner, rest = {"exclude": ((own, "excluded"), (a.label, "excluded")), "as_off": ((off, eligible), (off, eligible)),
                       "as_on": ((off, eligible), (on, eligible)), "third_class": ((own, "excluded"), (a.label, eligible)),
                       "holdout": ((own, "holdout"), (a.label, "holdout"))}[a.policy]
        mine = F.col(arm) == a.name
        if a.inner is not None:
            out = out.when(mine & F.coalesce(a.inner, F.lit(False)), row(*inner))
        out = out.when(mine, row(*rest))
    return df.withColumn("_place", out.otherwise(row(unknown, "excluded"))).select(*df.columns, "_place.cls", "_place.role")


def corrupted_key(c: Column) -> Column:
    """Identifiers a spreadsheet turned into dates."""
    return c.rlike(r"^\d{4}-\d{2}-\d{2}")


def unanimous(field: Column, sep: str, sub: tuple[str, int] | None = None, placeholders: Sequence[str] = ("",)) -> Column:
    """The single value of a multi-valued field, NULL when its parts differ.

    ``sub`` = (separator, index) compares one sub-field of each part; parts that are a placeholder or lack
    that sub-field do not count.
    """
    def value(x: Column) -> Column:
        return F.trim(x) if sub is None else F.coalesce(F.trim(F.get(F.split(x, sub[0]), F.lit(sub[1]))), F.lit(placeholders[0]))

    parts = F.array_distinct(F.filter(F.transform(F.split(field, sep), value), lambda x: ~x.isin(*placeholders)))
    return F.when(F.size(parts) == 1, F.get(parts, F.lit(0)))


def resolve_duplicates(df: DataFrame, key: str, value: str, policy: str, order: str) -> DataFrame:
    """One row per key: first / last by order, sum, max or mean of the value."""
    agg = {"first": F.min_by(value, order), "highest": F.max_by(value, F.struct(F.col(value), -F.col(order))),
           "sum": F.sum(value), "max": F.max(value), "mean": F.avg(value), "longest": F.max_by(value, order)}[policy]
    return df.groupBy(key).agg(agg.alias(value))


def old_name_classes(registry: DataFrame, symbol: str, olds: Sequence[str], status: str | None = None,
                     approved: str = "Approved") -> DataFrame:
    """One row per old name or symbol in one pass: (old, target, kind, n_targets).

    ``approved``: an approved symbol itself, never remapped, whatever else carries it as an old name; ``unique``: an old
    name of exactly one approved symbol, its ``target``; ``ambiguous``: of several; ``withdrawn``: known from
    records that are not approved only. Without ``status`` every record is approved. NULL and empty names do not count.
    """
    live = F.lit(True) if status is None else F.coalesce(F.col(status) == approved, F.lit(False))
    previous = F.split(F.concat_ws("|", *[F.col(o) for o in olds]), r"\|")
    names = F.concat(F.array(F.struct(F.col(symbol).alias("old"), F.lit(True).alias("own"))),
                     F.transform(previous, lambda o: F.struct(F.trim(o).alias("old"), F.lit(False).alias("own"))))
    rows = registry.select(live.alias("live"), F.col(symbol).alias("target"), F.explode(names).alias("n"))
    rows = rows.select("live", "target", "n.old", "n.own").where("old is not null and old <> ''")
    # a name has one row per record in a registry; least and greatest target tell one from several
    mine = F.when(F.col("live") & ~F.col("own"), F.col("target"))
    g = rows.groupBy("old").agg(F.bool_or(F.col("live") & F.col("own")).alias("is_live"), F.min(mine).alias("lo"), F.max(mine).alias("hi"),
                                F.count_distinct(mine).alias("n_targets"))
    kind = F.when(F.col("is_live"), "approved").when(F.col("lo").isNull(), "withdrawn").when(F.col("lo") == F.col("hi"), "unique").otherwise("ambiguous")
    return g.select("old", F.when(kind == "unique", F.col("lo")).alias("target"), kind.alias("kind"), "n_targets")


def alias_table(registry: DataFrame, symbol: str, olds: Sequence[str], status: str | None = None, approved: str = "Approved") -> DataFrame:
    """(old, target) for old names that are no approved symbol and belong to exactly one approved symbol."""
    return old_name_classes(registry, symbol, olds, status, approved).where("kind = 'unique'").select("old", "target")


def resolved_keys(df: DataFrame, source: str, key: str, value: str, registry: DataFrame, symbol: str, olds: Sequence[str],
                  status: str | None = None, approved: str = "Approved") -> DataFrame:
    """One row per (source, key): its rows and largest value, what the registry says of it, ``action`` and the ``resolved`` key.

    ``renamed`` onto its approved symbol; ``collision`` where the source carries that symbol already; else ``kept``.
    """
    # one row per (source, key) before any join: a key with very many rows weighs no more than others
    per = cut(df.groupBy(source, key).agg(F.max(value).alias(value), F.count(F.lit(1)).alias("n_rows")))
    classes = old_name_classes(registry, symbol, olds, status, approved).withColumnRenamed("old", key)
    present = per.select(source, F.col(key).alias("target"), F.lit(True).alias("_there")).where("target is not null")
    # a NULL source is a source of its own
    j = keyed_join(per.join(classes, key, "left"), present, [source, "target"], "left")
    action = F.when(F.col("target").isNull(), "kept").when(F.col("_there"), "collision").otherwise("renamed")
    j = j.withColumn("action", action).withColumn("kind", F.coalesce("kind", F.lit("unknown")))
    return j.select(source, key, value, "n_rows", "kind", "action", F.when(F.col("action") == "renamed", F.col("target")).otherwise(F.col(key)).alias("resolved"))


def harmonise(df: DataFrame, source: str, key: str, value: str, registry: DataFrame, symbol: str,
              olds: Sequence[str], status: str | None = None, approved: str = "Approved") -> DataFrame:
    """Rename keys of each source onto approved symbols; a target already present is left alone;
    rows that meet after renaming are merged by maximum. Adds ``action``."""
    named = resolved_keys(df, source, key, value, registry, symbol, olds, status, approved)
    return (named.groupBy(source, F.col("resolved").alias("symbol"))
            .agg(F.max(value).alias(value), F.sum("n_rows").alias("n_merged"), F.max("action").alias("action")))


def harmonise_statistics(df: DataFrame, source: str, key: str, value: str, registry: DataFrame, symbol: str,
                         olds: Sequence[str], status: str | None = None, approved: str = "Approved") -> DataFrame:
    """Per source, in rows: renamed, collisions left alone, merged into another row of the resolved key, and not an
    approved symbol afterwards, the last split into ambiguous, withdrawn and unknown names (collisions are old names too)."""
    named = resolved_keys(df, source, key, value, registry, symbol, olds, status, approved)
    rows = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n_rows"))), F.lit(0)).cast("long")
    per = named.groupBy(source, "resolved").agg(
        F.sum("n_rows").alias("n"), rows(F.col("action") == "renamed").alias("renamed"), rows(F.col("action") == "collision").alias("collisions"),
        rows((F.col("action") != "renamed") & (F.col("kind") != "approved")).alias("not_approved"),
        *[rows(F.col("kind") == k).alias(k) for k in ("ambiguous", "withdrawn", "unknown")])
    sums = ("renamed", "collisions", "not_approved", "ambiguous", "withdrawn", "unknown")
    return per.groupBy(source).agg(F.sum("n").alias("n_rows"), (F.sum("n") - F.count(F.lit(1))).alias("merged"), *[F.sum(c).alias(c) for c in sums])


def shared_keys(df: DataFrame, source: str, key: str) -> DataFrame:
    """Per source: its distinct keys, those present in every source, and its loss."""
    pairs = df.select(source, key).distinct()
    n = pairs.agg(F.count_distinct(source).alias("n_sources")).withColumn("_one", F.lit(1))
    spread = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("_k")).withColumn("_one", F.lit(1))
    common = lookup_join(spread, n, ["_one"]).where("_k = n_sources").select(key, F.lit(1).alias("_common"))
    per = pairs.join(common, key, "left").groupBy(source).agg(F.count(F.lit(1)).alias("n_keys"), F.count("_common").alias("n_shared"))
    return per.withColumn("n_lost", F.col("n_keys") - F.col("n_shared"))


def replicate_inventory(df: DataFrame, by: Sequence[str], unit: str, minimum: int = 3) -> DataFrame:
    """Tasks against independent units per condition, and a flag below the minimum."""
    return (df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_tasks"), F.count_distinct(unit).alias("n_units"))
            .withColumn("under_replicated", F.col("n_units") < minimum))
