"""One query per operator over its whole table, with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regulus.llm import jaccard, language, lexical, licenses, minhash, mixing, packing, pii, quality, runs, suffix, topk, toxicity
from regulus.session import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op8_language")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.fitted(docs, ~language.held_out())
    out = language.predict(docs, model)
    return out.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")


@_query("op5_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    q = quality.assess(docs).select("doc_id", "quality.*")
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                    "n_lost_words")


@_query("op7_mixing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    sizes = cut(docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size")))
    rows = mixing.plan(sizes, F.col("size"))
    first = F.when(F.col("_mix_copies") > 0, mixing.position(F.lit(0)))
    return (rows.select("doc_id", "size", F.col("_mix_total").alias("source_size"), F.col("_mix_target").alias("target"),
                        (F.col("_mix_copies") * F.col("size")).alias("taken"), first.alias("position"))
            .repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id"))


@_query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.train(toxicity.sample(docs, labels, ~toxicity.held_out()))
    out = toxicity.score(docs, model)
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score",
                      F.when(F.col("score") >= 0.7, 1).otherwise(0).cast("int").alias("predicted"))


@_query("op3_topk", """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) f from embeddings
           where embedding is not null and len(embedding) > 0
             and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select q.vec_id query_id, c.vec_id, list_inner_product(q.f, c.f)::bigint score
      from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.f) = len(c.f)),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int "rank", vec_id, score from s)
select * from r where "rank" <= 5""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@_query("op2_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.packed_documents(_table(spark, sf_dir, "documents"), packing.vocabulary_path("word_bpe_49k.json"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "gap")


@_query("op9_licenses")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


@_query("op1_pii")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fitted(docs))


@_query("op4_jaccard")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(_table(spark, sf_dir, "documents"), percent=75, k=5)


@_query("op10_suffix")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removal(_table(spark, sf_dir, "documents"), span=200)


@_query("op12_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(_table(spark, sf_dir, "documents"), planted=True)


@_query("op13_lexical", r"""
with words as (select doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
d as (select doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') l from words),
bags as (select doc_id, len(l)::bigint n, unnest(l) term from d),
tfs as (select doc_id, n, term, count(*)::bigint tf from bags group by all),
total as (select count(*)::bigint docs, sum(len(l))::bigint words from d where len(l) > 0),
dfs as (select term, count(*)::bigint df from tfs group by term),
asked as (select distinct item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term from benchmark),
scored as (select item_id, doc_id, sum(floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint
               * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))))::bigint score
           from asked join dfs using (term) join tfs using (term), total group by item_id, doc_id),
ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int "rank", doc_id, score from scored where score > 0)
select * from ranked where "rank" <= 10""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


@_query("op11_minhash", r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x20\x09-\x0D]+') l from documents),
g as (select doc_id, case when len(l) = 0 then [] when len(l) < 5 then [array_to_string(l, ' ')]
                          else list_distinct(list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' '))) end s from w),
t as (select doc_id, len(s) n, unnest(s) x from g),
shared as (select a.doc_id a, b.doc_id b, any_value(a.n) na, any_value(b.n) nb, count(*) c
           from t a join t b on a.x = b.x and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
link as (select a, b from shared where 100 * c >= 85 * (na + nb - c)),
both_ways as (select a, b from link union all select b, a from link),
reach(a, b) as (select a, b from both_ways union select r.a, l.b from reach r join both_ways l on r.b = l.a),
least as (select a doc_id, min(b) m from reach group by a)
select g.doc_id, len(s)::bigint n_shingles, least(g.doc_id, coalesce(m, g.doc_id)) component_id,
       g.doc_id = least(g.doc_id, coalesce(m, g.doc_id)) kept
from g left join least using (doc_id)""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(_table(spark, sf_dir, "documents"), percent=85, k=5)
