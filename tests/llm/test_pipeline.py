"""The pipeline's stages: what each keeps, and that its decisions take effect."""

from collections import Counter

from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as cp
from regulus.llm import jaccard, pii
from regulus.llm.queries import QUERIES

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, k long, label string"


def test_stages_on_the_smallest_table(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    start = docs.columns
    lang = cp.identify_language(spark, docs, sf)
    assert lang.columns == start and lang.count() >= 0.95 * docs.count()
    lang.write.parquet(str(tmp_path / "a"))
    lang = spark.read.parquet(str(tmp_path / "a"))
    near = cp.drop_near_duplicates(spark, lang, sf)
    want = jaccard.classes(lang).select("component_id").distinct().count()
    assert near.columns == start and near.count() == want
    ids = {r.doc_id for r in near.select("doc_id").collect()}
    assert ids == {r.component_id for r in jaccard.classes(lang).select("component_id").collect()}
    near.write.parquet(str(tmp_path / "b"))
    near = spark.read.parquet(str(tmp_path / "b"))
    clean = cp.redact_personal_data(spark, near, sf)
    rows = {r.doc_id: r for r in clean.collect()}
    for r in near.collect():
        found = any(pii.base_spans(r.text))
        assert (rows[r.doc_id].text != r.text) >= found
        assert rows[r.doc_id].source == r.source and not any(pii.base_spans(rows[r.doc_id].text))
    mixed = cp.mix_sources(spark, clean, sf)
    assert mixed.columns == start and max(Counter(r.doc_id for r in mixed.collect()).values()) <= 3
    packed = cp.pack_sequences(spark, mixed, sf)
    assert packed.select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()


def test_stages_on_odd_rows(spark):
    text = "a plain text of some words that is long enough to stay here, and it says little more than that."
    rows = [(1, text, "en", "a", 5, 1, "x"), (1, text, "en", "a", 5, 1, "x"), (2, None, None, None, None, None, None), (3, "", "en", None, 0, 0, ""),
            (None, text, "en", "b", 1, 1, "y"), (4, "1234 !!", "en", "b", 1, 1, "y"), (5, text.upper() + " mail a.b@c.de", None, "c", 1, 1, "z")]
    docs = spark.createDataFrame(rows, COLUMNS)
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        out.collect()
        stage(spark, docs.limit(0), "").collect()
    assert Counter(r.doc_id for r in cp.drop_near_duplicates(spark, docs, "").collect())[1] == 1
    assert cp.drop_near_duplicates(spark, docs, "").count() == 4  # row 5 is a near copy of row 1
    assert all("@" not in (r.text or "") for r in cp.redact_personal_data(spark, docs, "").collect())
    assert cp.pack_sequences(spark, docs, "").count() == 7


def test_columns_named_like_the_stages_own(spark):
    names = ["score", "lang_pred", "bits_per_byte", "_row", "_key", "_mix_size", "_mix_hash", "sid", "t"]
    text = "a plain text of some words that is long enough to stay here, and it says little more than that."
    docs = spark.createDataFrame([(i, text + f" no {i % 3}", "en", "ab"[i % 2], 5, *[10 + i] * len(names)) for i in range(9)],
                                 "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[n] == 10 + r.doc_id for r in rows for n in names), name
    assert cp.pack_sequences(spark, docs, "").count() == 9


def test_registered(spark, sf):
    q = entry.queries()
    assert set(QUERIES) | {"pipeline"} <= set(q) and sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
    assert [n for n, _ in cp.STAGES] == ["language", "near duplicates", "personal data", "mixing", "packing"]
    out = q["pipeline"](spark, sf)
    assert out.where(F.col("length") > 2048).count() == 0 and out.count() > 0
