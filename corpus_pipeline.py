"""Corpus pipeline over ``documents``: language, near duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next
stage's ``docs``; all but the last return the columns of ``documents``. A stage works on everything its
predecessor kept. Empty tables, NULLs, repeated rows and extra columns are handled by the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regulus.llm import jaccard, language, mixing, packing, pii
from regulus.session import cut

# Stages 1 to 5 rest on trained models, shingle classes, a tokenizer and bin packing, which SQL cannot express.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in a language that the model knows; texts without a letter and incompressible ones go."""
    model = language.fitted(docs, ~language.held_out())
    return language.kept(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every class of near duplicates: that of the least doc_id (texts without a word all stay)."""
    return jaccard.representatives(docs, percent=75, k=5)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data in the text replaced by the kind of data."""
    return pii.redact(docs, pii.fitted(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every taken copy of every document, in the order of the curriculum."""
    return mixing.mixture(docs, mixing.n_words(F.col("text")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.packed_documents(docs, packing.vocabulary_path("word_bpe_49k.json"))


STAGES = [
    ("language", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("personal data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared checkpoint folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
