"""Corpus pipeline: documents in, packed token sequences out.

Five stages, each an operator of ``shopledger.llm`` over all rows that the stage before kept. Every stage is
written as Parquet under the shared folder and read again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopledger.llm import bpe, language, packing, personal, simhash, substrings
from shopledger.llm.text import importable, unused
from shopledger.session import fresh_path

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048


def _with_text(docs: DataFrame, text) -> DataFrame:
    """``docs`` with another text, its length counted anew, and the same columns in the same order."""
    rows = docs.withColumn("text", text)
    if "n_chars" in docs.columns:
        count = F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
        rows = rows.withColumn("n_chars", count)
    return rows.select(*docs.columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language, learned from all that name one; texts without letters (null, empty too) go, whatever their length.

    Repeated rows stay or go together; other columns stay as they are; an empty table stays empty.
    """
    found = language.predicted(language.fit(docs.select("text", "lang")), F.col("text"))
    (name,) = unused(docs, "__language")
    return docs.withColumn(name, found).where(F.col(f"{name}.lang_pred") != language.UNKNOWN).select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints (three words) differ in two bits at most.

    That of the smallest key stays, null keys last; texts without words are one group. Columns stay as they are.
    """
    return simhash.keep_first(docs, size=3, max_bits=2)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words or more that a document of a smaller id has too are cut out; every document stays.

    A null text stays null; null keys are the largest, and rows of one key are not compared.
    """
    cleaned = substrings.cleaned(docs)
    return _with_text(cleaned, F.col("text"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; every document stays, a null text stays null."""
    return _with_text(docs, personal.redacted(personal.fit(docs), F.col("text")))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens with their places in sequences; a null or empty text is its separator alone."""
    vocabulary = bpe.Vocabulary(spark, public_tokenizers.path(TOKENIZER))
    return packing.pack_documents(docs, vocabulary, CAPACITY)


STAGES = [
    ("language", known_language),
    ("near_copies", one_of_near_copies),
    ("passages", without_repeated_passages),
    ("personal_data", without_personal_data),
    ("packing", packed_sequences),
]

# Learned models, tokens and packing are beyond SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each stage's rows are stored before the next reads them."""
    docs = importable(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
