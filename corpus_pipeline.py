"""Corpus pipeline: language ID, near-duplicates, benchmark leaks, secrets, mixing.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir) and
returns what it kept, with the columns of documents.  Each stage works on all its
predecessor kept.  The last one returns the mix: the columns of documents and
``copy``, a row for each emission.

Every stage accepts nulls in any column, empty tables, repeated rows and extra
columns whatever their names.  Documents without a letter go in the first stage;
rows without id are judged by their text.  No stage changes a text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import decontaminate, langid, mixing, secret_scan, simhash
from tillroll.llm.text import n_words, read_table
from tillroll.session import scratch_path

#: A document stays if its language is found at this probability or more.
MIN_LANGUAGE_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined, at ``MIN_LANGUAGE_SCORE`` or more."""
    model = langid.fit_language_model(docs)
    named = langid.language_id(docs, [F.struct("*").alias("row")], F.col("text"), model)
    sure = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE)
    return named.where(sure).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least id."""
    return simhash.one_of_each(docs, "doc_id", "text", shingle=4, max_bits=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontaminate.without_contaminated(
        docs, F.col("text"), read_table(spark, sf_dir, "benchmark"), F.col("item_id"), F.col("text"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a secret."""
    scanned = secret_scan.secret_spans(docs, [F.struct("*").alias("row")], F.col("text"))
    return scanned.where(F.size("spans") == 0).select("row.*")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources at their targets, a row for each emission."""
    return mixing.mixed(docs, "doc_id", "source", n_words(F.col("text")))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("source_mix", source_mix),
]
#: The language model cannot be told in SQL; the tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order on the table ``documents``, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, "pipeline", f"{name}-{uuid.uuid4().hex}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
