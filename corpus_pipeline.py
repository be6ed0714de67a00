"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Defined results of all stages: a null text counts as empty and stays null; empty and null texts are clean, copies of
nothing and free of benchmark items and secrets, so they are kept, and have no tokens; texts of any length are taken
whole; rows with equal ids are judged each, but rows that are copies of each other are a group like any other; columns
besides doc_id and text may have any names and values, and stay; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnmill.llm import bpe, decontaminate, jaccard, secrets, toxicity
from tarnmill.llm.common import new_path, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject; it learns from the labels of the documents it is given."""
    model = toxicity.learn(toxicity.train_rows(docs), toxicity.train_rows(table(spark, sf_dir, "labels")))
    return toxicity.keep_clean(docs, model)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, alike by 0.8 or more."""
    return jaccard.keep_one(docs, 5, 80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_matched(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their text replaced and their characters, if there is a count, counted anew."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as token ids, and the number of them."""
    import public_tokenizers

    coded = bpe.encode_documents(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_50k.json"), decoded=None, columns=["doc_id", "lang", "source"])
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("near_duplicates", keep_one_copy),
    ("decontamination", drop_benchmark),
    ("secrets", redact_secrets),
    ("bpe", tokenize),
]

#: No SQL has piecewise models, tilings or merges; tests hold the rows against the stages as plain functions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
