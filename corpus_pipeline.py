"""Corpus preparation: identify languages, drop toxic documents, drop near-duplicates, pack for training.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again as the
next one's ``docs``. All but the last return the columns of ``documents``. Counted as part of ``fathomline.llm``.

Nulls and edges, stage by stage: a text that is null, empty or without a letter has no language and goes in the first
stage; a clean one stays whatever its labels. Rows that repeat another one are judged alike and go or stay together, until
the near-duplicate stage keeps one row of each class (the smallest ``doc_id``; of rows that repeat it one stays, and rows
without a ``doc_id`` all stay). Very long texts are read whole in every stage. Columns beyond those of ``documents``, of any
name, pass through the first three stages. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fathomline.llm import language, packing, simhash, toxicity
from fathomline.llm.common import materialize, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be identified go."""
    table(spark, sf_dir, "documents")
    return language.keep_identified(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked fingerprints stays."""
    table(spark, sf_dir, "documents")
    return simhash.keep_one_per_class(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in training sequences."""
    table(spark, sf_dir, "documents")
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("simhash_dedup", near_duplicate_stage),
    ("packing", packing_stage),
]

#: Trained models, hashes and packing are not expressible in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
