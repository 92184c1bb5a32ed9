"""Corpus pipeline: from raw documents to a seeded training mix.

Every stage works on all rows that its predecessor kept and returns the columns
of ``documents``; the last one adds the mix.  ``run`` writes each stage's
result to the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm.common import fold
from flowlens.llm.decontaminate import decontaminate
from flowlens.llm.language_id import UNDETERMINED, fit, identify
from flowlens.llm.mixing import mix
from flowlens.llm.ngram_join import keep_one_per_class
from flowlens.llm.secrets import redact
from flowlens.operators._small import materialize

# Models and flows have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a determinable language: no text, no letter, or
    two languages that fit equally well."""
    model = fit(docs.where(fold(F.col("doc_id"), 4) != 2), "text", "lang")
    found, n = identify(docs, model)
    return found.where((F.col(n["lang_pred"]) != UNDETERMINED) & ~F.col(n["ambiguous"])).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of every group of linked texts."""
    return keep_one_per_class(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the texts; documents stay."""
    return redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, with the mix's columns."""
    mixed, n = mix(docs)
    return mixed.where(F.col(n["taken"]) > 0)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("secrets", secrets),
    ("source_mix", source_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
