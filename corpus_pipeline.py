"""The corpus pipeline: language, near copies, benchmark passages, personal data, packing. Each stage's rows are written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontaminate, dedup, language, packing, pii
from quillon.llm.common import discard, materialise, table, workspace


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that is clear; those that the operator rejects go."""
    found = language.identify(docs, language.train(docs.where(~language.held_out())))
    return found.where(~F.col("lang_rejected")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, decided by row: see dedup.drop_copies."""
    return dedup.drop_copies(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item within its edit budget."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def sanitise_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that disclose it replaced."""
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("benchmark_passages", drop_benchmark_passages),
    ("personal_data", sanitise_personal_data),
    ("packing", pack),
]

#: SQL cannot express the stages; tests/llm compares each with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage returns. A stage's scratch tables, and the rows it was given, are deleted once its own are written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with workspace(spark) as keep:
            done = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
            keep(done)
        if hasattr(docs, "scratch_path"):
            discard(spark, docs.scratch_path)
        docs = done
    return docs
