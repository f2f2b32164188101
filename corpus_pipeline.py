"""A corpus pipeline: every stage works on all rows that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from relweave.llm.decontaminate import drop_contaminated
from relweave.llm.lines import drop_repeated_lines
from relweave.llm.mixing import mix_sources
from relweave.llm.nearcopies import keep_one
from relweave.llm.scratch import Scratch
from relweave.llm.toxicity import drop_toxic, fit
from relweave.session import tune


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity score is at least 0.7."""
    return drop_toxic(docs, fit(docs, _table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that repeat across documents; every document stays."""
    return drop_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near copies."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix of all sources takes of each document."""
    return mix_sources(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: SQL can't express the stages that score, sample or fingerprint
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again by the next."""
    scratch = Scratch(tune(spark))
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return docs
