"""Five stages that turn documents into a training mix; each calls one operator of tidemark.llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.decontaminate import drop_contaminated
from tidemark.llm.line_dedup import drop_repeated_lines
from tidemark.llm.mixing import mix_documents
from tidemark.llm.near_dedup import near_duplicates
from tidemark.llm.training import free_name
from tidemark.llm.toxicity import score_toxicity, train_toxicity
from tidemark.session import scratch_path

TOXIC = 0.3


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below TOXIC; labels only teach the model."""
    model = train_toxicity(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free_name(docs, "toxicity")
    return score_toxicity(docs, model, score_col=score).where(F.col(score) < TOXIC).drop(score)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go, and documents that had nothing else with them."""
    removed = free_name(docs, "removed_lines")
    cut = drop_repeated_lines(docs, removed_col=removed)
    changed = F.size(removed) > 0
    cut = cut.where(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return cut.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars"))).drop(removed)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that shares 0.8 of its five-word shingles."""
    groups = near_duplicates(docs, size=5, percent=80)
    copies = groups.where(~F.col("kept")).select(F.col("doc_id").alias("_copy")).distinct()
    return docs.join(copies, docs["doc_id"] == F.col("_copy"), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled with the probabilities that meet the target shares."""
    return mix_documents(docs).where("sampled").drop("sampled")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

# Learned scores and signatures can't be expressed in SQL; the tests compare stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
