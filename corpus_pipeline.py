"""A corpus from raw documents to packed bins: toxicity, exact and near duplicates, benchmark passages, packing.

Each stage reads what its predecessor wrote. Filtering stages return the columns of ``documents``, whatever further columns
there are; the last returns one row a packed piece, with its text, so that the bins hold the corpus. Null texts count as
empty in every stage; an empty table passes through.  ``ORACLE_SQL`` is None: toxicity, near duplicates and packing are no SQL; the run is tested against a
brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewire.llm.decontaminate import decontaminate
from tidewire.llm.exact_dedup import exact_dedup
from tidewire.llm.near_dedup import near_dedup
from tidewire.llm.packing import pack
from tidewire.llm.shared import Workspace
from tidewire.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go. It is fitted on a bounded sample of the labelled documents among
    ``docs``. Null and empty texts get the score of the constant; without labels nothing goes; repeated rows go together; rows
    without an id are judged like others."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; all empty and null texts are equal. Rows that repeat an id and a
    text stay or go together; a row without an id stays only where no row of its text has one."""
    return exact_dedup(docs, keep="max")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, of five-word shingles and a similarity of 0.8 or more, the first document stays. Texts
    without words are in no class, and rows without an id stay; rows that repeat an id are one document."""
    return near_dedup(docs, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, in any order of its passages. Items without words, null ones among them, are in
    none; an empty benchmark takes nothing out."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed by words, with the texts of the pieces; equal texts and one source never share a bin. Empty and
    null texts and rows without an id have pieces too."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontamination", benchmark),
    ("packing", packing),
]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    work = Workspace(spark, "corpus-pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = work.keep(stage(spark, docs, sf_dir), name)
        if before is not None:
            work.drop(before)  # what the next stage has read whole
        before = docs
    return docs
