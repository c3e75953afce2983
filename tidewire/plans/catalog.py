"""The registry of named queries: each module contributes ``QUERIES`` and ``ORACLES``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewire.plans import event_queries, story_queries, text_queries

MODULES: list = [text_queries, story_queries, event_queries]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events out of all stories: deduplicated, classified, scored, clustered, with evidence and confidence."""
    return story_queries.collect_run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
