"""Defaults that follow from other columns, applied to raw entries and to articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire import rules
from tidewire.functions.text import article_id

ENTRY_DEFAULTS = {
    "source_type": ("string", "media"), "evidence_level": ("string", "industry_media"), "excerpt": ("string", ""), "content": ("string", ""),
    "is_primary_source": ("boolean", False), "is_independent_source": ("boolean", False), "is_discovery_source": ("boolean", False),
}
ARTICLE_DEFAULTS = ENTRY_DEFAULTS | {
    "is_official": ("boolean", False), "is_reference": ("boolean", False), "source_score": ("double", 0.0), "priority_score": ("double", 0.0), "score": ("double", 0.0),
    "category": ("string", "frontier_models"),
}
NULLABLE = {"authority_score": "int", "source_authority": "int", "publisher": "string", "canonical_url": "string", "original_url": "string", "primary_category": "string", "collected_at": "timestamp", "published_at": "timestamp", "article_id": "string"}


def _filled(df: DataFrame, defaults: dict) -> DataFrame:
    have = {c.lower() for c in df.columns}
    new = {c: F.coalesce(F.col(c), F.lit(v).cast(t)) if c in have else F.lit(v).cast(t) for c, (t, v) in defaults.items()}
    new |= {c: F.lit(None).cast(t) for c, t in NULLABLE.items() if c not in have}
    return df.withColumns(new)


def normalize_entries(df: DataFrame, ref_time: Column) -> DataFrame:
    """Raw entries: authority, publisher, canonical address and time of collection filled in from one another."""
    out = _filled(df, ENTRY_DEFAULTS)
    out = out.withColumn("source_authority", F.coalesce("source_authority", "authority_score", F.lit(rules.DEFAULT_AUTHORITY)))
    return out.withColumns(
        {
            "authority_score": F.coalesce("authority_score", "source_authority"),
            "publisher": F.coalesce("publisher", "source"),
            "canonical_url": F.coalesce("canonical_url", "url"),
            "collected_at": F.coalesce("collected_at", ref_time),
        }
    )


def normalize_articles(df: DataFrame, ref_time: Column) -> DataFrame:
    """Articles: ids, categories, authority and scores that mirror each other, flags and level that raise each other.

    The steps build on one another in this order; flags are raised, never cleared."""
    c, kind = F.col, F.col("source_type")
    out = _filled(df, ARTICLE_DEFAULTS)
    out = out.withColumns({"canonical_url": F.coalesce("canonical_url", "url"), "original_url": F.coalesce("original_url", "url")})
    given = F.coalesce(F.nullif("canonical_url", F.lit("")), c("url"))
    out = out.withColumn("article_id", F.coalesce("article_id", article_id(given))).withColumn("publisher", F.coalesce("publisher", "source"))
    out = out.withColumn("primary_category", F.coalesce("primary_category", "category"))
    out = out.withColumn("category", F.when((c("category") == "big") & (c("primary_category") != "big"), c("primary_category")).otherwise(c("category")))
    out = out.withColumn("source_authority", F.coalesce("source_authority", "authority_score", F.lit(rules.DEFAULT_AUTHORITY)))
    out = out.withColumn("authority_score", F.coalesce("authority_score", "source_authority"))
    mirror = lambda a, b: F.when((c(a) == 0) & (c(b) > 0), c(b)).otherwise(c(a))
    out = out.withColumn("source_score", F.when(c("source_score") == 0, c("source_authority").cast("double")).otherwise(c("source_score")))
    out = out.withColumns({"priority_score": mirror("priority_score", "score"), "score": mirror("score", "priority_score")})
    out = out.withColumns(
        {
            "is_official": c("is_official") | (kind == "official"),
            "is_primary_source": c("is_primary_source") | kind.isin("official", "regulator", "press_release"),
            "is_discovery_source": c("is_discovery_source") | (kind == "aggregator"),
            "is_reference": c("is_reference") | kind.isin("regulator", "institution", "research"),
        }
    )
    level = c("evidence_level")
    raised = (
        F.when(level != "industry_media", level).when(c("is_primary_source"), "primary").when(c("is_discovery_source"), "discovery")
        .when(kind == "research", "research").when(kind == "community", "community").otherwise(level)
    )
    out = out.withColumn("_given", level).withColumn("evidence_level", raised)
    flags = {f"is_{n}_source": c(f"is_{n}_source") | (c("_given") == n) for n in ("primary", "independent", "discovery")}
    return out.withColumns(flags).drop("_given").withColumn("collected_at", F.coalesce("collected_at", ref_time))
