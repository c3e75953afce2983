"""The feeds as a table, and how to find one."""

from __future__ import annotations

from urllib.parse import quote_plus

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire import rules

SCHEMA = (
    "rank int, id string, name string, bucket string, url string, source_type string, authority_score int, region string, language string, catalog_group string, "
    "discovery_method string, enabled boolean, aliases array<string>, evidence_level string, is_primary_source boolean, is_independent_source boolean, is_discovery_source boolean"
)
SEARCH = {"en": "https://news.google.com/rss/search?q={}&hl=en-US&gl=US&ceid=US:en", "ko": "https://news.google.com/rss/search?q={}&hl=ko&gl=KR&ceid=KR:ko"}


def search_url(query: str, language: str = "en") -> str:
    return SEARCH[language].format(quote_plus(query))


def feed_rows() -> list[tuple]:
    out = []
    for i, (key, name, bucket, at, kind, authority, region, language, group, aliases, level) in enumerate(rules.FEEDS):
        searched = at[:3] in ("en:", "ko:")
        url = search_url(at[3:], at[:2]) if searched else at
        out.append((i, key, name, bucket, url, kind, authority, region, language, group, "search" if searched else "rss", True, rules.words(aliases), level, level == "primary", level == "independent", level == "discovery"))
    return out


def feeds(spark: SparkSession) -> DataFrame:
    """The catalogue, in order (``rank``)."""
    return spark.createDataFrame(feed_rows(), SCHEMA)


def in_group(table: DataFrame, group: str) -> DataFrame:
    return table.filter(F.col("catalog_group") == group)


def enabled(table: DataFrame) -> DataFrame:
    return table.filter("enabled")


def independent(table: DataFrame) -> DataFrame:
    return table.filter("is_independent_source")


def discovery(table: DataFrame) -> DataFrame:
    return table.filter("is_discovery_source")


def lookup(names: DataFrame, table: DataFrame, name: str = "name") -> DataFrame:
    """``names`` with the id, type, authority and level of the feed that has the name, id or alias, in any case; the
    first feed in order if several do. The catalogue is small and fixed in size, the names may be many."""
    keys = table.select("rank", "id", "source_type", "authority_score", "evidence_level", F.explode(F.concat(F.array(F.lower("name"), F.col("id")), F.transform("aliases", F.lower))).alias("_key"))
    first = keys.groupBy("_key").agg(F.min_by(F.struct(F.col("id").alias("feed_id"), F.col("source_type").alias("feed_type"), F.col("authority_score").alias("feed_authority"), F.col("evidence_level").alias("feed_level")), "rank").alias("_f"))
    out = names.withColumn("_key", F.lower(F.trim(F.col(name)))).join(F.broadcast(first), "_key", "left")
    return out.select(*names.columns, "_f.*")


def source_defaults(table: DataFrame) -> DataFrame:
    """Feeds given with gaps: id from the name, authority from the type, level by the ladder, flags from the level."""
    low, level = F.lower("name"), F.lower(F.trim("evidence_level"))
    kinds = F.create_map(*[F.lit(x) for kv in rules.TYPE_AUTHORITY.items() for x in kv])
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    has_id = F.coalesce("id", F.regexp_replace(F.regexp_replace(low, "[^a-z0-9_]+", "_"), "^_+|_+$", ""))
    inferred = (
        F.when(flag("is_primary_source"), "primary").when(flag("is_independent_source"), "independent").when(flag("is_discovery_source"), "discovery")
        .when(F.col("source_type").isin("official", "regulator") | (F.col("catalog_group") == "primary"), "primary")
        .when((F.col("source_type") == "research") | (F.col("catalog_group") == "research"), "research")
        .when((F.col("source_type") == "aggregator") | (F.col("catalog_group") == "aggregator") | low.contains("google news"), "discovery")
        .when(F.col("source_type") == "community", "community")
        .when((has_id == "mit_tech_review") | low.rlike("reuters|bloomberg|financial times|the information|technology review"), "independent")
        .otherwise("industry_media")
    )
    out = table.withColumns({"id": has_id, "authority_score": F.coalesce("authority_score", F.try_element_at(kinds, F.col("source_type")), F.lit(rules.DEFAULT_AUTHORITY)), "evidence_level": F.coalesce(level, inferred)})
    return out.withColumns({f"is_{n}_source": F.coalesce(f"is_{n}_source", F.col("evidence_level") == n) for n in ("primary", "independent", "discovery")})
