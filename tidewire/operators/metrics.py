"""Figures of a run: feeds, stories, events and the share that is primary, independently reported or only found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


LEVEL_COLUMNS = {"primary": "primary_feeds", "research": "research_feeds", "independent": "independent_media_feeds", "community": "community_feeds", "discovery": "discovery_feeds"}


def feed_counts(feeds: DataFrame, level: str = "evidence_level") -> DataFrame:
    """One row: feeds_total and the feeds of each level; whatever is none of the others counts as industry media."""
    lv = F.coalesce(level, F.lit("industry_media"))
    return feeds.agg(
        F.count(F.lit(1)).alias("feeds_total"), *(F.count_if(lv == k).alias(c) for k, c in LEVEL_COLUMNS.items()),
        F.count_if(~lv.isin(*LEVEL_COLUMNS)).alias("industry_media_feeds"),
    )


def local_day(at: str, zone: str) -> F.Column:
    """The calendar day of an instant in a time zone, as text, whatever the session's zone is."""
    shifted = F.unix_seconds(F.from_utc_timestamp(at, zone))
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(shifted / F.lit(86_400)).cast("int")).cast("string")


def daily_counts(rows: DataFrame, zone: str = "UTC", at: str = "published_at") -> DataFrame:
    """(day, n): rows a calendar day of a time zone."""
    return rows.groupBy(local_day(at, zone).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def _share(test) -> F.Column:
    return F.coalesce(F.count_if(test) / F.nullif(F.count(F.lit(1)), F.lit(0)) * 100.0, F.lit(0.0))


def story_metrics(articles: DataFrame) -> DataFrame:
    """One row over enriched articles: how many, and percentages; 0 where there are none."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    independent = flag("is_independent_source") | (F.coalesce("event_independent_source_count", F.lit(0)) > 0) | (F.coalesce("evidence_level", F.lit("")) == "independent")
    found = flag("is_discovery_source") | (F.coalesce("evidence_level", F.lit("")) == "discovery")
    return articles.agg(
        F.count(F.lit(1)).alias("articles_selected"), F.bround(_share(independent), 1).alias("percentage_with_independent_reporting"), F.bround(_share(found), 1).alias("percentage_discovery_only")
    )


def top_metrics(articles: DataFrame, n: int = 5, tie: str = "article_id") -> DataFrame:
    """One row: the percentage of the ``n`` stories of the highest priority that are primary."""
    top = articles.orderBy(F.col("priority_score").desc(), F.col(tie).asc()).limit(n)
    primary = F.coalesce("is_primary_source", F.lit(False)) | (F.coalesce("evidence_level", F.lit("")) == "primary")
    return top.agg(F.bround(_share(primary), 1).alias("percentage_top_stories_primary"))


def event_metrics(events: DataFrame) -> DataFrame:
    """One row: events, those with independent confirmation, and the mean diversity of evidence."""
    confirmed = F.col("verification_status").isin("independently_reported", "multi_source") | (F.size("independent_sources") > 0)
    return events.agg(
        F.count(F.lit(1)).alias("events_created"), F.count_if(confirmed).alias("events_with_independent_confirmation"),
        F.bround(F.coalesce(F.avg("evidence_diversity"), F.lit(0.0)), 2).alias("average_evidence_diversity"),
    )


def run_metrics(feeds: DataFrame, articles: DataFrame, events: DataFrame, collected: int, suppressed: int) -> DataFrame:
    """All figures of a run in one row. Each part is one partial aggregation; only single rows are combined."""
    out = feed_counts(feeds)
    for part in (story_metrics(articles), top_metrics(articles), event_metrics(events)):
        out = out.join(F.broadcast(part))
    return out.withColumns({"articles_collected": F.lit(collected), "duplicate_suppression_count": F.lit(suppressed), "articles_after_dedupe": F.col("articles_selected")})


__all__ = ["daily_counts", "event_metrics", "feed_counts", "run_metrics", "story_metrics", "top_metrics"]
