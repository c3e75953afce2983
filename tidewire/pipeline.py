"""A whole run: entries to kept, classified, scored and clustered stories with events, metrics and an issue."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators.classify import with_taxonomy, with_template_summary
from tidewire.operators.cluster import assign_events, numbered, with_event_ids
from tidewire.operators.dedupe import deduplicate
from tidewire.operators.evidence import bridge, build_events, enrich
from tidewire.operators.graph import cut
from tidewire.operators.metrics import run_metrics
from tidewire.operators.normalize import normalize_articles, normalize_entries
from tidewire.operators.score import with_scores
from tidewire.operators.store import IssueStore


@dataclass
class Run:
    articles: DataFrame
    events: DataFrame
    bridge: DataFrame
    collected: int
    kept: int


def enrich_entries(entries: DataFrame, ref_time: Column, half_life_hours: float = 36.0) -> DataFrame:
    """Kept entries to classified, summarised, scored articles: projections only."""
    told = with_template_summary(with_taxonomy(normalize_entries(entries, ref_time)))
    articles = normalize_articles(told.withColumn("category", F.col("primary_category")), ref_time)
    return with_scores(articles, ref_time, half_life_hours)


def collect(entries: DataFrame, ref_time: Column, recent: DataFrame | None = None) -> Run:
    """Entries need seq, title, url, source, bucket and published_at; other columns are optional."""
    ready = cut(normalize_entries(entries, ref_time))
    kept = deduplicate(ready, recent)
    scored = cut(enrich_entries(kept, ref_time))
    assigned = cut(with_event_ids(assign_events(scored)))
    events = cut(build_events(assigned))
    return Run(enrich(assigned.drop("event_title"), events), events, bridge(assigned), ready.count(), scored.count())


def run_day(spark: SparkSession, store: IssueStore, entries: DataFrame, feeds: DataFrame, day: date, ref_time: Column, warnings: list[str] | None = None, exclude_same_day: bool = False) -> Run:
    """Collect against the last three days of the store and replace the day's issue. By default a day that is collected
    again is also held against itself."""
    recent = store.recent_articles(3, ref_time, day, day.isoformat() if exclude_same_day else None)
    recent = recent.withColumn("seq", F.monotonically_increasing_id())
    run = collect(entries, ref_time, cut(recent))
    metrics = run_metrics(feeds, run.articles, run.events, run.collected, run.collected - run.kept)
    place = [F.col("priority_score").desc(), F.col("event_pos"), F.col("member_pos")]
    drop = [c for c in run.articles.columns if c.startswith("f_")]
    store.save_issue(day.isoformat(), numbered(run.articles.drop(*drop), place, "position"), run.events, run.bridge, metrics, warnings, at=ref_time)
    return run
