"""Who reports an event, how well that is verified, and how far to trust it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import normal_publisher, pretty_publisher
from tidewire.operators.graph import cut

#: A publisher counts by its strongest level, in this order; anything else is other.
STRENGTH = ("primary", "independent", "research", "discovery", "community")


def _who() -> Column:
    return F.trim(F.coalesce(F.nullif("publisher", F.lit("")), F.col("source"), F.lit("")))


def publisher_strength(members: DataFrame, event: str = "event_id") -> DataFrame:
    """(event, publisher_key, strength): every publisher of an event once. Partial minima before the shuffle."""
    level = F.coalesce(F.nullif("evidence_level", F.lit("")), F.lit("industry_media"))
    rank = F.array_position(F.array(*map(F.lit, STRENGTH)), level)
    rank = F.when(rank == 0, F.lit(len(STRENGTH) + 1)).otherwise(rank)
    keyed = members.select(event, normal_publisher(_who()).alias("publisher_key"), rank.alias("r")).filter("publisher_key != ''")
    best = keyed.groupBy(event, "publisher_key").agg(F.min("r").alias("r"))
    return best.select(event, "publisher_key", F.element_at(F.array(*map(F.lit, (*STRENGTH, "other"))), F.col("r").cast("int")).alias("strength"))


def event_evidence(members: DataFrame, event: str = "event_id") -> DataFrame:
    """One row an event: evidence_sources, primary_sources, independent_sources (sorted), evidence_diversity,
    verification_status and the number of publishers of each strength. Events without any publisher are included."""
    of = lambda s: F.array_sort(F.collect_list(F.when(F.col("strength") == s, F.col("publisher_key"))))
    n = lambda s: F.count_if(F.coalesce(F.col("strength") == s, F.lit(False)))
    strong = publisher_strength(members, event)
    found = strong.groupBy(event).agg(
        F.array_sort(F.collect_list("publisher_key")).alias("evidence_sources"), of("primary").alias("primary_sources"), of("independent").alias("independent_sources"),
        *(n(s).alias(f"n_{s}") for s in (*STRENGTH, "other")),
    )
    out = members.select(event).distinct().join(found, event, "left")
    empty = F.array().cast("array<string>")
    out = out.withColumns({c: F.coalesce(c, empty) for c in ("evidence_sources", "primary_sources", "independent_sources")})
    out = out.withColumns({f"n_{s}": F.coalesce(f"n_{s}", F.lit(0)) for s in (*STRENGTH, "other")})
    out = out.withColumn("evidence_diversity", (F.col("n_primary") + F.col("n_independent") + F.col("n_research") + F.col("n_other")).cast("int"))
    return out.withColumn("verification_status", verification_status())


def verification_status() -> Column:
    """From the numbers of publishers."""
    c = F.col
    return (
        F.when((c("evidence_diversity") == 0) & (c("n_discovery") > 0) & (c("n_community") == 0), "discovery_only")
        .when(c("evidence_diversity") == 0, "insufficient_evidence")
        .when(c("n_independent") >= 2, "multi_source")
        .when((c("n_primary") >= 1) & (c("n_independent") >= 1), "independently_reported")
        .when(c("n_primary") >= 1, "primary_only")
        .when(c("n_independent") == 1, "independently_reported")
        .when(c("n_research") >= 1, "primary_only")
        .when(c("n_other") >= 2, "multi_source")
        .when(c("n_other") == 1, "independently_reported")
        .otherwise("insufficient_evidence")
    )


def event_signals(members: DataFrame, event: str = "event_id") -> DataFrame:
    """any() over an event's stories, the best authority among its official ones, and counts."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    kind = F.coalesce("source_type", F.lit(""))
    any_ = lambda t: F.bool_or(t)
    content = F.trim(F.coalesce("content", F.lit(""))) != "" if "content" in members.columns else F.lit(False)
    own = F.coalesce(F.nullif("authority_score", F.lit(0)), F.col("source_authority"), F.lit(0))
    return members.groupBy(event).agg(
        any_(flag("is_official") | (kind == "official")).alias("has_official_source"),
        any_(kind == "regulator").alias("has_regulatory_source"),
        any_(kind.isin("media", "korean_media")).alias("has_major_media_source"),
        any_((F.coalesce("evidence_level", F.lit("")) == "research") | kind.isin("research", "paper", "preprint")).alias("has_research"),
        any_(content).alias("has_content"),
        F.coalesce(F.max(F.when(flag("is_primary_source") | kind.isin("official", "regulator"), own)), F.lit(0)).alias("max_authority"),
        F.max("priority_score").alias("importance"),
        F.array_sort(F.collect_set(F.nullif(_who(), F.lit("")))).alias("related_sources"),
    )


def confidence_score() -> Column:
    """0 to 100: how strong and varied the evidence is. From evidence and signals."""
    c, status = F.col, F.col("verification_status")
    # Fixed values.
    base = F.when(status == "multi_source", 85.0).when(status == "independently_reported", 70.0).when(status == "primary_only", 58.0).when(status == "discovery_only", 22.0).otherwise(10.0)
    n_independent = F.size("independent_sources")
    score = base + F.when(c("has_regulatory_source"), 12.0).otherwise(0.0) + F.when(c("has_research"), 8.0).otherwise(0.0)
    score = score + F.least(F.lit(18.0), F.greatest(F.lit(0), n_independent - 1) * F.lit(6.0))
    score = score + F.when(c("max_authority") >= 95, 5.0).when(c("max_authority") >= 90, 4.0).otherwise(0.0) + F.when(c("has_content"), 3.0).otherwise(0.0)
    lone = (c("evidence_diversity") == 1) & (F.size("primary_sources") == 0) & (n_independent == 0)
    score = score - F.when(status == "discovery_only", 8.0).otherwise(0.0) - F.when(lone, 5.0).otherwise(0.0)
    top = F.when((status == "primary_only") & ~c("has_regulatory_source"), 68.0).when(status == "discovery_only", 35.0).when(status == "insufficient_evidence", 20.0).otherwise(100.0)
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.least(score, top))), 1)


def confidence_label(score: str = "confidence_score") -> Column:
    return F.when(F.col(score) >= 70.0, "High").when(F.col(score) >= 40.0, "Medium").otherwise("Low")


#: Label in Korean.
LABEL_KO = {"High": "높음", "Medium": "보통", "Low": "낮음"}


def label_ko(label: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LABEL_KO.items() for x in kv]), label), F.lit("낮음"))


def _names(column: str, more: str) -> Column:
    shown = F.array_join(F.transform(F.slice(column, 1, 3), pretty_publisher), ", ")
    rest = F.size(column) - 3
    return F.concat(shown, F.when(rest > 0, F.format_string(more, rest)).otherwise(""))


def confidence_explanation(language: int) -> Column:
    """Why: Korean for 0, English for 1."""
    status, say = F.col("verification_status"), lambda ko, en: F.lit((ko, en)[language])
    more = (" 외 %d곳", " (+%d more)")[language]
    primary, independent = _names("primary_sources", more), _names("independent_sources", more)
    parts = F.filter(
        F.array(
            F.when(F.col("has_regulatory_source"), say("규제기관 발표", "regulatory source")),
            F.when(F.size("primary_sources") > 0, F.concat(primary, say(" 공식 발표", " primary announcement"))),
            F.when(F.col("has_research") & (F.size("primary_sources") == 0), say("연구기관 발표 기반", "research publication")),
            F.when(F.size("independent_sources") > 0, F.concat(F.lit(("", "independent ")[language]), independent, say(" 독립 취재", " reporting"))),
        ),
        lambda p: p.isNotNull(),
    )
    return (
        F.when(status == "discovery_only", say("검색 집계 결과만 확인됨", "Only discovered through an aggregator"))
        .when(status == "insufficient_evidence", say("충분한 출처 없음 — 커뮤니티 논의 또는 알 수 없는 출처", "Insufficient evidence — community discussion or no known publisher"))
        .when(F.size(parts) == 0, say("산업 전문 매체 보도만 확인됨", "Industry media coverage only"))
        .otherwise(F.array_join(parts, " + "))
    )


def event_confidence(members: DataFrame, event: str = "event_id") -> DataFrame:
    """Evidence, signals, confidence_score, confidence_label and explanations of each event."""
    # Written once: else label and explanations each repeat what they read, down to the members' columns.
    both = cut(event_evidence(members, event).join(event_signals(members, event), event).withColumn("confidence_score", confidence_score()))
    return both.withColumns(
        {
            "confidence_label": confidence_label(), "confidence_label_ko": label_ko(confidence_label()),
            "confidence_explanation_ko": confidence_explanation(0), "confidence_explanation_en": confidence_explanation(1),
            "source_count": F.when(F.size("evidence_sources") > 0, F.size("evidence_sources")).otherwise(F.size("related_sources")),
            "independent_source_count": F.size("independent_sources"),
        }
    )


def build_events(assigned: DataFrame) -> DataFrame:
    """The events of articles with event ids and positions: titles, category, first official source, evidence, members."""
    official = F.coalesce("is_official", F.lit(False)) | (F.coalesce("source_type", F.lit("")) == "official")
    first_official = F.min(F.when(official, F.struct("member_pos", "url", F.coalesce(F.nullif("publisher", F.lit("")), F.col("source")).alias("name"))))
    head = F.max(F.when(F.col("relationship") == "primary", F.struct("category", "primary_category"))).alias("head")
    members = F.transform(F.array_sort(F.collect_list(F.struct("member_pos", "article_id"))), lambda x: x["article_id"])
    about = assigned.groupBy("event_id", "event_title", "primary_article_id").agg(first_official.alias("off"), head, members.alias("article_ids"), F.min("event_pos").alias("event_pos"))
    about = about.select(
        "event_id", F.col("event_title").alias("title"), F.coalesce("head.category", "head.primary_category").alias("category"), "primary_article_id",
        F.col("off.url").alias("official_source_url"), F.col("off.name").alias("official_source_name"), "article_ids", "event_pos",
    )
    return about.join(event_confidence(assigned), "event_id")


def event_anchors_of(features: DataFrame, event: str = "event_id") -> DataFrame:
    """What an event is about: the union of its stories' entities, models, themes and actions, sorted. Each value is reduced
    to one a task before it is shuffled."""
    kinds = ("entities", "models", "themes", "effective")
    named = lambda k: F.transform(f"f_{k}", lambda v: F.struct(F.lit(k).alias("k"), v.alias("v")))
    pairs = F.concat(*map(named, kinds))
    values = features.select(event, F.explode_outer(pairs).alias("x")).select(event, "x.*").distinct()
    return values.groupBy(event).agg(*(F.array_sort(F.collect_list(F.when(F.col("k") == k, F.col("v")))).alias(k) for k in kinds))


def bridge(assigned: DataFrame) -> DataFrame:
    return assigned.select("event_id", "article_id", "relationship", "similarity")


ON_ARTICLE = {
    "event_title": "title", "event_source_count": "source_count", "event_independent_source_count": "independent_source_count", "event_has_official_source": "has_official_source",
    "event_has_regulatory_source": "has_regulatory_source", "event_has_major_media_source": "has_major_media_source", "event_official_source_url": "official_source_url",
    "event_official_source_name": "official_source_name", "event_related_sources": "related_sources", "event_evidence_sources": "evidence_sources", "event_primary_sources": "primary_sources",
    "event_independent_sources": "independent_sources", "event_evidence_diversity": "evidence_diversity", "event_verification_status": "verification_status",
    "event_confidence_score": "confidence_score", "event_confidence_label": "confidence_label", "event_confidence_explanation_ko": "confidence_explanation_ko",
    "event_confidence_explanation_en": "confidence_explanation_en", "related_article_ids": "article_ids",
}


def enrich(articles: DataFrame, events: DataFrame) -> DataFrame:
    """Articles with their event's columns; an article without a known event keeps nulls (or what it had)."""
    side = events.select("event_id", *(F.col(v).alias(f"_{k}") for k, v in ON_ARTICLE.items()))
    out = articles.join(side, "event_id", "left")
    have = set(articles.columns)
    return out.withColumns({k: F.coalesce(f"_{k}", k) if k in have else F.col(f"_{k}") for k in ON_ARTICLE}).drop(*(f"_{k}" for k in ON_ARTICLE))
