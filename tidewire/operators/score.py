"""Six scores of a story, their weighted priority, its level and the reasons given for it."""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire import rules
from tidewire.functions.text import Lexicon, contains_any, matches, novelty_tokens, strings
from tidewire.operators.graph import cut

PREPRINT = ("arxiv", "biorxiv", "medrxiv", "preprint")


def _low(name: str) -> Column:
    return F.lower(F.coalesce(F.col(name), F.lit("")))


def clamp(x: Column, low: float, high: float) -> Column:
    """Within bounds, rounded to one place, halves to even."""
    return F.bround(F.least(F.lit(high), F.greatest(F.lit(low), x)), 1)


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def source_score() -> Column:
    kind, name = F.lower(F.coalesce(F.col("source_type"), F.lit("media"))), F.lower(F.coalesce(F.nullif("publisher", F.lit("")), F.col("source"), F.lit("")))
    base = None
    for types, parts, value in rules.SOURCE_BASES:
        test = contains_any(name, parts) | (kind.isin(*types) if types else F.lit(False))
        base = F.when(test, F.lit(value)) if base is None else base.when(test, F.lit(value))
    base = base.otherwise(F.lit(75.0))
    own = F.col("source_authority")
    mean = F.lit(0.5) * base + F.lit(0.5) * own.cast("double")
    return clamp(F.when(own.isNotNull() & (own != rules.DEFAULT_AUTHORITY), mean).otherwise(base), 10.0, 100.0)


def evidence_quality() -> Column:
    kind, source, publisher, level, url = (_low(c) for c in ("source_type", "source", "publisher", "evidence_level", "url"))
    found = _flag("is_discovery_source") | (level == "discovery") | (kind == "aggregator") | source.contains("google news") | publisher.contains("google news") | url.contains("news.google.com")
    primary = _flag("is_primary_source") | (level == "primary") | kind.isin("official", "regulator", "press_release")
    state = ("eu ai office", "nist", "과기정통부")
    rule_maker = (kind == "regulator") | contains_any(publisher, state) | contains_any(source, state)
    research = (level == "research") | kind.isin("research", "paper", "preprint")
    return (
        F.when(found, F.lit(40.0))
        .when(primary & rule_maker, F.lit(98.0)).when(primary, F.lit(96.0))
        .when(_flag("is_independent_source") | (level == "independent"), F.lit(94.0))
        .when(research & contains_any(F.concat_ws(" ", source, publisher, url), PREPRINT), F.lit(88.0)).when(research, F.lit(94.0))
        .when((level == "community") | kind.isin("community", "forum", "blog"), F.lit(55.0))
        .when((level == "industry_media") | kind.isin("media", "news"), F.lit(78.0))
        .otherwise(F.lit(70.0))
    )


def _category() -> Column:
    return F.lower(F.coalesce(F.nullif("primary_category", F.lit("")), F.col("category"), F.lit("")))


def _base(category: Column, steps: tuple, otherwise: float) -> Column:
    found = None
    for names, value in steps:
        found = F.when(category.isin(*names), F.lit(value)) if found is None else found.when(category.isin(*names), F.lit(value))
    return found.otherwise(F.lit(otherwise))


def _wide_text() -> Column:
    return F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("excerpt", F.lit("")), F.array_join("topics", " "), F.array_join("tags", " ")))


def core_terms_found() -> Column:
    """How many core terms stand in title, excerpt, topics or tags: whole ASCII words, or a topic or tag itself.

    Every topic and tag is part of the text, but its edges need not be, so both are looked at.
    """
    own = F.array_intersect(F.transform(F.concat("topics", "tags"), F.lower), strings(rules.CORE_TOPICS))
    return F.size(F.array_union(core_lexicon().found(_wide_text()), F.coalesce(own, strings([]))))


@cache
def core_lexicon() -> Lexicon:
    inner = re.compile("[a-z0-9]")
    return Lexicon({t: [t] for t in rules.CORE_TOPICS}, lambda w: True, ("(?<![a-z0-9])", "(?![a-z0-9])"), lambda a, b: not inner.match(b))


def relevance() -> Column:
    base = _base(_category(), ((("frontier_models", "agents_coding", "hardware_infra"), 65.0), (("open_source", "research_breakthroughs", "multimodal_media"), 58.0), (("regulation_policy", "enterprise_app", "industry_vc"), 45.0)), 30.0)
    return clamp(base + F.least(core_terms_found() * F.lit(10.0), F.lit(40.0)), 10.0, 100.0)


def _story() -> Column:
    return F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("excerpt", F.lit(""))))


def impact_signals() -> Column:
    return sum((matches(_story(), p).cast("int") for p in rules.IMPACT_SIGNALS.values()), F.lit(0))


def impact() -> Column:
    base = _base(_category(), ((("big", "frontier_models", "hardware_infra"), 45.0), (("agents_coding", "regulation_policy", "industry_vc"), 38.0)), 28.0)
    return clamp(base + F.least(impact_signals() * F.lit(16.0), F.lit(52.0)), 10.0, 100.0)


def novelty(similar_past: Column | None = None) -> Column:
    """``similar_past`` says whether an earlier story has a similar title."""
    text = _story()
    stale = F.when(matches(F.lower(F.coalesce("title", F.lit(""))), rules.EVERGREEN), F.lit(35.0)).when(matches(text, rules.EVERGREEN), F.lit(20.0)).otherwise(F.lit(0.0))
    promo = F.when(matches(text, rules.PROMOTION) & (impact_signals() == 0), F.lit(20.0)).otherwise(F.lit(0.0))
    again = F.when(similar_past, F.lit(30.0)).otherwise(F.lit(0.0)) if similar_past is not None else F.lit(0.0)
    return clamp(F.lit(90.0) - stale - promo - again, 10.0, 100.0)


def recency(ref_time: Column, half_life_hours: float = 36.0, published: str = "published_at") -> Column:
    """Halved every ``half_life_hours``; 50 where nothing is known; the future counts as now."""
    hours = F.greatest(F.lit(0.0), (F.unix_micros(ref_time) - F.unix_micros(published)) / F.lit(1e6)) / F.lit(3600.0)
    value = F.lit(100.0) * F.pow(F.lit(0.5), hours / F.lit(max(1.0, half_life_hours)))
    return F.when(F.col(published).isNull(), F.lit(50.0)).otherwise(clamp(value, 5.0, 100.0))


def priority() -> Column:
    """From the six score columns."""
    c, w = F.col, rules.WEIGHTS
    base = F.lit(w["relevance"]) * c("relevance_score") + F.lit(w["impact"]) * c("impact_score") + F.lit(w["source"]) * c("source_score") + F.lit(w["evidence"]) * c("evidence_quality_score") + F.lit(w["recency"]) * c("recency_score") + F.lit(w["novelty"]) * c("novelty_score")
    return clamp(base + F.greatest(F.when(authority_boost(), 20.0).otherwise(0.0), F.when(frontier_boost(), 15.0).otherwise(0.0)) - F.when(low_signal(), 10.0).otherwise(0.0), 10.0, 100.0)


def authority_boost() -> Column:
    return (F.col("impact_score") >= 65.0) & (F.col("source_score") >= 85.0)


def frontier_boost() -> Column:
    return (F.col("relevance_score") >= 80.0) & (F.col("impact_score") >= 45.0)


def low_signal() -> Column:
    return (F.col("relevance_score") < 40.0) & (F.col("impact_score") < 40.0)


# What is said of a story's evidence, Korean and English.
SAID_OF_EVIDENCE = {
    "discovery": ("검색 집계 출처", "Discovery source"), "primary": ("공식 발표 출처", "Primary source"), "independent": ("독립 취재 출처", "Independent reporting"),
    "preprint": ("연구기관 사전 논문 (Preprint) 출처", "Research preprint source"), "research": ("공인 학술·연구기관 출처", "Research source"),
    "industry_media": ("산업 전문 보도 출처", "Industry media coverage"), "community": ("커뮤니티 논의 출처", "Community discussion source"),
}


def explained_level() -> Column:
    """The level named in the reasons."""
    kind, level = _low("source_type"), F.col("evidence_level")
    found = _flag("is_discovery_source") | (kind == "aggregator") | _low("source").contains("google news") | _low("publisher").contains("google news")
    real = (
        F.when(found, F.lit("discovery"))
        .when(_flag("is_primary_source") & (level != "discovery"), F.lit("primary"))
        .when(_flag("is_independent_source") & ~level.isin("discovery", "industry_media", "community"), F.lit("independent"))
        .otherwise(level)
    )
    early = ((real == "research") | kind.isin("research", "paper", "preprint")) & contains_any(F.concat_ws(" ", _low("source"), _low("publisher"), _low("url")), PREPRINT)
    return F.when((real == "research") & early, F.lit("preprint")).otherwise(real)


def reasons(language: int) -> Column:
    """The reasons, in order; ``language`` 0 is Korean, 1 English."""
    c, level = F.col, explained_level()
    said = None
    for k, v in SAID_OF_EVIDENCE.items():
        said = F.when(level == k, F.lit(v[language])) if said is None else said.when(level == k, F.lit(v[language]))
    # Fixed values.
    steps = (
        (authority_boost(), ("공식 기관·선도 기업의 주요 발표", "Authoritative major announcement")),
        (frontier_boost(), ("프론티어 모델·AI 아키텍처 핵심 혁신", "Frontier model / AI architecture breakthrough")),
        (c("relevance_score") >= 80.0, ("AI 핵심 기술·인프라 직결", "Core AI technology & infrastructure relevance")),
        (c("impact_score") >= 70.0, ("생태계 파급력 높은 대형 이벤트", "High ecosystem market impact")),
        (c("source_score") >= 88.0, ("공인 연구소 및 1차 취재 매체", "High authority lab / primary news outlet")),
        (c("recency_score") >= 70.0, ("최근 24시간 이내 신속 보도", "Recent publication within 24h")),
        (low_signal(), ("관찰 항목 (낮은 관련도·영향도)", "Watch item (low relevance & impact)")),
    )
    found = F.filter(F.array(said, *(F.when(t, F.lit(v[language])) for t, v in steps)), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(("일반 AI 산업 참고 항목", "General AI ecosystem reference")[language])))


def with_scores(df: DataFrame, ref_time: Column, half_life_hours: float = 36.0, similar_past: Column | None = None) -> DataFrame:
    """Add the six scores, priority_score (also as score) and evidence_explanation. All in one projection, no shuffle."""
    out = df.withColumns(
        {
            "source_score": source_score(), "evidence_quality_score": evidence_quality(), "relevance_score": relevance(),
            "impact_score": impact(), "novelty_score": novelty(similar_past), "recency_score": recency(ref_time, half_life_hours),
        }
    )
    out = out.withColumn("priority_score", priority())
    return out.withColumns({"score": F.col("priority_score"), "evidence_explanation": F.array_join(F.slice(reasons(0), 1, 3), " · "), "evidence_explanation_en": F.array_join(F.slice(reasons(1), 1, 3), " · ")})


def priority_level(score: Column | str = "priority_score") -> Column:
    s = F.col(score) if isinstance(score, str) else score
    found = None
    for name, least, *_ in rules.PRIORITY_LEVELS:
        if least is not None:
            found = F.when(s >= least, F.lit(name)) if found is None else found.when(s >= least, F.lit(name))
    return found.otherwise(F.lit("watch"))


def level_rank(level: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for p in rules.PRIORITY_LEVELS for x in (p[0], p[2])]), level)


def _earliest(rows: DataFrame, by: str) -> DataFrame:
    """(by, seen): of each group the rows (o, url, canonical_url) that decide for any story which is the earliest of another
    address. These are the first of all, the first whose url and the first whose canonical address differ from its own, and
    after each of these the first that differs from it in the other address too: five at most, however large the group."""
    row = F.struct("o", "url", "canonical_url")
    first = rows.groupBy(by).agg(F.min(row).alias("p"))
    other = rows.join(first, by).groupBy(by).agg(F.min("p").alias("p"), F.min(F.when(F.col("url") != F.col("p.url"), row)).alias("a"), F.min(F.when(F.col("canonical_url") != F.col("p.canonical_url"), row)).alias("b"))
    past_url = (F.col("url") != F.col("p.url")) & (F.col("canonical_url") != F.col("a.canonical_url"))
    past_canonical = (F.col("canonical_url") != F.col("p.canonical_url")) & (F.col("url") != F.col("b.url"))
    last = rows.join(other, by).groupBy(by).agg(*(F.min(c).alias(c) for c in "pab"), F.min(F.when(past_url, row)).alias("a2"), F.min(F.when(past_canonical, row)).alias("b2"))
    return last.select(by, F.array_distinct(F.array_compact(F.array("p", "a", "b", "a2", "b2"))).alias("seen"))


def past_similar(incoming: DataFrame, past: DataFrame, key: str = "article_id", order: str | None = None) -> DataFrame:
    """Keys of incoming stories to which a past story of another address has a similar title. With ``order``, a column of
    both, only past stories that come before the incoming one count.

    Titles of equal words are one group. Three quarters of the longer title's words must be shared, so of similar titles
    each has one of the other's first words, those left after three quarters of its own less one: groups meet on these
    alone, long words first. What a group of past titles holds is told by the few stories that decide, so a title that
    very many stories have costs its stories, not its pairs."""
    at = lambda otherwise: (F.col(order) if order else F.lit(otherwise)).alias("o")
    told_apart = F.col("url").isNotNull() & F.col("canonical_url").isNotNull() & (F.size("t") >= 4)
    worded = lambda df, *more: df.select(*more, "url", "canonical_url", novelty_tokens("title").alias("t")).filter(told_apart).withColumn("s", F.array_join("t", " "))
    mine = worded(incoming, F.col(key).alias("k"), at(1))
    theirs = cut(worded(past, at(0)).groupBy("s", "url", "canonical_url").agg(F.min("o").alias("o")))
    need = F.ceil(F.size("t") * F.lit(3) / F.lit(4)).cast("int")
    ranked = F.array_sort(F.transform("t", lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    keyed = lambda sets, s: sets.distinct().withColumn("t", F.split("s", " ")).select(F.col("s").alias(s), F.explode(F.slice(ranked, F.lit(1), F.size("t") - F.greatest(need, F.lit(4)) + 1)["w"]).alias("w"))
    met = keyed(mine.select("s"), "s").join(keyed(theirs.select("s"), "ps"), "w").select("s", "ps").distinct()
    t, pt = F.split("s", " "), F.split("ps", " ")
    common = F.size(F.array_intersect(t, pt))
    alike = met.filter((common >= 4) & (common / F.greatest(F.size(t), F.size(pt)) >= 0.75))
    held = cut(_earliest(theirs, "s").select(F.col("s").alias("ps"), F.explode("seen").alias("p")))
    told = _earliest(cut(alike.join(held, "ps").select("s", "p.*")), "s")
    another = lambda p: (p["url"] != F.col("url")) & (p["canonical_url"] != F.col("canonical_url")) & (p["o"] < F.col("o"))
    return mine.join(told, "s").filter(F.exists("seen", another)).select(F.col("k").alias(key)).distinct()
