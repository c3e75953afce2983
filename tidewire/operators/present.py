"""What the dashboard shows: facets, sections, fallbacks, transparency, filters and pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire import rules
from tidewire.functions.sources import evidence_level
from tidewire.functions.text import contains_any, names_where, strings
from tidewire.operators.classify import by_key
from tidewire.operators.cluster import numbered
from tidewire.operators.evidence import label_ko
from tidewire.operators.graph import cut
from tidewire.operators.score import level_rank, priority_level


def _text(*names: str) -> Column:
    return F.coalesce(*(F.nullif(n, F.lit("")) for n in names))


def _all(*parts: Column | str) -> Column:
    return F.lower(F.concat_ws(" ", *parts))


def regions() -> Column:
    """Regions whose terms are part of title, excerpt or tags; ``global`` if none."""
    text = _all("title", F.coalesce("excerpt", F.lit("")), F.array_join("tags", " "))
    found = names_where({k: contains_any(text, rules.words(t)) for k, t in rules.REGION_TERMS.items()})
    return F.when(F.size(found) > 0, found).otherwise(strings(["global"]))


def topic_keys() -> Column:
    text = _all("title", F.coalesce("excerpt", F.lit("")), F.array_join("topics", " "), F.array_join("tags", " "))
    return F.concat(strings(["all"]), names_where({k: contains_any(text, rules.words(t)) for k, t in rules.TOPIC_FILTERS.items()}))


def source_kind() -> Column:
    """The level of evidence used for filtering."""
    level = F.lower(F.trim(F.coalesce("evidence_level", F.lit(""))))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return (
        F.when(level.isin(*rules.EVIDENCE_LEVELS), level).when(flag("is_primary_source"), "primary").when(flag("is_independent_source"), "independent")
        .when(flag("is_discovery_source"), "discovery").otherwise(evidence_level(_text("publisher", "source", "source_type")))
    )


FACETS = {
    "region": ("all", "global", *rules.REGION_TERMS),
    "topic": ("all", *rules.TOPIC_FILTERS),
    "source_type": ("all", *rules.EVIDENCE_LEVELS),
}


def facet_counts(articles: DataFrame) -> DataFrame:
    """(facet, key, n): a story counts once for each of its keys and once for ``all``; keys with nothing stay at 0."""
    pairs = lambda facet, keys: F.transform(keys, lambda k: F.struct(F.lit(facet).alias("facet"), k.alias("key")))
    keys = F.concat(
        pairs("region", F.concat(strings(["all"]), regions())), pairs("topic", topic_keys()), pairs("source_type", F.array(F.lit("all"), source_kind()))
    )
    counted = articles.select(F.explode(keys).alias("k")).groupBy("k.facet", "k.key").agg(F.count(F.lit(1)).alias("n"))
    wanted = articles.sparkSession.createDataFrame([(f, k) for f, ks in FACETS.items() for k in ks], "facet string, key string")
    return wanted.join(counted, ["facet", "key"], "left").select("facet", "key", F.coalesce("n", F.lit(0)).alias("n"))


def weight() -> Column:
    return F.coalesce(F.nullif("priority_score", F.lit(0.0)), F.col("score"), F.lit(0.0))


def featured(articles: DataFrame, least: float = 60.0, want: int = 3) -> DataFrame:
    """Stories of the first threshold (60, 45, 30) that at least ``want`` reach; the last that any reach; else all. Rows are
    written once, as they are counted and then chosen: their scores are not worked out twice."""
    articles, w = cut(articles), weight()
    steps = (least, 45.0, 30.0)
    counts = articles.agg(*(F.count_if(w >= s).alias(f"n{i}") for i, s in enumerate(steps)), F.count_if(w > 0).alias("scored"))
    reached = (
        F.when(F.col("scored") == 0, F.lit(float("-inf"))).when(F.col("n0") >= want, F.lit(steps[0])).when(F.col("n1") >= want, F.lit(steps[1]))
        .when(F.col("n2") > 0, F.lit(steps[2])).otherwise(F.lit(float("-inf")))
    )
    return articles.join(F.broadcast(counts.select(reached.alias("_cut"))), w >= F.col("_cut")).drop("_cut")


def sections(articles: DataFrame, room: int = rules.SECTION_ROOM, position: str = "position") -> DataFrame:
    """(section, section_pos, place, article_id) of the stories shown.

    Sections fill in order with their best; a story goes to the first section that holds one of its two categories and has
    room; of those left the first by ``position`` go to the first section, which is then sorted and cut again.

    A story has two categories at most, so it can be taken by one of two sections: first by the earlier one's ranking, and
    where that is full by the later one's, among the stories that are still free. Each section needs its ``room`` best
    alone, so candidates are cut to a bounded number a pair of categories before anything is gathered.
    """
    wanted = featured(articles).withColumn("_w", weight()).select("article_id", "primary_category", "category", "_w", F.col(position).alias("_at"))
    names = [c for _, c in rules.SECTIONS]
    index = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    at = lambda c: F.coalesce(F.try_element_at(index, F.col(c)), F.lit(len(names)))
    keyed = wanted.withColumn("_s", F.least(at("primary_category"), at("category"))).withColumn("_t", F.greatest(at("primary_category"), at("category")))
    bound = room * (len(names) + 2)
    # Two ranks, each bounded alone: Spark cuts every task's rows to the bound before it shuffles them.
    first = lambda *order: keyed.withColumn("_n", F.row_number().over(Window.partitionBy("_s", "_t").orderBy(*order))).filter(F.col("_n") <= bound).drop("_n")
    few = first(F.col("_w").desc(), F.col("_at").asc()).unionByName(first(F.col("_at").asc())).dropDuplicates(["article_id"])

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        ranked, taken = pdf.sort_values(["w", "at"], ascending=[False, True]), set()
        chosen: list[list[tuple]] = []
        for i in range(len(names)):
            own = [r for r in ranked.itertuples(index=False) if i in (r.s, r.t) and r.article_id not in taken][:room]
            taken.update(r.article_id for r in own)
            chosen.append(own)
        left = [r for r in pdf.sort_values("at").itertuples(index=False) if r.article_id not in taken][:room]
        if left:
            chosen[0] = sorted(chosen[0] + left, key=lambda r: -r.w)[:room]
        out = [(rules.SECTIONS[i][0], i, k, r.article_id) for i, own in enumerate(chosen) for k, r in enumerate(own)]
        return pd.DataFrame(out, columns=["section", "section_pos", "place", "article_id"])

    plain = few.select(F.lit(1).alias("g"), "article_id", F.col("_at").alias("at"), F.col("_w").alias("w"), F.col("_s").alias("s"), F.col("_t").alias("t"))
    return plain.groupBy("g").applyInPandas(fill, "section string, section_pos int, place int, article_id string")


def priority_counts(articles: DataFrame) -> DataFrame:
    """One row: total and the number of stories of each level."""
    level = priority_level()
    return articles.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(level == p[0]).alias(p[0]) for p in rules.PRIORITY_LEVELS))


def top_prioritised(articles: DataFrame, n: int = 5, tie: str = "article_id") -> DataFrame:
    level = priority_level()
    out = articles.withColumn("level", level).withColumn("rounded", F.bround("priority_score", 0).cast("int"))
    return out.orderBy(level_rank(F.col("level")).desc(), F.col("rounded").desc(), F.col("score").desc(), F.col(tie).asc()).limit(n)


def with_display(df: DataFrame) -> DataFrame:
    """Add what is shown, with fallbacks for what is missing."""
    cat = F.coalesce(F.nullif("primary_category", F.lit("")), F.nullif("category", F.lit("")), F.lit("frontier_models"))
    # Fixed values.
    label = {i: by_key(cat, rules.CATEGORIES, i, o) for i, o in ((0, "인공지능 기술"), (1, "AI Technology"))}
    told = F.filter("key_points", lambda p: p.rlike("핵심 분야|Topics|주요 분야|핵심 토픽") & (F.trim(F.regexp_extract(p, "^[^:]*:(.*)$", 1)) != ""))
    point = F.try_element_at(told, F.lit(1))
    few = lambda c: F.when(F.size(c) > 0, F.array_join(F.slice(c, 1, 3), ", "))
    return df.withColumns(
        {
            "display_title_ko": _text("title_ko", "title"), "display_title_en": _text("title_en", "title"),
            "display_summary_ko": _text("summary_ko", "excerpt", "title"), "display_summary_en": _text("summary_en", "excerpt", "title"),
            "display_why_ko": F.coalesce(F.nullif("why_it_matters_ko", F.lit("")), F.lit("인공지능 산업 생태계에 유의미한 전략적 파급효과가 예상됩니다.")),
            "display_why_en": F.coalesce(F.nullif("why_it_matters_en", F.lit("")), F.lit("Has notable strategic and technical implications for the AI ecosystem.")),
            "category_label_ko": label[0], "category_label_en": label[1],
            "published_time": F.coalesce(F.date_format("published_at", "yyyy-MM-dd HH:mm"), F.lit("")),
            "display_url": _text("canonical_url", "url"),
            "topics_display": F.coalesce(few("topics"), F.trim(F.regexp_replace(point, "^[^:]*:", "")), few("tags"), label[0]),
            "publisher_display": F.coalesce(_text("publisher", "source"), F.lit("Unknown Source")),
            "display_key_points": key_points(),
        }
    )


def key_points() -> Column:
    """Points without those that only repeat metadata; entities as a fallback."""
    low = F.lower
    starts = "^(발행처|출처|핵심 분야|핵심 토픽|주요 분야|카테고리)"
    meta = lambda p: p.rlike(starts) | (low(p).contains("source") & p.rlike("출처|발행처")) | (low(p).contains("topics") & p.rlike("분야|토픽"))
    value = lambda p: F.when(p.contains(":"), F.trim(F.regexp_replace(p, "^[^:]*:", ""))).otherwise("")
    void = ("none", "null", "[]", "없음", "미지정", "")
    naming = lambda p: low(p).contains("entities") | p.rlike("주요 기업|기업/모델")
    points = F.transform(F.coalesce("key_points", F.array().cast("array<string>")), F.trim)
    kept = F.array_distinct(F.filter(points, lambda p: (p != "") & ~meta(p) & ~(naming(p) & low(value(p)).isin(*void))))
    valid = F.filter(F.transform(F.coalesce("entities", F.array().cast("array<string>")), F.trim), lambda e: ~low(e).isin("none", "null", "없음", ""))
    fall = F.when(F.size(valid) > 0, F.array(F.concat(F.lit("주요 기업/모델 (Entities): "), F.array_join(F.slice(valid, 1, 4), ", ")))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(kept) > 0, kept).otherwise(fall)


# Badges and labels.
BADGES = {
    "primary": ("1차 출처", "Primary"), "research": ("연구", "Research"), "independent": ("독립 취재", "Independent"), "industry_media": ("산업 미디어", "Industry Media"),
    "community": ("커뮤니티", "Community"), "discovery": ("검색 집계", "Discovery"),
}
LEVEL_SAID = {
    "primary": ("1차 출처", "Primary source"), "research": ("연구기관 발표", "Research publication"), "independent": ("독립 취재 보도", "Independent reporting"),
    "industry_media": ("산업 전문 미디어", "Industry media"), "community": ("커뮤니티 논의", "Community discussion"),
}


def with_transparency(df: DataFrame) -> DataFrame:
    """Add badge, sources, status, evidence label, confidence and its explanation, and the other sources of each story."""
    c, none = F.col, F.array().cast("array<string>")
    flag = lambda n: F.coalesce(F.col(n), F.lit(False))
    who, kind = F.trim(F.coalesce(_text("publisher", "source"), F.lit(""))), F.coalesce("source_type", F.lit(""))
    level = F.coalesce(F.nullif("evidence_level", F.lit("")), evidence_level(who))
    out = df.withColumns({"_who": who, "_level": level, "_rel": F.coalesce(c("event_related_sources"), none)})
    out = out.withColumn("_rel", F.when(F.size("_rel") > 0, c("_rel")).otherwise(F.array(F.when(c("_who") != "", c("_who")).otherwise("Unknown Source"))))
    lv, many = c("_level"), F.size("_rel") > 1
    official = flag("is_official") | flag("is_primary_source") | (kind == "official") | (lv == "primary")
    alone = flag("is_independent_source") | (lv == "independent")
    given = c("event_verification_status")
    # Fixed values, here and below: states, labels and the words of explanations.
    guess = (
        F.when(many, "multi_source").when(official, "primary_only").when(alone, "independently_reported").when((lv == "research") | (kind == "research"), "primary_only")
        .when((lv == "industry_media") | kind.isin("media", "korean_media"), "independently_reported")
        .when((lv == "discovery") | flag("is_discovery_source"), "discovery_only").otherwise("insufficient_evidence")
    )
    status = F.when(F.coalesce(given, F.lit("")).isin("", "insufficient_evidence"), guess).otherwise(given)
    out = out.withColumn("status", status)
    paper = ~(flag("is_primary_source") | (kind == "official")) & ((lv == "research") | (kind == "research"))
    st = c("status")
    said = lambda i: (
        F.when(st == "multi_source", ("다수 독립 언론 교차 취재", "Multi-source independent reporting")[i]).when(st == "independently_reported", ("1차 출처 + 독립 언론 취재", "Primary + independent reporting")[i])
        .when((st == "primary_only") & paper, ("연구기관 발표 기반", "Research publication")[i]).when(st == "primary_only", ("1차 공식 발표", "Primary announcement")[i])
        .when(st == "discovery_only", ("검색 집계 발견", "Aggregator discovery")[i]).otherwise(by_key(lv, LEVEL_SAID, i, ("검색 집계 / 발견", "Aggregator / Discovery")[i]))
    )
    has = F.coalesce(c("event_confidence_label"), F.lit(""))
    anew = (has == "") | ((has == "Low") & st.isin("multi_source", "independently_reported", "primary_only"))
    strong = F.coalesce(F.nullif("authority_score", F.lit(0)), F.nullif("source_authority", F.lit(0)), F.lit(70)) >= 90
    high = F.when(strong, "High").otherwise("Medium")
    steps = (
        ((st == "multi_source") | (official & alone), F.lit("High"), " 등 다수 출처 교차 검증", None),
        (official, high, " 공식 발표 (1차 출처)", " official primary announcement"),
        (alone, high, " 독립 언론 심층 보도", " independent journalistic coverage"),
        ((lv == "research") | (kind == "research"), high, " 연구기관 논문 및 발표", " academic / research publication"),
        ((lv == "industry_media") | kind.isin("media", "korean_media"), F.lit("Medium"), " IT/산업 전문 매체 보도", " industry media coverage"),
    )
    label = ko = en = None
    for test, value, k, e in steps:
        k_text = F.concat(c("_who"), F.lit(k))
        e_text = F.concat(c("_who"), F.lit(e)) if e else F.concat(F.lit("Multi-source verified reporting including "), c("_who"))
        label, ko, en = ((F if x is None else x).when(test, y) for x, y in ((label, value), (ko, k_text), (en, e_text)))
    label, ko, en = label.otherwise("Low"), ko.otherwise("커뮤니티 논의 또는 미확인 출처"), en.otherwise("Community discussion or unverified source")
    blank = lambda n: F.coalesce(F.col(n), F.lit(""))
    lowered = lambda a: F.transform(a, F.lower)
    named = lowered(F.concat(F.coalesce("event_primary_sources", none), F.coalesce("event_independent_sources", none)))
    return out.withColumns(
        {
            "badge_ko": by_key(lv, BADGES, 0, BADGES["industry_media"][0]), "badge_en": by_key(lv, BADGES, 1, BADGES["industry_media"][1]),
            "sources_display": F.concat(F.array_join(F.slice("_rel", 1, 4), " · "), F.when(F.size("_rel") > 4, F.format_string(" (+%d)", F.size("_rel") - 4)).otherwise("")),
            "evidence_label_ko": said(0), "evidence_label_en": said(1),
            "confidence_label": F.when(anew, label).otherwise(has), "confidence_label_ko": label_ko(F.when(anew, label).otherwise(has)),
            "confidence_explanation_ko": F.when(anew, ko).otherwise(blank("event_confidence_explanation_ko")), "confidence_explanation_en": F.when(anew, en).otherwise(blank("event_confidence_explanation_en")),
            "is_multi_source": many, "other_sources": F.filter("_rel", lambda s: ~F.array_contains(named, F.lower(s))),
            "shown_independent_count": F.coalesce(F.nullif("event_independent_source_count", F.lit(0)), F.when(flag("is_independent_source"), 1).otherwise(0)),
        }
    ).drop("_who", "_level", "_rel")


def filter_dashboard(df: DataFrame, section: str = "all", region: str = "all", topic: str = "all", source: str = "all", level: str = "all") -> DataFrame:
    """All facets at once; ``all`` leaves one out. Columns: section, regions, topic_keys, source_kind, level."""
    out = df
    for column, value in (("section", section), ("source_kind", source), ("level", level)):
        if value != "all":
            out = out.filter(F.col(column) == value)
    for column, value in (("regions", region), ("topic_keys", topic)):
        if value != "all":
            out = out.filter(F.array_contains(column, value))
    return out


def filter_table(df: DataFrame, search: str = "", **equal: str) -> DataFrame:
    """Equality on columns, and a search string that may stand in title, source or category, in any case."""
    for column, value in equal.items():
        if value not in ("", "all"):
            df = df.filter(F.col(column) == value)
    return df.filter(_all("title", "source", "primary_category").contains(search.strip().lower())) if search.strip() else df


SORTABLE = ("title", "source", "primary_category", "published_at", "priority_score", "confidence_score")


def sort_table(df: DataFrame, column: str, ascending: bool = True, tie: str = "article_id") -> DataFrame:
    if column not in SORTABLE:
        raise ValueError(f"cannot sort by {column}")
    return df.orderBy(F.col(column).asc_nulls_last() if ascending else F.col(column).desc_nulls_last(), F.col(tie).asc())


def placed_table(df: DataFrame, column: str, ascending: bool = True, tie: str = "article_id", place: str = "place") -> DataFrame:
    """Add each row's place in the sorted table; no task holds all rows."""
    if column not in SORTABLE:
        raise ValueError(f"cannot sort by {column}")
    return numbered(df, [F.col(column).asc_nulls_last() if ascending else F.col(column).desc_nulls_last(), F.col(tie).asc()], place)


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    """(kind, value): every value of each column once, in one pass with partial aggregation."""
    pairs = F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select(F.explode(pairs).alias("x")).select("x.*").distinct()


def page(df: DataFrame, number: int, size: int | None, order: list[Column]) -> DataFrame:
    """One page, the number kept within what there is; ``size`` None is all."""
    if size is None:
        return df.orderBy(*order)
    last = max(1, -(-df.count() // size))
    return df.orderBy(*order).offset((min(max(1, number), last) - 1) * size).limit(size)
