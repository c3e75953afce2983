"""Queries over stories: sources, classification, scores, deduplication, similarity and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire import pipeline, rules
from tidewire.functions import sources as src
from tidewire.functions import text as tx
from tidewire.operators import classify, cluster, dedupe, normalize, score, similarity
from tidewire.operators.graph import cut
from tidewire.plans import duck
from tidewire.plans.views import REF, articles, ref_time, table
from tidewire.sources import catalog, feeds

# Sources -------------------------------------------------------------------------------------------------------------


def s5(spark, d):
    """The catalogue by group."""
    t = catalog.enabled(catalog.feeds(spark))
    return t.groupBy("catalog_group").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_independent_source").alias("n_independent"), F.count_if("is_discovery_source").alias("n_discovery"), F.max("authority_score").alias("best"))


def s6(spark, d):
    """Names looked up in the catalogue: by name, id or alias."""
    names = articles(spark, d).select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit(" openai_news ")).otherwise(F.col("publisher")).alias("name"))
    return catalog.lookup(names, catalog.feeds(spark)).select("doc_id", "feed_id", "feed_level")


def s7(spark, d):
    """Addresses of search feeds."""
    return table(spark, d, "documents").select("doc_id", tx.search_feed_url(F.concat(F.lit("site:"), "source", F.lit(' "AI" OR x')), "en").alias("url"))


def s4(spark, d):
    """Evidence and authority of an entry whose publisher is not its feed."""
    a = articles(spark, d).select("doc_id", "publisher", F.lit("Google News Global AI").alias("feed_name"), F.when(F.col("doc_id") % 2 == 0, "discovery").otherwise("industry_media").alias("feed_level"), F.lit(50).alias("feed_authority"))
    return feeds.with_publisher_evidence(a).select("doc_id", "evidence_level", "authority_score")


def s1(spark, d):
    """Entries capped per feed."""
    e = table(spark, d, "documents").select("doc_id", F.col("source").alias("feed_id"), F.col("doc_id").alias("pos"))
    return feeds.cap_per_feed(e).select("doc_id", "feed_id")


def s11(spark, d):
    """Health of feeds by events: errors, entries, response."""
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("feed")).agg(F.count_if(F.col("event_type") == "view").alias("entries"), F.max(F.when(F.col("event_type") == "error", F.lit("x"))).alias("error"), F.max("value").alias("took"))
    return e.select("feed", feeds.health_state(F.col("feed") % 10 != 0, F.when(F.col("feed") % 3 == 0, F.col("error")), F.col("entries"), F.when(F.col("took") > 100, 6.0).otherwise(1.0)).alias("state"))


def p29(spark, d):
    """Levels of evidence of publishers."""
    return articles(spark, d).select("doc_id", src.evidence_level("publisher").alias("evidence_level"))


def p30(spark, d):
    """Authority of publishers; J4: the same as a join with the catalogue."""
    return articles(spark, d).select("doc_id", src.authority("publisher", F.col("source_type")).cast("int").alias("authority"))


def p31(spark, d):
    """Types of publishers."""
    return articles(spark, d).select("doc_id", src.source_type("publisher").alias("kind"))


def j4(spark, d):
    """Publishers joined to feeds, counted by feed."""
    found = catalog.lookup(articles(spark, d).select("doc_id", F.col("publisher").alias("name")), catalog.feeds(spark))
    return found.groupBy(F.coalesce("feed_id", F.lit("none")).alias("feed_id")).agg(F.count(F.lit(1)).alias("n"), F.max("feed_authority").alias("authority"))


# Stories -------------------------------------------------------------------------------------------------------------


def classified(spark, d):
    return classify.with_taxonomy(articles(spark, d))


def normal(spark, d):
    c = classified(spark, d).withColumns({"category": F.col("primary_category"), "evidence_level": src.evidence_level("publisher")})
    return normalize.normalize_articles(c, ref_time())


def scored(spark, d):
    return score.with_scores(classify.with_template_summary(normal(spark, d)), ref_time())


def norm(spark, d):
    """Articles with defaults that follow from one another."""
    return normal(spark, d).select("doc_id", "article_id", "evidence_level", "source_authority", "authority_score", "is_official", "is_primary_source", "is_independent_source", "is_discovery_source", "is_reference")


def norm_entries(spark, d):
    """Raw entries with defaults."""
    e = normalize.normalize_entries(articles(spark, d), ref_time())
    return e.select("doc_id", "publisher", "canonical_url", "source_authority", "authority_score", F.unix_seconds("collected_at").alias("collected_s"))


def p14(spark, d):
    """Categories, first and further, and tags."""
    return classified(spark, d).select("doc_id", "primary_category", F.array_join("secondary_categories", ",").alias("secondary"), F.array_join("tags", ",").alias("tags"))


def p21(spark, d):
    """Template texts."""
    t = classify.with_template_summary(classified(spark, d))
    return t.select("doc_id", "title_ko", "summary_ko", "summary_en", "why_it_matters_en", F.array_join("key_points", "|").alias("key_points"))


def scores(spark, d):
    """The six scores and the priority."""
    return scored(spark, d).select("doc_id", "source_score", "evidence_quality_score", "relevance_score", "impact_score", "novelty_score", "recency_score", "priority_score")


def explanation(spark, d):
    """The reasons for a score."""
    return scored(spark, d).select("doc_id", "evidence_explanation_en")


def levels(spark, d):
    """Priority levels and whole-number scores."""
    return scored(spark, d).select("doc_id", score.priority_level().alias("level"), F.bround("priority_score", 0).cast("int").alias("score"))


def j8(spark, d):
    """Stories to which an earlier one of another address has a similar title."""
    a = articles(spark, d).withColumns({"article_id": F.col("doc_id"), "canonical_url": F.col("url")})
    return score.past_similar(a, a, order="seq").select(F.col("article_id").alias("doc_id"))


# Deduplication -------------------------------------------------------------------------------------------------------


def d1(spark, d):
    """First story of each address."""
    a = articles(spark, d).select("doc_id", tx.canonical_url("url").alias("k"))
    return dedupe.first_by(a, ["k"], "doc_id").select("doc_id")


def d2(spark, d):
    """First story of each publisher and title."""
    a = articles(spark, d).select("doc_id", tx.normal_publisher("publisher").alias("p"), tx.clean_title("title").alias("t"))
    return dedupe.first_by(a, ["p", "t"], "doc_id").select("doc_id")


def d3(spark, d):
    """Similar titles of one publisher: each story's class, how many stories have a similar title, and the pairs of classes."""
    return dedupe.similar_links(cut(dedupe.dedupe_keys(articles(spark, d))))


def d4(spark, d):
    """The whole suppression: which stories stay."""
    return dedupe.suppressed(articles(spark, d))


def d5(spark, d):
    """Suppression against stories of earlier days."""
    a = articles(spark, d)
    return dedupe.suppressed(a.filter("doc_id % 4 != 0"), a.filter("doc_id % 4 = 0"))


def d6(spark, d):
    """How many stories exact address and title repeats cost."""
    return d4(spark, d).agg(F.count_if(~F.col("kept")).alias("suppressed"), F.count_if("kept").alias("kept"))


def f1(spark, d):
    """Stories without an address or a title, left out and not counted."""
    a = articles(spark, d).withColumns({"url": F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.col("url")), "title": F.when(F.col("doc_id") % 10 == 0, "[속보] (x)").otherwise(F.col("title"))})
    return dedupe.dedupe_keys(a).select(F.col("seq").alias("doc_id"))


# Similarity and clusters ---------------------------------------------------------------------------------------------


def _features(spark, d):
    a = articles(spark, d).withColumns({"article_id": F.concat(F.lit("a"), F.col("doc_id").cast("string")), "canonical_url": F.col("url"), "pos": F.col("doc_id")})
    return cut(similarity.with_features(a))


def j7(spark, d):
    """Similar stories: the class and time of each story, pairs of classes that are similar and have stories within 72 hours,
    a class with itself among them, and the first story of the same address. Rows grow with the stories and the classes; all
    pairs of stories follow from them."""
    found = similarity.story_classes(_features(spark, d))
    none, no_time = F.lit(None).cast("double").alias("similarity"), F.lit(None).cast("long").alias("at")
    member = found.members.select(F.lit("class").alias("kind"), F.col("pos").alias("u"), F.col("g").alias("v"), none, "at")
    pairs, nodes = similarity.class_pairs(found, rules.SIMILARITY * rules.COHESION), similarity.class_cells(found)
    # A class and cell of one story is not near itself.
    near = similarity.near_cells(nodes, pairs).join(nodes.select(F.col("node").alias("u"), "n"), "u").filter("u != v or n > 1")
    pairs = pairs.join(near.select("g", "h").distinct(), ["g", "h"])
    pair = pairs.select(F.lit("similar").alias("kind"), F.col("g").alias("u"), F.col("h").alias("v"), F.bround("similarity", 6).alias("similarity"), no_time)
    same = similarity.identical(found.members).filter("pos != first").select(F.lit("same").alias("kind"), F.col("pos").alias("u"), F.col("first").alias("v"), none, no_time).distinct()
    return member.unionByName(pair).unionByName(same)


def j9(spark, d):
    """Stories within 72 hours of one another that share a model, counted."""
    a = similarity.with_features(articles(spark, d)).select(F.col("doc_id").alias("pos"), "published_s", F.explode("f_models").alias("model"))
    return similarity.near_counts(a, "model", "pos", "published_s").select(F.col("key").alias("model"), "n")


def o2(spark, d):
    """The order in which stories are clustered."""
    return cluster.with_position(scored(spark, d).drop("position")).select("doc_id", "pos")


def clusters(spark, d):
    """Events of all stories: the flagship."""
    s = scored(spark, d)
    return cluster.with_event_ids(cluster.assign_events(cut(s))).select("doc_id", "event_id", "relationship", "similarity", "event_pos", "member_pos")


def collect_run(spark, d):
    """A whole run: entries in, events out."""
    run = pipeline.collect(articles(spark, d), ref_time())
    return run.events.select("event_id", "title", "category", "importance", "source_count", "verification_status", "confidence_score", "confidence_label")


QUERIES = {
    "S1_feed_cap": s1, "S4_publisher_evidence": s4, "S5_catalog_groups": s5, "S6_catalog_lookup": s6, "S7_search_feed_url": s7, "S11_feed_health": s11, "P29_evidence_level": p29, "P30_source_authority": p30,
    "P31_source_type": p31, "J4_publisher_join": j4, "normalize_articles": norm, "normalize_entries": norm_entries, "P14_taxonomy": p14, "P21_template_summary": p21, "scores": scores, "score_explanation": explanation,
    "priority_level": levels, "J8_novelty_past": j8, "D1_url_dedupe": d1, "D2_title_dedupe": d2, "D3_similar_titles": d3, "D4_fuzzy_dedupe": d4, "D5_lookback_dedupe": d5, "D6_suppression_count": d6,
    "F1_empty_keys": f1, "J7_event_similarity": j7, "J9_time_band": j9, "O2_cluster_order": o2, "event_clusters": clusters, "collect_run": collect_run,
}

_FEEDS = ", ".join(
    f"({r[0]}, {duck.q(r[1])}, {duck.q(r[2])}, {duck.q(r[9])}, {r[6]}, {str(r[15]).lower()}, {str(r[16]).lower()}, {duck.lst(r[12])}, {duck.q(r[13])})" for r in catalog.feed_rows()
)
_FEED_CTE = f"feeds(rank, id, name, catalog_group, authority, ind, dis, aliases, level) AS (VALUES {_FEEDS})"
_KEYS_CTE = _FEED_CTE + ", keys AS (SELECT k, arg_min(id, rank) AS feed_id, arg_min(level, rank) AS feed_level, arg_min(authority, rank) AS authority FROM (SELECT rank, id, level, authority, unnest(list_concat([lower(name), id], list_transform(aliases, lambda x: lower(x)))) AS k FROM feeds) GROUP BY k)"
_NORMAL = duck.normal()
_SCORED = duck.scored()
_DK = [("k", f"SELECT doc_id AS seq, {duck.url('url')} AS url_key, {duck.publisher('publisher')} AS publisher_key, {duck.clean_title('title')} AS title_key, {duck.numbers('title')} AS numbers, {duck.title_tokens('title')} AS tokens FROM a")]


def _suppression(body: str, old: str = "false") -> str:
    """The decision row by row: a recursive step takes the next row unless what is kept so far conflicts with it. Rows that
    ``old`` holds for are kept from the start."""
    alike = duck.similar(("x.title_key", "y.title_key"), ("x.numbers", "y.numbers"), ("x.tokens", "y.tokens"))
    steps = [
        ("k0", "SELECT *, " + old + " AS old FROM k WHERE url_key <> '' AND title_key <> ''"),
        ("conf", f"SELECT y.seq AS v, list(x.seq) AS us FROM k0 x JOIN k0 y ON NOT y.old AND (x.old OR x.seq < y.seq) AND (x.url_key = y.url_key OR x.publisher_key = y.publisher_key AND (x.title_key = y.title_key OR list_has_any(x.tokens, y.tokens) AND {alike})) GROUP BY 1"),
        ("o", "SELECT seq, row_number() OVER (ORDER BY seq) AS i, coalesce(us, []) AS us FROM k0 LEFT JOIN conf ON v = seq WHERE NOT old"),
    ]
    loop = "r(i, kept) AS (SELECT 0::BIGINT, coalesce((SELECT list(seq) FROM k0 WHERE old), []::BIGINT[]) UNION ALL SELECT o.i, CASE WHEN list_has_any(o.us, r.kept) THEN r.kept ELSE list_append(r.kept, o.seq) END FROM r JOIN o ON o.i = r.i + 1)"
    done = "d AS (SELECT seq, list_contains((SELECT kept FROM r ORDER BY i DESC LIMIT 1), seq) AS kept FROM o)"
    return duck.with_articles("", *_DK, *steps).replace("WITH a AS", "WITH RECURSIVE a AS", 1).rstrip() + f",\n{loop},\n{done}\n{body}"


_SAID = [("explained = " + duck.q(k), duck.q(v[1])) for k, v in score.SAID_OF_EVIDENCE.items()]
_PRE = duck.parts("(lower(source) || ' ' || lower(publisher) || ' ' || lower(url))", score.PREPRINT)
_LEVEL = duck.case([("is_discovery_source OR source_type = 'aggregator' OR contains(lower(source), 'google news')", "'discovery'"), ("is_primary_source AND evidence_level <> 'discovery'", "'primary'"), ("is_independent_source AND evidence_level NOT IN ('discovery', 'industry_media', 'community')", "'independent'")], "evidence_level")
_REASONS = f"""list_filter([{duck.case(_SAID, 'NULL')},
  CASE WHEN impact_score >= 65 AND source_score >= 85 THEN 'Authoritative major announcement' END, CASE WHEN relevance_score >= 80 AND impact_score >= 45 THEN 'Frontier model / AI architecture breakthrough' END,
  CASE WHEN relevance_score >= 80 THEN 'Core AI technology & infrastructure relevance' END, CASE WHEN impact_score >= 70 THEN 'High ecosystem market impact' END, CASE WHEN source_score >= 88 THEN 'High authority lab / primary news outlet' END,
  CASE WHEN recency_score >= 70 THEN 'Recent publication within 24h' END, CASE WHEN relevance_score < 40 AND impact_score < 40 THEN 'Watch item (low relevance & impact)' END], lambda x: x IS NOT NULL)"""
_TEMPLATE = [
    *duck.classified(),
    ("t", "SELECT *, regexp_matches(title, '[가-힣]') AS hangul, " + duck.case([(f"primary_category = {duck.q(k)}", duck.q(v[0])) for k, v in rules.CATEGORIES.items()], "'인공지능 산업'") + " AS ko, "
     + duck.case([(f"primary_category = {duck.q(k)}", duck.q(v[1])) for k, v in rules.CATEGORIES.items()], "'Artificial Intelligence'") + " AS en FROM c"),
]
_FEAT_TEXT = "lower(trim(title) || CASE WHEN excerpt <> '' THEN ' ' || excerpt ELSE '' END)"
_FEATURES = [
    ("g1", f"SELECT doc_id AS pos, url, published_s, {_FEAT_TEXT} AS low FROM a"),
    ("g2", f"SELECT *, {duck.models('low')} AS models, {duck.entities('low')} AS entities, {duck.tokens(duck.plain('low'), rules.STOP_WORDS, 2)} AS tokens, {duck.keyed('low', rules.THEMES)} AS themes, {duck.keyed('low', rules.ACTIONS)} AS actions FROM g1"),
    ("g", f"SELECT *, {duck.effective('actions', 'themes')} AS acts FROM g2"),
]


def _similarity_steps() -> list[tuple[str, str]]:
    """Pair similarity in SQL. Anchors are products of actions, entities and models, so that a launch context is a shared
    entity and model with the two actions on either side."""
    has = lambda c, n: f"list_contains({c}, {duck.q(n)})"
    both = lambda c, *names: f"list_has_any(list_intersect(x.{c}, y.{c}), {duck.lst(names)})"
    xor = lambda n: f"({has('x.acts', n)} <> {has('y.acts', n)})"
    disjoint = lambda c: f"(len(x.{c}) > 0 AND len(y.{c}) > 0 AND NOT list_has_any(x.{c}, y.{c}))"
    clash = []
    for n, weight, excuse in (("legal", 0.45, ("legal_policy", "partnership")), ("office_expansion", 0.40, ("model_release", "partnership")), ("executive_movement", 0.40, ("model_release", "partnership")), ("security", 0.40, ("security_safety", "partnership")), ("partnership", 0.40, ("partnership", "security_safety"))):
        extra = " OR n_ents >= 2" if n == "partnership" else ""
        clash.append(f"CASE WHEN {xor(n)} AND {xor('release')} AND NOT ({both('themes', *excuse)}{extra}) THEN {weight}::DOUBLE ELSE 0.0::DOUBLE END")
    move = lambda s, n: f"({has(f'{s}.themes', n)} OR {has(f'{s}.acts', n)})"
    moved = " OR ".join(f"(({move('x', n)} <> {move('y', n)}) AND NOT {both('themes', 'partnership', 'investment', 'model_release')})" for n in ("office_expansion", "executive_movement"))
    launch = f"(((({has('x.acts', 'release')} AND {has('y.acts', 'pricing')}) OR ({has('x.acts', 'pricing')} AND {has('y.acts', 'release')})) AND {xor('pricing')}) AND n_ents > 0 AND len(list_intersect(x.models, y.models)) > 0 AND len(x.models) = len(y.models) AND len(list_intersect(x.models, y.models)) = len(x.models))"
    return [
        ("w", "SELECT x.pos AS u, y.pos AS v, x, y, len(list_intersect(x.tokens, y.tokens)) / len(list_distinct(list_concat(x.tokens, y.tokens)))::DOUBLE AS j, len(list_intersect(x.entities, y.entities)) AS n_ents, list_distinct(list_concat(x.themes, y.themes)) AS all_themes FROM g x JOIN g y ON x.pos < y.pos AND len(x.tokens) > 0 AND len(y.tokens) > 0 AND (x.url = y.url OR x.published_s IS NULL OR y.published_s IS NULL OR abs(x.published_s - y.published_s) <= 259200)"),
        ("w2", f"SELECT *, {launch} AS launch, len(list_filter(all_themes, lambda t: t NOT IN ('model_release', 'benchmarking'))) = 0 AS launch_only FROM w"),
        ("w3", f"""SELECT u, v, CASE WHEN x.url = y.url THEN 1.0::DOUBLE
  WHEN ({disjoint('entities')} AND NOT (({both('themes', 'partnership', 'legal_policy', 'security_safety')} OR {both('acts', 'partnership', 'legal', 'security')}) AND j >= 0.15::DOUBLE))
    OR ({disjoint('models')} AND NOT (n_ents >= 2 OR {both('themes', 'partnership', 'security_safety', 'legal_policy', 'benchmarking')} OR {both('acts', 'partnership', 'security', 'legal')}))
    OR ({xor('pricing')} AND NOT launch) OR {moved} THEN 0.0::DOUBLE
  ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, j
    + CASE WHEN n_ents >= 2 THEN 0.30::DOUBLE WHEN n_ents = 1 THEN CASE WHEN list_has_any(x.acts, y.acts) OR list_has_any(x.themes, y.themes) OR list_has_any(x.models, y.models) OR (launch_only AND len(all_themes) > 0) OR launch OR j >= 0.20::DOUBLE THEN 0.25::DOUBLE ELSE 0.05::DOUBLE END ELSE 0.0::DOUBLE END
    + CASE WHEN list_has_any(x.models, y.models) THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN n_ents > 0 AND list_has_any(x.models, y.models) THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN list_has_any(x.themes, y.themes) THEN 0.15::DOUBLE WHEN launch_only AND len(x.themes) > 0 AND len(y.themes) > 0 THEN 0.10::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN list_has_any(x.acts, y.acts) THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END - ({' + '.join(clash)}))) END AS similarity FROM w2"""),
    ]


ORACLES = {
    "S1_feed_cap": "SELECT doc_id, source AS feed_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 15",
    "S4_publisher_evidence": duck.with_articles(f"SELECT doc_id, CASE WHEN publisher <> 'Google News Global AI' AND (lvl = 'discovery' OR own IN ('primary', 'independent', 'research')) THEN own ELSE lvl END AS evidence_level, CASE WHEN publisher <> 'Google News Global AI' THEN coalesce({duck.case([(f'lower(trim(publisher)) = {duck.q(k)}', str(v)) for k, v in rules.PUBLISHER_AUTHORITY.items()], 'NULL')}, 50) ELSE 50 END AS authority_score FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'discovery' ELSE 'industry_media' END AS lvl, {duck.evidence_level('publisher')} AS own FROM a)"),
    "S5_catalog_groups": f"WITH {_FEED_CTE} SELECT catalog_group, count(*) AS n, count(*) FILTER (ind) AS n_independent, count(*) FILTER (dis) AS n_discovery, max(authority) AS best FROM feeds GROUP BY 1",
    "S6_catalog_lookup": duck.with_articles("SELECT doc_id, feed_id, feed_level FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ' openai_news ' ELSE publisher END AS name FROM a) LEFT JOIN keys ON k = lower(trim(name))").replace("WITH a AS", f"WITH {_KEYS_CTE}, a AS", 1),
    "S7_search_feed_url": "SELECT doc_id, 'https://news.google.com/rss/search?q=' || replace(url_encode('site:' || source || ' \"AI\" OR x'), '%20', '+') || '&hl=en-US&gl=US&ceid=US:en' AS url FROM documents",
    "S11_feed_health": "SELECT user_id AS feed, CASE WHEN user_id % 10 = 0 THEN 'disabled' WHEN user_id % 3 = 0 AND bool_or(event_type = 'error') THEN 'failing' WHEN count(*) FILTER (event_type = 'view') = 0 OR max(value) > 100 THEN 'degraded' ELSE 'healthy' END AS state FROM events GROUP BY user_id",
    "P29_evidence_level": duck.with_articles(f"SELECT doc_id, {duck.evidence_level('publisher')} AS evidence_level FROM a"),
    "P30_source_authority": duck.with_articles(f"SELECT doc_id, {duck.authority('publisher', 'source_type')}::INT AS authority FROM a"),
    "P31_source_type": duck.with_articles(f"SELECT doc_id, {duck.source_type('publisher')} AS kind FROM a"),
    "J4_publisher_join": duck.with_articles("SELECT coalesce(feed_id, 'none') AS feed_id, count(*) AS n, max(authority) AS authority FROM a LEFT JOIN keys ON k = lower(trim(publisher)) GROUP BY 1").replace("WITH a AS", f"WITH {_KEYS_CTE}, a AS", 1),
    "normalize_articles": duck.with_articles("SELECT doc_id, 'art_' || sha256(trim(url))[:16] AS article_id, evidence_level, source_authority, source_authority AS authority_score, is_official, is_primary_source, is_independent_source, is_discovery_source, source_type IN ('regulator', 'institution', 'research') AS is_reference FROM n", *_NORMAL),
    "normalize_entries": duck.with_articles(f"SELECT doc_id, publisher, url AS canonical_url, coalesce(source_authority, 70) AS source_authority, coalesce(source_authority, 70) AS authority_score, epoch(TIMESTAMP '{REF}')::BIGINT AS collected_s FROM a"),
    "P14_taxonomy": duck.with_articles("SELECT doc_id, primary_category, array_to_string(secondary_categories, ',') AS secondary, array_to_string(tags, ',') AS tags FROM c", *duck.classified()),
    "P21_template_summary": duck.with_articles(f"""SELECT doc_id, CASE WHEN hangul THEN title ELSE '[AI 동향] ' || title END AS title_ko,
  CASE WHEN NOT hangul THEN publisher || '에 따르면, ' || title || ' 내용이 발표되었습니다. ' || ko || ' 분야의 주요 전개입니다.' WHEN trim(excerpt) <> '' THEN trim(excerpt) ELSE title || ' 관련 ' || ko || ' 주요 동향입니다.' END AS summary_ko,
  CASE WHEN hangul THEN title || '. Updates in the ' || en || ' sector reported by ' || publisher || '.' WHEN trim(excerpt) <> '' THEN trim(excerpt) ELSE title || '. Strategic updates in the ' || en || ' ecosystem.' END AS summary_en,
  {duck.case([(f"primary_category = {duck.q(k)}", duck.q(v[1])) for k, v in classify.IMPACT.items()], duck.q(classify.IMPACT_OTHERWISE[1]))} AS why_it_matters_en,
  CASE WHEN len(entities) > 0 THEN '주요 기업/모델 (Entities): ' || array_to_string(entities[:4], ', ') || '|' ELSE '' END || '핵심 분야 (Topics): ' || CASE WHEN len(topics) > 0 THEN array_to_string(topics[:4], ', ') ELSE ko || ' (' || en || ')' END AS key_points FROM t""", *_TEMPLATE),
    "scores": duck.with_articles("SELECT doc_id, source_score, evidence_quality_score, relevance_score, impact_score, novelty_score, recency_score, priority_score FROM s", *_SCORED),
    "score_explanation": duck.with_articles(f"SELECT doc_id, array_to_string(CASE WHEN len(r) > 0 THEN r[:3] ELSE ['General AI ecosystem reference'] END, ' · ') AS evidence_explanation_en FROM (SELECT doc_id, {_REASONS} AS r FROM (SELECT *, CASE WHEN lv = 'research' AND {_PRE} THEN 'preprint' ELSE lv END AS explained FROM (SELECT *, {_LEVEL} AS lv FROM s)))", *_SCORED),
    "priority_level": duck.with_articles(f"SELECT doc_id, {duck.level()} AS level, round_even(priority_score, 0)::INT AS score FROM s", *_SCORED),
    "J8_novelty_past": duck.with_articles("SELECT DISTINCT x.doc_id FROM z x JOIN z y ON y.doc_id < x.doc_id AND x.url <> y.url AND len(list_intersect(x.t, y.t)) >= 4 AND len(list_intersect(x.t, y.t)) / greatest(len(x.t), len(y.t)) >= 0.75", ("z", f"SELECT doc_id, url, {duck.tokens(duck.plain('title'), rules.NOVELTY_STOP_WORDS, 3)} AS t FROM a")),
    "D1_url_dedupe": duck.with_articles("SELECT min(seq) AS doc_id FROM k GROUP BY url_key", *_DK),
    "D2_title_dedupe": duck.with_articles("SELECT min(seq) AS doc_id FROM k GROUP BY publisher_key, title_key", *_DK),
    "D3_similar_titles": duck.with_articles("SELECT 'class' AS kind, seq AS u, class_seq AS v, (SELECT count(*) FROM p WHERE p.u = kc.seq OR p.v = kc.seq) AS n_links FROM kc UNION ALL SELECT DISTINCT 'similar', least(x.class_seq, y.class_seq), greatest(x.class_seq, y.class_seq), NULL::BIGINT FROM p JOIN kc x ON x.seq = p.u JOIN kc y ON y.seq = p.v WHERE x.class_seq <> y.class_seq",
        *_DK, ("kc", "SELECT seq, CASE WHEN len(tokens) > 0 THEN min(seq) OVER (PARTITION BY publisher_key, title_key, numbers, tokens) ELSE seq END AS class_seq FROM k"), ("p", "SELECT x.seq AS u, y.seq AS v FROM k x JOIN k y ON x.publisher_key = y.publisher_key AND x.seq < y.seq AND list_has_any(x.tokens, y.tokens) AND " + duck.similar(("x.title_key", "y.title_key"), ("x.numbers", "y.numbers"), ("x.tokens", "y.tokens")))),
    "D4_fuzzy_dedupe": _suppression("SELECT * FROM d"),
    "D5_lookback_dedupe": _suppression("SELECT * FROM d", "seq % 4 = 0"),
    "D6_suppression_count": _suppression("SELECT count(*) FILTER (NOT kept) AS suppressed, count(*) FILTER (kept) AS kept FROM d"),
    "stream_exact_dedupe": _suppression("SELECT seq FROM d WHERE kept"),
    "F1_empty_keys": duck.with_articles(f"SELECT doc_id FROM a WHERE doc_id % 9 <> 0 AND doc_id % 10 <> 0 AND {duck.clean_title('title')} <> ''"),
    "J7_event_similarity": duck.with_articles("""SELECT 'class' AS kind, pos AS u, rep AS v, NULL::DOUBLE AS similarity, (published_s * 1000000)::BIGINT AS at FROM gc
  UNION ALL SELECT DISTINCT 'similar', least(xr.rep, yr.rep), greatest(xr.rep, yr.rep), round_even(w3.similarity, 6), NULL::BIGINT FROM w3 JOIN gc xr ON xr.pos = w3.u JOIN gc yr ON yr.pos = w3.v WHERE w3.similarity >= 0.6::DOUBLE * 0.65::DOUBLE
  UNION ALL SELECT 'same', pos, first, NULL::DOUBLE, NULL::BIGINT FROM (SELECT pos, min(pos) OVER (PARTITION BY url) AS first FROM g WHERE url <> '') WHERE pos <> first""", *_FEATURES, ("gc", "SELECT pos, published_s, min(pos) OVER (PARTITION BY models, entities, tokens, themes, actions, acts) AS rep FROM g"), *[(n, t.replace("x.url = y.url OR x.published_s IS NULL", "x.published_s IS NULL").replace("CASE WHEN x.url = y.url THEN 1.0::DOUBLE\n  WHEN", "CASE WHEN")) for n, t in _similarity_steps()]),
    "J9_time_band": duck.with_articles("SELECT m AS model, count(*) AS n FROM (SELECT pos, published_s, unnest(models) AS m FROM g) x JOIN (SELECT pos AS pos2, published_s AS s2, unnest(models) AS m FROM g) y USING (m) WHERE pos < pos2 AND abs(published_s - s2) <= 259200 GROUP BY 1", *_FEATURES),
    "O2_cluster_order": duck.with_articles("SELECT doc_id, row_number() OVER (ORDER BY (is_official OR is_primary_source)::INT DESC, priority_score DESC, published_s DESC NULLS LAST, 'art_' || sha256(trim(url))[:16] DESC) - 1 AS pos FROM s", *_SCORED),
}
