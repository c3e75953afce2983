"""Queries of scalar functions: addresses, titles, publishers, lexicons, dates, JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire import rules
from tidewire.functions import entities as ent
from tidewire.functions import text as tx
from tidewire.plans import duck
from tidewire.plans.views import articles, table
from tidewire.sources.feeds import entry_publisher, published_time, strip_tags, warning_parts



def first_line():
    return F.substring_index("text", "\n", 1)


TITLE_SQL = "split_part(text, chr(10), 1)"


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "source")


def p1(spark, d):
    """Canonical addresses."""
    return table(spark, d, "pages").select("page_id", tx.canonical_url("url").alias("canonical_url"))


def p2(spark, d):
    """Titles cleaned for comparison."""
    return _docs(spark, d).select("doc_id", tx.clean_title(first_line()).alias("title_key"))


def p3(spark, d):
    """Tokens of titles."""
    return articles(spark, d).select("doc_id", F.array_join(tx.title_tokens("title"), " ").alias("tokens"))


def p4(spark, d):
    """Numbers in titles."""
    return _docs(spark, d).select("doc_id", F.array_join(tx.title_numbers(F.concat_ws(" ", first_line(), F.col("doc_id").cast("string"), F.lit("v3 7b"))), " ").alias("numbers"))


def p5(spark, d):
    """Tokens for novelty."""
    return articles(spark, d).select("doc_id", F.array_join(tx.novelty_tokens("title"), " ").alias("tokens"))


def p6(spark, d):
    """Tokens for clustering, of whole texts."""
    return _docs(spark, d).select("doc_id", F.size(tx.tokens(tx.plain_words("text"), rules.STOP_WORDS, 2)).cast("long").alias("n_tokens"))


def p7(spark, d):
    """Publisher keys."""
    return articles(spark, d).select("doc_id", tx.normal_publisher("publisher").alias("publisher_key"))


def p8(spark, d):
    """Publisher names for display."""
    return articles(spark, d).select("doc_id", tx.pretty_publisher(tx.normal_publisher("publisher")).alias("shown"))


def p9(spark, d):
    """Keywords: whole words where ASCII, anywhere else."""
    low = F.lower(F.concat_ws(" ", "title", "excerpt"))
    return articles(spark, d).select("doc_id", *(tx.matches(low, tx.keyword_pattern([k])).alias(n) for n, k in (("k_release", "release"), ("k_open_weights", "open weights"), ("k_korean", "공개"))))


def p10(spark, d):
    """Model names."""
    return articles(spark, d).select("doc_id", F.array_join(tx.models_in(F.concat_ws(" ", "title", "excerpt")), " ").alias("models"))


def p11(spark, d):
    """Entities in a text."""
    return articles(spark, d).select("doc_id", F.array_join(tx.entities_in(F.concat_ws(" ", "title", "excerpt")), ",").alias("entities"))


ALIASES = ("OpenAI", " hbm3e ", "hbm", "DeepMind", "claude", "nobody", "Copilot", "microsoft", "gpt-5", "엔비디아")


def _pairs(spark, d):
    pick = lambda c: F.element_at(F.array(*map(F.lit, ALIASES)), (c % len(ALIASES) + 1).cast("int"))
    return _docs(spark, d).select("doc_id", pick(F.col("doc_id")).alias("a"), pick(F.floor(F.col("doc_id") / 3)).alias("b"))


def p12(spark, d):
    """Canonical entity, id and group of names, and whether two are the same or of one group."""
    return _pairs(spark, d).select("doc_id", ent.canonical_name("a").alias("name"), ent.canonical_id("a").alias("id"), ent.same_entity("a", "b").alias("same"), ent.same_group("a", "b").alias("same_group"), F.array_join(ent.family("a"), ",").alias("family"))


def j5(spark, d):
    """Aliases joined to entities: the lookup as a join."""
    names = _pairs(spark, d).withColumn("alias", F.lower(F.trim("a")))
    return names.join(F.broadcast(ent.alias_table(spark)), "alias", "left").groupBy(F.coalesce("name", F.lit("?")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


def p13(spark, d):
    """Topics."""
    return articles(spark, d).select("doc_id", F.array_join(tx.topics_in(F.concat_ws(" ", "title", "excerpt")), ",").alias("topics"))


def _featured(spark, d):
    a = articles(spark, d).withColumn("low", F.lower(F.concat_ws(" ", "title", "excerpt")))
    a = a.withColumns({"themes": tx.keyed(F.col("low"), rules.THEMES), "actions": tx.keyed(F.col("low"), rules.ACTIONS), "models": tx.models_in("low"), "entities": tx.entities_in("low")})
    return a.withColumn("effective", tx.effective_actions(F.col("actions"), F.col("themes")))


def p15(spark, d):
    """Themes, actions and effective actions."""
    return _featured(spark, d).select("doc_id", *(F.array_join(c, ",").alias(c) for c in ("themes", "actions", "effective")))


def p16(spark, d):
    """Event anchors: action, entity, model."""
    a = _featured(spark, d).select("doc_id", F.explode(tx.event_anchors(F.col("effective"), F.col("entities"), F.col("models"))).alias("x"))
    return a.select("doc_id", "x.action", "x.entity", "x.model")


def p17(spark, d):
    """Concrete (entity, model) pairs."""
    a = _featured(spark, d)
    return a.select("doc_id", F.size(tx.concrete_pairs(tx.event_anchors(F.col("effective"), F.col("entities"), F.col("models")))).cast("long").alias("n_pairs"))


def p20(spark, d):
    """Hosts, and which only lead elsewhere."""
    u = F.when(F.col("page_id") % 9 == 0, F.lit("https://News.Google.com/rss/x")).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", tx.url_host(u).alias("host"), tx.is_intermediary(u).alias("intermediary"))


def p32(spark, d):
    """Warnings in two parts."""
    w = F.when(F.col("doc_id") % 3 == 0, F.lit("no colon here")).otherwise(F.concat(F.col("source"), F.lit(": HTTP 5"), F.col("doc_id").cast("string"), F.lit(": x")))
    p = _docs(spark, d).select("doc_id", warning_parts(w).alias("p"))
    return p.select("doc_id", F.col("p.source").alias("warn_source"), F.col("p.detail").alias("detail"))


def s3(spark, d):
    """Parts of an entry: publisher from the title, excerpt without tags, time of publication."""
    p = articles(spark, d)
    title = F.concat(F.col("title"), F.when(F.col("doc_id") % 3 == 0, F.lit(" - Daily Planet")).otherwise(F.lit("")))
    own = F.when(F.col("doc_id") % 10 == 1, F.lit(" Own Source "))
    at = F.when(F.col("doc_id") % 17 == 0, F.lit("nonsense")).otherwise(F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss 'GMT'"))
    return p.select("doc_id", entry_publisher(title, own, F.lit("Feed")).alias("publisher"), F.substring(strip_tags(F.concat(F.lit("<p>"), "excerpt", F.lit("</p>  <b>more</b>"))), 1, 500).alias("excerpt"), F.unix_seconds(published_time(at)).alias("published_s"))


def json_props(spark, d):
    """JSON fields and lists, tolerant of what is no JSON."""
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.sum(F.from_json("props", "map<string,bigint>")["k"]).alias("k_sum"), F.count_if(F.from_json(F.when(F.col("event_id") % 5 == 0, F.lit("[broken")).otherwise(F.lit('["a","b"]')), "array<string>").isNull()).alias("bad"))


QUERIES = {
    "P1_canonical_url": p1, "P2_clean_title": p2, "P3_title_tokens": p3, "P4_title_numbers": p4, "P5_novelty_tokens": p5, "P6_cluster_tokens": p6, "P7_normal_publisher": p7, "P8_pretty_publisher": p8,
    "P9_keyword_match": p9, "P10_model_ids": p10, "P11_entities": p11, "P12_canonical_entity": p12, "P13_topics": p13, "P15_themes_actions": p15, "P16_event_anchors": p16, "P17_anchor_pairs": p17,
    "P20_intermediary": p20, "P32_warning_items": p32, "S3_entry_parts": s3, "J5_alias_join": j5, "json_columns": json_props,
}

_LOW = "lower(title || ' ' || excerpt)"
_PAIR = f"SELECT doc_id, {duck.lst(ALIASES)}[doc_id % {len(ALIASES)} + 1] AS a, {duck.lst(ALIASES)}[(doc_id // 3) % {len(ALIASES)} + 1] AS b FROM documents"
_KEYS = ent.alias_keys()
_ALIAS_VALUES = ", ".join(f"({duck.q(k)}, {duck.q(rules.ENTITIES[i][0])}, {duck.q(rules.ENTITIES[i][1])}, {duck.q(rules.ENTITIES[i][3]) if rules.ENTITIES[i][3] else 'NULL'})" for k, i in _KEYS.items())
_FEATURED = [
    ("f1", f"SELECT *, {_LOW} AS low FROM a"),
    ("f2", f"SELECT *, {duck.keyed('low', rules.THEMES)} AS themes, {duck.keyed('low', rules.ACTIONS)} AS actions, {duck.models('low')} AS models, {duck.entities('low')} AS entities FROM f1"),
    ("f", f"SELECT *, {duck.effective('actions', 'themes')} AS effective FROM f2"),
]
_ANCHORS = "SELECT doc_id, action, entity, model FROM (SELECT doc_id, unnest(CASE WHEN len(effective) > 0 THEN effective ELSE ['general'] END) AS action, entities, models FROM f), LATERAL (SELECT unnest(CASE WHEN len(entities) > 0 THEN entities ELSE [NULL::VARCHAR] END) AS entity), LATERAL (SELECT unnest(CASE WHEN len(models) > 0 THEN models ELSE [NULL::VARCHAR] END) AS model)"

ORACLES = {
    "P1_canonical_url": f"SELECT page_id, {duck.url('url')} AS canonical_url FROM pages",
    "P2_clean_title": f"SELECT doc_id, {duck.clean_title(TITLE_SQL)} AS title_key FROM documents",
    "P3_title_tokens": duck.with_articles(f"SELECT doc_id, array_to_string({duck.title_tokens('title')}, ' ') AS tokens FROM a"),
    "P4_title_numbers": f"SELECT doc_id, array_to_string({duck.numbers(TITLE_SQL + chr(32) + '|| chr(32) || doc_id || chr(32) || ' + duck.q('v3 7b'))}, ' ') AS numbers FROM documents",
    "P5_novelty_tokens": duck.with_articles(f"SELECT doc_id, array_to_string({duck.tokens(duck.plain('title'), rules.NOVELTY_STOP_WORDS, 3)}, ' ') AS tokens FROM a"),
    "P6_cluster_tokens": f"SELECT doc_id, len({duck.tokens(duck.plain('text'), rules.STOP_WORDS, 2)}) AS n_tokens FROM documents",
    "P7_normal_publisher": duck.with_articles(f"SELECT doc_id, {duck.publisher('publisher')} AS publisher_key FROM a"),
    "P8_pretty_publisher": duck.with_articles(f"SELECT doc_id, {duck.pretty('k')} AS shown FROM (SELECT doc_id, {duck.publisher('publisher')} AS k FROM a)"),
    "P9_keyword_match": duck.with_articles(f"SELECT doc_id, {duck.has(_LOW, tx.keyword_pattern(['release']))} AS k_release, {duck.has(_LOW, tx.keyword_pattern(['open weights']))} AS k_open_weights, contains({_LOW}, '공개') AS k_korean FROM a"),
    "P10_model_ids": duck.with_articles(f"SELECT doc_id, array_to_string({duck.models(_LOW)}, ' ') AS models FROM a"),
    "P11_entities": duck.with_articles(f"SELECT doc_id, array_to_string({duck.entities(_LOW)}, ',') AS entities FROM a"),
    "P12_canonical_entity": f"""
WITH e(alias, name, id, parent_group) AS (VALUES {_ALIAS_VALUES}), p AS ({_PAIR}),
g AS (SELECT parent_group, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM (VALUES {", ".join(f"({duck.q(x[3])}, {duck.q(x[0])})" for x in rules.ENTITIES if x[3])}) v(parent_group, name) GROUP BY parent_group)
SELECT doc_id, x.name, x.id, CASE WHEN x.id IS NOT NULL AND y.id IS NOT NULL THEN x.id = y.id ELSE lower(trim(a)) = lower(trim(b)) END AS same,
  coalesce(x.parent_group = y.parent_group, false) AS same_group, coalesce(g.names, x.name, a) AS family
FROM p LEFT JOIN e x ON x.alias = lower(trim(a)) LEFT JOIN e y ON y.alias = lower(trim(b)) LEFT JOIN g ON g.parent_group = x.parent_group""",
    "J5_alias_join": f"WITH e(alias, name, id, parent_group) AS (VALUES {_ALIAS_VALUES}), p AS ({_PAIR}) SELECT coalesce(name, '?') AS name, count(*) AS n FROM p LEFT JOIN e ON alias = lower(trim(a)) GROUP BY 1",
    "P13_topics": duck.with_articles(f"SELECT doc_id, array_to_string({duck.topics(_LOW)}, ',') AS topics FROM a"),
    "P15_themes_actions": duck.with_articles("SELECT doc_id, array_to_string(themes, ',') AS themes, array_to_string(actions, ',') AS actions, array_to_string(effective, ',') AS effective FROM f", *_FEATURED),
    "P16_event_anchors": duck.with_articles(_ANCHORS, *_FEATURED),
    "P17_anchor_pairs": duck.with_articles("SELECT doc_id, len(entities) * len(models) AS n_pairs FROM f", *_FEATURED),
    "P20_intermediary": "SELECT page_id, h AS host, regexp_matches(h, '^google\\.com$|\\.google\\.com$|news\\.google|google\\.co\\.uk$') AS intermediary FROM (SELECT page_id, " + duck.host("CASE WHEN page_id % 9 = 0 THEN 'https://News.Google.com/rss/x' ELSE url END") + " AS h FROM pages)",
    "P32_warning_items": """
SELECT doc_id, CASE WHEN i = 0 THEN '수집기' ELSE trim(w[:i - 1]) END AS warn_source, CASE WHEN i = 0 THEN w ELSE trim(w[i + 1:]) END AS detail
FROM (SELECT doc_id, w, instr(w, ':') AS i FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'no colon here' ELSE source || ': HTTP 5' || doc_id || ': x' END AS w FROM documents))""",
    "S3_entry_parts": duck.with_articles("""
SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN 'Own Source' WHEN contains(t, ' - ') AND length(tail) <= 40 THEN tail ELSE 'Feed' END AS publisher,
  trim(excerpt || CASE WHEN excerpt = '' THEN '' ELSE ' ' END || 'more')[:500] AS excerpt, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE published_s END AS published_s
FROM (SELECT *, trim(regexp_extract(t, '^.* - (.*)$', 1)) AS tail FROM (SELECT *, title || CASE WHEN doc_id % 3 = 0 THEN ' - Daily Planet' ELSE '' END AS t FROM a))"""),
    "json_columns": "SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k_sum, count(*) FILTER (event_id % 5 = 0) AS bad FROM events GROUP BY 1",
}
