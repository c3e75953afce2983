"""Queries over events and issues: evidence, confidence, facets, sections, metrics, storage, pages, streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewire import rules
from tidewire.operators import cluster, evidence, keyed, metrics, present, score, similarity, store
from tidewire.operators.graph import cut
from tidewire.plans import duck
from tidewire.plans.story_queries import _FEATURES, _TEMPLATE, normal, scored
from tidewire.plans.views import articles, ref_time, table
from tidewire.sources import catalog, feeds, pages
from tidewire.sources.page_text import BOILERPLATE, MOST_CHARS, page_text, usable_text
from tidewire.streaming import incremental



def event_key():
    return F.concat(F.lit("e"), (F.col("doc_id") % 97).cast("string"))

JOINED = lambda *cols: [F.array_join(c, ",").alias(c) for c in cols]


def members(spark, d):
    """Stories with a given event."""
    n = normal(spark, d).withColumns({"event_id": event_key(), "priority_score": (F.col("doc_id") % 100).cast("double"), "content": F.when(F.col("doc_id") % 6 == 0, F.lit("body")).otherwise("")})
    return n


def a2(spark, d):
    """The strongest level of each publisher of an event."""
    return evidence.publisher_strength(members(spark, d))


def a1(spark, d):
    """The levels of each publisher of an event."""
    m = members(spark, d).select("event_id", evidence.normal_publisher("publisher").alias("publisher_key"), "evidence_level")
    return m.groupBy("event_id", "publisher_key").agg(F.array_join(F.array_sort(F.collect_set("evidence_level")), ",").alias("levels"))


def a3(spark, d):
    """Evidence of events: sources, diversity, status."""
    return evidence.event_evidence(members(spark, d)).select("event_id", *JOINED("evidence_sources", "primary_sources", "independent_sources"), "evidence_diversity", "verification_status")


def a4(spark, d):
    """any() over the stories of an event, best authority and importance, names as given."""
    return evidence.event_signals(members(spark, d)).select("event_id", "has_official_source", "has_regulatory_source", "has_major_media_source", "has_research", "has_content", "max_authority", "importance", *JOINED("related_sources"))


def a8(spark, d):
    """Confidence of events, with label and explanation."""
    return evidence.event_confidence(cut(members(spark, d))).select("event_id", "confidence_score", "confidence_label", "confidence_explanation_en", "source_count", "independent_source_count")


def _placed(spark, d):
    m = members(spark, d).withColumns({"pos": F.col("doc_id"), "score": F.col("priority_score"), "event_pos": F.col("doc_id") % 97})
    return m.withColumn("member_pos", F.row_number().over(Window.partitionBy("event_pos").orderBy("pos")) - 1)


def o3(spark, d):
    """The primary story of each event, and the bridge's constant similarity."""
    return cluster.with_event_ids(_placed(spark, d).drop("event_id")).select("doc_id", "event_id", "relationship", "similarity")


def a6(spark, d):
    """Events with their first official source and members in order."""
    e = evidence.build_events(cluster.with_event_ids(_placed(spark, d).drop("event_id")))
    return e.select("event_pos", "official_source_name", F.size("article_ids").alias("n_members"))


def a9(spark, d):
    """What an event is about: the union of its stories' entities, models, themes and actions."""
    f = similarity.with_features(articles(spark, d)).withColumn("event", F.col("doc_id") % 97)
    return evidence.event_anchors_of(f, "event").select("event", *JOINED("entities", "models", "themes", "effective"))


def a10(spark, d):
    """Feeds by level."""
    return metrics.feed_counts(catalog.feeds(spark))


def a11(spark, d):
    """Figures of a run."""
    m = members(spark, d)
    full = evidence.enrich(m, evidence.build_events(cluster.with_event_ids(_placed(spark, d).drop("event_id"))).withColumn("event_id", F.concat(F.lit("e"), F.col("event_pos").cast("string"))))
    ev = evidence.event_confidence(cut(m))
    out = metrics.story_metrics(full).join(metrics.event_metrics(ev)).join(metrics.top_metrics(m.withColumn("article_id", F.col("doc_id"))))
    return out


def facets(spark, d):
    """Counts by region, topic and kind of source."""
    return present.facet_counts(normal(spark, d))


def p26(spark, d):
    """Regions, topics and kind of source of each story."""
    n = normal(spark, d)
    return n.select("doc_id", F.array_join(present.regions(), ",").alias("regions"), F.array_join(present.topic_keys(), ",").alias("topics"), present.source_kind().alias("kind"))


def issue(spark, d):
    """Scored stories as an issue keeps them: written once, as the dashboard reads them from the store."""
    return cut(scored(spark, d))


def a13(spark, d):
    """Stories by priority level."""
    return present.priority_counts(issue(spark, d))


def o5(spark, d):
    """The five stories of the highest level and score."""
    return present.top_prioritised(issue(spark, d), 5, "doc_id").select("doc_id", "level", "rounded")


def f3(spark, d):
    """Stories good enough to be featured."""
    return present.featured(scored(spark, d)).select("doc_id")


def o6(spark, d):
    """Sections, with room for six."""
    s = issue(spark, d).withColumns({"article_id": F.col("doc_id").cast("string"), "position": F.col("doc_id")})
    return present.sections(s)


def p23(spark, d):
    """What is shown, with fallbacks."""
    t = present.with_display(issue(spark, d).withColumn("summary_en", F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("summary_en"))))
    return t.select("doc_id", "display_summary_en", "category_label_en", "published_time", "topics_display", "publisher_display", F.array_join("display_key_points", "|").alias("points"))


def p25(spark, d):
    """Source transparency."""
    m = cut(members(spark, d))
    blank = {"title": F.lit(""), "official_source_url": F.lit(None).cast("string"), "official_source_name": F.lit(None).cast("string"), "article_ids": F.array().cast("array<string>")}
    t = present.with_transparency(cut(evidence.enrich(m, evidence.event_confidence(m).withColumns(blank))))
    return t.select("doc_id", "badge_en", "status", "evidence_label_en", "confidence_label", "sources_display", F.size("other_sources").alias("n_other"))


def f4(spark, d):
    """All facets of the dashboard at once."""
    n = issue(spark, d).withColumns({"regions": present.regions(), "topic_keys": present.topic_keys(), "source_kind": present.source_kind(), "level": score.priority_level()})
    return present.filter_dashboard(n, region="us", topic="frontier_models", source="industry_media").select("doc_id", "level")


def f5(spark, d):
    """Search and equality in the table."""
    return present.filter_table(issue(spark, d), "  OpenAI ", source_type="media").select("doc_id")


def o9(spark, d):
    """The third page of twenty stories, by priority."""
    s = issue(spark, d).select("doc_id", "priority_score")
    return present.page(s, 3, 20, [F.col("priority_score").desc(), F.col("doc_id").asc()])


def o8(spark, d):
    """The table sorted by publisher, with a place."""
    return present.placed_table(issue(spark, d).select("doc_id", "source"), "source", False, "doc_id")


def a15(spark, d):
    """Categories and sources there are."""
    return present.distinct_values(normal(spark, d), "primary_category", "source")


def j1(spark, d):
    """Days with their number of stories."""
    e = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("issue_date"), "event_type")
    return store.issue_counts(e.select("issue_date").distinct(), e.filter("event_type = 'signup'"))


def a14(spark, d):
    """Stories a calendar day of a time zone: tumbling windows."""
    return metrics.daily_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "Europe/Berlin", "ts")


def j2(spark, d):
    """Stories with the columns of their event of the same day."""
    m = cut(members(spark, d).withColumn("event_id", F.when(F.col("doc_id") % 10 != 0, F.col("event_id"))))
    about = {"title": F.concat(F.lit("about "), "event_id"), "official_source_url": F.lit("u"), "official_source_name": F.lit("n"), "article_ids": F.array("event_id")}
    e = evidence.enrich(m, evidence.event_confidence(m.filter("event_id is not null")).withColumns(about))
    names = [c for c in evidence.ON_ARTICLE if c not in ("event_confidence_explanation_ko",)]
    lists = [c for c in names if c.endswith("_sources") and not c.startswith("event_has") or c == "related_article_ids"]
    return e.select("doc_id", *(c for c in names if c not in lists), *JOINED(*lists))


def j3(spark, d):
    """Rows whose key another table names are deleted."""
    return store.delete_matching(table(spark, d, "documents"), table(spark, d, "labels").filter("quality = 0"), "doc_id").select("doc_id")


def f2(spark, d):
    """Look-back: rows within three days, both ends included."""
    e = table(spark, d, "events").withColumns({"published_at": F.when(F.col("event_id") % 7 != 0, F.col("ts")), "collected_at": F.col("ts")})
    return store.look_back(e, 3, F.to_timestamp(F.lit("2024-01-20 00:00:00"))).agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


def k2(spark, d):
    """Customers upserted by key into a keyed table: those divisible by 2 or 3 come anew, those not divisible by 3 are there."""
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    t = keyed.KeyedTable(spark, _folder(spark, "customers"), ["c_custkey"], buckets=8)
    t.upsert(c.filter("c_custkey % 3 != 0"))
    t.upsert(c.filter("c_custkey % 2 = 0 OR c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1))
    return t.read()


def k3(spark, d):
    """Bridge rows inserted into a keyed table unless there: the first stays."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    t = keyed.KeyedTable(spark, _folder(spark, "bridge"), ["l_orderkey", "l_suppkey"], buckets=8)
    t.insert_new(li.filter("l_linenumber = 1"), "l_linenumber")
    t.insert_new(li.filter("l_linenumber > 1"), "l_linenumber")
    return t.read().groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"))


def k1(spark, d):
    """An issue saved twice and read back: the second takes the place of the first."""
    root = _folder(spark, "issues")
    s = store.IssueStore(spark, root)
    m = cut(members(spark, d).withColumns({"position": F.col("doc_id"), "event_title": F.lit("")}).drop("secondary_categories"))
    ev = cut(evidence.event_confidence(m).withColumns({"title": F.concat(F.lit("t"), "event_id"), "official_source_url": F.lit("u"), "official_source_name": F.lit("n"), "article_ids": F.array(F.lit("x"))}))
    br = m.select("event_id", "article_id", F.lit("coverage").alias("relationship"), F.lit(0.85).alias("similarity"))
    fig = metrics.feed_counts(catalog.feeds(spark))
    for day, rows in (("2026-09-16", m), ("2026-09-17", m), ("2026-09-17", m.filter("doc_id % 2 = 0"))):
        s.save_issue(day, rows, ev, br.join(rows.select("article_id"), "article_id", "left_semi"), fig, at=ref_time())
    return s.issues().join(s.articles("2026-09-17").agg(F.count(F.lit(1)).alias("n_read"), F.count("event_verification_status").alias("n_enriched")))


def _folder(spark, name):
    from tidewire.operators.graph import scratch

    return scratch(spark, name)


#: Documents a feed shows at most: one feed is one thousand numbers of one source.
_IN_A_FEED = 1000


def s2(spark, d):
    """All feeds scanned in catalogue order. The feeds are written from the documents, one file each, and read back."""
    x = table(spark, d, "documents").select(F.concat_ws("_", "source", F.floor(F.col("doc_id") / _IN_A_FEED)).alias("id"), "doc_id", "text")
    shown = feeds.cap_per_feed(x, "id", "doc_id", 2 * rules.FEED_CAP)
    safe = F.col("text")
    for pattern, mark in ((r"[\x00-\x08\x0B-\x1F]", " "), ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.regexp_replace(safe, pattern, mark)
    item = F.concat(F.lit("<item><title>story "), "doc_id", F.lit("</title><link>https://example.com/"), "doc_id", F.lit("</link><description>"), F.coalesce(safe, F.lit("")), F.lit("</description></item>"))
    bodies = shown.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", item.alias("item")))), lambda i: i["item"]), "").alias("items"))
    out = _folder(spark, "feeds")
    bodies.select("id", F.concat(F.lit("<rss><channel>"), "items", F.lit("</channel></rss>")).alias("value")).write.partitionBy("id").text(out)
    found = spark.read.schema("value string, id string").text(out, wholetext=True).select(F.col("id").alias("feed_id"), F.col("value").alias("body"), F.lit(200).alias("http_status"), F.lit(None).cast("string").alias("error"))
    ranks = bodies.select("id").withColumn("rank", F.row_number().over(Window.orderBy("id")) - 1)
    rows = feeds.scan_responses(found, ranks)
    return rows.select("seq", "feed_id", "title", F.col("link").alias("url"), F.length("summary").alias("n_chars"))


def s10(spark, d):
    """The latest issue."""
    e = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("issue_date"))
    return store.latest_issue(e.distinct())


def p18(spark, d):
    """Article text of pages."""
    return table(spark, d, "pages").select("page_id", page_text("html").alias("text"))


def p19(spark, d):
    """The first usable text of an entry."""
    some = lambda *langs: F.when(F.col("lang").isin(*langs), F.col("text")).otherwise("")
    u = usable_text(some("en"), some("en", "fr"), some("fr", "de"), some("de", "es"), F.lit(" short "), F.lit("title"))
    x = table(spark, d, "documents").select("doc_id", u.alias("u"))
    return x.select("doc_id", F.length("u.text").alias("n"), F.col("u.source_type").alias("kind"), F.col("u.is_short_excerpt").alias("short"))


def _canned(method, url, seconds):
    """A network of eight hosts: one shows no rules, one forbids a part, one is down, one leads elsewhere."""
    host, path = url.split("/")[2], "/".join(url.split("/")[3:])
    number = path.rsplit("-", 1)[-1]
    if host == "h2.example":
        raise OSError("down")
    if path == "robots.txt":
        return (403, "", url) if host == "h0.example" else (200, "User-agent: *\nDisallow: /no", url) if host == "h1.example" else (404, "", url)
    if host == "news.google.com":
        return (200, "", f"https://target.example/{number}?utm_source=x") if int(number) % 2 else (404, "", url)
    body = f"<html><body><nav><p>A menu that is long enough to be a paragraph.</p></nav><article><p>Page {number} has one paragraph of some length.</p></article></body></html>"
    return (500, "", url) if number.endswith("0") else (200, body, url)


def _addresses(spark, d):
    n = F.col("doc_id")
    host = F.when(n % 8 == 7, "news.google.com").otherwise(F.concat(F.lit("h"), (n % 8).cast("string"), F.lit(".example")))
    part = F.when(n % 3 == 0, "no").otherwise("yes")
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("https://"), host, F.lit("/"), part, F.lit("/p-"), n.cast("string")).alias("url"))


def s8(spark, d):
    """Pages of allowed addresses."""
    return pages.fetch_pages(_addresses(spark, d), "doc_id", fetch=_canned).select("doc_id", "allowed", F.coalesce("status", F.lit(-1)).alias("status"), "text")


def s9(spark, d):
    """Addresses after redirects."""
    return pages.resolved_urls(_addresses(spark, d), "doc_id", fetch=_canned)


def a17(spark, d):
    """Feeds that answered."""
    named = catalog.feeds(spark).select(F.col("rank").alias("k"), F.col("id").alias("feed_id"))
    at = F.col("doc_id") % 50
    raw = table(spark, d, "documents").select(at.alias("k"), F.lit("t").alias("title"), F.when((F.col("doc_id") % 7 == 0) & (at % 2 == 0), "down").alias("error"), F.lit(200).alias("http_status"), F.lit(1.0).alias("response_time"), F.lit(None).cast("string").alias("parsing_error"))
    return feeds.health_ok(feeds.feed_health(raw.join(F.broadcast(named), "k"), catalog.feeds(spark)))


def p22(spark, d):
    """Summaries by a model, the template's where it fails."""
    from tidewire.operators.classify import with_model_summary, with_template_summary

    base = with_template_summary(normal(spark, d)).withColumn("text", F.col("excerpt"))
    return with_model_summary(base.select("doc_id", "title", "text", "summary_ko", "summary_en"), _toy_model).select("doc_id", "summary_en")


def _toy_model(title: str, text: str) -> tuple[str, str]:
    if "GPT" in title:
        raise RuntimeError("no answer")
    return "", title.upper()


def k6(spark, d):
    """The plain-text edition."""
    from tidewire.operators.mail import issue_text

    s = present.with_display(issue(spark, d)).withColumns({"article_id": F.col("doc_id").cast("string"), "position": F.col("doc_id")})
    s = cut(s)
    return issue_text(s.join(present.sections(s), "article_id"), "2026-09-17").select("total", "critical", "high", F.length("text").alias("n_chars"))


def stream_first(spark, d):
    """Streaming: first event of each user and type within the look-back, as files arrive."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(d + "/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("url", F.concat(F.lit("http://h/"), F.col("user_id").cast("string"), F.lit("/"), "event_type", F.lit("?utm_source="), F.col("event_id").cast("string")))
    return _drained(spark, incremental.first_by_url(events, "90 days", "ts").select("url_key", "user_id"), "append").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def stream_days(spark, d):
    """Streaming: events a day, once the day is closed."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(d + "/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    return _drained(spark, incremental.daily_counts(events, at="ts"), "append")


def stream_late(spark, d):
    """Streaming: events a day of a time zone where each file holds events of all days, so that most come late."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "ts")
    folder = _folder(spark, "late")
    e.repartition(4, F.xxhash64("event_id")).write.parquet(folder)
    flow = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    counts = incremental.DailyCounts(spark, _folder(spark, "counts"), "Europe/Berlin", "ts")
    counts.start(flow, _folder(spark, "checkpoint")).awaitTermination()
    return counts.counts()


def stream_exact(spark, d):
    """Streaming: the exact suppression on every batch, against what earlier batches kept."""
    rows = articles(spark, d).select("seq", "title", "url", "source", "publisher", F.coalesce("published_at", ref_time()).alias("published_at"))
    folder, state = _folder(spark, "entries"), _folder(spark, "state")
    rows.repartition(1).write.option("maxRecordsPerFile", 400).parquet(folder)
    flow = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = incremental.ExactDedupe(spark, state, days=30).start(flow, _folder(spark, "checkpoint"))
    query.awaitTermination()
    return spark.read.parquet(state).select("seq")


def _drained(spark, flow, mode):
    """Run a stream over what is there and read what it wrote."""
    out = _folder(spark, "stream")
    query = flow.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", _folder(spark, "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(flow.schema).parquet(out)


QUERIES = {
    "A1_publisher_levels": a1, "A2_publisher_strength": a2, "A3_event_evidence": a3, "A4_event_signals": a4, "A6_event_members": a6, "A8_event_confidence": a8, "A9_event_anchor": a9, "A10_feed_counts": a10,
    "A11_run_metrics": a11, "A12_facet_counts": facets, "P26_story_facets": p26, "A13_priority_counts": a13, "O5_top_prioritised": o5, "F3_featured": f3, "O6_sections": o6, "O3_primary_story": o3, "P23_display": p23,
    "P25_transparency": p25, "F4_dashboard_filter": f4, "F5_table_filter": f5, "O8_table_order": o8, "O9_page": o9, "A15_distinct_values": a15, "J1_issue_counts": j1, "A14_daily_counts": a14, "J2_enrichment": j2,
    "J3_delete_matching": j3, "F2_look_back": f2, "K1_save_issue": k1, "K2_upsert": k2, "K3_insert_ignore": k3, "K6_plain_edition": k6, "S2_feed_scan": s2, "S10_latest_issue": s10, "P18_page_text": p18, "S8_page_fetch": s8, "S9_redirects": s9, "A17_feeds_ok": a17,
    "P19_usable_text": p19, "P22_model_summary": p22, "stream_first_by_url": stream_first, "stream_daily_counts": stream_days, "stream_late_counts": stream_late, "stream_exact_dedupe": stream_exact,
}

_M = [*duck.normal(), ("m", f"SELECT *, 'e' || CAST(doc_id % 97 AS VARCHAR) AS event_id, (doc_id % 100)::DOUBLE AS p, {duck.publisher('publisher')} AS pk FROM n")]
_STRONG = ("st", "SELECT event_id, pk AS publisher_key, ['primary','independent','research','discovery','community','other'][min(CASE evidence_level WHEN 'primary' THEN 1 WHEN 'independent' THEN 2 WHEN 'research' THEN 3 WHEN 'discovery' THEN 4 WHEN 'community' THEN 5 ELSE 6 END)] AS strength FROM m WHERE pk <> '' GROUP BY 1, 2")
_of = lambda s: f"coalesce(list_sort(list(publisher_key) FILTER (strength = '{s}')), [])"
_n = lambda s: f"count(*) FILTER (strength = '{s}')"
_EV = [
    *_M, _STRONG,
    ("ev0", f"SELECT event_id, list_sort(list(publisher_key)) AS evidence_sources, {_of('primary')} AS primary_sources, {_of('independent')} AS independent_sources, {_n('primary')} AS n1, {_n('independent')} AS n2, {_n('research')} AS n3, {_n('discovery')} AS n4, {_n('community')} AS n5, {_n('other')} AS n6 FROM st GROUP BY 1"),
    ("ev", """SELECT *, (n1 + n2 + n3 + n6)::INT AS evidence_diversity, CASE WHEN n1 + n2 + n3 + n6 = 0 AND n4 > 0 AND n5 = 0 THEN 'discovery_only' WHEN n1 + n2 + n3 + n6 = 0 THEN 'insufficient_evidence'
  WHEN n2 >= 2 THEN 'multi_source' WHEN n1 >= 1 AND n2 >= 1 THEN 'independently_reported' WHEN n1 >= 1 THEN 'primary_only' WHEN n2 = 1 THEN 'independently_reported' WHEN n3 >= 1 THEN 'primary_only'
  WHEN n6 >= 2 THEN 'multi_source' WHEN n6 = 1 THEN 'independently_reported' ELSE 'insufficient_evidence' END AS verification_status FROM ev0"""),
    ("sg", """SELECT event_id, bool_or(is_official) AS has_official_source, bool_or(source_type = 'regulator') AS has_regulatory_source, bool_or(source_type IN ('media', 'korean_media')) AS has_major_media_source,
  bool_or(evidence_level = 'research' OR source_type = 'research') AS has_research, bool_or(doc_id % 6 = 0) AS has_content,
  coalesce(max(CASE WHEN is_primary_source OR source_type IN ('official', 'regulator') THEN source_authority END), 0) AS max_authority, max(p) AS importance, array_to_string(list_sort(list(DISTINCT trim(publisher))), ',') AS related_sources FROM m GROUP BY 1"""),
    ("cf0", f"SELECT ev.*, sg.* EXCLUDE (event_id), {duck.half_even('''greatest(0.0::DOUBLE, least(CASE WHEN verification_status = 'primary_only' AND NOT has_regulatory_source THEN 68.0 WHEN verification_status = 'discovery_only' THEN 35.0 WHEN verification_status = 'insufficient_evidence' THEN 20.0 ELSE 100.0 END, CASE verification_status WHEN 'multi_source' THEN 85.0 WHEN 'independently_reported' THEN 70.0 WHEN 'primary_only' THEN 58.0 WHEN 'discovery_only' THEN 22.0 ELSE 10.0 END + CASE WHEN has_regulatory_source THEN 12 ELSE 0 END + CASE WHEN has_research THEN 8 ELSE 0 END + least(18, greatest(0, len(independent_sources) - 1) * 6) + CASE WHEN max_authority >= 95 THEN 5 WHEN max_authority >= 90 THEN 4 ELSE 0 END + CASE WHEN has_content THEN 3 ELSE 0 END - CASE WHEN verification_status = 'discovery_only' THEN 8 ELSE 0 END - CASE WHEN evidence_diversity = 1 AND len(primary_sources) = 0 AND len(independent_sources) = 0 THEN 5 ELSE 0 END)::DOUBLE)''', 1)} AS confidence_score FROM ev JOIN sg USING (event_id)"),
    ("cf", "SELECT *, CASE WHEN confidence_score >= 70 THEN 'High' WHEN confidence_score >= 40 THEN 'Medium' ELSE 'Low' END AS confidence_label FROM cf0"),
]
_pretty = lambda c: f"array_to_string(list_transform({c}[:3], lambda p: array_to_string(list_transform(string_split(p, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')), ', ') || CASE WHEN len({c}) > 3 THEN ' (+' || (len({c}) - 3) || ' more)' ELSE '' END"
_EXPLAIN = f"""CASE verification_status WHEN 'discovery_only' THEN 'Only discovered through an aggregator' WHEN 'insufficient_evidence' THEN 'Insufficient evidence — community discussion or no known publisher'
  ELSE coalesce(nullif(array_to_string(list_filter([CASE WHEN has_regulatory_source THEN 'regulatory source' END, CASE WHEN len(primary_sources) > 0 THEN {_pretty('primary_sources')} || ' primary announcement' END,
  CASE WHEN has_research AND len(primary_sources) = 0 THEN 'research publication' END, CASE WHEN len(independent_sources) > 0 THEN 'independent ' || {_pretty('independent_sources')} || ' reporting' END], lambda x: x IS NOT NULL), ' + '), ''), 'Industry media coverage only') END"""
_facet = lambda text, lists: duck.names_where({k: duck.parts(text, rules.words(t)) for k, t in lists.items()})
_REG = "lower(title || ' ' || excerpt || ' ' || array_to_string(tags, ' '))"
_TOP = "lower(title || ' ' || excerpt || ' ' || array_to_string(topics, ' ') || ' ' || array_to_string(tags, ' '))"
_FACET = [*duck.normal(), ("fc0", f"SELECT *, {_facet(_REG, rules.REGION_TERMS)} AS r0, list_concat(['all'], {_facet(_TOP, rules.TOPIC_FILTERS)}) AS topic_keys FROM n"), ("fc", "SELECT *, CASE WHEN len(r0) > 0 THEN r0 ELSE ['global'] END AS regions FROM fc0")]
_WANTED = ", ".join(f"('{f}', '{k}')" for f, ks in present.FACETS.items() for k in ks)
_SCORED = duck.scored()
_PRIMARY = ("pr", "SELECT *, row_number() OVER (PARTITION BY doc_id % 97 ORDER BY (is_official)::INT DESC, coalesce(nullif(p, 0), p) DESC, source_authority DESC, doc_id) AS rk FROM m")
_FEATURED = ("ft", "SELECT s.* FROM s, (SELECT count(*) FILTER (priority_score >= 60) AS n0, count(*) FILTER (priority_score >= 45) AS n1, count(*) FILTER (priority_score >= 30) AS n2 FROM s) c WHERE priority_score >= CASE WHEN n0 >= 3 THEN 60 WHEN n1 >= 3 THEN 45 WHEN n2 > 0 THEN 30 ELSE -1 END")



def _sections(room: int = rules.SECTION_ROOM) -> list[tuple[str, str]]:
    """Sections one after another: each takes its best of what is left; the first ones by place that none took go to the
    first section."""
    steps, taken = [], "SELECT NULL::BIGINT AS doc_id"
    for i, (_, category) in enumerate(rules.SECTIONS):
        steps.append((f"g{i}", f"SELECT doc_id, priority_score AS w, row_number() OVER (ORDER BY priority_score DESC, doc_id) - 1 AS place FROM ft WHERE primary_category = {duck.q(category)} AND doc_id NOT IN (SELECT doc_id FROM ({taken}) WHERE doc_id IS NOT NULL) QUALIFY place < {room}"))
        taken += f" UNION ALL SELECT doc_id FROM g{i}"
    steps.append(("rest", f"SELECT doc_id, priority_score AS w FROM ft WHERE doc_id NOT IN (SELECT doc_id FROM ({taken}) WHERE doc_id IS NOT NULL) ORDER BY doc_id LIMIT {room}"))
    steps.append(("first", f"SELECT doc_id, row_number() OVER (ORDER BY w DESC, late, p) - 1 AS place FROM (SELECT doc_id, w, 0 AS late, place AS p FROM g0 UNION ALL SELECT doc_id, w, 1, doc_id FROM rest) QUALIFY place < {room}"))
    return steps


_SHOWN = " UNION ALL ".join(f"SELECT {duck.q(name)} AS section, {i} AS section_pos, place::INT AS place, doc_id::VARCHAR AS article_id FROM {'first' if i == 0 else f'g{i}'}" for i, (name, _) in enumerate(rules.SECTIONS))
_SEEN = [
    *_EV,
    ("tr0", """SELECT m.doc_id, trim(publisher) AS who, evidence_level AS lv, source_type AS kind, is_primary_source, is_discovery_source, string_split(cf.related_sources, ',') AS rel, verification_status AS given, confidence_label AS had,
  list_transform(list_concat(primary_sources, independent_sources), lambda x: lower(x)) AS named, coalesce(nullif(source_authority, 0), 70) >= 90 AS strong,
  is_official OR is_primary_source OR source_type = 'official' OR evidence_level = 'primary' AS official, is_independent_source OR evidence_level = 'independent' AS alone FROM m JOIN cf USING (event_id)"""),
    ("tr1", """SELECT *, lv = 'research' OR kind = 'research' AS paper, lv = 'industry_media' OR kind IN ('media', 'korean_media') AS press FROM tr0"""),
    ("tr2", """SELECT *, CASE WHEN given NOT IN ('', 'insufficient_evidence') THEN given WHEN len(rel) > 1 THEN 'multi_source' WHEN official THEN 'primary_only' WHEN alone THEN 'independently_reported' WHEN paper THEN 'primary_only' WHEN press THEN 'independently_reported'
  WHEN lv = 'discovery' OR is_discovery_source THEN 'discovery_only' ELSE 'insufficient_evidence' END AS status FROM tr1"""),
]
_BADGE = duck.case([(f"lv = {duck.q(k)}", duck.q(v[1])) for k, v in present.BADGES.items()], duck.q(present.BADGES["industry_media"][1]))
_LEVEL_SAID = duck.case([(f"lv = {duck.q(k)}", duck.q(v[1])) for k, v in present.LEVEL_SAID.items()], "'Aggregator / Discovery'")

ORACLES = {
    "O6_sections": duck.with_articles(_SHOWN, *_SCORED, _FEATURED, *_sections()),
    "P25_transparency": duck.with_articles(f"""SELECT doc_id, {_BADGE} AS badge_en, status, CASE WHEN status = 'multi_source' THEN 'Multi-source independent reporting' WHEN status = 'independently_reported' THEN 'Primary + independent reporting'
  WHEN status = 'primary_only' AND paper AND NOT (is_primary_source OR kind = 'official') THEN 'Research publication' WHEN status = 'primary_only' THEN 'Primary announcement' WHEN status = 'discovery_only' THEN 'Aggregator discovery' ELSE {_LEVEL_SAID} END AS evidence_label_en,
  CASE WHEN had <> '' AND NOT (had = 'Low' AND status IN ('multi_source', 'independently_reported', 'primary_only')) THEN had WHEN status = 'multi_source' OR official AND alone THEN 'High' WHEN official OR alone OR paper THEN CASE WHEN strong THEN 'High' ELSE 'Medium' END WHEN press THEN 'Medium' ELSE 'Low' END AS confidence_label,
  array_to_string(rel[:4], ' · ') || CASE WHEN len(rel) > 4 THEN ' (+' || (len(rel) - 4) || ')' ELSE '' END AS sources_display, len(list_filter(rel, lambda x: NOT list_contains(named, lower(x)))) AS n_other FROM tr2""", *_SEEN),
    "A1_publisher_levels": duck.with_articles("SELECT event_id, pk AS publisher_key, array_to_string(list_sort(list(DISTINCT evidence_level)), ',') AS levels FROM m GROUP BY 1, 2", *_M),
    "A2_publisher_strength": duck.with_articles("SELECT * FROM st", *_M, _STRONG),
    "A3_event_evidence": duck.with_articles("SELECT event_id, array_to_string(evidence_sources, ',') AS evidence_sources, array_to_string(primary_sources, ',') AS primary_sources, array_to_string(independent_sources, ',') AS independent_sources, evidence_diversity, verification_status FROM ev", *_EV),
    "A4_event_signals": duck.with_articles("SELECT * FROM sg", *_EV),
    "A8_event_confidence": duck.with_articles(f"SELECT event_id, confidence_score, confidence_label, {_EXPLAIN} AS confidence_explanation_en, len(evidence_sources) AS source_count, len(independent_sources) AS independent_source_count FROM cf", *_EV),
    "A6_event_members": duck.with_articles("SELECT doc_id % 97 AS event_pos, arg_min(publisher, doc_id) FILTER (is_official) AS official_source_name, count(*)::INT AS n_members FROM m GROUP BY 1", *_M),
    "O3_primary_story": duck.with_articles("SELECT x.doc_id, 'ev_' || sha256(h.url)[:16] AS event_id, CASE WHEN x.url = h.url THEN 'primary' ELSE 'coverage' END AS relationship, CASE WHEN x.url = h.url THEN 1.0::DOUBLE ELSE 0.85::DOUBLE END AS similarity FROM pr x JOIN pr h ON h.rk = 1 AND h.doc_id % 97 = x.doc_id % 97", *_M, _PRIMARY),
    "A9_event_anchor": duck.with_articles("SELECT pos % 97 AS event, " + ", ".join(f"array_to_string(list_sort(list_distinct(flatten(list({c})))), ',') AS {n}" for c, n in (("entities", "entities"), ("models", "models"), ("themes", "themes"), ("acts", "effective"))) + " FROM g GROUP BY 1", *_FEATURES),
    "A10_feed_counts": "SELECT {t} AS feeds_total, {primary} AS primary_feeds, {research} AS research_feeds, {independent} AS independent_media_feeds, {community} AS community_feeds, {discovery} AS discovery_feeds, {industry_media} AS industry_media_feeds".format(t=len(rules.FEEDS), **{lv: sum(f[10] == lv for f in rules.FEEDS) for lv in rules.EVIDENCE_LEVELS}),
    "A11_run_metrics": duck.with_articles(f"""SELECT count(*) AS articles_selected, {duck.half_even("100.0::DOUBLE * count(*) FILTER (is_independent_source OR evidence_level = 'independent' OR len(independent_sources) > 0) / count(*)", 1)} AS percentage_with_independent_reporting,
  {duck.half_even("100.0::DOUBLE * count(*) FILTER (is_discovery_source OR evidence_level = 'discovery') / count(*)", 1)} AS percentage_discovery_only, (SELECT count(*) FROM ev) AS events_created,
  (SELECT count(*) FROM ev WHERE verification_status IN ('independently_reported', 'multi_source') OR len(independent_sources) > 0) AS events_with_independent_confirmation, (SELECT {duck.half_even('avg(evidence_diversity)', 2)} FROM ev) AS average_evidence_diversity,
  (SELECT {duck.half_even("100.0::DOUBLE * count(*) FILTER (is_primary_source OR evidence_level = 'primary') / count(*)", 1)} FROM (SELECT * FROM m ORDER BY p DESC, doc_id LIMIT 5)) AS percentage_top_stories_primary FROM m JOIN ev USING (event_id)""", *_EV),
    "A12_facet_counts": duck.with_articles(f"SELECT w.facet, w.key, count(x.key) AS n FROM (VALUES {_WANTED}) w(facet, key) LEFT JOIN (SELECT 'region' AS facet, unnest(list_concat(['all'], regions)) AS key FROM fc UNION ALL SELECT 'topic', unnest(topic_keys) FROM fc UNION ALL SELECT 'source_type', unnest(['all', evidence_level]) FROM fc) x USING (facet, key) GROUP BY 1, 2", *_FACET),
    "P26_story_facets": duck.with_articles("SELECT doc_id, array_to_string(regions, ',') AS regions, array_to_string(topic_keys, ',') AS topics, evidence_level AS kind FROM fc", *_FACET),
    "A13_priority_counts": duck.with_articles(f"SELECT count(*) AS total, {', '.join(f'''count(*) FILTER (lv = '{p[0]}') AS {p[0]}''' for p in rules.PRIORITY_LEVELS)} FROM (SELECT {duck.level()} AS lv FROM s)", *_SCORED),
    "O5_top_prioritised": duck.with_articles(f"SELECT doc_id, lv AS level, r AS rounded FROM (SELECT *, {duck.level()} AS lv, {duck.half_even('priority_score', 0)}::INT AS r FROM s) ORDER BY CASE lv WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, r DESC, priority_score DESC, doc_id LIMIT 5", *_SCORED),
    "F3_featured": duck.with_articles("SELECT doc_id FROM ft", *_SCORED, _FEATURED),
    "F4_dashboard_filter": duck.with_articles(f"SELECT doc_id, {duck.level()} AS level FROM s JOIN (SELECT doc_id, regions, topic_keys FROM fc) USING (doc_id) WHERE list_contains(regions, 'us') AND list_contains(topic_keys, 'frontier_models') AND evidence_level = 'industry_media'", *_SCORED, *_FACET[-2:]),
    "F5_table_filter": duck.with_articles("SELECT doc_id FROM s WHERE source_type = 'media' AND contains(lower(title || ' ' || source || ' ' || primary_category), 'openai')", *_SCORED),
    "O8_table_order": duck.with_articles("SELECT doc_id, source, row_number() OVER (ORDER BY source DESC, doc_id) - 1 AS place FROM s", *_SCORED),
    "O9_page": duck.with_articles("SELECT doc_id, priority_score FROM s ORDER BY priority_score DESC, doc_id LIMIT 20 OFFSET 40", *_SCORED),
    "A15_distinct_values": duck.with_articles("SELECT DISTINCT 'primary_category' AS kind, primary_category AS value FROM n UNION SELECT DISTINCT 'source', source FROM n", *duck.normal()),
    "J1_issue_counts": "SELECT d AS issue_date, count(*) FILTER (event_type = 'signup') AS n_articles FROM (SELECT strftime(ts, '%Y-%m-%d') AS d, event_type FROM events) GROUP BY 1",
    "A14_daily_counts": "SELECT strftime(timezone('Europe/Berlin', timezone('UTC', ts::TIMESTAMP)), '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1",
    "J2_enrichment": duck.with_articles(f"""SELECT m.doc_id, 'about ' || ec.event_id AS event_title, len(ec.evidence_sources) AS event_source_count, len(ec.independent_sources) AS event_independent_source_count, ec.has_official_source AS event_has_official_source,
  ec.has_regulatory_source AS event_has_regulatory_source, ec.has_major_media_source AS event_has_major_media_source, CASE WHEN ec.event_id IS NOT NULL THEN 'u' END AS event_official_source_url, CASE WHEN ec.event_id IS NOT NULL THEN 'n' END AS event_official_source_name,
  ec.evidence_diversity AS event_evidence_diversity, ec.verification_status AS event_verification_status, ec.confidence_score AS event_confidence_score, ec.confidence_label AS event_confidence_label, ec.explained AS event_confidence_explanation_en,
  ec.related_sources AS event_related_sources, array_to_string(ec.evidence_sources, ',') AS event_evidence_sources, array_to_string(ec.primary_sources, ',') AS event_primary_sources, array_to_string(ec.independent_sources, ',') AS event_independent_sources, ec.event_id AS related_article_ids
  FROM m LEFT JOIN ec USING (event_id)""", *[(n, s.replace("(doc_id % 97 AS VARCHAR) AS event_id", "(doc_id % 97 AS VARCHAR) AS event_key, CASE WHEN doc_id % 10 <> 0 THEN 'e' || CAST(doc_id % 97 AS VARCHAR) END AS event_id") if n == "m" else s) for n, s in _EV], ("ec", f"SELECT *, {_EXPLAIN} AS explained FROM cf WHERE event_id IS NOT NULL")),
    "J3_delete_matching": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)",
    "F2_look_back": "SELECT count(*) AS n, sum(event_id)::BIGINT AS ids FROM events WHERE ts >= TIMESTAMP '2024-01-17 00:00:00'",
    "S2_feed_scan": rf"""
        WITH x AS (SELECT concat_ws('_', source, CAST(floor(doc_id / {_IN_A_FEED}) AS BIGINT)) AS id, doc_id, text FROM documents),
             r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY doc_id) - 1 AS pos, dense_rank() OVER (ORDER BY id) - 1 AS rank FROM x)
        SELECT rank * 1000000 + pos AS seq, id AS feed_id, 'story ' || doc_id AS title, 'https://example.com/' || doc_id AS url, nullif(length(text), 0) AS n_chars
        FROM r WHERE pos < {rules.FEED_CAP}""",
    "K2_upsert": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 OR c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer",
    "K3_insert_ignore": "SELECT l_linenumber, count(*) AS n FROM (SELECT DISTINCT ON (l_orderkey, l_suppkey) * FROM (SELECT l_orderkey, l_suppkey, l_linenumber FROM lineitem) ORDER BY l_orderkey, l_suppkey, l_linenumber) GROUP BY 1",
    "K1_save_issue": "SELECT d AS issue_date, CASE WHEN d = '2026-09-17' THEN n2 ELSE n END AS n_articles, n2 AS n_read, n2 AS n_enriched FROM (VALUES ('2026-09-16'), ('2026-09-17')) v(d), (SELECT count(*) AS n, count(*) FILTER (doc_id % 2 = 0) AS n2 FROM documents)",
    "S10_latest_issue": "SELECT max(strftime(ts, '%Y-%m-%d')) AS issue_date FROM events",
    "P18_page_text": f"""WITH x AS (SELECT page_id, list_transform(string_split_regex(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<p>|</p>'), lambda p: regexp_replace(p, '<h1>.*</h1>', ''))[2:] AS ps FROM pages),
  y AS (SELECT page_id, list_transform(ps, lambda p: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(p, '<[^>]*>', ' ', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '[ \\t]+', ' ', 'g'))) AS ps FROM x),
  z AS (SELECT page_id, array_to_string(list_filter(ps, lambda p: length(p) > 25 AND NOT regexp_matches(lower(p), '{"|".join(BOILERPLATE)}')), chr(10) || chr(10)) AS t FROM y)
  SELECT page_id, CASE WHEN length(t) > {MOST_CHARS} THEN regexp_replace(left(t, {MOST_CHARS}), ' [^ ]*$', '') || '…' ELSE t END AS text FROM z""",
    "S8_page_fetch": """SELECT doc_id, h NOT IN (0, 7) AND NOT (h = 1 AND no) AS allowed, CASE WHEN h IN (0, 2, 7) OR h = 1 AND no THEN -1 WHEN doc_id % 10 = 0 THEN 500 ELSE 200 END AS status,
  CASE WHEN h IN (0, 2, 7) OR h = 1 AND no OR doc_id % 10 = 0 THEN '' ELSE 'Page ' || doc_id || ' has one paragraph of some length.' END AS text FROM (SELECT doc_id, doc_id % 8 AS h, doc_id % 3 = 0 AS no FROM documents)""",
    "S9_redirects": "SELECT doc_id, CASE WHEN doc_id % 8 = 7 AND doc_id % 2 = 1 THEN 'https://target.example/' || doc_id ELSE 'https://' || CASE WHEN doc_id % 8 = 7 THEN 'news.google.com' ELSE 'h' || (doc_id % 8) || '.example' END || CASE WHEN doc_id % 3 = 0 THEN '/no' ELSE '/yes' END || '/p-' || doc_id END AS url FROM documents",
    "A17_feeds_ok": f"SELECT {len(rules.FEEDS)} - count(DISTINCT doc_id % 50) AS feeds_ok, {len(rules.FEEDS)} AS feeds_total FROM documents WHERE doc_id % 7 = 0 AND doc_id % 50 % 2 = 0 AND doc_id % 50 < {len(rules.FEEDS)}",
    "P23_display": duck.with_articles("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN coalesce(nullif(excerpt, ''), title) WHEN hangul THEN title || '. Updates in the ' || en || ' sector reported by ' || publisher || '.' WHEN trim(excerpt) <> '' THEN trim(excerpt) ELSE title || '. Strategic updates in the ' || en || ' ecosystem.' END AS display_summary_en,
  en AS category_label_en, coalesce(strftime(make_timestamp(published_s * 1000000), '%Y-%m-%d %H:%M'), '') AS published_time, CASE WHEN len(topics) > 0 THEN array_to_string(topics[:3], ', ') ELSE ko || ' (' || en || ')' END AS topics_display, publisher AS publisher_display,
  CASE WHEN len(entities) > 0 THEN '주요 기업/모델 (Entities): ' || array_to_string(entities[:4], ', ') ELSE '' END AS points FROM t""", *_TEMPLATE),
    "stream_late_counts": "SELECT strftime(timezone('Europe/Berlin', timezone('UTC', ts::TIMESTAMP)), '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1",
    "stream_daily_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1 HAVING date_trunc('day', min(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)",
    "P19_usable_text": """SELECT doc_id, length(x) AS n, kind, length(x) < 250 AS short FROM (SELECT doc_id, CASE WHEN any_text AND (lang <> 'es' OR long_text) THEN text ELSE 'short' END AS x,
  CASE WHEN any_text AND lang IN ('en', 'fr') THEN 'rss_content' WHEN any_text AND lang = 'de' THEN 'rss_summary' WHEN long_text AND lang = 'es' THEN 'page_extraction' ELSE 'fallback' END AS kind
  FROM (SELECT doc_id, text, lang, length(trim(coalesce(text, ''))) > 0 AS any_text, length(trim(coalesce(text, ''))) >= 50 AS long_text FROM documents))""",
    "P22_model_summary": duck.with_articles("SELECT doc_id, CASE WHEN NOT contains(title, 'GPT') THEN upper(title) WHEN trim(excerpt) <> '' THEN trim(excerpt) ELSE title || '. Strategic updates in the ' || en || ' ecosystem.' END AS summary_en FROM t", *duck.classified(), ("t", "SELECT *, " + duck.case([(f"primary_category = {duck.q(k)}", duck.q(v[1])) for k, v in rules.CATEGORIES.items()], "''") + " AS en FROM c")),
    "stream_first_by_url": "SELECT user_id, count(DISTINCT event_type) AS n FROM events GROUP BY 1",
}

__all__ = ["ORACLES", "QUERIES"]
