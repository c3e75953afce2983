"""Scenarios of the reference's behaviour: addresses, titles, publishers, scores, evidence, events, storage, control."""

from __future__ import annotations

from datetime import UTC, date, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from tidewire import pipeline, rules
from tidewire.functions import entities, sources
from tidewire.functions import text as tx
from tidewire.operators import control, dedupe, evidence, present, score, store
from tidewire.sources import catalog, feeds
from tidewire.sources.page_text import article_text

REF = "2026-09-17 12:00:00"


def one(spark, expr, **cols):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in cols.items()))
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "url, want",
    [
        ("https://TechCrunch.com/2026/09/15//openai-gpt4o/?utm_source=x&ref=feed#top", "https://techcrunch.com/2026/09/15/openai-gpt4o"),
        ("http://h.io/a?b=1&UTM_Source=x&c", "http://h.io/a?b=1&c="), ("http://h.io/", "http://h.io/"), ("", ""), ("no scheme/x/", "no scheme/x"),
    ],
)
def test_canonical_url(spark, url, want):
    assert one(spark, tx.canonical_url("u"), u=url) == want


def test_titles_and_publishers(spark):
    assert one(spark, tx.clean_title("t"), t="[속보] OpenAI (beta) ships GPT-5! - Reuters") == "openai ships gpt 5"
    for name in ("Reuters News", "REUTERS", "reuters.com", " Reuters "):
        assert one(spark, tx.normal_publisher("p"), p=name) == "reuters"
    assert one(spark, tx.normal_publisher("p"), p="Reuters Technology AI") == "reuters technology"
    assert one(spark, tx.models_in("t"), t="Claude 3.5 Sonnet, GPT-4o and llama 3.3") == ["claude3.5sonnet", "gpt4o", "llama3"]
    assert one(spark, tx.entities_in("t"), t="Sam Altman meets 엔비디아에서 at MIT") == ["MIT CSAIL", "NVIDIA", "OpenAI"]


def test_sources_and_entities(spark):
    assert one(spark, entities.canonical_name("n"), n=" HBM3E ") == "Samsung Electronics"
    assert one(spark, sources.evidence_level("n"), n="Reuters") == "independent" and one(spark, sources.evidence_level("n"), n="Unknown Gazette") == "industry_media"
    assert one(spark, sources.authority("n"), n="MIT Technology Review AI") == 90
    table = catalog.feeds(spark)
    assert table.count() == 39 and {r["evidence_level"] for r in table.collect()} == set(rules.EVIDENCE_LEVELS)
    assert catalog.search_url("a b*") == "https://news.google.com/rss/search?q=a+b%2A&hl=en-US&gl=US&ceid=US:en"


RSS = b"""<rss xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel>
<item><title>OpenAI ships &amp;amp; tells - Reuters</title><link>https://x.com/a?utm_source=f</link><pubDate>Tue, 15 Sep 2026 10:00:00 GMT</pubDate><description>&lt;p&gt;Hello  &lt;b&gt;there&lt;/b&gt;&lt;/p&gt;</description></item>
<item><title></title><link>https://x.com/b</link></item></channel></rss>"""


def test_feeds_never_raise(spark):
    bad = lambda u: (_ for _ in ()).throw(OSError("down"))
    rows = feeds.read_feed("gnews_global_ai", "u", lambda u: (200, RSS)) + feeds.read_feed("openai_news", "u", bad) + feeds.read_feed("wired_ai", "u", lambda u: (200, b"<rss>")) + feeds.read_feed("arxiv_ai", "u", lambda u: (200, b"<rss/>"))
    raw = spark.createDataFrame(rows, feeds.RAW)
    entries = feeds.parse_entries(raw, catalog.feeds(spark)).collect()
    assert [(e["title"], e["publisher"], e["evidence_level"], e["authority_score"], e["excerpt"], e["canonical_url"]) for e in entries] == [("OpenAI ships & tells - Reuters", "Reuters", "independent", 95, "Hello there", "https://x.com/a")]
    assert entries[0]["published_at"] == datetime(2026, 9, 15, 10)
    state = {r["id"]: r["health_state"] for r in feeds.feed_health(raw, catalog.feeds(spark)).collect()}
    assert (state["openai_news"], state["wired_ai"], state["arxiv_ai"], state["gnews_global_ai"]) == ("failing", "failing", "degraded", "healthy")
    assert feeds.warnings(raw, catalog.feeds(spark)).count() == 2


def test_feed_source_reads_a_partition_each(spark, tmp_path):
    (tmp_path / "openai_news.xml").write_bytes(RSS)
    got = feeds.read_feeds(spark, ids="openai_news,wired_ai", folder=str(tmp_path)).collect()
    assert {(r["feed_id"], r["title"] is not None, r["error"] is not None) for r in got} >= {("openai_news", True, False), ("wired_ai", False, True)}


def entry(seq, title, publisher, url, hours=1, kind="media", bucket="frontier_models"):
    return (seq, title, f"{title}.", publisher, publisher, kind, bucket, url, datetime(2026, 9, 17, 12) - timedelta(hours=hours))


ENTRY = "seq long, title string, excerpt string, publisher string, source string, source_type string, bucket string, url string, published_at timestamp"


def plain_suppression(rows):
    """By definition: a row goes if it repeats an earlier row that stays."""
    kept = []
    for seq, url, pub, title, numbers, tokens in rows:
        def like(o, pub=pub, title=title, numbers=numbers, tokens=tokens):
            if o[2] != pub or not tokens or not set(tokens) & set(o[5]):
                return False
            a, b = set(tokens), set(o[5])
            c, lo, hi = len(a & b), min(len(a), len(b)), max(len(a), len(b))
            return title == o[3] or numbers == o[4] and (c >= 4 and (c / hi >= 0.65 or c / lo >= 0.8) or c >= 3 and lo >= 4 and c / len(a | b) >= 0.75)

        if not any(o[1] == url or (o[2], o[3]) == (pub, title) or like(o) for o in kept):
            kept.append((seq, url, pub, title, numbers, tokens))
    return {k[0] for k in kept}


def test_suppression_matches_the_definition(spark):
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    rows = [entry(i, " ".join(words[(i * k) % 6] for k in (1, 2, 3, 5)) + f" {words[i % 6]} launch", f"P{i % 3}", f"http://h/{i % 17}?utm_source={i}") for i in range(60)]
    df = spark.createDataFrame(rows, ENTRY)
    keys = [tuple(r[c] for c in ("seq", "url_key", "publisher_key", "title_key", "numbers", "tokens")) for r in dedupe.dedupe_keys(df).orderBy("seq").collect()]
    got = {r["seq"] for r in dedupe.suppressed(df).filter("kept").collect()}
    assert got == plain_suppression(keys) and 3 < len(got) < 60


def test_three_publishers_make_one_event(spark):
    rows = [
        entry(1, "OpenAI launches GPT-5 model with reasoning", "OpenAI", "https://openai.com/a", 3, "official"), entry(2, "OpenAI launches GPT-5 model with reasoning", "Reuters", "https://reuters.com/a", 2),
        entry(3, "OpenAI launches GPT-5 model with reasoning", "Reuters Technology", "https://reuters.com/a?ref=rss", 2), entry(4, "OpenAI launches GPT-5 model with reasoning", "TechCrunch", "https://techcrunch.com/a", 1),
        entry(5, "Anthropic releases Claude 3.5 Sonnet for coding", "Anthropic", "https://anthropic.com/a", 1, "official"),
    ]
    df = spark.createDataFrame(rows, ENTRY).withColumn("evidence_level", sources.evidence_level("publisher"))
    run = pipeline.collect(df, F.to_timestamp(F.lit(REF)))
    ev = {r["official_source_name"]: r for r in run.events.collect()}
    assert (run.collected, run.kept, len(ev)) == (5, 4, 2)
    assert (ev["OpenAI"]["source_count"], ev["OpenAI"]["independent_source_count"], ev["OpenAI"]["verification_status"]) == (3, 1, "independently_reported")
    assert ev["OpenAI"]["primary_article_id"] == ev["OpenAI"]["article_ids"][0] and run.bridge.count() == 4
    backwards = pipeline.collect(df.withColumn("seq", 100 - F.col("seq")).filter("seq != 97"), F.to_timestamp(F.lit(REF)))
    assert {r["event_id"] for r in backwards.events.collect()} == {r["event_id"] for r in run.events.collect()}


def test_levels_and_confidence(spark):
    for s, want in ((88.0, "critical"), (68.0, "high"), (50.0, "medium"), (35.0, "watch")):
        assert one(spark, score.priority_level("s"), s=s) == want
    kinds = {"primary": ("OpenAI", "official", "primary", "Medium"), "both": ("", "", "", "High"), "community": ("HN", "community", "community", "Low"), "found": ("Google News", "aggregator", "discovery", "Low")}
    rows = [(k, p, p, t, lv, t == "official", 95, 95, 1.0, "") for k, (p, t, lv, _) in kinds.items() if p]
    rows += [("both", "OpenAI", "OpenAI", "official", "primary", True, 95, 95, 1.0, ""), ("both", "Reuters", "Reuters", "media", "independent", False, 95, 95, 1.0, "")]
    m = spark.createDataFrame(rows, "event_id string, publisher string, source string, source_type string, evidence_level string, is_primary_source boolean, authority_score int, source_authority int, priority_score double, content string").withColumn("is_official", F.col("source_type") == "official")
    got = {r["event_id"]: r["confidence_label"] for r in evidence.event_confidence(m).collect()}
    assert got == {k: v[3] for k, v in kinds.items()}


def test_look_back_is_inclusive(spark):
    at = datetime(2026, 9, 17, 12, tzinfo=UTC)
    rows = [(i, at - timedelta(days=3, seconds=s), at) for i, s in ((1, 0), (2, 1), (3, -1))] + [(4, None, at)]
    df = spark.createDataFrame(rows, "id int, published_at timestamp, collected_at timestamp")
    assert {r["id"] for r in store.look_back(df, 3, F.to_timestamp(F.lit(REF))).collect()} == {1, 3, 4}
    assert store.look_back(df, 0, F.to_timestamp(F.lit(REF))).count() == 0 and store.look_back(df, "x", F.to_timestamp(F.lit(REF))).count() == 0


def test_a_day_is_stored_and_replaced(spark, tmp_path):
    s = store.IssueStore(spark, f"file://{tmp_path}/issues")
    rows = [entry(i, t, "OpenAI", f"https://openai.com/{i}", i, "official") for i, t in enumerate(["OpenAI launches GPT-5 model", "Quarterly results of a bakery"])]
    df = spark.createDataFrame(rows, ENTRY)
    for _ in range(2):
        pipeline.run_day(spark, s, df, catalog.feeds(spark), date(2026, 9, 17), F.to_timestamp(F.lit(REF)), ["x: y"], exclude_same_day=True)
    assert [tuple(r) for r in s.issues().select("n_articles").collect()] == [(2,)] and s.health()["ok"] and s.latest_day() == "2026-09-17"
    shown = s.articles("2026-09-17")
    assert shown.filter("event_verification_status is not null").count() == 2 and shown.first()["position"] == 0
    s.mark_sent("2026-09-17", F.to_timestamp(F.lit(REF)))
    assert s.table("issues").first()["sent_at"] is not None


def test_facets_keep_zeros(spark):
    cols = "title string, excerpt string, publisher string, source string, source_type string, evidence_level string, tags array<string>, topics array<string>, is_primary_source boolean, is_independent_source boolean, is_discovery_source boolean"
    rows = [(lv, "", lv, lv, "media", lv, [], [], False, False, False) for lv in rules.EVIDENCE_LEVELS]
    got = {(r["facet"], r["key"]): r["n"] for r in present.facet_counts(spark.createDataFrame(rows, cols)).collect()}
    assert all(got["source_type", lv] == 1 for lv in rules.EVIDENCE_LEVELS) and got["source_type", "all"] == 6 and got["region", "korea"] == 0


def test_page_text():
    page = "<html><body><nav><p>Navigation that is long enough to be kept</p></nav><article><p>A first paragraph with enough characters.</p><p>Short.</p><p>All rights reserved by the publisher of this.</p><p>Another paragraph, &amp; also long enough.</p></article></body></html>"
    assert article_text(page) == "A first paragraph with enough characters.\n\nAnother paragraph, & also long enough." and article_text(None) == ""
    assert article_text(f"<p>{'word ' * 3000}</p>").endswith("word…") and len(article_text(f"<p>{'word ' * 3000}</p>")) <= 6001


def test_control():
    lock, now = control.RunLock(), datetime(2026, 9, 17, 6, tzinfo=UTC)
    assert lock.acquire("d", now) and not lock.acquire("d", now + timedelta(minutes=29)) and lock.acquire("d", now + timedelta(minutes=31))
    lock.fail("d", now, "x")
    assert lock.acquire("d", now)
    lock.finish("d", now)
    assert not lock.acquire("d", now + timedelta(days=1)) and lock.completed("d")
    early, late = now.replace(hour=5), now.replace(hour=8)
    assert control.should_run(early, "06:00", control.RunLock())[2] == "before_scheduled_time" and control.should_run(late, "06:00", control.RunLock())[0]
    assert control.should_run(late, "06:00", control.RunLock(issues={"2026-09-17"}))[2] == "already_completed" and control.should_run(early, "06:00", lock, force=True)[2] == "forced"
    with pytest.raises(ValueError, match="time of day"):
        control.clock("25:00")
    mail = control.MailSettings(host="h", password="p").overridden({"to": "a@b; c@d,a@b", "port": "25", "host": ""})
    assert mail.to == ("a@b", "c@d") and mail.host == "h" and mail.port == 25 and mail.missing() == ["sender"] and mail.redacted()["password"] == "********"
