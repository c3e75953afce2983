"""Scenarios: guards between companies and models, events of several publishers, look-back edges, levels, growth."""

from __future__ import annotations

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from tidewire.operators import cluster, mail, present, score, similarity, store
from tidewire.operators.graph import cut
from tidewire.plans import story_queries

from tests.test_events import SMALL, STORY, events_of, story


def alike(spark, a, b):
    """The similarity of two titles, with tags."""
    rows = [story(k, title, f"P{k}", f"https://h{k}.com/x", tags) for k, (title, tags) in enumerate((a, b))]
    f = cut(similarity.with_features(spark.createDataFrame(rows, STORY)))
    one, two = (f.filter(F.col("seq") == k).select(*(F.col(c).alias(f"{p}{c}") for c in f.columns)) for k, p in ((0, "a_"), (1, "b_")))
    return one.crossJoin(two).select(similarity.pair_similarity().alias("s")).first()["s"]


@pytest.mark.parametrize(
    "a, b",
    [
        (("OpenAI rolls out a ChatGPT voice for phones", ["OpenAI"]), ("Anthropic ships an update of Claude 3.5 Haiku", ["Anthropic"])),
        (("OpenAI presents GPT-4o for pictures and sound", []), ("OpenAI presents o1 for long chains of thought", [])),
        (("NVIDIA opens an office in Seoul", []), ("NVIDIA Blackwell benchmark results", [])),
    ],
)
def test_other_companies_models_and_moves_are_no_one_event(spark, a, b):
    assert alike(spark, a, b) == 0.0 == alike(spark, b, a)


def test_one_story_of_two_outlets_is_one_event(spark):
    a, b = ("OpenAI introduces ChatGPT Search, a rival of Google", ["OpenAI"]), ("OpenAI launches ChatGPT Search for all users", ["OpenAI"])
    assert alike(spark, a, b) >= 0.60 and alike(spark, a, b) == alike(spark, b, a)


def test_a_joint_initiative_holds_stories_of_different_models(spark):
    rows = [
        story(1, "OpenAI and Anthropic agree on a joint AI safety evaluation with US AISI", "OpenAI", "https://o.com/s", ["OpenAI", "Anthropic", "US NIST AISI"], priority=90.0),
        story(2, "OpenAI lets US AISI test GPT-4o in a joint safety evaluation", "TechCrunch", "https://t.com/s", ["OpenAI", "US NIST AISI"], priority=80.0),
        story(3, "Anthropic lets US AISI test Claude 3.5 in a joint safety evaluation", "Reuters", "https://r.com/s", ["Anthropic", "US NIST AISI"], priority=70.0),
    ]
    assert events_of(spark, rows) == {frozenset({1, 2, 3})}


def test_three_labs_are_three_events(spark):
    rows = [story(k, t, p, f"https://{p}.com/x") for k, (t, p) in enumerate((("OpenAI launches the GPT-5 model", "a"), ("Google DeepMind launches the Gemini 2.0 model", "b"), ("Anthropic launches the Claude 3.5 model", "c")))]
    assert events_of(spark, rows) == {frozenset({k}) for k in range(3)}


@pytest.mark.parametrize("value, level", [(88, "critical"), (68, "high"), (50, "medium"), (35, "watch")])
def test_priority_levels(spark, value, level):
    assert spark.range(1).select(score.priority_level(F.lit(float(value))).alias("x")).first()["x"] == level


def test_look_back_includes_its_edge(spark):
    now = datetime(2026, 9, 17, 12)
    at = [now - timedelta(days=3), now - timedelta(days=3, seconds=1), now - timedelta(days=2, hours=23, minutes=59, seconds=59), None, None]
    rows = spark.createDataFrame([(k, x, now if k == 3 else now - timedelta(days=9)) for k, x in enumerate(at)], "n int, published_at timestamp, collected_at timestamp")
    ref = F.to_timestamp(F.lit("2026-09-17 12:00:00"))
    assert sorted(r["n"] for r in store.look_back(rows, 3, ref).collect()) == [0, 2, 3]
    assert all(store.look_back(rows, d, ref).count() == 0 for d in (0, -1, "x", None))


def test_the_plain_edition_says_what_is_shown(spark):
    s = present.with_display(story_queries.scored(spark, SMALL)).withColumns({"article_id": F.col("doc_id").cast("string"), "position": F.col("doc_id")})
    s = cut(s)
    shown = s.join(present.sections(s), "article_id").select("*", score.priority_level().alias("lv")).collect()
    r = mail.issue_text(s.join(present.sections(s), "article_id"), "2026-09-17").first()
    assert (r["total"], r["critical"], r["high"]) == (len(shown), sum(x["lv"] == "critical" for x in shown), sum(x["lv"] == "high" for x in shown))
    order = sorted(shown, key=lambda x: (x["section_pos"], x["place"]))
    lines = r["text"].split("\n")
    assert [x[8:] for x in lines if x.startswith("  Link: ")] == [x["display_url"] for x in order] and len(shown) > 10
    assert [x[4:-4] for x in lines if x.startswith("=== ")] == list(dict.fromkeys(x["section"] for x in order)) and lines[0] == "Intelligence briefing - 2026-09-17"


TOPICS = ("OpenAI GPT-5 reasoning", "Anthropic Claude 3.5 coding", "Google DeepMind Gemini 2.0 video", "NVIDIA Blackwell B200 supply", "Meta AI Llama 3.3 weights", "EU AI Act fines", "Mistral AI funding round", "SK Hynix HBM3E memory")


def many(n):
    return [story(k, f"{TOPICS[k % 8]} story number{k} of part{k % 37}", f"P{k % 50}", f"https://h.com/{k}", priority=float(k % 100), hours=k % 60) for k in range(n)]


def test_clustering_grows_less_than_quadratically(spark):
    """A thousand stories keep their number, and take less than a hundred times as long as a hundred."""
    took = {}
    for n in (100, 1000):
        rows = spark.createDataFrame(many(n), STORY)
        began = time.monotonic()
        found = cluster.assign_events(rows).select("seq", "event_pos").collect()
        took[n] = time.monotonic() - began
        assert len(found) == n == len({r["seq"] for r in found})
    assert took[1000] < 100 * took[100]
