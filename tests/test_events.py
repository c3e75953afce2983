"""Event clustering against one pass over everything, in every order of arrival; lexicons; time bands; days of a zone."""

from __future__ import annotations

import re
from datetime import datetime, timedelta
from itertools import permutations

import pandas as pd
import pytest
from pyspark.sql import functions as F
from tidewire import rules
from tidewire.functions import text as tx
from tidewire.operators import cluster, metrics, similarity
from tidewire.operators.graph import cut
from tidewire.plans import story_queries
from tidewire.streaming import incremental

REF = datetime(2026, 9, 17, 12)
SMALL = "/root/testdata/sf0.001"


def story(n, title, publisher, url, tags=(), hours=1, kind="media", priority=50.0):
    return (n, title, "", publisher, publisher, kind, list(tags), url, url, f"art{n}", REF - timedelta(hours=hours), priority, priority, False, False)


STORY = "seq long, title string, excerpt string, publisher string, source string, source_type string, tags array<string>, url string, canonical_url string, article_id string, published_at timestamp, priority_score double, score double, is_official boolean, is_primary_source boolean"


def events_of(spark, rows):
    """The stories' numbers by event."""
    got = cluster.assign_events(spark.createDataFrame(rows, STORY)).select("seq", "event_pos").collect()
    out = {}
    for r in got:
        out.setdefault(r["event_pos"], set()).add(r["seq"])
    return {frozenset(v) for v in out.values()}


CHAIN = [
    story(1, "OpenAI launches GPT-5 model release", "OpenAI", "https://o.com/1", priority=90.0), story(2, "OpenAI GPT-5 pricing: GPT-5 release cost per token", "Reuters", "https://r.com/2", priority=80.0),
    story(3, "Anthropic Claude 3.5 pricing changes cost per token", "The Verge", "https://v.com/3", priority=70.0),
]


def test_groups_do_not_depend_on_the_order_of_arrival(spark):
    found = {frozenset(events_of(spark, [(n, *row[1:]) for n, row in zip((r[0] for r in p), p, strict=True)])) for p in permutations(CHAIN)}
    assert found == {frozenset({frozenset({1, 2}), frozenset({3})})}


def test_five_and_three_stories_make_two_events(spark):
    rows = [story(k, "OpenAI launches GPT-5 model with new reasoning", f"P{k}", f"https://a.com/{k}", priority=50.0 + k) for k in range(5)]
    rows += [story(10 + k, "NVIDIA Blackwell B200 enters mass production at TSMC", f"Q{k}", f"https://b.com/{k}", priority=40.0 + k) for k in range(3)]
    want = {frozenset(range(5)), frozenset({10, 11, 12})}
    assert events_of(spark, rows) == want == events_of(spark, rows[::-1])


def plain_events(rows, sims, tie, near):
    """One pass over all stories in order, which looks at every member of every event. Rows are (pos, traits)."""
    events, out = [], {}
    for pos, f in rows:
        best, best_mean = None, -1.0
        for k, (members, about) in enumerate(events):
            values = [sims.get((m, pos), 0.0) for m in members]
            if max(values) < tie or min(values) < near or min(values) <= 0.0 or not cluster.agrees(f, about):
                continue
            mean = round(sum(values) / len(values), 12)
            if mean > best_mean:
                best, best_mean = k, mean
        if best is None:
            events.append(([pos], f))
        else:
            events[best] = (events[best][0] + [pos], events[best][1] | f)
        out[pos] = events[len(events) - 1 if best is None else best][0][0]
    return out


@pytest.mark.parametrize("step", [1, 3])
def test_events_match_one_pass_over_all_stories(spark, step):
    """Connected groups one by one give what a single pass over all stories, with every pair's similarity, gives."""
    s = cut(story_queries.scored(spark, SMALL).filter(F.col("doc_id") % step == 0))
    placed = cut(similarity.with_features(cluster.with_position(s)))
    every = cut(placed.select(*(F.col(c).alias(f"a_{c}") for c in placed.columns)).join(placed.select(*(F.col(c).alias(f"b_{c}") for c in placed.columns)), F.col("a_pos") < F.col("b_pos")).select(F.col("a_pos").alias("u"), F.col("b_pos").alias("v"), similarity.pair_similarity().alias("similarity")))
    pairs = every.toPandas()
    near = rules.SIMILARITY * rules.COHESION
    got = similarity.similar_articles(placed, near).toPandas()
    want = pairs[pairs.similarity >= near]
    key = lambda f: sorted(zip(f.u, f.v, f.similarity.round(9), strict=True))
    assert key(got) == key(want) and len(want) > 50
    rows = [
        (r["pos"], cluster.Traits(*(frozenset(r[f"f_{n}"]) for n in ("models", "entities", "themes", "effective")), frozenset(map(tuple, r["f_anchors"]))))
        for r in placed.select("pos", "f_models", "f_entities", "f_themes", "f_effective", "f_anchors").orderBy("pos").collect()
    ]
    plain = plain_events(rows, {(u, v): x for u, v, x in zip(pairs.u, pairs.v, pairs.similarity, strict=True)}, rules.SIMILARITY, near)
    found = {r["pos"]: r["event_pos"] for r in cluster.assign_events(s).select("pos", "event_pos").collect()}
    assert found == plain and 1 < len(set(plain.values())) < len(plain)


WORDS = [
    "open ai", "open", "ai", "ai lab", "gpt-4", "gpt-4o", "gpt", "오픈ai", "오픈", "메타", "메타 ai", "o1", "sk하이닉스", "c++", "data center", "data centers", "fast.ai",
]


def test_a_lexicon_finds_what_single_patterns_find(spark):
    lists = {f"n{k}": [w, WORDS[(k * 5 + 3) % len(WORDS)]] for k, w in enumerate(WORDS)}
    texts = ["open ai labs", "openai open", "gpt-4o and gpt-4", "xgpt-4", "오픈ai가 메타 ai를", "새오픈", "o1.o11", "sk하이닉스는", "c++ c+", "data centersx data center", "éopen ai", "open aié", "ai-lab ai lab_", "", None, "fast.ai fastxai", "gpt-4-open"]
    lex = tx.Lexicon(lists, lambda w: not re.search("[가-힣]", w))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [sorted(r["x"]) for r in df.select(lex.found(F.col("t")).alias("x")).collect()]
    single = {n: tx.alias_pattern(dict.fromkeys(ws)) for n, ws in lists.items()}
    want = [sorted(n for n in lists if r[n]) for r in df.select(*(F.coalesce(tx.matches(F.col("t"), p), F.lit(False)).alias(n) for n, p in single.items())).collect()]
    assert got == want and sum(map(len, want)) > 40


def test_topics_in_one_pass(spark):
    df = spark.createDataFrame([(t,) for t in ["Series B funding of data centers", "a datacenter; series bb", "chain of thought and 추론 모델", "No topic", None]], "t string")
    single = [[n for n, p in rules.TOPICS.items() if t and re.search(p, t.lower())] for t in (r["t"] for r in df.collect())]
    assert [r["x"] for r in df.select(tx.topics_in("t").alias("x")).collect()] == single


def test_time_bands(spark):
    rows = [(k % 3, k, (k * 37_003) % 900_000) for k in range(120)] + [(0, 500, None), (1, 501, 259_200), (1, 502, 0), (1, 503, 518_400)]
    got = sorted(map(tuple, similarity.near_in_time(spark.createDataFrame(rows, "m int, pos long, s long"), "m", "pos", "s").collect()))
    want = sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[2] is not None and b[2] is not None and abs(a[2] - b[2]) <= 72 * 3600)
    assert got == want


DAYS = ["2024-03-30 22:30:00", "2024-03-30 23:30:00", "2024-03-31 21:30:00", "2024-03-31 22:30:00", "2024-07-01 22:30:00", "2024-07-03 12:00:00", "2024-07-09 12:00:00"]


@pytest.mark.parametrize("session", ["UTC", "Asia/Seoul"])
def test_days_of_a_zone(spark, session, tmp_path):
    """Berlin is an hour ahead until the last Sunday of March, then two."""
    frame = pd.DataFrame({"published_at": pd.to_datetime(DAYS).tz_localize("UTC")})
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", session)
    try:
        rows = spark.createDataFrame([(int(x.timestamp()),) for x in frame.published_at], "s long").select(F.timestamp_seconds("s").alias("published_at"))
        want = {"2024-03-30": 1, "2024-03-31": 2, "2024-04-01": 1, "2024-07-02": 1, "2024-07-03": 1, "2024-07-09": 1}
        assert {r["day"]: r["n"] for r in metrics.daily_counts(rows, "Europe/Berlin").collect()} == want
        rows.write.parquet(f"{tmp_path}/in")
        flow = incremental.daily_counts(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "Europe/Berlin")
        flow.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        got = {r["day"]: r["n"] for r in spark.read.schema(flow.schema).parquet(f"{tmp_path}/out").collect()}
        assert got == {d: n for d, n in want.items() if d < "2024-07-08"}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
