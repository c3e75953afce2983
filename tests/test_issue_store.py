"""The store of issues: readers beside a writer, two writers, snapshots, leftovers."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F
from tidewire.operators.store import IssueStore

AT = datetime(2026, 9, 17, 6)
ARTICLES = "article_id string, event_id string, position long, published_at timestamp, collected_at timestamp, mark string"


def save(store, spark, day, mark, n=3):
    rows = spark.createDataFrame([(f"a{k}", "e", k, AT, AT, mark) for k in range(n)], ARTICLES)
    events = spark.createDataFrame([("e", mark)], "event_id string, title string")
    bridge = rows.select("event_id", "article_id").union(rows.select("event_id", "article_id"))
    store.save_issue(day, rows, events, bridge, spark.createDataFrame([(n,)], "articles int"), [mark], at=F.lit(AT))


def seen(store, day):
    one = {t: store.table(t).filter(F.col("issue_date") == day) for t in ("articles", "events", "event_articles", "issues")}
    return {r["mark"] for r in one["articles"].collect()} | {r["title"] for r in one["events"].collect()} | {w for r in one["issues"].collect() for w in r["warnings"]}, one["event_articles"].count()


def test_a_reader_between_two_writes_sees_the_old_issue_whole(spark, tmp_path, monkeypatch):
    store = IssueStore(spark, f"file://{tmp_path}/issues")
    assert store.health() == {"ok": False, "missing": ["issues", "articles", "events", "event_articles"], "latest_issue": None}
    save(store, spark, "2026-09-16", "old")
    save(store, spark, "2026-09-17", "first")
    write, during = store._write, []
    monkeypatch.setattr(store, "_write", lambda *a: (during.append(seen(IssueStore(spark, store.root), "2026-09-17")), write(*a))[1])
    before = store.snapshot()
    save(store, spark, "2026-09-17", "second", 2)
    assert during == [({"first"}, 3)] * 4 and seen(store, "2026-09-17") == ({"second"}, 2)
    assert seen(before, "2026-09-17") == ({"first"}, 3) and seen(store, "2026-09-16") == ({"old"}, 3)
    with pytest.raises(ValueError, match="read only"):
        save(before, spark, "2026-09-17", "third")
    assert [tuple(r) for r in store.issues().select("n_articles").collect()] == [(2,), (3,)] and store.health()["ok"]
    assert store.vacuum() == 0  # all is young
    assert store.vacuum(keep=1, grace_seconds=-5) == 4 and seen(store, "2026-09-17") == ({"second"}, 2)


def test_writers_at_one_moment_both_count(spark, tmp_path, monkeypatch):
    store, other = (IssueStore(spark, f"file://{tmp_path}/issues") for _ in range(2))
    save(store, spark, "2026-09-17", "one")
    last = store.journal.last

    def late(key):
        monkeypatch.undo()
        found = last(key)
        save(other, spark, "2026-09-18", "two")
        return found

    monkeypatch.setattr(store.journal, "last", late)
    save(store, spark, "2026-09-19", "three")
    assert store.version() == 3 and [seen(store, f"2026-09-{d}")[0] for d in (17, 18, 19)] == [{"one"}, {"two"}, {"three"}]


def test_sent_is_marked_on_what_was_read(spark, tmp_path, monkeypatch):
    store, other = (IssueStore(spark, f"file://{tmp_path}/issues") for _ in range(2))
    save(store, spark, "2026-09-17", "one")
    write = store._write
    monkeypatch.setattr(store, "_write", lambda *a: (monkeypatch.undo(), save(other, spark, "2026-09-17", "two"), write(*a))[2])
    store.mark_sent("2026-09-17", F.lit(AT))
    r = store.table("issues").first()
    assert r["warnings"] == ["two"] and r["sent_at"] == AT
    store.mark_sent("2026-09-30", F.lit(AT))
    assert store.table("issues").count() == 1
