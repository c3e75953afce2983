"""Journals, run lock, settings, run log, page fetch and redirects."""

from __future__ import annotations

import io
import json
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from tidewire.operators import control, runlog
from tidewire.operators.graph import scratch
from tidewire.sources import feeds, pages

NOW = datetime(2026, 9, 17, 6, tzinfo=UTC)


@pytest.fixture(params=["memory", "folder"])
def journal(request, spark):
    return control.MemoryJournal() if request.param == "memory" else control.FolderJournal(spark, scratch(spark, "journal"))


def test_run_lock_over_journals(journal):
    lock = control.RunLock(journal=journal)
    assert lock.acquire("d", NOW) and not lock.acquire("d", NOW + timedelta(minutes=29, seconds=59)) and lock.acquire("d", NOW + timedelta(minutes=30))
    lock.fail("d", NOW, "no network")
    assert lock.state("d")["status"] == "failed" and lock.state("d")["error"] == "no network" and lock.acquire("d", NOW)
    assert lock.state("d")["error"] is None
    lock.finish("d", NOW + timedelta(minutes=1), {"n": 3})
    again = control.RunLock(journal=journal)  # another process
    assert again.completed("d") and not again.acquire("d", NOW + timedelta(days=3)) and again.state("d")["metrics"] == {"n": 3}
    assert again.acquire("d", NOW, job="other") and again.acquire("e", NOW) and not again.completed("e")


def test_only_one_of_two_gets_a_number(spark):
    root = scratch(spark, "race")
    journals = [control.FolderJournal(spark, root) for _ in range(4)]
    with ThreadPoolExecutor(4) as pool:
        for n in range(1, 4):
            won = list(pool.map(lambda j, n=n: j.write("k", n, {"by": n}), journals))
            assert sum(won) == 1
    assert journals[0].last("k") == (3, {"by": 3}) and journals[1].last("none") == (0, None)


def test_a_run_taken_meanwhile_is_not_ours():
    journal = control.MemoryJournal()
    lock, last = control.RunLock(journal=journal), journal.last

    def late(key):
        found = last(key)
        journal.write(key, found[0] + 1, {"status": "running", "started_at": NOW.isoformat()})
        return found

    journal.last = late
    assert not lock.acquire("d", NOW)


def test_settings(journal):
    one, two = control.SettingsStore(journal), control.SettingsStore(journal)
    assert one.all() == {} and one.update({"host": "h", "port": 25}) == {"host": "h", "port": "25"}
    two.update({"port": None, "to": "a@b"})
    assert one.all() == {"host": "h", "port": "", "to": "a@b"}


@pytest.mark.parametrize("text", ["", "6", "6:0:0", "24:00", "12:60", "a:b", "-1:00"])
def test_times_of_day(text):
    with pytest.raises(ValueError, match="time of day"):
        control.clock(text)
    assert control.clock(" 06:30 ") == (6, 30)


def test_run_log(spark):
    out = io.StringIO()
    log = runlog.RunLog(out)
    log.log("info", "collector", "started", at=NOW)
    with pytest.raises(OSError), log.timed("collector", "fetch", "feed"):
        raise OSError("down")
    with log.timed("store", "save"):
        rows, seen = log.counted(spark.range(7), "rows")
        assert rows.count() == 7 and seen.get["rows"] == 7
    lines = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [(x["level"], x["event"], x["error"]) for x in lines] == [("INFO", "started", None), ("ERROR", "fetch", "down"), ("INFO", "save", None)]
    assert lines[0]["timestamp"] == NOW.isoformat() and log.table(spark).count() == 3
    out.close()
    log.log("WARNING", "x", "written nowhere", duration=0.123456)
    assert log.records[-1]["duration"] == 0.1235


def test_robots():
    asked = []

    def fetch(method, url, seconds):
        asked.append(url)
        host = url.split("/")[2]
        if host == "down":
            raise OSError
        return {"rules": (200, "User-agent: *\nDisallow: /no", url), "shut": (403, "", url), "login": (401, "", url), "empty": (200, "", url)}.get(host, (404, "", url))

    r = pages.Robots(fetch)
    assert [r.allow(u) for u in ("https://rules/yes", "https://rules/no/x", "https://shut/a", "https://login/a", "https://empty/a", "https://none/a", "https://down/a", "ftp://x/y", "", None)] == [True, False, False, False, True, True, True, False, False, False]
    assert len(asked) == 6  # each host once


PAGE = "<html><body><article><p>One paragraph that is long enough to be kept.</p></article></body></html>"


def fetch(method, url, seconds):
    if "boom" in url:
        raise OSError("down")
    if method == "HEAD":
        return 200, "", "https://Site.example/story/?utm_source=x&id=1"
    return (404, "", url) if url.endswith("robots.txt") or "gone" in url else (200, PAGE, url)


def test_pages_and_redirects(spark):
    rows = [(1, "https://a.example/x", "t"), (2, None, "t"), (3, "", "t"), (4, "https://news.google.com/z", "t"), (5, "https://a.example/gone", "t"), (6, "https://a.example/boom", "t"), (1, "https://a.example/x", "t"), (None, "https://news.google.com/boom", "t")]
    df = spark.createDataFrame(rows, "id long, url string, text string")
    got = sorted(((r["id"] or 0, r["allowed"], r["status"], len(r["text"])) for r in pages.fetch_pages(df, "id", fetch=fetch).collect()), key=str)
    assert got == sorted([(1, True, 200, 45), (1, True, 200, 45), (2, False, None, 0), (3, False, None, 0), (4, False, None, 0), (5, True, 404, 0), (6, True, None, 0), (0, False, None, 0)], key=str)
    found = {r["id"]: r["url"] for r in pages.resolved_urls(df, "id", fetch=fetch).collect()}
    assert found[4] == "https://site.example/story?id=1" and found[None] == "https://news.google.com/boom" and found[1] == "https://a.example/x"
    assert pages.fetch_pages(df.limit(0), "id", fetch=fetch).count() == 0 and pages.resolved_urls(df.limit(0), "id", fetch=fetch).count() == 0


def test_health_of_feeds(spark):
    health = spark.createDataFrame([("ok",), ("error",), ("ok",)], "status string")
    assert feeds.health_ok(health).first().asDict() == {"feeds_ok": 2, "feeds_total": 3}
    assert feeds.health_ok(health.filter(F.lit(False))).first().asDict() == {"feeds_ok": 0, "feeds_total": 0}
