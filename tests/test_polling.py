"""Feeds polled as a stream, and scanned from responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.sources import catalog, feeds
from tidewire.streaming.polling import FeedPoller, poll_feeds


def write(folder, feed, numbers):
    items = "".join(f"<item><title>t{n}</title><link>https://e.com/{feed}/{n}</link></item>" for n in numbers)
    (folder / f"{feed}.xml").write_text(f"<rss><channel>{items}</channel></rss>")


def test_each_entry_once_over_polls_and_restarts(spark, tmp_path):
    src, out, state = tmp_path / "feeds", f"{tmp_path}/out", f"{tmp_path}/state"
    src.mkdir()

    def poll():
        """A query of its own each time: the offsets come from the checkpoint."""
        rows = poll_feeds(spark, ids="openai_news,wired_ai", folder=str(src)).select("feed_id", "title")
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return sorted((r["feed_id"], r["title"]) for r in spark.read.schema("feed_id string, title string").parquet(out).collect())

    write(src, "openai_news", [2, 1])
    first = [("openai_news", "t1"), ("openai_news", "t2")]
    assert poll() == first  # the other feed is not there yet
    write(src, "openai_news", [3, 1, 2, 3])
    write(src, "wired_ai", [7])
    both = [*first, ("openai_news", "t3"), ("wired_ai", "t7")]
    assert poll() == both and poll() == both
    (src / "wired_ai.xml").write_text("<rss>")
    write(src, "openai_news", [4])
    assert poll() == sorted([*both, ("openai_news", "t4")])


def test_offsets_decide_what_a_batch_gives(tmp_path):
    write(tmp_path, "openai_news", [2, 1])
    options = {"ids": "openai_news,wired_ai", "folder": str(tmp_path), "cap": "3"}
    poller = FeedPoller(options)
    one = poller.latestOffset()
    write(tmp_path, "openai_news", [3, 2, 1])
    titles = lambda p, a, b: [r[2] for part in p.partitions(a, b) for r in p.read(part)]
    assert titles(poller, poller.initialOffset(), one) == ["t2", "t1"]  # what came since waits
    two = poller.latestOffset()
    assert titles(poller, one, two) == ["t3"] and titles(FeedPoller(options), one, two) == ["t3"]  # again, in another process
    assert poller.latestOffset() == two and poller.partitions(two, two) == []
    (tmp_path / "openai_news.xml").unlink()
    assert poller.latestOffset() == two  # a feed that fails keeps its place
    write(tmp_path, "openai_news", [5, 4, 3])
    assert titles(poller, two, poller.latestOffset()) == ["t5", "t4"]


def test_scan_in_catalogue_order_with_failures(spark):
    rss = "<rss><item><title>a</title><link>l</link></item><item><title>b</title></item></rss>"
    rows = [("wired_ai", rss, 200, None), ("openai_news", rss, None, None), ("arxiv_ai", None, 200, None), ("unknown", rss, 200, None), ("gnews_global_ai", None, None, "timeout")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "feed_id string, body string, http_status int, error string, rank int")
    table = catalog.feeds(spark)
    got = feeds.scan_responses(df.repartition(3), table).orderBy("seq").select("feed_id", "title", "error", "rank").collect()
    rank = {r["id"]: r["rank"] for r in table.select("id", "rank").collect()}
    assert [r["rank"] for r in got] == sorted(rank[f] for f, n in (("wired_ai", 2), ("openai_news", 2), ("arxiv_ai", 1), ("gnews_global_ai", 1)) for _ in range(n))
    said = {r["feed_id"]: r["error"] for r in got}
    assert said["gnews_global_ai"] == "timeout" and "malformed" in said["arxiv_ai"] and said["wired_ai"] is None
    assert [r["title"] for r in got if r["feed_id"] == "openai_news"] == ["a", "b"]
    assert feeds.scan_responses(df.limit(0), table).filter(F.col("title").isNotNull()).count() == 0
