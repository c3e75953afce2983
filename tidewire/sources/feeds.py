"""Feeds as a data source: one partition a feed, entries parsed to rows; and the health of feeds.

Fetching is a parameter, so that feeds can come from the network, from files or from memory. Failures are rows, not errors.
"""

from __future__ import annotations

import time
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidewire import rules
from tidewire.functions.sources import evidence_level, exact_authority
from tidewire.functions.text import canonical_url
from tidewire.sources.catalog import feed_rows

RAW = "feed_id string, pos int, title string, link string, published string, summary string, content string, source_title string, error string, http_status int, response_time double, parsing_error string"
_CONTENT = "{http://purl.org/rss/1.0/modules/content/}encoded"
_ATOM = "{http://www.w3.org/2005/Atom}"


def fetch_http(url: str, timeout: float = 12.0) -> tuple[int, bytes]:
    from urllib.request import Request, urlopen

    with urlopen(Request(url, headers={"User-Agent": "tidewire/1"}), timeout=timeout) as r:  # noqa: S310
        return r.status, r.read()


def parse_feed(data: bytes) -> list[dict[str, str | None]]:
    """Items of RSS or entries of Atom; raises ParseError on malformed XML."""
    root, out = ET.fromstring(data), []
    for item in [*root.iter("item"), *root.iter(f"{_ATOM}entry")]:
        text = lambda *names: next((e.text for n in names if (e := item.find(n)) is not None and e.text), None)  # noqa: B023, E731
        link = text("link") or next((e.get("href") for e in item.findall(f"{_ATOM}link")), None)
        out.append({"title": text("title", f"{_ATOM}title"), "link": link, "published": text("pubDate", f"{_ATOM}published", f"{_ATOM}updated"), "summary": text("description", f"{_ATOM}summary"), "content": text(_CONTENT, f"{_ATOM}content"), "source_title": text("source")})
    return out


def read_feed(feed_id: str, url: str, fetch: Callable[[str], tuple[int, bytes]], cap: int = rules.FEED_CAP) -> list[tuple]:
    """A feed's first entries as raw rows; one row without a title where it failed or is empty. Never raises."""
    began, status, row = time.time(), None, lambda **k: tuple(k.get(c.split()[0]) for c in RAW.split(", "))
    try:
        status, data = fetch(url)
        took = time.time() - began
        if status >= 400:
            return [row(feed_id=feed_id, error=f"HTTP {status}", http_status=status, response_time=took)]
        try:
            items = parse_feed(data)
        except ET.ParseError as e:
            return [row(feed_id=feed_id, error=f"malformed feed: {e}", parsing_error=str(e), http_status=status, response_time=took)]
    except Exception as e:  # noqa: BLE001  a feed's failure is a result
        return [row(feed_id=feed_id, error=str(e) or type(e).__name__, http_status=status, response_time=time.time() - began)]
    found = [row(feed_id=feed_id, pos=i, http_status=status, response_time=took, **x) for i, x in enumerate(items[:cap])]
    return found or [row(feed_id=feed_id, http_status=status, response_time=took)]


class FeedSource(DataSource):
    """``spark.read.format("tidewire_feeds")``: the catalogue's feeds, or those in the option ``ids`` (comma-separated)."""

    @classmethod
    def name(cls) -> str:
        return "tidewire_feeds"

    def schema(self) -> str:
        return RAW

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _FeedReader(self.options)


def listed(options: dict) -> list[tuple[str, str]]:
    """(id, address) of the feeds that the options name."""
    ids = set(filter(None, options.get("ids", "").split(",")))
    return [(f[1], f[4]) for f in feed_rows() if not ids or f[1] in ids]


def fetcher(options: dict) -> Callable[[str, str], tuple[int, bytes]]:
    """How a feed of an id and address is fetched: ``folder`` holds <id>.xml files, mounted everywhere, in place of the
    network."""
    folder = options.get("folder")

    def fetch(feed_id: str, url: str) -> tuple[int, bytes]:
        if not folder:
            return fetch_http(url)
        with open(f"{folder}/{feed_id}.xml", "rb") as f:
            return 200, f.read()

    return fetch


class _FeedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.feeds, self.fetch, self.cap = listed(options), fetcher(options), int(options.get("cap", rules.FEED_CAP))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(len(self.feeds))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        feed_id, url = self.feeds[partition.value]
        yield from read_feed(feed_id, url, lambda u: self.fetch(feed_id, u), self.cap)


def scan_responses(responses: DataFrame, feeds: DataFrame, cap: int = rules.FEED_CAP) -> DataFrame:
    """Raw rows of responses that are there already (feed_id, body string, http_status int, error string), with ``seq``, which
    orders them by the feeds' ``rank`` and the place in the feed, whichever task is done first. A response with an error, a
    bad status or malformed XML gives one row that says so; a null body is an empty one, which is malformed; a feed that
    is not among ``feeds`` gives nothing, rows that repeat a feed are each read. No row is lost with an executor: tasks only
    read."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                failed = None if pd.isna(r.error) else r.error

                def fetch(_: str, r=r, failed=failed) -> tuple[int, bytes]:
                    if failed is not None:
                        raise OSError(failed)
                    return (200 if pd.isna(r.http_status) else int(r.http_status)), ("" if pd.isna(r.body) else r.body).encode()

                rows = pd.DataFrame(read_feed(r.feed_id, "", fetch, cap), columns=[c.split()[0] for c in RAW.split(", ")]).astype(object)
                rows["response_time"], rows["rank"] = 0.0, r.rank
                yield rows.where(rows.notna(), None)

    ranked = responses.select("feed_id", "body", "http_status", "error").join(feeds.select(F.col("id").alias("feed_id"), F.col("rank").cast("long").alias("rank")), "feed_id")
    return ranked.mapInPandas(read, f"{RAW}, rank long").withColumn("seq", F.col("rank") * F.lit(1_000_000) + F.coalesce("pos", F.lit(0)))


def read_feeds(spark: SparkSession, **options: str) -> DataFrame:
    spark.dataSource.register(FeedSource)
    return spark.read.format("tidewire_feeds").options(**options).load()


@F.pandas_udf(T.StringType())
def html_unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unescape(x) if x else x)


def published_time(text: Column) -> Column:
    """RFC 822 or ISO dates; anything else is null. A weekday, if any, is not looked at."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    bare = F.regexp_replace(bare, r"\b(GMT|UTC|UT|Z)$", "+0000")
    formats = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yy HH:mm:ss Z")
    return F.coalesce(*(F.try_to_timestamp(bare, F.lit(f)) for f in formats), F.when(bare.rlike(r"^\d{4}-"), F.try_to_timestamp(F.trim(text))))


def strip_tags(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), r"\s+", " "))


def entry_publisher(title: Column, source_title: Column, feed_name: Column) -> Column:
    """The entry's own source, else what follows the last `` - `` of its title if short, else the feed."""
    last = F.trim(F.regexp_extract(title, r"^.* - (.*)$", 1))
    tail = F.when(title.contains(" - ") & (F.length(last) <= 40), last)
    return F.coalesce(F.nullif(F.trim(source_title), F.lit("")), tail, feed_name)


def parse_entries(raw: DataFrame, feeds: DataFrame, unescape_html: bool = True) -> DataFrame:
    """Raw rows of feeds to entries: text cleaned, publisher found, evidence and authority taken from the publisher where
    it is not the feed. Rows without title or address are left out. ``seq`` orders them by feed, then place."""
    clean = html_unescape if unescape_html else (lambda c: c)
    f = F.broadcast(feeds.select(F.col("id").alias("feed_id"), F.col("rank"), F.col("name").alias("feed_name"), "bucket", "source_type", F.col("authority_score").alias("feed_authority"), F.col("evidence_level").alias("feed_level")))
    out = raw.filter("error is null").join(f, "feed_id").withColumns({"title": F.trim(clean(F.coalesce("title", F.lit("")))), "url": F.trim(F.coalesce("link", F.lit("")))})
    out = out.filter("title != '' and url != ''")
    out = out.withColumn("publisher", entry_publisher(F.col("title"), F.col("source_title"), F.col("feed_name")))
    out = with_publisher_evidence(out)
    level = F.col("evidence_level")
    return out.select(
        (F.col("rank") * F.lit(1_000_000) + F.col("pos")).cast("long").alias("seq"), "title", "url", F.col("feed_name").alias("source"), "bucket", published_time(F.col("published")).alias("published_at"),
        F.substring(strip_tags(clean(F.coalesce("summary", F.lit("")))), 1, 500).alias("excerpt"), F.coalesce("content", F.lit("")).alias("content"), F.col("feed_id").alias("source_id"),
        F.col("feed_id").alias("discovered_via"), "publisher", "authority_score", F.col("authority_score").alias("source_authority"), "source_type", canonical_url("url").alias("canonical_url"), level.alias("evidence_level"),
        *((level == n).alias(f"is_{n}_source") for n in ("primary", "independent", "discovery")),
    )


def with_publisher_evidence(df: DataFrame) -> DataFrame:
    """Add evidence_level and authority_score to rows with publisher, feed_name, feed_level and feed_authority: a
    publisher other than the feed counts where the feed only finds, or where it is primary, independent or research."""
    other = (F.col("publisher") != F.col("feed_name")) & (F.col("publisher") != "")
    own = evidence_level("publisher")
    takes = other & ((F.col("feed_level") == "discovery") | own.isin("primary", "independent", "research"))
    return df.withColumns(
        {
            "evidence_level": F.when(takes, own).otherwise(F.col("feed_level")),
            "authority_score": F.when(other, F.coalesce(exact_authority("publisher"), F.col("feed_authority"))).otherwise(F.col("feed_authority")),
        }
    )


def cap_per_feed(df: DataFrame, feed: str = "feed_id", order: str = "pos", cap: int = rules.FEED_CAP) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(feed).orderBy(order))).filter(F.col("_n") <= cap).drop("_n")


def health_state(enabled: Column, error: Column, entries: Column, response_time: Column) -> Column:
    return F.when(~enabled, "disabled").when(error.isNotNull(), "failing").when((entries == 0) | (response_time > 5.0), "degraded").otherwise("healthy")


def feed_health(raw: DataFrame, feeds: DataFrame) -> DataFrame:
    """One row a feed: status, state, entries, response and error."""
    seen = raw.groupBy("feed_id").agg(F.count("title").alias("entries_count"), F.max("error").alias("error"), F.max("http_status").alias("http_status"), F.max("response_time").alias("response_time"), F.max("parsing_error").alias("parsing_error"))
    out = feeds.join(seen, feeds["id"] == seen["feed_id"], "left")
    entries, took = F.coalesce("entries_count", F.lit(0)), F.coalesce("response_time", F.lit(0.0))
    return out.select(
        "id", "name", "url", F.when(F.col("error").isNull(), "ok").otherwise("error").alias("status"), health_state(F.col("enabled"), F.col("error"), entries, took).alias("health_state"), entries.alias("entries_count"),
        "http_status", took.alias("response_time"), "parsing_error", F.col("discovery_method").alias("feed_type"), F.col("evidence_level").alias("source_role"), "error", F.when(F.col("error").isNull(), 0).otherwise(1).alias("consecutive_failures"),
    )


def health_ok(health: DataFrame) -> DataFrame:
    """One row: how many feeds answered, and how many there are."""
    return health.agg(F.count_if(F.col("status") == "ok").alias("feeds_ok"), F.count(F.lit(1)).alias("feeds_total"))


def warnings(raw: DataFrame, feeds: DataFrame) -> DataFrame:
    """``name: error`` of each failed feed, and its two parts."""
    named = raw.filter("error is not null").join(F.broadcast(feeds.select(F.col("id").alias("feed_id"), "name")), "feed_id")
    return named.select(F.concat_ws(": ", "name", "error").alias("warning"))


def warning_parts(warning: Column) -> Column:
    """(source, detail) around the first colon; without a source the collector is named."""
    i = F.instr(warning, ":")
    head = F.when(i > 0, F.trim(F.substring(warning, F.lit(1), i - 1)))
    tail = F.when(i > 0, F.trim(F.substring(warning, i + 1, F.length(warning)))).otherwise(F.trim(warning))
    return F.struct(F.coalesce(F.nullif(head, F.lit("")), F.lit("수집기")).alias("source"), tail.alias("detail"))
