"""Pages of articles from the network: asked for only where robots.txt allows, and addresses that lead elsewhere resolved.

Fetching is a parameter, so that pages can come from the network, from files or from memory. Failures are rows, not errors.
Addresses are dealt by host and a few slices of it, so that a host is asked for its rules a few times only, and a host with
very many addresses is no single task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import urlsplit
from urllib.robotparser import RobotFileParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import canonical_url, is_intermediary, url_host
from tidewire.sources.page_text import article_text

#: Seconds, the name given to hosts, tasks a host's addresses are dealt to, and a host whose addresses lead elsewhere.
PAGE_SECONDS, ROBOTS_SECONDS, AGENT, HOST_SLICES, LEADS_ON = 6.0, 3.0, "tidewire/1", 4, "news.google.com"
#: (method, address, seconds) to (status, body, final address).
Fetch = Callable[[str, str, float], tuple[int, str, str]]


def fetch_http(method: str, url: str, seconds: float) -> tuple[int, str, str]:
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(url, headers={"User-Agent": AGENT}, method=method), timeout=seconds) as r:  # noqa: S310
            return r.status, r.read().decode(r.headers.get_content_charset() or "utf-8", "replace"), r.url
    except HTTPError as e:
        return e.code, "", url


class Robots:
    """What hosts allow, each asked once. Rules that cannot be read allow all; a host that refuses to show them, nothing."""

    def __init__(self, fetch: Fetch = fetch_http, agent: str = AGENT, seconds: float = ROBOTS_SECONDS):
        self.fetch, self.agent, self.seconds = fetch, agent, seconds
        self.rules: dict[str, RobotFileParser | bool] = {}

    def _rules(self, origin: str) -> RobotFileParser | bool:
        try:
            status, body, _ = self.fetch("GET", f"{origin}/robots.txt", self.seconds)
        except Exception:  # noqa: BLE001  a host without an answer has no rules
            return True
        if status == 200 and body:
            rules = RobotFileParser()
            rules.parse(body.splitlines())
            return rules
        return status not in (401, 403)

    def allow(self, url: str | None) -> bool:
        if not url or not url.startswith(("http://", "https://")):
            return False
        parts = urlsplit(url)
        origin = f"{parts.scheme}://{parts.netloc}"
        if origin not in self.rules:
            self.rules[origin] = self._rules(origin)
        own = self.rules[origin]
        return own if isinstance(own, bool) else own.can_fetch(self.agent, url)


def page_of(url: str | None, robots: Robots, fetch: Fetch = fetch_http, seconds: float = PAGE_SECONDS) -> tuple[bool, int | None, str]:
    """(allowed, status, article text) of one address; an empty text where there is no page."""
    if not robots.allow(url):
        return False, None, ""
    try:
        status, body, _ = fetch("GET", url, seconds)
    except Exception:  # noqa: BLE001  a page's failure is a result
        return True, None, ""
    return True, status, article_text(body) if status == 200 else ""


def _dealt(rows: DataFrame, url: Column, slices: int) -> DataFrame:
    return rows.withColumn("_slice", F.pmod(F.xxhash64(url), F.lit(slices))).repartition(url_host(url), "_slice").drop("_slice")


def fetch_pages(rows: DataFrame, key: str, url_col: str = "url", fetch: Fetch = fetch_http, host_slices: int = HOST_SLICES) -> DataFrame:
    """One row a row: the key, url, allowed, status and article text. Search engines' addresses, which lead elsewhere, are
    not asked for. Null and empty addresses have no page; repeated rows are asked for again."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        robots = Robots(fetch)
        for batch in batches:
            found = [page_of(u, robots, fetch) if asked else (False, None, "") for u, asked in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            columns = [pa.array([f[k] for f in found], t) for k, t in ((0, pa.bool_()), (1, pa.int32()), (2, pa.string()))]
            yield pa.record_batch([batch.column(0), batch.column(1), *columns], names=[key, "url", "allowed", "status", "text"])

    url = F.col(url_col)
    asked = _dealt(rows.select(key, url.alias("url"), (F.coalesce(url != "", F.lit(False)) & ~is_intermediary(F.coalesce(url, F.lit("")))).alias("asked")), F.coalesce("url", F.lit("")), host_slices)
    return asked.mapInArrow(run, f"`{key}` {kind}, url string, allowed boolean, status int, text string")


def resolved_urls(rows: DataFrame, key: str, url_col: str = "url", fetch: Fetch = fetch_http, host_slices: int = HOST_SLICES) -> DataFrame:
    """One row a row: the key and the canonical address, after following those of LEADS_ON; where that fails, their own."""
    kind = rows.schema[key].dataType.simpleString()

    def follow(url: str) -> str:
        try:
            status, _, final = fetch("HEAD", url, PAGE_SECONDS)
            return final if status < 400 else url
        except Exception:  # noqa: BLE001  an address that does not answer stays
            return url

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([follow(u) for u in batch.column(1).to_pylist()], pa.string())], names=[key, "url"])

    named = rows.select(key, F.col(url_col).alias("url"))
    leads = F.coalesce(F.contains("url", F.lit(LEADS_ON)), F.lit(False))
    followed = _dealt(named.filter(leads), F.col("url"), host_slices).mapInArrow(run, f"`{key}` {kind}, url string")
    return followed.unionByName(named.filter(~leads)).select(key, canonical_url("url").alias("url"))


__all__ = ["Robots", "fetch_pages", "page_of", "resolved_urls"]
