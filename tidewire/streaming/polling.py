"""Feeds as an unbounded source: each poll gives the entries that no earlier poll has given."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from hashlib import blake2b

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidewire import rules
from tidewire.sources.feeds import RAW, fetcher, listed, parse_feed, read_feed

#: Polls of a whole feed whose entries an offset remembers; feeds that the driver asks at a time.
REMEMBERED, AT_A_TIME = 4, 16


def entry_key(link: str | None, title: str | None) -> str:
    """What an entry is known by: its address, else its title."""
    return blake2b((link or title or "").strip().encode(), digest_size=8).hexdigest()


class FeedStream(DataSource):
    """``spark.readStream.format("tidewire_feed_stream")``: options as for the batch source."""

    @classmethod
    def name(cls) -> str:
        return "tidewire_feed_stream"

    def schema(self) -> str:
        return RAW

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:  # noqa: N802
        return FeedPoller(self.options)


@dataclass
class _Fresh(InputPartition):
    feed_id: str
    url: str
    keys: frozenset


class FeedPoller(DataSourceStreamReader):
    """An offset holds, for each feed, the keys of the entries that it showed, latest first, and so is in Spark's own
    checkpoint. The driver asks all feeds for their keys; a task a feed with new ones fetches it again and gives those entries
    that the end offset names and the start offset does not, so a batch that runs again gives the same ones, and what
    appeared meanwhile waits for the next. An entry that its feed has dropped between the two is lost.

    A feed that fails in a poll keeps the keys it had; one that fails in a task fails the task, which Spark runs again. A feed
    that is unchanged plans no task. Changed order, and entries that come back within ``REMEMBERED`` times the cap, give
    nothing twice.
    """

    def __init__(self, options: dict):
        self.feeds, self.fetch, self.cap = dict(listed(options)), fetcher(options), int(options.get("cap", rules.FEED_CAP))
        self.known: dict[str, list[str]] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"feeds": {}}

    def _showing(self, feed_id: str) -> list[str] | None:
        try:
            status, data = self.fetch(feed_id, self.feeds[feed_id])
            return [entry_key(e["link"], e["title"]) for e in parse_feed(data)[: self.cap]] if status < 400 else None
        except Exception:  # noqa: BLE001  a feed's failure is no failure of the poll
            return None

    def latestOffset(self) -> dict:  # noqa: N802
        with ThreadPoolExecutor(AT_A_TIME) as pool:
            shown = dict(zip(self.feeds, pool.map(self._showing, self.feeds), strict=True))
        for feed_id, keys in shown.items():
            if keys is not None:
                # What was there stays in its place, so that an unchanged feed gives an equal offset.
                had = self.known.get(feed_id, [])
                new = [k for k in dict.fromkeys(keys) if k not in set(had)]
                self.known[feed_id] = (new + had)[: REMEMBERED * self.cap] if new else had
        return {"feeds": {f: " ".join(keys) for f, keys in self.known.items()}}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out = []
        for feed_id, keys in end["feeds"].items():
            before = start["feeds"].get(feed_id, "").split()
            self.known[feed_id] = list(dict.fromkeys([*self.known.get(feed_id, []), *keys.split(), *before]))[: REMEMBERED * self.cap]
            fresh = frozenset(keys.split()) - frozenset(before)
            if fresh and feed_id in self.feeds:
                out.append(_Fresh(feed_id, self.feeds[feed_id], fresh))
        for feed_id, keys in start["feeds"].items():
            self.known.setdefault(feed_id, keys.split())
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        columns = [c.split()[0] for c in RAW.split(", ")]
        given: set[str] = set()
        for row in read_feed(partition.feed_id, partition.url, lambda url: self.fetch(partition.feed_id, url), cap=10 * self.cap):
            r = dict(zip(columns, row, strict=True))
            if r["error"]:
                raise RuntimeError(f"{partition.feed_id}: {r['error']}")
            key = entry_key(r["link"], r["title"])
            if r["pos"] is not None and key in partition.keys and key not in given:
                given.add(key)
                yield row

    def commit(self, end: dict) -> None:
        """Nothing is kept outside the checkpoint."""


def poll_feeds(spark: SparkSession, **options: str) -> DataFrame:
    spark.dataSource.register(FeedStream)
    return spark.readStream.format("tidewire_feed_stream").options(**options).load()
