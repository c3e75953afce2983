"""Daily issues as partitioned tables: whole days are replaced at once, look-backs read the days they need."""

from __future__ import annotations

import time
import uuid
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators.control import FolderJournal
from tidewire.operators.evidence import enrich
from tidewire.operators.graph import file_system

TABLES = ("issues", "articles", "events", "event_articles")


class IssueStore:
    """Four Parquet tables under one folder, by day. The four tables of a day are committed at once: their rows are written to
    new folders, and then one record, renamed to the next number, says which folders each day consists of. So a reader sees
    an issue as it was before or after a save, never half of it, and of two writers at the same moment the second commits on
    top of the first. Folders are never changed."""

    def __init__(self, spark: SparkSession, root: str, version: int | None = None):
        self.spark, self.root, self.pinned = spark, root.rstrip("/"), version
        self.journal = FolderJournal(spark, f"{self.root}/_commits")

    def version(self) -> int:
        return self.journal.last("issue")[0] if self.pinned is None else self.pinned

    def snapshot(self, version: int | None = None) -> IssueStore:
        """The store as it is now, or was at a version, whatever is saved later."""
        return IssueStore(self.spark, self.root, self.version() if version is None else version)

    def _days(self) -> dict[str, dict[str, str]]:
        """Each day's folder of each table."""
        record = self.journal.last("issue")[1] if self.pinned is None else self.journal.read("issue", self.pinned)
        return (record or {"days": {}})["days"]

    def exists(self, table: str) -> bool:
        return any(table in tables for tables in self._days().values())

    def table(self, name: str, days: dict[str, dict[str, str]] | None = None) -> DataFrame:
        found = self._days() if days is None else days
        paths = [f"{self.root}/{name}/commit=c-{t[name]}/issue_date={day}" for day, t in sorted(found.items()) if name in t]
        return self.spark.read.option("mergeSchema", "true").option("basePath", f"{self.root}/{name}").parquet(*paths).drop("commit")

    def _write(self, df: DataFrame, table: str, day: str) -> str:
        if self.pinned is not None:
            raise ValueError("a snapshot is read only")
        commit = uuid.uuid4().hex
        df.drop("issue_date").write.parquet(f"{self.root}/{table}/commit=c-{commit}/issue_date={day}")
        return commit

    def _commit(self, day: str, tables: dict[str, str], instead: dict[str, str] | None = None) -> bool:
        """Let a day consist of these folders from the next version on; False if ``instead`` of what is named, something else
        is there by now."""
        for _ in range(1000):
            number, record = self.journal.last("issue")
            days = (record or {"days": {}})["days"]
            own = days.get(day, {})
            if instead is not None and any(own.get(t) != c for t, c in instead.items()):
                return False
            if self.journal.write("issue", number + 1, {"days": {**days, day: {**own, **tables}}}):
                return True
        raise RuntimeError(f"the issue of {day} could not be committed")

    def save_issue(self, day: str, articles: DataFrame, events: DataFrame, bridge: DataFrame, metrics: DataFrame, warnings: list[str] | None = None, title: str = "Intelligence briefing", at: Column | None = None) -> None:
        """Articles need ``position``. A (event, article) pair is kept once, and one event id a day. Saving a day again takes
        the place of what was there."""
        issue = metrics.select(F.lit(title).alias("title"), F.array(*map(F.lit, warnings or [])).cast("array<string>").alias("warnings"), F.to_json(F.struct("*")).alias("metrics"), (at if at is not None else F.current_timestamp()).alias("created_at"), F.lit(None).cast("timestamp").alias("sent_at"))
        rows = {"articles": articles, "events": events.dropDuplicates(["event_id"]), "event_articles": bridge.dropDuplicates(["event_id", "article_id"]), "issues": issue}
        self._commit(day, {table: self._write(df, table, day) for table, df in rows.items()})

    def mark_sent(self, day: str, at: Column) -> None:
        """Only this day's issue is written anew, from the version that it was read in."""
        while day in (days := self._days()):
            issue = self.table("issues", {day: days[day]}).withColumn("sent_at", at)
            if self._commit(day, {"issues": self._write(issue, "issues", day)}, instead={"issues": days[day]["issues"]}):
                return

    def vacuum(self, keep: int = 2, grace_seconds: float = 86_400.0) -> int:
        """Delete folders that none of the last ``keep`` versions names and that are older than the time a writer or reader
        may need; how many."""
        last = self.journal.last("issue")[0]
        named = {(t, c) for n in range(max(1, last - keep + 1), last + 1) for tables in self.journal.read("issue", n)["days"].values() for t, c in tables.items()}
        gone, before = 0, (time.time() - grace_seconds) * 1000
        for table in TABLES:
            fs, path = file_system(self.spark, f"{self.root}/{table}")
            for s in fs.listStatus(path) if fs.exists(path) else []:
                if (table, s.getPath().getName().removeprefix("commit=c-")) not in named and s.getModificationTime() <= before:
                    gone += bool(fs.delete(s.getPath(), True))
        return gone

    def articles(self, day: str) -> DataFrame:
        """A day's articles with their events, by position. Only events of the same day count."""
        days = self._days()  # one version for both
        rows, events = (self.table(t, days).filter(F.col("issue_date") == day).drop("issue_date") for t in ("articles", "events"))
        return enrich(rows, events).orderBy("position")

    def latest_day(self) -> str | None:
        row = latest_issue(self.table("issues")).first() if self.exists("issues") else None
        return str(row["issue_date"]) if row else None

    def issues(self) -> DataFrame:
        """Days, latest first, with their number of articles, 0 included."""
        days = self._days()
        return issue_counts(self.table("issues", days), self.table("articles", days))

    def recent_articles(self, days: float, ref_time: Column, today: date, exclude_day: str | None = None) -> DataFrame:
        """Articles published (or else collected) within ``days``; only partitions that can hold such are read, one day
        of slack on each side. Older days hold articles collected then, which are older still."""
        if not self.exists("articles"):
            return self.spark.createDataFrame([], "title string, url string, source string, publisher string, canonical_url string, published_at timestamp, collected_at timestamp, seq long")
        rows = self.table("articles").filter(F.col("issue_date") >= F.lit((today - timedelta(days=int(days) + 1)).isoformat()))
        if exclude_day:
            rows = rows.filter(F.col("issue_date") != exclude_day)
        return look_back(rows, days, ref_time)

    def health(self) -> dict[str, object]:
        missing = [t for t in TABLES if not self.exists(t)]
        return {"ok": not missing, "missing": missing, "latest_issue": self.latest_day() if not missing else None}


def look_back(rows: DataFrame, days: float, ref_time: Column, published: str = "published_at", collected: str = "collected_at") -> DataFrame:
    """Rows at or after ``ref_time`` less ``days``, by time of publication, else of collection. No positive number of days
    gives no row."""
    try:
        days = float(days)
    except (TypeError, ValueError):
        days = 0.0
    if not days > 0:
        return rows.limit(0)
    at = F.coalesce(published, collected).cast("timestamp")
    return rows.filter(F.unix_micros(at) >= F.unix_micros(ref_time) - F.lit(int(days * 86_400_000_000)))


def latest_issue(issues: DataFrame) -> DataFrame:
    return issues.orderBy(F.col("issue_date").desc()).limit(1)


def issue_counts(issues: DataFrame, articles: DataFrame) -> DataFrame:
    """(issue_date, n_articles) of every issue. Articles are counted before the join."""
    n = articles.groupBy("issue_date").agg(F.count(F.lit(1)).alias("n"))
    return issues.join(n, "issue_date", "left").select("issue_date", F.coalesce("n", F.lit(0)).alias("n_articles")).orderBy(F.col("issue_date").desc())


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, and old ones whose key none has."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Old rows, and of new ones the first by ``order`` of each key that is not there yet."""
    fresh = new.join(old.select(*keys).distinct(), keys, "left_anti")
    first = fresh.groupBy(*keys).agg(F.min(order).alias(order))
    return old.unionByName(fresh.join(first, [*keys, order], "left_semi").dropDuplicates(keys), allowMissingColumns=True)


def delete_matching(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key).distinct(), key, "left_anti")


def json_list(text: Column) -> Column:
    """A JSON list of strings; an empty one where it is not."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
