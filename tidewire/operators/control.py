"""The control plane: run lock, schedule, settings. Small state and pure decisions; no data passes here.

State is a journal: numbered records, of which the last counts. A record is written under the next number, and only one
writer can take a number, so that of two who decide on the same state one is told that it was second.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import SparkSession

JOB = "daily_collection"
STALE_MINUTES = 30


class MemoryJournal:
    """Records by key, in this process alone."""

    def __init__(self) -> None:
        self.records: dict[str, list[dict]] = {}

    def last(self, key: str) -> tuple[int, dict | None]:
        own = self.records.get(key, [])
        return len(own), own[-1] if own else None

    def write(self, key: str, number: int, record: dict) -> bool:
        """Whether the number was free."""
        own = self.records.setdefault(key, [])
        if len(own) >= number:
            return False
        own.append(record)
        return True


class FolderJournal:
    """Records under a folder that all processes see: ``<key>/<number>/record.json``. A record's folder is written aside
    and renamed, which fails if the number is taken; renames are atomic on HDFS and local file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop

    def _path(self, name: str):
        return self.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def last(self, key: str) -> tuple[int, dict | None]:
        fs, at = self._fs(), self._path(key)
        number = max((int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit()), default=0) if fs.exists(at) else 0
        return (number, self.read(key, number)) if number else (0, None)

    def read(self, key: str, number: int) -> dict | None:
        """The record of that number; None before the first."""
        if number < 1:
            return None
        stream = self._fs().open(self._path(f"{key}/{number:09d}/record.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, key: str, number: int, record: dict) -> bool:
        fs, aside, final = self._fs(), self._path(f"{key}/.{uuid.uuid4().hex}"), self._path(f"{key}/{number:09d}")
        stream = fs.create(self.hadoop.fs.Path(aside, "record.json"))
        try:
            stream.write(json.dumps(record, ensure_ascii=False).encode())
        finally:
            stream.close()
        context = self.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            if not fs.exists(final):
                context.rename(aside, final, self.spark.sparkContext._gateway.new_array(self.hadoop.fs.Options.Rename, 0))
                return True
        except Exception as e:  # noqa: BLE001  only a taken number is an answer
            if "AlreadyExists" not in str(e) and "not empty" not in str(e):
                raise
        fs.delete(aside, True)
        return False


@dataclass
class RunLock:
    """Runs by (job, day). One can be taken that never ran, that failed, or that has been running for too long; a run that
    another process takes at the same moment is not ours."""

    issues: set[str] = field(default_factory=set)
    journal: MemoryJournal | FolderJournal = field(default_factory=MemoryJournal)

    @staticmethod
    def _key(job: str, day: str) -> str:
        return f"{job}/{day}"

    def state(self, day: str, job: str = JOB) -> dict | None:
        return self.journal.last(self._key(job, day))[1]

    def acquire(self, day: str, now: datetime, job: str = JOB, stale_minutes: int = STALE_MINUTES) -> bool:
        number, run = self.journal.last(self._key(job, day))
        started = datetime.fromisoformat(run["started_at"]) if run and run.get("started_at") else None
        fresh = started is not None and now < started + timedelta(minutes=stale_minutes)
        if run and (run["status"] == "completed" or run["status"] == "running" and fresh):
            return False
        return self.journal.write(self._key(job, day), number + 1, {**(run or {}), "status": "running", "started_at": now.isoformat(), "error": None})

    def _end(self, job: str, day: str, now: datetime, **what: object) -> None:
        for _ in range(100):
            number, run = self.journal.last(self._key(job, day))
            if self.journal.write(self._key(job, day), number + 1, {**(run or {"started_at": now.isoformat()}), "finished_at": now.isoformat(), **what}):
                return
        raise RuntimeError(f"the end of {job} on {day} could not be written")

    def finish(self, day: str, now: datetime, metrics: dict | None = None, job: str = JOB, status: str = "completed") -> None:
        self._end(job, day, now, status=status, metrics=metrics or {}, error=None)

    def fail(self, day: str, now: datetime, error: str, job: str = JOB) -> None:
        self._end(job, day, now, status="failed", error=str(error))

    def completed(self, day: str, job: str = JOB) -> bool:
        """Also true for any day that has an issue."""
        return day in self.issues or (self.state(day, job) or {}).get("status") == "completed"


def clock(text: str) -> tuple[int, int]:
    """HH:MM."""
    try:
        at = datetime.strptime(text.strip(), "%H:%M")  # noqa: DTZ007  a time of day alone
    except ValueError:
        raise ValueError(f"not a time of day as HH:MM: {text}") from None
    return at.hour, at.minute


@dataclass(frozen=True)
class Moment:
    """What a decision to run rests on."""

    now: datetime
    due: Callable[[], tuple[int, int]]
    done: Callable[[], bool]
    forced: bool


#: Why a run starts or not: the first reason that holds. Their names.
DECISIONS: tuple[tuple[str, bool, Callable[[Moment], bool]], ...] = (
    ("forced", True, lambda m: m.forced),
    ("before_scheduled_time", False, lambda m: (m.now.hour, m.now.minute) < m.due()),
    ("already_completed", False, lambda m: m.done()),
    ("scheduled_or_catchup", True, lambda m: True),
)


def should_run(now: datetime, at: str, lock: RunLock, force: bool = False) -> tuple[bool, str, str]:
    """(whether, day, why)."""
    day = f"{now:%Y-%m-%d}"
    moment = Moment(now, lambda: clock(at), lambda: lock.completed(day), force)
    return next((start, day, why) for why, start, holds in DECISIONS if holds(moment))


class SettingsStore:
    """Named values; each change is a whole new record, so readers see a change whole and none is lost to another."""

    KEY = "settings"

    def __init__(self, journal: MemoryJournal | FolderJournal):
        self.journal = journal

    def all(self) -> dict[str, str]:
        return self.journal.last(self.KEY)[1] or {}

    def update(self, changes: dict[str, object]) -> dict[str, str]:
        """Values are kept as text, nothing as empty text; others stay."""
        for _ in range(100):
            number, now = self.journal.last(self.KEY)
            new = {**(now or {}), **{k: "" if v is None else str(v) for k, v in changes.items()}}
            if self.journal.write(self.KEY, number + 1, new):
                return new
        raise RuntimeError("settings could not be written")


def flag(text: str | None, default: bool) -> bool:
    """A setting as a flag."""
    return default if text is None or not text.strip() else text.strip().lower() in {"1", "true", "yes", "on"}


def recipients(text: str | None) -> list[str]:
    """Addresses between commas or semicolons, each once."""
    found = [p.strip() for p in (text or "").replace(";", ",").split(",")]
    return list(dict.fromkeys(p for p in found if p))


@dataclass(frozen=True)
class MailSettings:
    host: str = ""
    port: int = 587
    user: str = ""
    password: str = ""
    sender: str = ""
    to: tuple[str, ...] = ()

    def missing(self) -> list[str]:
        return [n for n in ("host", "sender", "to") if not getattr(self, n)]

    def overridden(self, saved: dict[str, str]) -> MailSettings:
        """Saved values that are not empty take the place of configured ones."""
        new = {k: v for k, v in saved.items() if v and k in self.__dataclass_fields__}
        if "port" in new:
            new["port"] = int(new["port"])
        if "to" in new:
            new["to"] = tuple(recipients(new["to"]))
        return MailSettings(**{**self.__dict__, **new})

    def redacted(self) -> dict[str, object]:
        return {**self.__dict__, "password": "********" if self.password else ""}
