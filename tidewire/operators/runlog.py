"""Records of what a run does: one JSON object a line, to a stream, and as a table; counts come along with the data."""

from __future__ import annotations

import json
import sys
import time
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime
from typing import TextIO

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

RECORD = "timestamp string, level string, component string, source string, event string, duration double, error string"
_NAMES = tuple(c.split()[0] for c in RECORD.split(", "))


class RunLog:
    """Collects records; writing them never fails a run."""

    def __init__(self, out: TextIO | None = None):
        self.out, self.records = out or sys.stdout, []

    def log(self, level: str, component: str, event: str, source: str | None = None, duration: float | None = None, error: object = None, at: datetime | None = None) -> dict:
        values = ((at or datetime.now(UTC)).isoformat(), level.upper(), component, source, event, None if duration is None else round(duration, 4), None if error is None else str(error))
        record = dict(zip(_NAMES, values, strict=True))
        self.records.append(record)
        try:
            print(json.dumps(record, ensure_ascii=False), file=self.out, flush=True)
        except (OSError, ValueError):
            pass  # a closed or full stream
        return record

    @contextmanager
    def timed(self, component: str, event: str, source: str | None = None) -> Iterator[None]:
        """Log how long a block took; what it raises is logged and raised on."""
        began = time.monotonic()
        try:
            yield
        except Exception as e:
            self.log("ERROR", component, event, source, time.monotonic() - began, e)
            raise
        self.log("INFO", component, event, source, time.monotonic() - began)

    def counted(self, df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
        """The rows, counted as they pass by, in the job that reads them anyway."""
        seen = Observation(name)
        return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(r[n] for n in _NAMES) for r in self.records], RECORD)
