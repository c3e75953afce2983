"""Licence scans of texts that repeat one thing a million times."""

from __future__ import annotations

import pytest
from tidewire.llm.licenses import scan_licenses

MANY = 1_000_000


@pytest.mark.parametrize(
    "middle",
    ["\n" * MANY, "\r" * MANY, "\r\n" * MANY, " \t\n" * MANY, "# \n" * MANY, "*" * MANY, "//" * MANY, "- " * MANY, "|~" * MANY, ". " * MANY, ":;" * MANY, "\n# copyright (c) x" * (MANY // 4), " " * MANY, "copyright | ~ " * (MANY // 4), "all rights\n" * (MANY // 4)],
    ids=lambda m: repr(m[:6]),
)
def test_a_million_times(spark, middle):
    text = f"License.\nReleased under the MIT License.\n{middle}\nLicensed under the Apache License, Version 2.0.\n{middle}"
    rows = scan_licenses(spark.createDataFrame([(1, text), (1, text), (2, "")], "doc_id long, text string")).collect()
    assert [r["licenses"] for r in rows] == ["MIT,Apache-2.0"] * 2 + [""] and rows[0]["n_known"] == 2
