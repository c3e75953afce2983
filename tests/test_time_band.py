"""Pairs near in time by key: counted as they are listed, and without listing them where they are too many."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from tidewire.operators.similarity import near_counts, near_in_time


@pytest.mark.parametrize("seed", range(3))
def test_counts_are_those_of_the_pairs(spark, seed):
    rng, hour = random.Random(seed), 3600
    rows = [(rng.randrange(120), rng.choice(["a", "b", None]), rng.choice([None, *(k * 24 * hour + d for k in range(-4, 12) for d in (-1, 0, 1, 7))])) for _ in range(200)]
    df = spark.createDataFrame(rows, "p int, k string, s long")
    width = 72 * hour
    want = {}
    for i, (p, k, s) in enumerate(rows):
        for q, m, t in rows[:i]:
            if k is not None and k == m and p != q and None not in (s, t) and abs(s - t) <= width:
                want[k] = want.get(k, 0) + 1
    assert {r.key: r.n for r in near_counts(df, "k", "p", "s").collect()} == want
    listed = near_in_time(df, "k", "p", "s").groupBy("key").count()
    assert {r["key"]: r["count"] for r in listed.collect()} == want


def test_a_key_that_all_rows_have(spark):
    """45 billion pairs are counted, not made."""
    n = 300_000
    rows = spark.range(n).select(F.col("id").alias("p"), F.lit("m").alias("k"), (F.col("id") % 259_200).alias("s"))
    assert [tuple(r) for r in near_counts(rows, "k", "p", "s").collect()] == [("m", n * (n - 1) // 2)]
    assert near_counts(rows.limit(1), "k", "p", "s").collect() == []
