"""Joins and components with hot keys, against plain ones."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from tidewire.operators import graph


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("few", [0, 10**9])
def test_spread_joins_are_joins(spark, monkeypatch, how, few):
    monkeypatch.setattr(graph, "FEW_ROWS", few)
    rows = spark.range(3000).select((F.col("id") % 1000).alias("id"), F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 700).alias("k"))
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top")).filter("k != 5")
    got = graph.spread_join(rows, groups, ["k"], "n", 3000, how)
    assert sorted(map(str, got.select("k", "id", "top").collect())) == sorted(map(str, rows.join(groups, "k", how).select("k", "id", "top").collect()))


@pytest.mark.parametrize("few", [0, 10**9])
def test_components_of_stars_and_chains(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW_ROWS", few)
    rng = random.Random(4)
    edges = [(7, k) for k in range(100, 900)] + [(k, k + 1) for k in range(2000, 2300)] + [(rng.randrange(5000, 5400), rng.randrange(5000, 5400)) for _ in range(260)] + [(1, 1), (3, 2), (2, 3)]
    label = {v: v for e in edges for v in e}

    def top(v):
        while label[v] != v:
            v = label[v]
        return v

    for u, v in edges:
        a, b = sorted((top(u), top(v)))
        label[b] = a
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {v: top(v) for e in edges if e[0] != e[1] for v in e}


def test_a_star_of_a_hundred_thousand_edges(spark):
    found = graph.components(spark.range(1, 100_001).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v")))
    assert found.agg(F.count(F.lit(1)), F.max("component")).first() == (100_001, 0)
