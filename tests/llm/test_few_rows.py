"""Small tables: one join where three were planned, with the rows that the three give."""

import pytest
from pyspark.sql import functions as F

from tidewire.llm import near_dedup, shared


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("how", ["left", "inner"])
def test_groups_of_few_rows_are_attached_by_one_join(spark, monkeypatch, how):
    rows = spark.createDataFrame([(i % 7 if i % 3 else 0, i) for i in range(200)] + [(99, 200), (None, 201)], "k long, x long")
    groups = rows.filter("k < 99").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    few = shared.attach(rows, groups, ["k"], F.col("n"), 202, how)
    assert "Union" not in _plan(few) and _plan(few).count("Join") == 1
    found = sorted(few.collect(), key=lambda r: r["x"])
    monkeypatch.setattr(shared, "FEW_ROWS", 0)
    many = shared.attach(rows, groups, ["k"], F.col("n"), 202, how)
    assert "Union" in _plan(many)
    assert found == sorted(many.collect(), key=lambda r: r["x"])


def test_classes_are_the_same_without_the_shortcuts(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[:50] + [f"x{i % 4}"] * (i % 3)) for i in range(60)] + [" ".join(words[i : i + 20]) for i in range(30)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sorted(map(tuple, near_dedup.near_groups(docs, percent=80).collect()))
    monkeypatch.setattr(shared, "FEW_ROWS", 0)
    monkeypatch.setattr(near_dedup, "LEAST_HOT", 1)
    assert found == sorted(map(tuple, near_dedup.near_groups(docs, percent=80).collect()))
