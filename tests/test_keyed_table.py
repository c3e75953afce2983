"""Merges into keyed tables: what they rewrite, and what they leave."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.operators.keyed import KeyedTable


def content(t, *columns, version=None):
    return sorted((tuple(r) for r in t.read(version).select(*columns).collect()), key=repr)


def test_only_files_that_hold_a_key_are_rewritten(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/t", ["k"], buckets=16)
    assert t.upsert(spark.range(2000).select(F.col("id").alias("k"), F.lit("a").alias("v"))) == []
    before = set(t.files())
    assert len(before) == 16
    hit = t.upsert(spark.createDataFrame([(5, "b"), (5, "c"), (9999, "d")], "k int, v string"), order="v")  # an int meets a long
    after = set(t.files())
    assert len(hit) == 1 and before - after == set(hit)  # the new key rewrites nothing
    assert content(t, "k", "v") == sorted([(i, "c" if i == 5 else "a") for i in range(2000)] + [(9999, "d")], key=repr)
    assert t.read(1).count() == 2000 and t.read(1).filter("v = 'c'").isEmpty()  # a version stays as it was


def test_inserts_rewrite_nothing_and_deletes_what_they_meet(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/t", ["a", "b"], buckets=4)
    rows = [(None, 1, "x"), (1, None, "y"), (2, 2, "z")]
    t.insert_new(spark.createDataFrame(rows, "a long, b long, v string"))
    old = set(t.files())
    t.insert_new(spark.createDataFrame([(None, 1, "no"), (3, 3, "w2"), (3, 3, "w1"), (1, None, "no")], "a long, b long, v string"))
    assert old <= set(t.files())
    assert content(t, "a", "b", "v") == sorted([*rows, (3, 3, "w1")], key=repr)  # null equals null; the smallest of a key
    assert len(t.delete(spark.createDataFrame([(None, 1), (8, 8)], "a long, b long"))) == 1
    assert content(t, "a", "b", "v") == sorted([*rows[1:], (3, 3, "w1")], key=repr)


def test_new_columns_empty_tables_and_compaction(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/t", ["k"], buckets=2)
    assert t.read().count() == 0
    t.upsert(spark.createDataFrame([], "k long, v long"))
    assert t.read().columns == ["k", "v"] and t.files() == []
    for i in range(6):
        t.upsert(spark.createDataFrame([(i, i), (100 + i, i)], "k long, v long"))
    t.upsert(spark.createDataFrame([(3, "new")], "k long, w string"))
    want = content(t, "k", "v", "w")
    assert len(want) == 12 and (3, None, "new") in want
    assert t.compact(most_files=2) and len(t.files()) <= 4 and content(t, "k", "v", "w") == want


def test_two_writers_at_once(spark, tmp_path):
    one, two = (KeyedTable(spark, f"file://{tmp_path}/t", ["k"], buckets=2) for _ in range(2))
    one.upsert(spark.createDataFrame([(1, "a"), (2, "a")], "k long, v string"))
    write = one.journal.write

    def late(name, number, record):  # the other writer comes in between
        one.journal.write = write
        two.upsert(spark.createDataFrame([(1, "two"), (3, "two")], "k long, v string"))
        return write(name, number, record)

    one.journal.write = late
    one.upsert(spark.createDataFrame([(2, "one"), (3, "one")], "k long, v string"))
    assert content(two, "k", "v") == [(1, "two"), (2, "one"), (3, "one")]
