"""Very many rows that are alike, very long texts, and very many shards."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from tidewire.llm import packing
from tidewire.llm.token_files import shard_count, with_starts


def test_a_million_rows_without_id_alike(spark):
    same = spark.range(1_000_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("three words here").alias("text"), F.lit(None).cast("string").alias("source"))
    other = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("s").alias("source"))
    packed = packing.pack(same.unionByName(other), capacity=64).withColumn("block", F.shiftright("bin_id", 32))
    blocks = packed.groupBy("block").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("doc_id").isNull()).alias("alike")).collect()
    assert sum(r["alike"] for r in blocks) == 1_000_000 and sum(r["rows"] for r in blocks) == 1_005_000
    assert len(blocks) > 400 and max(r["rows"] for r in blocks) < 2 * packing.BLOCK_DOCS
    bins = packed.groupBy("bin_id").agg(F.sum("length").alias("length"), F.count_if(F.col("doc_id").isNull()).alias("alike"), F.count_if(F.col("doc_id").isNotNull()).alias("of_s"))
    worst = bins.agg(F.max("length"), F.max("alike"), F.max("of_s")).first()
    assert tuple(worst) == (5, 1, 1)  # one of the rows that are alike, one of the source


def test_blocks_are_bounded_by_bytes(spark):
    df = spark.range(200).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 2000).alias("text"), F.concat(F.lit("s"), "id").alias("source"))
    packed = packing.pack(df, capacity=1500, block_bytes=100_000)
    per = Counter(r["bin_id"] >> 32 for r in packed.select("bin_id").collect())
    assert len(per) > 15 and sum(per.values()) == 400 and max(per.values()) <= 2 * 30
    assert {r["t"] for r in packed.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "text"))), lambda p: p["text"]), "").alias("t")).collect()} == {"word " * 2000}


def test_the_result_depends_on_the_rows_alone(spark):
    rows = [(1, "a b", "s")] * 50 + [(None, "c", None)] * 40 + [(i % 7, f"w {i}", f"s{i % 3}") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, two = (sorted(map(tuple, packing.pack(d, capacity=9, block_docs=20).collect()), key=repr) for d in (df.coalesce(1), df.orderBy(F.rand(3)).repartition(7)))
    assert one == two and Counter(r[0] for r in one) == Counter(r[0] for r in rows)


def test_shards_grow_before_there_are_more(spark):
    assert shard_count(0) == 1 and shard_count(30 << 30) == 1280 and shard_count(200 << 40) < 10**6
    assert [shard_count(n << 30) for n in (96, 1024, 4096)] == [4096, 4096, 8192]
    manifest = spark.range(5000).filter("id % 11 != 3").select(F.col("id").cast("int").alias("part"), (F.col("id") % 13 + 1).alias("n_tokens")).repartition(5)
    at = 0
    for r in sorted(with_starts(manifest).collect(), key=lambda r: r["part"]):
        assert r["shard_start"] == at
        at += r["n_tokens"]
