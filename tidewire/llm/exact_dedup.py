"""Exact deduplication: group by a 128-bit content hash, keep one stable id, compare bytes inside the groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import HOT_PARTS, Workspace, attach, doc_frame


def content_hash(text: Column) -> Column:
    """128 bits of the text."""
    return F.unhex(F.md5(text))


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    hash_fn: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row a row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep`` names whether the smallest ("min") or the largest ("max") id of a group stays.

    1. Hashes are counted with a map-side combine, so a group that holds a third of all rows costs one row a task.
    2. Rows of groups of two or more get their group's winner; hot groups by a broadcast of at most HOT_PARTS keys.
    3. Each such row is compared byte for byte with the winner's text; the winner is repeated for slices of a hot group.
    4. Rows that differ from the winner (a collision) are grouped by hash and text itself.

    Null text counts as empty, and all empty texts are equal. A row without an id ranks behind all others; if a whole
    group has no id, keep_id is null and each of its rows is kept. Rows that repeat an id and a text are each returned,
    with the same values. An empty table gives an empty result. Other columns are ignored.
    """
    if keep not in ("min", "max"):
        raise ValueError(f"keep is min or max, not {keep!r}")
    spark: SparkSession = docs.sparkSession
    best = F.min if keep == "min" else F.max
    work = Workspace(spark, "exact-dedup")
    base = doc_frame(docs, id_col, text_col).withColumn("h", hash_fn(F.col("text")))

    sizes = work.keep(base.groupBy("h").agg(best("doc_id").alias("win"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "groups")
    total = base.count()
    rows = work.keep(
        attach(base.withColumn("text_sha256", F.sha2("text", 256)), sizes, ["h"], F.col("n"), total).select(
            "doc_id", "h", "text_sha256", "win", F.coalesce("n", F.lit(1)).alias("n"), F.when(F.col("n") > 1, F.col("text")).alias("text")
        ),
        "rows",
    )
    alone = rows.filter("n = 1").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )

    slices = F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(HOT_PARTS) / F.lit(max(total, HOT_PARTS)))).cast("int")
    many = rows.filter("n > 1").withColumn("slice", F.pmod(F.xxhash64("doc_id", F.lit(7)), slices).cast("int"))
    winners = (
        rows.filter("n > 1 and doc_id = win")
        .select("h", "n", F.col("text").alias("win_text"))
        .dropDuplicates(["h"])
        .select("h", "win_text", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"))
    )
    compared = many.join(winners, ["h", "slice"], "left").select(
        "doc_id", "h", "text_sha256", "win", "n", "text", F.coalesce(F.col("text") == F.col("win_text"), F.lit(False)).alias("same")
    )
    checked = work.keep(compared.withColumn("text", F.when(~F.col("same"), F.col("text"))), "checked")

    def flagged(df: DataFrame) -> DataFrame:
        kept = F.when(F.col("keep_id").isNull(), F.lit(True)).otherwise(F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)))
        return df.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")

    same = checked.filter("same").withColumn("keep_id", F.col("win"))
    if checked.filter("not same").isEmpty():
        return work.only(alone.unionByName(flagged(same.withColumn("group_size", F.col("n")))), "result")
    # Collisions, and groups in which no row has an id.
    other = checked.filter("not same")
    left_out = other.groupBy("h").agg(F.count(F.lit(1)).alias("out"))
    same = attach(same, left_out, ["h"], F.col("out"), total).withColumn("group_size", F.col("n") - F.coalesce("out", F.lit(0)))
    exact = other.groupBy("h", "text").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    apart = attach(other.select("doc_id", "h", "text", "text_sha256"), exact, ["h", "text"], F.col("group_size"), total)
    return work.only(alone.unionByName(flagged(same)).unionByName(flagged(apart)), "result")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """``docs`` without the rows whose text another row keeps; all columns stay.

    Ids are expected to be unique; rows that repeat id and text are all kept or all dropped. A row without an id stays
    only if no row with its text has one.
    """
    found = exact_groups(docs, id_col, text_col, keep)
    gone = found.filter("not kept and doc_id is not null").select(F.col("doc_id").alias("_gone"), F.col("text_sha256").alias("_sha")).distinct()
    sha = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    kept = docs.join(gone, (docs[id_col] == gone["_gone"]) & (sha == gone["_sha"]), "left_anti")
    nameless = found.filter("not kept and doc_id is null").select(F.col("text_sha256").alias("_sha")).distinct()
    stay = kept.filter(F.col(id_col).isNotNull())
    rest = kept.filter(F.col(id_col).isNull())
    return stay.unionByName(rest.join(nameless, F.sha2(F.coalesce(rest[text_col], F.lit("")), 256) == nameless["_sha"], "left_anti"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``; of equal texts the row with the largest doc_id stays."""
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="max")


OP5_SQL = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
             count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size FROM documents)
"""
