"""Tables in the shared folder, joins that survive hot keys, and connected components of an edge table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with at least one in HOT_SHARE of all rows is hot; no more than HOT_SHARE keys can be.
HOT_SHARE = 500
#: Below so many rows a key that has them all is no burden, and one join is enough.
FEW_ROWS = 50_000


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share. A session on one machine alone (a local master)
    gets one of its own where none is named, for tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="tidewire-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back, so that loops don't grow plans and a lost executor costs
    little."""
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of an address, and the address as its path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` has written and nothing will read again."""
    for t in tables:
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            fs, path = file_system(t.sparkSession, folder)
            fs.delete(path, True)


def spread_join(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``groups``, one row a key with the number of ``rows`` that have it under ``size``. Hot keys, of
    which there are HOT_SHARE at most, are broadcast, so that their rows stay in the tasks they are in; the others are
    shuffled, and none of them makes a large partition. ``how`` is inner or left."""
    if total < FEW_ROWS:
        return rows.join(groups, keys, how).drop(size)
    hot_one = F.col(size) * HOT_SHARE >= max(int(total), 1)
    hot, cold = groups.filter(hot_one), groups.filter(~hot_one)
    here = rows.join(F.broadcast(hot), keys)
    there = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how)
    return here.unionByName(there).drop(size)


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(id, component) of every vertex of undirected edges (u, v): the smallest id it reaches.

    Labels fall to the smallest neighbouring label and then to the label's own label, so that chains halve each round.
    Vertices with very many edges, and labels that very many vertices have, are looked up by broadcast."""
    both = cut(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u != v").distinct())
    n_edges = both.count()
    degrees = both.groupBy(F.col("u").alias("id")).agg(F.count(F.lit(1)).alias("degree"), F.least(F.col("id"), F.min("v")).alias("label"))
    labels = cut(degrees)
    for _ in range(most_rounds):
        known = labels.select(F.col("id").alias("v"), "degree", F.col("label").alias("other"))
        near = spread_join(both, known, ["v"], "degree", n_edges).groupBy(F.col("u").alias("id")).agg(F.min("other").alias("low"))
        low = cut(labels.join(near, "id").select("id", "degree", F.least("label", "low").alias("label"), F.col("label").alias("was")))
        shared = low.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        jump = shared.join(labels.select(F.col("id").alias("label"), F.col("label").alias("far")), "label", "left")
        new = cut(spread_join(low, jump, ["label"], "n", n_edges).select("id", "degree", F.least("label", F.coalesce("far", "label")).alias("label"), "was"))
        settled = new.filter("label != was").isEmpty()
        forget(labels, low)
        labels = new
        if settled:
            forget(both)
            return labels.select("id", F.col("label").alias("component"))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")

