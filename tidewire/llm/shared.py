"""What the operators share: the folder that driver and executors both see, and joins that survive hot keys.

Every intermediate table is written under ``spark.checkpoint.dir``, so that a lost executor costs only the tasks it ran.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SETTING = "spark.checkpoint.dir"
#: A group with at least one part in HOT_PARTS of all rows is hot; there are at most HOT_PARTS of them.
HOT_PARTS = 400
#: Groups of fewer rows than this are broadcast whole: one small join instead of three.
FEW_ROWS = 50_000


def shared_root(spark: SparkSession) -> str:
    """The shared folder's address, which the session must name: a folder of one machine would lose rows on a cluster. A
    session on one machine alone (a local master) gets one of its own where none is named, for tests."""
    root = spark.conf.get(SETTING, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{SETTING} must name a folder that driver and executors share")
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="tidewire-")
        spark.conf.set(SETTING, root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, *paths: str) -> None:
    """Remove folders by Hadoop's file system, whatever store they are in."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Workspace:
    """Tables written for one operator run."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, new_folder(spark, name), 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write the rows and read them back: lineage ends here."""
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing will read again."""
        for t in tables:
            for f in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
                delete(self.spark, f)

    def only(self, df: DataFrame, name: str) -> DataFrame:
        """Write a result, and delete every other table of this run: nothing but the result can be read after that."""
        kept = self.keep(df, name)
        own = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        files = own.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for s in files.listStatus(own):
            if s.getPath().getName() != f"{self.n:03d}-{name}":
                files.delete(s.getPath(), True)
        return kept


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], size: Column, total: int, how: str = "left") -> DataFrame:
    """Join ``groups`` (one row a key, ``size`` its number of rows) to ``rows`` without putting a hot key in one task.

    Groups with at least ``total / HOT_PARTS`` rows number HOT_PARTS at most; these are broadcast, so their rows stay
    where they are. The others are joined by a shuffle, in which no key has more than ``total / HOT_PARTS`` rows. Below
    FEW_ROWS all groups are broadcast, as each join costs the driver a plan, and each broadcast a thread.
    """
    if total < FEW_ROWS:
        return rows.join(F.broadcast(groups), keys, how)
    is_hot = size * F.lit(HOT_PARTS) >= F.lit(int(total))
    hot, cold = groups.filter(is_hot), groups.filter(~is_hot)
    near = rows.join(F.broadcast(hot), keys, "inner")
    far = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how)
    return near.select(*far.columns).unionByName(far)


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def doc_frame(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Identifier and text alone, under fixed names; null text counts as empty. Other columns are not looked at."""
    return docs.select(F.col(id_col).cast(T.LongType()).alias("doc_id"), text_or_empty(text_col).alias("text"))
