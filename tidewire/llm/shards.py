"""Shards under a versioned manifest, with size-tiered compaction. DataFrame operations only.

A store is a folder: ``data/<append>/...parquet`` are immutable shards, ``_manifest/v<number>`` lists the shards that make
up one version (name, rows, bytes, seq, generation) and the columns of its rows. A version appears by one rename that fails
if it exists already, so that readers see whole versions and two writers cannot both commit the same number. Renames are
atomic on HDFS and local file systems; on a store without that, the manifest folder needs one that has it.

Appends write what arrives as small shards, without a shuffle. Compaction puts shards in tiers by size, takes runs of
neighbours within a tier up to the target size, and rewrites each run of ``min_run`` or more as one shard. Only shards
that merge are read and shuffled, each run to a task of its own.

Rows are kept as they are: nulls in any column, empty and very long texts, repeated rows. An empty table appends no shard.
Columns may differ between appends: a version has the columns of all of them, null where a shard has none; one name with
two types is refused.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import new_folder

#: Bytes of a finished shard; sizes up to the base are one tier, each further tier is FACTOR times larger.
TARGET_BYTES, BASE_BYTES, FACTOR, MIN_RUN = 64 << 20, 4 << 20, 4, 4
#: A plan with more shards than this is joined by a shuffle, not broadcast.
BROADCAST_SHARDS = 100_000
#: What no version lists may be another writer's that has not committed yet; it is left alone for so long. So many of the
#: newest versions stay readable however old they are.
GRACE_SECONDS, KEEP_VERSIONS = 86_400.0, 2
#: How often a writer that others overtook bases its commit on the newest version.
TRIES = 20
MANIFEST = "name string, rows long, bytes long, seq long, generation long"
_SHARD = "/(data/[0-9a-f]{32}/.*)$"


class CommitConflict(RuntimeError):
    """Another writer has committed the version."""


def fresh(taken: list[str], base: str) -> str:
    """A column name that no column has."""
    low = {c.lower() for c in taken}
    while base.lower() in low:
        base += "_"
    return base


def merged_columns(old: T.StructType, new: T.StructType) -> T.StructType:
    """The columns of both, without the writer's word on nulls. A name, in any case, has one type."""
    found = {}
    for f in [*old.fields, *new.fields]:
        had = found.setdefault(f.name.lower(), T.StructField(f.name, f.dataType, True))
        if had.dataType != f.dataType:
            raise ValueError(f"column {f.name} is {had.dataType.simpleString()} and {f.dataType.simpleString()}")
    return T.StructType(list(found.values()))


class ShardStore:
    """A folder of shards. ``root`` is an address that all executors see."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET_BYTES, base: int = BASE_BYTES, factor: int = FACTOR, min_run: int = MIN_RUN):
        self.spark, self.root, self.target, self.base, self.factor, self.min_run = spark, root.rstrip("/"), target, base, factor, min_run

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _versions(self) -> list[tuple[int, float]]:
        """Numbers of the versions there are, oldest first, and when each was committed."""
        fs, at = self._fs(), self._path("_manifest")
        found = [(s.getPath().getName(), s.getModificationTime() / 1000) for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted((int(n[1:]), t) for n, t in found if n[:1] == "v" and n[1:].isdigit())

    def version(self) -> int:
        """The newest version; 0 before the first commit."""
        return max((v for v, _ in self._versions()), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        reader = self.spark.read.schema(MANIFEST)
        return reader.parquet(f"{self.root}/_manifest/v{v:010d}") if v else self.spark.createDataFrame([], MANIFEST)

    def schema(self, version: int | None = None) -> T.StructType:
        """The columns of a version's rows."""
        v = self.version() if version is None else version
        if not v:
            return T.StructType([])
        stream = self._fs().open(self._path(f"_manifest/v{v:010d}/_columns.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return T.StructType.fromJson(json.loads(text))

    def commit(self, entries: DataFrame, expected: int, columns: T.StructType | None = None) -> int:
        """Make ``entries`` the version after ``expected``; CommitConflict if someone else has."""
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        pending = f"_manifest/.pending-{uuid.uuid4().hex}"
        columns = self.schema(expected) if columns is None else columns
        entries.select("name", "rows", "bytes", "seq", "generation").coalesce(1).write.parquet(f"{self.root}/{pending}")
        stream = self._fs().create(self._path(f"{pending}/_columns.json"))
        try:
            stream.write(columns.json().encode("utf-8"))
        finally:
            stream.close()
        hadoop = jvm.org.apache.hadoop
        context = hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        final = self._path(f"_manifest/v{expected + 1:010d}")
        try:
            if self._fs().exists(final):
                raise CommitConflict(f"version {expected + 1} exists")
            context.rename(self._path(pending), final, gateway.new_array(hadoop.fs.Options.Rename, 0))
        except CommitConflict:
            self._fs().delete(self._path(pending), True)
            raise
        except Exception as e:
            self._fs().delete(self._path(pending), True)
            if "AlreadyExists" in str(e):
                raise CommitConflict(f"version {expected + 1} exists") from e
            raise
        return expected + 1

    def _written(self, folder: str, generation: int) -> DataFrame:
        """Manifest entries of the files of one folder, without their seq: rows are counted, columns not read."""
        path = f"{self.root}/{folder}"
        if not any(s.getPath().getName().endswith(".parquet") or s.isDirectory() for s in self._fs().listStatus(self._path(folder))):
            return self.spark.createDataFrame([], MANIFEST).drop("seq")
        files = self.spark.read.option("recursiveFileLookup", "true").schema(T.StructType([])).parquet(path)
        found = files.groupBy(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("bytes")).agg(F.count(F.lit(1)).alias("rows"))
        return found.select(F.regexp_extract("p", _SHARD, 1).alias("name"), "rows", "bytes", F.lit(generation).cast("long").alias("generation")).filter("rows > 0")

    def _publish(self, new: DataFrame, columns: T.StructType, gone: DataFrame | None = None) -> int:
        """Commit the newest version without the shards ``gone`` and with ``new``, which are as old as the version. Others
        may commit meanwhile; CommitConflict if one of them has taken away what is to go."""
        new = new.cache()
        try:
            for _ in range(TRIES):
                v = self.version()
                now = self.manifest(v)
                stay = now
                if gone is not None:
                    stay = now.join(gone.select("name"), "name", "left_anti")
                    if now.count() - stay.count() != gone.count():
                        raise CommitConflict("shards that were to merge are gone")
                try:
                    return self.commit(stay.unionByName(new.withColumn("seq", F.lit(v + 1).cast("long"))), v, merged_columns(self.schema(v), columns))
                except CommitConflict:
                    continue
            raise CommitConflict(f"overtaken {TRIES} times")
        finally:
            new.unpersist()

    def append(self, rows: DataFrame, arrival: F.Column | None = None) -> int:
        """Write rows as small shards and commit them. With ``arrival`` the rows of each value (null is one) get shards of
        their own, as if each had been appended alone."""
        merged_columns(self.schema(), rows.schema)  # refused before anything is written
        folder, extra = f"data/{uuid.uuid4().hex}", fresh(rows.columns, "arrival")
        if arrival is None:
            rows.write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
        else:
            rows.withColumn(extra, F.xxhash64(arrival)).write.option("compression", "zstd").partitionBy(extra).parquet(f"{self.root}/{folder}")
        return self._publish(self._written(folder, 0), rows.schema)

    def plan(self, entries: DataFrame) -> DataFrame:
        """The shards that merge and the run of each: name, run. One row a shard; no row of data is looked at.

        Shards of the target size are finished. Within a tier, in order of age, shards are gathered until their bytes
        reach the target; a run of fewer than ``min_run`` shards waits for more."""
        tier = F.greatest(F.lit(0), F.ceil(F.log(F.col("bytes") / F.lit(float(self.base))) / F.log(F.lit(float(self.factor)))))
        by_age = Window.partitionBy("tier").orderBy("seq", "name")
        small = entries.filter(F.col("bytes") < self.target).withColumn("tier", tier.cast("int"))
        run = F.floor((F.sum("bytes").over(by_age) - F.col("bytes")) / F.lit(self.target)).cast("long")
        runs = small.withColumn("k", run).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("tier", "k")))
        runs = runs.filter(F.col("n") >= self.min_run)
        return runs.select("name", (F.col("tier") * F.lit(1 << 40) + F.col("k")).alias("run"))

    def read(self, version: int | None = None, shard_col: str | None = None, names: DataFrame | None = None) -> DataFrame:
        """The rows of a version (or of some of its shards); ``shard_col`` adds the shard's name. The names go from the
        manifest to the scan within the JVM, which holds the paths of any scan."""
        v = self.version() if version is None else version
        entries, schema = self.manifest(v) if names is None else names, self.schema(v)
        jvm = self.spark._jvm
        paths = entries.select(F.concat(F.lit(f"{self.root}/"), "name").alias("p"))._jdf.toDF()
        paths = getattr(paths, "as")(jvm.org.apache.spark.sql.Encoders.STRING()).collectAsList()
        if not paths.size():
            empty = self.spark.createDataFrame([], schema)
            return empty.withColumn(shard_col, F.lit("")) if shard_col else empty
        rows = DataFrame(self.spark.read.schema(schema)._jreader.parquet(jvm.PythonUtils.toSeq(paths)), self.spark)
        return rows.select("*", F.regexp_extract(F.col("_metadata.file_path"), _SHARD, 1).alias(shard_col)) if shard_col else rows

    def compact(self) -> int | None:
        """Merge what the plan names and commit; None if nothing is to merge. Appends may be committed meanwhile. On
        CommitConflict (another compaction was first) call it again: the new shards are no part of any version then, and
        ``vacuum`` removes them in time."""
        v = self.version()
        plan = self.plan(self.manifest(v)).cache()
        try:
            size, n_runs = plan.agg(F.count(F.lit(1)), F.countDistinct("run")).first()
            if not size:
                return None
            # One number a run, without gaps: a task of its own for each. There is a row a run, not one a shard.
            numbers = plan.select("run").distinct().withColumn("number", F.row_number().over(Window.orderBy("run")) - 1)
            shard = fresh(self.schema(v).names, "shard")
            rows = self.read(v, names=plan, shard_col=shard)
            run = fresh([*rows.columns], "run")
            told = plan.join(F.broadcast(numbers), "run").select(F.col("name").alias(shard), F.col("number").cast("int").alias(run))
            merged = rows.join(F.broadcast(told) if size <= BROADCAST_SHARDS else told, shard).drop(shard)
            folder = f"data/{uuid.uuid4().hex}"
            merged.repartitionById(int(n_runs), run).drop(run).write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
            return self._publish(self._written(folder, v + 1), rows.drop(shard).schema, plan)
        finally:
            plan.unpersist()

    def vacuum(self, grace_seconds: float = GRACE_SECONDS, keep_versions: int = KEEP_VERSIONS) -> int:
        """Delete old versions and the shards that no version left lists; returns how many shards went.

        The newest ``keep_versions`` stay, and all committed within ``grace_seconds``, so that a reader of a version has
        that long. Files younger than that stay too, as another writer may be about to commit them. Files are listed and
        compared on the executors; folders without a live or young file go as a whole. No grace is for a store that
        nobody else reads or writes."""
        now, fs = time.time(), self._fs()
        versions = self._versions()
        kept = [v for k, (v, t) in enumerate(versions) if len(versions) - k <= max(1, keep_versions) or t > now - grace_seconds]
        for v, _ in versions:
            if v not in kept:
                fs.delete(self._path(f"_manifest/v{v:010d}"), True)
        if not kept or not fs.exists(self._path("data")):
            return 0
        live = self.manifest(kept[0]).select("name")
        for v in kept[1:]:
            live = live.unionByName(self.manifest(v).select("name"))
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{self.root}/data")
        files = files.select(F.regexp_extract("path", _SHARD, 1).alias("name"), (F.col("modificationTime") > F.timestamp_seconds(F.lit(now - grace_seconds))).alias("young"))
        told = files.join(live.distinct().withColumn("listed", F.lit(True)), "name", "left").select("name", F.substring_index("name", "/", 2).alias("folder"), (F.coalesce("listed", F.lit(False)) | F.col("young")).alias("stays"))
        told = told.cache()
        try:
            folders = told.groupBy("folder").agg(F.bool_or("stays").alias("some"), F.count_if(~F.col("stays")).alias("n"))
            gone = 0
            for r in folders.filter("not some").toLocalIterator():
                fs.delete(self._path(r["folder"]), True)
                gone += r["n"]
            for r in told.filter("not stays").join(folders.filter("some").select("folder"), "folder", "left_semi").toLocalIterator():
                fs.delete(self._path(r["name"]), False)
                gone += 1
            return gone
        finally:
            told.unpersist()


#: The query deals documents into so many arrivals by a hash of their ids.
ARRIVALS = 8


def op3_shard_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append all of ``documents`` as small shards, compact until nothing is to merge, and return each row's shard."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = ShardStore(spark, new_folder(spark, "shards"))
    store.append(docs, F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)))
    while store.compact() is not None:
        store.vacuum(grace_seconds=0, keep_versions=1)  # the store is this query's own
    v = store.version()
    rows = store.read(v, shard_col="shard").select("doc_id", "shard")
    sizes = store.manifest(v).select(F.col("name").alias("shard"), F.col("rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"), "generation")
    return rows.join(sizes, "shard", "left").select("doc_id", "shard", "shard_rows", "shard_bytes", "generation", F.lit(v).alias("version"))


__all__ = ["CommitConflict", "ShardStore", "op3_shard_compaction"]
