"""Tables with unique keys whose merges rewrite only the files that hold a key of the new rows."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.operators.control import FolderJournal
from tidewire.operators.graph import file_system

#: Bits of one part of a file's filter (as many as Spark's bitmap functions have), and bits set for a key.
PART_BITS, KEY_BITS = 32_768, 3


class KeyedTable:
    """Parquet files in buckets by a hash of the key, with a Bloom filter a file.

    A merge looks new keys up in the filters of their bucket, reads the key columns of the files that may hold one, and
    rewrites those that do; all others keep their names. Files are written first; then one numbered record, renamed into
    place, names the commits that make up the table, so readers see a merge whole or not at all, and of two writers at once the
    second merges into what the first left. Each commit holds its own list of files, filters and files taken out: a merge
    writes as much metadata as it writes files.

    Keys are compared as SQL's ``IS NOT DISTINCT FROM``: null equals null. Columns that only new rows have are added, and null
    in old rows; columns that new rows lack are null in them. A column keeps its first type. ``parts`` is the size of a filter, at 10
    bits a key enough for 3,000 keys a part; fuller filters let more files through to the look at their keys, no row is lost.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], buckets: int = 64, parts: int = 16):
        self.spark, self.root, self.keys, self.buckets, self.parts = spark, root.rstrip("/"), keys, buckets, parts
        self.journal = FolderJournal(spark, f"{self.root}/_commits")

    def upsert(self, new: DataFrame, order: str | None = None) -> list[str]:
        """Rows of ``new`` take the place of those with their key; of rows that repeat a key the largest by ``order`` (by
        default: by all columns) stays. Returns the files that were rewritten."""

        def change(record: dict, commit: str) -> list[str]:
            rows = self._cast(new, record)
            hit = self._holding(record, rows)
            kept = self._rows(record, hit).drop("file").join(self._marked(rows), self._same(), "left_anti")
            self._write(record, commit, kept.unionByName(self._one_a_key(rows, order), allowMissingColumns=True))
            return hit

        return self._commit(change)

    def insert_new(self, new: DataFrame, order: str | None = None) -> list[str]:
        """Rows whose key is not there yet are added; of rows that repeat a key the smallest by ``order`` (by default: by all
        columns). No file is rewritten."""

        def change(record: dict, commit: str) -> list[str]:
            rows = self._cast(new, record)
            there = self._rows(record, self._candidates(record, rows)).select(*self.keys)
            fresh = rows.join(self._marked(there), self._same(), "left_anti")
            self._write(record, commit, self._one_a_key(fresh, order, F.min_by, F.min))
            return []

        return self._commit(change)

    def delete(self, gone: DataFrame) -> list[str]:
        """Rows with one of the keys go. Returns the files that were rewritten."""

        def change(record: dict, commit: str) -> list[str]:
            rows = self._cast(gone.select(*self.keys), record, grow=False)
            hit = self._holding(record, rows)
            self._write(record, commit, self._rows(record, hit).drop("file").join(self._marked(rows), self._same(), "left_anti"))
            return hit

        return self._commit(change)

    def compact(self, most_files: int = 8) -> list[str]:
        """Buckets of more files than that are written anew. Returns the files that were replaced."""

        def change(record: dict, commit: str) -> list[str]:
            many = self._files(record).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.collect_list("file").alias("files")).filter(F.col("n") > most_files)
            old = [r["file"] for r in many.select(F.explode("files").alias("file")).toLocalIterator()]
            if old:
                self._write(record, commit, self._rows(record, old).drop("file"))
            return old

        return self._commit(change)

    def read(self, version: int | None = None) -> DataFrame:
        """The table as it is now, or was at a version."""
        record = self._record() if version is None else self.journal.read("table", version)
        return self._rows(record, self._names(record)).drop("file")

    def version(self) -> int:
        return self.journal.last("table")[0]

    def files(self) -> list[str]:
        return sorted(self._names(self._record()))

    def _record(self) -> dict:
        return self.journal.last("table")[1] or {"commits": [], "schema": None}

    def _commit(self, change: Callable[[dict, str], list[str]]) -> list[str]:
        for _ in range(100):
            number, found = self.journal.last("table")
            record, commit = json.loads(json.dumps(found or {"commits": [], "schema": None})), uuid.uuid4().hex
            gone = change(record, commit)
            if commit not in record["commits"]:
                return gone
            self.spark.createDataFrame([(f,) for f in gone], "file string").write.parquet(f"{self.root}/gone/{commit}")
            if self.journal.write("table", number + 1, record):
                return gone
            self._undo(commit)
        raise RuntimeError("the merge could not be committed")

    def _undo(self, commit: str) -> None:
        for place in (f"data/commit={commit}", f"files/{commit}", f"bloom/{commit}", f"gone/{commit}"):
            fs, path = file_system(self.spark, f"{self.root}/{place}")
            fs.delete(path, True)

    def _cast(self, rows: DataFrame, record: dict, grow: bool = True) -> DataFrame:
        """Columns in the types that the table has; its schema grows by those it lacks."""
        known = T.StructType.fromJson(record["schema"]) if record["schema"] else T.StructType()
        types = {f.name: f.dataType for f in known}
        if grow:
            for f in rows.schema:
                if f.name not in types:
                    known = known.add(T.StructField(f.name, f.dataType, True))
            record["schema"] = json.loads(known.json())
        return rows.select(*(F.col(f.name).cast(types.get(f.name, f.dataType)).alias(f.name) for f in rows.schema))

    def _hash(self, seed: int) -> Column:
        return F.xxhash64(F.lit(seed), *self.keys)

    def _bucket(self) -> Column:
        return F.pmod(self._hash(1), F.lit(self.buckets)).cast("int")

    def _part(self) -> Column:
        return F.pmod(self._hash(2), F.lit(self.parts)).cast("int")

    def _bits(self) -> list[Column]:
        return [F.shiftrightunsigned(self._hash(3), 15 * k).bitwiseAND(F.lit(PART_BITS - 1)) for k in range(KEY_BITS)]

    def _marked(self, rows: DataFrame) -> DataFrame:
        return rows.select(*(F.col(k).alias(f"_{k}") for k in self.keys))

    def _same(self) -> Column:
        condition = F.lit(True)
        for k in self.keys:
            condition = condition & F.col(k).eqNullSafe(F.col(f"_{k}"))
        return condition

    def _one_a_key(self, rows: DataFrame, order: str | None, by: Callable = F.max_by, plain: Callable = F.max) -> DataFrame:
        whole = F.struct(*rows.columns)
        best = by(whole, F.struct(order, whole)) if order else plain(whole)
        return rows.groupBy(*(F.col(k).alias(f"_{k}") for k in self.keys)).agg(best.alias("_row")).select("_row.*")

    def _write(self, record: dict, commit: str, rows: DataFrame) -> None:
        """Files of the rows, by bucket, with their filters."""
        data = f"{self.root}/data/commit={commit}"
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(data)
        schema = T.StructType.fromJson(record["schema"]).add("bucket", T.IntegerType())
        written = self.spark.read.schema(schema).parquet(data).select(*self.keys, "bucket", self._name().alias("file"))
        written.groupBy("bucket", "file").agg(F.count(F.lit(1)).alias("rows")).write.parquet(f"{self.root}/files/{commit}")
        bits = written.select("bucket", "file", self._part().alias("part"), F.explode(F.array(*self._bits())).alias("bit"))
        bits.groupBy("bucket", "file", "part").agg(F.bitmap_construct_agg("bit").alias("filter")).write.parquet(f"{self.root}/bloom/{commit}")
        record["commits"].append(commit)

    @staticmethod
    def _name() -> Column:
        return F.regexp_extract(F.col("_metadata.file_path"), r"commit=[0-9a-f]+/bucket=[^/]+/[^/]+$", 0)

    def _live(self, record: dict, kind: str, schema: str) -> DataFrame:
        if not record["commits"]:
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.schema(schema).parquet(*(f"{self.root}/{kind}/{c}" for c in record["commits"]))
        gone = self.spark.read.schema("file string").parquet(*(f"{self.root}/gone/{c}" for c in record["commits"]))
        return found.join(gone, "file", "left_anti")

    def _files(self, record: dict) -> DataFrame:
        return self._live(record, "files", "bucket int, file string, rows long")

    def _names(self, record: dict) -> list[str]:
        return [r["file"] for r in self._files(record).select("file").toLocalIterator()]

    def _rows(self, record: dict, files: list[str]) -> DataFrame:
        """Rows of some files, with the file that they are in."""
        schema = T.StructType.fromJson(record["schema"]) if record["schema"] else T.StructType([T.StructField(k, T.StringType()) for k in self.keys])
        if not files:
            return self.spark.createDataFrame([], schema).withColumn("file", F.lit(""))
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/data/{f}" for f in files)).select("*", self._name().alias("file"))

    def _candidates(self, record: dict, rows: DataFrame) -> list[str]:
        """Files whose filter may hold a key of ``rows``."""
        bits = [f"_bit{k}" for k in range(KEY_BITS)]
        probe = rows.select(*self.keys).distinct().select(self._bucket().alias("bucket"), self._part().alias("part"), *(b.alias(n) for b, n in zip(self._bits(), bits, strict=True)))
        found = probe.join(self._live(record, "bloom", "bucket int, file string, part int, filter binary"), ["bucket", "part"])
        for b in bits:
            byte = F.conv(F.hex(F.substring(F.col("filter"), F.shiftright(b, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            found = found.filter(F.getbit(byte, F.col(b).bitwiseAND(F.lit(7)).cast("int")) == 1)
        return [r["file"] for r in found.select("file").distinct().toLocalIterator()]

    def _holding(self, record: dict, rows: DataFrame) -> list[str]:
        """Files that hold a key of ``rows``."""
        there = self._rows(record, self._candidates(record, rows)).join(self._marked(rows), self._same(), "left_semi")
        return [r["file"] for r in there.select("file").distinct().toLocalIterator()]
