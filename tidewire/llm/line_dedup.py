"""Line deduplication: lines that several documents hold stay in one of them alone.

Lines are exploded with their positions and normalised; documents are counted by the hash of a line; lines over the threshold
are dropped, and each text is put together again from the positions that stay.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Workspace, attach, text_or_empty

#: What is stripped off the ends of a line: space and 0x09 to 0x0D.
BLANKS = " \t\n\x0b\x0c\r"
MIN_DOCS, MIN_CHARS = 2, 10
#: Rows without an id count together as one document with this id.
NO_ID = (1 << 63) - 1


def line_key(line: Column) -> Column:
    """What makes two lines one: stripped, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), string.ascii_uppercase, string.ascii_lowercase)


def _row_key(id_col: str, text_col: str) -> Column:
    """128 bits of id and text: rows alike in both have the same result."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text_or_empty(text_col))))


def repeated_positions(docs: DataFrame, work: Workspace, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(row_key, gone): the positions, from 0, of the lines that a row of ``docs`` loses; rows that lose none are left out.

    Documents are counted by 128 bits of the line's key. The count is spread by line and document before it is summed by
    line, and the lines that at least 1 in HOT_PARTS of all rows repeat get their count by broadcast, so no task holds all
    rows of a line.
    """
    who = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    rows = docs.select(who.alias("who"), _row_key(id_col, text_col).alias("row_key"), F.posexplode(F.split(text_or_empty(text_col), "\n")).alias("pos", "line"))
    keyed = rows.select("who", "row_key", "pos", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= min_chars)
    lines = work.keep(keyed.select("who", "row_key", "pos", F.unhex(F.md5("key")).alias("h")), "lines")
    held = lines.groupBy("h").agg(F.min("who").alias("first"), F.count_distinct("who").alias("n_docs"), F.count(F.lit(1)).alias("n"))
    held = work.keep(held.filter(F.col("n_docs") >= min_docs).select("h", "first", "n"), "held")
    gone = attach(lines, held, ["h"], F.col("n"), lines.count(), "inner").filter("who != first")
    return gone.groupBy("row_key").agg(F.collect_set("pos").alias("gone"))


def deduplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row a row of ``docs``: doc_id, n_lines (before dropping), n_dropped, text (the lines that stay, joined by newlines).

    A line whose key has at least ``min_chars`` code points and is found in at least ``min_docs`` documents loses all its
    places except those in the document of the smallest id. Null text counts as empty, which is one empty line. Rows that
    repeat an id are one document for the counts, and each is returned; rows without an id are together one document, behind
    all others. A line may stand several times in the document that keeps it. An empty table gives an empty result; other
    columns are ignored; whole texts are read, however long.
    """
    work = Workspace(docs.sparkSession, "line-dedup")
    gone = repeated_positions(docs, work, id_col, text_col, min_docs, min_chars)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"), _row_key(id_col, text_col).alias("row_key"))
    split = F.split("text", "\n")
    # The array of one array makes the lines a variable, which is cut once a text and not once a line.
    left = F.transform(F.array(split), lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone")), lambda k: F.get(lines, k)), "\n"))
    told = own.join(gone, "row_key", "left").select(
        "doc_id", F.size(split).cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long").alias("n_dropped"), F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.get(left, F.lit(0))).alias("text")
    )
    return told


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``."""
    found = deduplicate_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP11_SQL = f"""
WITH line AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
keyed AS (SELECT *, translate(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS k FROM line),
held AS (SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
told AS (SELECT doc_id, pos, l, coalesce(first <> doc_id, false) AS gone FROM keyed LEFT JOIN held USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(l, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM told GROUP BY doc_id
"""
