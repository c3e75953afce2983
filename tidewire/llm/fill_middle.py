"""Fill-in-the-middle: a text's prefix, middle and suffix change places, so that a model learns to fill gaps.

The places where a text may be cut are the ends of units, letter runs or single other characters. The tokenizers library's
``Split`` pre-tokenizer, with isolated matches and no training, gives their offsets in code points.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import text_or_empty

UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = "1", 90, 20
#: Code points that the library sees at once, whatever a text's length.
PORTION = 512


class Units:
    """The units of one text, by portions; a letter run over the edge of a portion is one unit."""

    def __init__(self, text: str):
        from tokenizers import Regex, pre_tokenizers

        self.text, self.split = text, pre_tokenizers.Split(Regex(UNIT), "isolated")
        self.firsts, self.n = [], 0  # the number of the first unit that begins in each portion
        for at in range(0, len(text), PORTION):
            self.firsts.append(self.n)
            self.n += len(self._offsets(at)) - self._goes_on(at)

    def _offsets(self, at: int) -> list[tuple[str, tuple[int, int]]]:
        return self.split.pre_tokenize_str(self.text[at : at + PORTION])

    def _goes_on(self, at: int) -> bool:
        """Whether a letter run goes on over the edge at ``at``."""
        both = self.text[at - 1 : at + 1] if at else ""
        return len(both) == 2 and both.isascii() and both.isalpha()

    def end(self, k: int) -> int:
        """Code points of the first k units: where unit k, counted from 0, begins."""
        if k == self.n:
            return len(self.text)
        p = bisect_right(self.firsts, k) - 1
        return p * PORTION + self._offsets(p * PORTION)[k - self.firsts[p] + self._goes_on(p * PORTION)][1][0]


def cut_places(text: str, one: int, two: int) -> tuple[int, int, int]:
    """Number of units, and the code points after which prefix and middle end."""
    units = Units(text)
    ranks = sorted((one % (units.n + 1), two % (units.n + 1)))
    return units.n, units.end(ranks[0]), units.end(ranks[1])


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in "nab"]))
def _places(text: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
    rows = [cut_places(t.as_py(), x, y) for t, x, y in zip(text, one.to_pylist(), two.to_pylist(), strict=True)]
    return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["n", "a", "b"])


def _numbers(id_col: str, seed: str) -> list[Column]:
    """The first four 32-bit numbers of the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """One row a row of ``docs``: doc_id, n (units), form, prefix_chars, middle_chars (code points; null if plain), output.

    ``rate`` of 100 texts are cut at two places that a hash of the id chooses; ``spm_rate`` of 100 of these begin with the
    suffix. Empty texts, and texts that hold one of the marks, stay plain. Null text counts as empty, a null id as an empty
    number. Repeated rows have equal results; an empty table gives an empty result; other columns are ignored. Texts are
    read whole, in portions, so the library's memory doesn't grow with them.
    """
    h = _numbers(id_col, seed)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"), *(x.alias(f"h{k}") for k, x in enumerate(h, 1)))
    rows = rows.withColumn("at", _places("text", "h1", "h2"))
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    form = F.when((F.col("text") == "") | marked | (F.col("h3") % 100 >= rate), "plain").when(F.col("h4") % 100 < spm_rate, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "at.*", form.alias("form"))
    piece = lambda start, size: F.substring("text", (start + 1).cast("int"), size.cast("int"))
    a, b, nothing = F.col("a"), F.col("b"), F.lit(0)
    prefix, middle, suffix = piece(nothing, a), piece(a, b - a), piece(b, F.char_length("text") - b)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)).otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    cut = F.col("form") != "plain"
    return rows.select("doc_id", "n", "form", F.when(cut, a).alias("prefix_chars"), F.when(cut, b - a).alias("middle_chars"), output.alias("output"))


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that was cut, from output and form alone. A text that holds a mark is never cut, and no mark begins as it
    ends, so the first place of each mark is its own."""
    text = F.col(output)
    psm = F.col(form) == "psm"
    second = F.when(psm, F.position(F.lit(SUFFIX), text, F.lit(4))).otherwise(F.position(F.lit(PREFIX), text, F.lit(4)))
    third = F.position(F.lit(MIDDLE), text, second + 3)
    one, two = F.substring(text, F.lit(4), second - 4), F.substring(text, second + 3, third - second - 3)
    middle = F.substring(text, third + 3, F.char_length(text))
    return F.when(F.col(form) == "plain", text).when(psm, F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``."""
    found = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


OP12_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || doc_id) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '{UNIT}') AS u, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
r AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM r)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
