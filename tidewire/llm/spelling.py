"""Spelling variants by anagram hashing: each word's key is the sum of its letters' fifth powers.

One letter taken out lowers the key by that letter's value, one put in raises it, an exchange does both. So words that differ
by one letter more have the longer one's key, less one letter, as their key; and words that differ by an exchange have equal
keys once the exchanged letter is taken out of each. Words meet on those keys, and on the half of the word that the change
leaves alone; then the order of their letters is compared.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Workspace, text_or_empty

LETTERS = "A-Za-zÀ-ÿ"
MIN_CHARS, MIN_COUNT, RATIO = 6, 5, 5
#: One in so many runs of a document loses a letter, which gives the corpus misspellings to find.
NOISE = 199
EXCHANGE, LONGER, SHORTER = 0, 1, 2


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, noise: int | None = NOISE) -> DataFrame:
    """(word, n) of the words of at least ``min_chars`` letters that occur at least ``min_count`` times. Runs are lower-cased
    (A-Z alone), and where ``noise`` divides the crc32 of id and run, one letter is deleted. Runs that are too short for a
    word are not looked at; the counts are combined before they are shuffled."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text_or_empty(text_col), F.lit(f"[{LETTERS}]{{{min_chars},}}"), F.lit(0))).alias("run"))
    runs = runs.select("id", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("run"))
    if noise:
        h = F.crc32(F.concat("id", F.lit(":"), "run"))
        at = (h % F.char_length("run")).cast("int")
        runs = runs.select(F.when(h % noise == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))).otherwise(F.col("run")).alias("run"))
    return runs.groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n")).filter((F.char_length("word") >= min_chars) & (F.col("n") >= min_count))


def value(letter: str) -> int:
    return ord(letter) ** 5


def anagram_keys(word: str) -> Iterator[tuple[int, int, str]]:
    """(role, key, half): keys on which a word may meet words that differ by one letter, each with the half that must be
    equal, marked by what has changed and how long the shorter word is.

    A word stands as one of two that exchange a letter, as the longer of two and as the shorter of two. A letter of the first
    half is taken out beside the second half and the reverse, so there are about as many keys as letters, and at most four
    for each letter of the alphabet, however long the word is.
    """
    key, n = sum(map(value, word)), len(word)
    half = n // 2
    for letter in set(word[half:]):
        yield EXCHANGE, key - value(letter), f"x{n}<{word[:half]}"
    for letter in set(word[:half]):
        yield EXCHANGE, key - value(letter), f"x{n}>{word[half:]}"
    yield SHORTER, key, f"d{n}<{word[:half]}"
    yield SHORTER, key, f"d{n}>{word[half:]}"
    half = (n - 1) // 2
    for letter in set(word[half:]):
        yield LONGER, key - value(letter), f"d{n - 1}<{word[:half]}"
    for letter in set(word[:half]):
        yield LONGER, key - value(letter), f"d{n - 1}>{word[half + 1 :]}"


def _signed(x: int) -> int:
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            rows = [(role, _signed(key), _signed(xxhash.xxh3_64_intdigest(half)), word, n) for word, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for role, key, half in anagram_keys(word)]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["role", "k", "half", "word", "n"])


def near_words(words: DataFrame, work: Workspace) -> DataFrame:
    """(word, n, other, other_n) once for each pair of words that differ by exactly one inserted, deleted or replaced
    letter. A word has at most as many near words as its length times the alphabet."""
    keys = work.keep(words.select("word", "n").mapInArrow(_keyed, "role int, k long, half long, word string, n long"), "keys")
    one = keys.filter(F.col("role") != SHORTER).select("k", "half", "word", "n")
    two = keys.filter(F.col("role") != LONGER).select("k", "half", F.col("word").alias("other"), F.col("n").alias("other_n"))
    met = one.join(two, ["k", "half"]).filter((F.char_length("word") > F.char_length("other")) | (F.char_length("word") == F.char_length("other")) & (F.col("word") < F.col("other")))
    return work.keep(met.filter(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n").distinct(), "near")


def roots_of(forms: DataFrame, work: Workspace) -> DataFrame:
    """(word, root) from (word, form): the last form that forms lead to. A form is several times as frequent as its word, so
    there are no rings, and the rounds, which double the steps, are few."""
    roots = work.keep(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        next_ = roots.select(F.col("word").alias("root"), F.col("root").alias("far"))
        moved = work.keep(roots.join(next_, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        roots = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return roots


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO, noise: int | None = NOISE) -> DataFrame:
    """One row a word: word, form, root, n, n_near, form_n.

    ``form`` is the most frequent near word (of equal ones the first in code-point order) if it is at least ``ratio`` times as
    frequent as the word, ``root`` where forms lead to, the word itself if nowhere. Null texts have no words; a null id counts
    as an empty one; repeated rows count again; very long texts and words are read whole; an empty table gives an empty
    result; other columns are ignored.
    """
    if ratio < 2:
        raise ValueError("forms must be more frequent than their words, else they could lead in a ring")
    work = Workspace(docs.sparkSession, "spelling")
    words = work.keep(word_counts(docs, id_col, text_col, min_chars, min_count, noise), "words")
    near = near_words(words, work)
    both = near.unionByName(near.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("best"))
    best_n = -F.col("best.less")
    told = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(best_n >= F.col("n") * ratio, F.col("best.other")).alias("form"), F.when(best_n >= F.col("n") * ratio, best_n).alias("form_n"))
    told = work.keep(told, "told")
    roots = roots_of(told.filter("form is not null"), work)
    return work.only(told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "result")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all of ``documents``."""
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
