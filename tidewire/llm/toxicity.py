"""Toxicity: vectors of character n-grams, averaged over a whole text, and a linear softmax, trained together in numpy.

A misspelt or unseen word shares most of its n-grams, and so its vectors, with the word it stems from. Once trained, the
softmax over an average is a number a n-gram, averaged, plus a constant; texts are scored with that table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import doc_frame
from .toxicity_model import TRAIN_CHARS, TRAIN_ROWS, Toxicity, fit, subwords

def crc_of_id(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def training_sample(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> DataFrame:
    """spin, doc_id, y, text of labelled documents whose crc32(doc_id as text) mod 5 is not 0: the first by a hash of the
    id, ``rows`` at most."""
    named = labels.filter(F.col(label_col).isin(0, 1) & (crc_of_id(id_col) % 5 != 0)).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("int").alias("y"))
    some = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = doc_frame(docs, id_col, text_col).join(F.broadcast(some), "doc_id")
    return found.select(F.xxhash64("doc_id").alias("spin"), "doc_id", "y", "text")


def within_bound(sample: Iterable[tuple], chars: int = TRAIN_CHARS) -> tuple[list[str], list[int]]:
    """Texts and labels of rows in the order of the hash, as long as they have ``chars`` characters together at most. What
    comes after that is not held."""
    texts, ys, held = [], [], 0
    for _, _, y, text in sample:
        held += len(text)
        if held > chars:
            break
        texts.append(text)
        ys.append(int(y))
    return texts, ys


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> tuple[list[str], list[int]]:
    """The bounded sample, here."""
    sample = training_sample(docs, labels, label_col, id_col, text_col, rows)
    return within_bound(map(tuple, sample.repartition(1).sortWithinPartitions("spin", "doc_id", "text").toLocalIterator()))


def score_of(spark: SparkSession, model: Toxicity):
    """A function of a text column that returns its score. Tables travel by broadcast: their size is fixed."""
    shared = spark.sparkContext.broadcast((model.table, model.constant))

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Toxicity(*shared.value)
        for batch in texts:
            yield pd.Series([own.score(t or "") for t in batch], dtype="float64")

    return score


def toxicity_scores(docs: DataFrame, model: Toxicity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of ``docs``: doc_id, held_out, score, predicted. The whole text is read and nothing else of the row.

    Null counts as empty; an empty text gets the score of the constant alone. ``held_out`` is null for a row without an id.
    Repeated rows give repeated results; an empty table gives an empty result.
    """
    score = score_of(docs.sparkSession, model)
    scored = doc_frame(docs, id_col, text_col).select("doc_id", score("text").alias("score"))
    return scored.select("doc_id", (crc_of_id() % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def fit_on(docs: DataFrame, labels: DataFrame, label_col: str = "toxic") -> Toxicity:
    """Fit on the bounded sample, in one task on an executor; the driver gets the table alone, whose size is fixed.

    The sample reaches the task in the order of the hash, and no more than TRAIN_CHARS of it is held. Labels other than 0
    and 1 and null ones are not used; of repeated labels of one id the larger counts, and repeated documents of one id are
    all used. Null texts count as empty. Without labels every score is a constant below 0.5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for k in range(0, b.num_rows, 100) for r in zip(*(c.to_pylist() for c in b.slice(k, 100).columns), strict=True))
        texts, ys = within_bound(rows)
        for _ in rows:
            pass  # the rest is read, as Spark expects, and forgotten
        if texts:
            model = fit(texts, ys)
            yield pa.record_batch([pa.array([model.table.tobytes()], pa.binary()), pa.array([model.constant])], names=["model", "constant"])

    sample = training_sample(docs, labels, label_col).repartition(1).sortWithinPartitions("spin", "doc_id", "text")
    found = sample.mapInArrow(run, "model binary, constant double").collect()  # one row
    return Toxicity(np.frombuffer(found[0]["model"], np.float32), found[0]["constant"]) if found else fit([], [])


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows predicted toxic; all columns stay. Each row is decided where it is read, by its whole text
    alone: null texts count as empty, rows without an id are decided like others, repeated rows go or stay together, and an
    empty table stays empty. Labels are looked up by ``doc_id``; with none, nothing goes."""
    return docs.filter(score_of(docs.sparkSession, fit_on(docs, labels))(F.col(text_col)) < 0.5)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit on the labelled rows that are not held out, score all of ``documents``."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity_scores(docs, fit_on(docs, labels))


__all__ = ["Toxicity", "drop_toxic", "fit", "fit_on", "op9_toxicity", "subwords", "toxicity_scores", "training_rows", "within_bound"]
