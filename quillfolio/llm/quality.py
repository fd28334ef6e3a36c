"""Quality classifier: naive Bayes support vectors over word n-grams."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import linear
from .common import join_small
from .tokens import arrow_schema, pieces

#: Labels are broadcast up to this many rows (a doc_id and a few numbers each).
LABEL_ROWS = 500_000
_SCORES = "doc_id long, score double"


def labelled(docs: DataFrame, labels: DataFrame, classes: dict[str, str]) -> DataFrame:
    """doc_id, text and a 0/1 column a class (an SQL expression over the labels) for the documents that have labels; rows with a null label are left out.

    A doc_id that is labelled twice counts once, with the larger label.
    """
    found = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.expr(c).alias(k) for k, c in classes.items()])
    found = found.groupBy("doc_id").agg(*[F.max(k).alias(k) for k in classes]).na.drop()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return join_small(texts, found, "doc_id", F.col("text"), rows=LABEL_ROWS)


def _fit(counts: Callable[[int], linear.Counts], texts: list[np.ndarray], labels: np.ndarray, fold: np.ndarray) -> list[linear.LinearModel]:
    return [linear.fit_folds(texts, np.zeros((len(texts), 0)), labels[:, 0], fold, counts(0))[0]]


def fit(rows: DataFrame, most: int = 8000) -> linear.LinearModel:
    """Fit to rows of doc_id, text, label (0/1).

    Class log-count ratios are counted over all rows; the hinge loss is fitted by one task
    to about `most` rows of them, by a hash of the doc_id (the bound of what it
    holds).  Without rows of both classes every score is the share of label 1.
    """
    return linear.fitted(rows, ["label"], most, _fit)[0]


def score(docs: DataFrame, model: linear.LinearModel) -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier) of every row; null and empty texts score by the constant alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 2 << 20):
            p = model.probabilities(*linear.indicators(part.column("text")), np.zeros((part.num_rows, 0)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p)], schema=arrow_schema(_SCORES))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, _SCORES)


def judged(docs: DataFrame, model: linear.LinearModel) -> DataFrame:
    """The rows of docs with all their columns, and their score."""
    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.struct(*docs.columns).alias("row"))
    schema = T.StructType([T.StructField("score", T.DoubleType()), rows.schema["row"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 2 << 20):
            p = model.probabilities(*linear.indicators(part.column("text")), np.zeros((part.num_rows, 0)))
            yield pa.RecordBatch.from_arrays([pa.array(p), part.column("row")], names=["score", "row"])

    return rows.mapInArrow(run, schema).select("row.*", "score")


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled documents outside the held-out third (crc32 of the doc_id as text, modulo 3, is 1)."""
    rows = labelled(docs, labels, {"label": "cast(quality as int)"})
    return rows.filter(~held_out())


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
