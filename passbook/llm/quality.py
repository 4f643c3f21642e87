"""Document quality by a regularised quadratic discriminant.

Each document becomes a short vector of transformed statistics (sizes, shares of character
classes, repetition). The two classes are Gaussian with covariances of their own, shrunk
towards the pooled diagonal; a score is the posterior that follows from the difference of
Mahalanobis log densities, taken with Cholesky factors that are computed once.

The model is fitted on all labelled rows. Moments are sums of whole numbers, added up by
task and then by Spark, so the fit does not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passbook.llm import arrays
from passbook.session import saved, shared_dir

#: A document at least this good is predicted to be of class 1.
THRESHOLD = 0.7
#: Share of the pooled diagonal in a class covariance, and what is added to its diagonal.
SHRINK, RIDGE = 0.1, 1e-3
#: Statistics are held in steps of 1 / GRID, so that sums of them are exact.
GRID = 4096
#: Number of statistics.
WIDTH = 13


def statistics(texts: arrays.Texts) -> np.ndarray:
    """One row of statistics per text. A text without words has zeros but for its size."""
    n = len(texts)
    data, bounds = texts.data, texts.bounds
    sizes = np.diff(bounds).astype(float)

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (total[bounds[1:]] - total[bounds[:-1]]).astype(float)

    words = arrays.words_of(texts)
    n_words = np.bincount(words.doc, minlength=n).astype(float)
    upper = count((data >= 65) & (data <= 90))
    lower = count((data >= 97) & (data <= 122)) + count(data >= 0xC0)
    digits = count((data >= 48) & (data <= 57))
    stops = count((data == 46) | (data == 44))
    printable = count((data > 32) & (data < 127))
    ascii_letters = upper + count((data >= 97) & (data <= 122))
    symbols = printable - ascii_letters - digits - stops
    loud = count(data == 33)
    lines = count(data == 10) + 1
    bars = count(data == 124)

    def distinct(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
        order = np.lexsort((value, doc))
        d, v = doc[order], value[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
        return np.bincount(d[new], minlength=n).astype(float)

    pair, at = arrays.grams(words, 2)
    pairs = np.bincount(words.doc[at], minlength=n).astype(float)
    same = np.bincount(words.doc[at], words.hash[at] == words.hash[at + 1], minlength=n)
    short = np.bincount(words.doc, (words.end - words.start) <= 3, minlength=n)
    share = lambda part, whole: np.sqrt(part / (whole + 4.0))
    with np.errstate(divide="ignore"):
        out = np.stack(
            [
                np.log1p(n_words),
                np.log1p(sizes / np.maximum(n_words, 1.0)),
                share(upper, upper + lower),
                share(digits, sizes),
                share(symbols, sizes),
                share(stops, n_words),
                share(loud, n_words),
                share(bars, n_words),
                share(n_words - distinct(words.doc, words.hash), n_words),
                share(pairs - distinct(words.doc[at], pair), pairs),
                share(same, pairs),
                np.log1p(n_words / lines),
                share(short, n_words),
            ],
            axis=1,
        )
    return np.round(out * GRID) / GRID


def statistics_of(column: pa.Array) -> np.ndarray:
    batch = pa.record_batch([column], names=["text"])
    rows = [statistics(arrays.texts_of(b.column("text"))) for b in arrays.blocks(batch)]
    return np.concatenate(rows) if rows else np.zeros((0, WIDTH))


def statistics_column(text: Column) -> Column:
    """The statistics of a text as array<double>."""

    def make(column: pa.Array) -> pa.Array:
        rows = statistics_of(column)
        return pa.ListArray.from_arrays(np.arange(0, rows.size + 1, WIDTH, dtype=np.int32), rows.ravel())

    return F.arrow_udf(make, T.ArrayType(T.DoubleType()))(text)


@dataclass
class Model:
    """Means, inverse Cholesky factors and log constants of the classes that were seen."""

    classes: dict[int, tuple[np.ndarray, np.ndarray, float]]

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Posterior of class 1; 0.5 where nothing was learned."""
        if not self.classes:
            return np.full(len(rows), 0.5)
        if len(self.classes) == 1:
            return np.full(len(rows), float(next(iter(self.classes))))
        log = {}
        for label, (mean, factor, constant) in self.classes.items():
            log[label] = constant - 0.5 * np.square((rows - mean) @ factor.T).sum(axis=1)
        return 1.0 / (1.0 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def fit(rows: DataFrame, shrink: float = SHRINK, ridge: float = RIDGE) -> Model:
    """The model of ``rows`` (statistics array<double>, quality int).

    Rows with another label than 0 or 1 are left out. A class that does not occur is never
    predicted; without any rows every score is 0.5. Only sums, of fixed number, reach the
    driver.
    """
    width = WIDTH

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = np.asarray(batch.column("quality"))
            x = np.asarray(batch.column("statistics").flatten()).reshape(-1, width)
            x = np.round(x * GRID).astype(np.int64)
            for c in (0, 1):
                part = x[label == c]
                ones = np.concatenate([np.ones((len(part), 1), np.int64), part], axis=1)
                product = (ones.T @ ones).ravel()
                yield pa.record_batch(
                    [pa.array([c] * len(product), pa.int32()), pa.array(range(len(product)), pa.int32()), pa.array(product)],
                    names=["quality", "k", "v"],
                )

    sums = (
        rows.where(F.col("quality").isin(0, 1))
        .select("statistics", F.col("quality").cast("int").alias("quality"))
        .mapInArrow(moments, "quality int, k int, v long")
        .groupBy("quality", "k")
        .agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("v"))
        .collect()
    )
    product = np.zeros((2, (width + 1) ** 2))
    for row in sums:
        product[row.quality, row.k] = float(row.v)
    product = product.reshape(2, width + 1, width + 1)
    counts = product[:, 0, 0]
    seen = [c for c in (0, 1) if counts[c] > 0]
    if not seen:
        return Model({})
    means, covariances = {}, {}
    for c in seen:
        means[c] = product[c, 0, 1:] / counts[c] / GRID
        covariances[c] = product[c, 1:, 1:] / counts[c] / GRID**2 - np.outer(means[c], means[c])
    pooled = sum(covariances[c] * counts[c] for c in seen) / counts.sum()
    classes = {}
    for c in seen:
        share = max(shrink, min(1.0, 2.0 * width / counts[c]))
        shrunk = (1 - share) * covariances[c] + share * np.diag(np.diag(pooled)) + ridge * np.eye(width)
        lower = np.linalg.cholesky(shrunk)
        prior = np.log(counts[c] / counts.sum())
        classes[c] = (means[c], np.linalg.inv(lower), float(prior - np.log(np.diag(lower)).sum()))
    return Model(classes)


def score_column(model: Model, statistics: Column) -> Column:
    """Score of a row of statistics, 0 to 1."""
    width = WIDTH

    def score(column: pa.Array) -> pa.Array:
        return pa.array(model.scores(np.asarray(column.flatten()).reshape(-1, width)))

    return F.arrow_udf(score, "double")(statistics)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, held_out, score, predicted).

    ``labels`` (doc_id, quality) teach only where crc32 of the id as text is not 2 modulo 4.
    Null and empty texts are scored like others, by zeros. A null doc_id or label teaches
    nothing; repeated labels count as often as they occur; repeated rows get a row each.
    No rows in, no rows out. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = saved(
        docs.select("doc_id", statistics_column(F.col("text")).alias("statistics")),
        shared_dir(spark, "quality"),
    )
    model = fit(_taught(rows, labels))
    score = score_column(model, F.col("statistics"))
    return rows.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), score.alias("score")
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def held_out(doc_id: Column) -> Column:
    """True for the quarter of ids that nothing is learned from."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


def _taught(rows: DataFrame, labels: DataFrame) -> DataFrame:
    known = labels.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("l_id"), "quality")
    return rows.join(known, F.col("doc_id") == F.col("l_id")).select("statistics", "quality")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with their columns."""
    spark = docs.sparkSession
    known = labels.where(F.col("quality").isNotNull()).select(F.col("doc_id").alias("l_id"))
    rows = saved(
        docs.select("doc_id", "text")
        .where(~held_out(F.col("doc_id")))
        .join(known, F.col("doc_id") == F.col("l_id"), "left_semi")
        .select("doc_id", statistics_column(F.col("text")).alias("statistics")),
        shared_dir(spark, "quality"),
    )
    model = fit(_taught(rows, labels))
    score = score_column(model, statistics_column(F.col("text")))
    return docs.where(score >= THRESHOLD)
