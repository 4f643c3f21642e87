"""Importance resampling: documents drawn by how much their words are like a target's.

1. The words of all documents and of the target are counted in buckets by checksum. A bucket's
   gain is the logarithm of how much more frequent it is in the target.
2. The gains, one array of a fixed length, score every document: its weight is the mean gain
   of its features, its score the weight plus Gumbel noise that depends on its doc_id only.
   The highest scores are then a draw without replacement in proportion to exp(weight / 1000).
3. Scores are ranked by a distributed radix sort over the composite key (score, doc_id).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passbook.llm import arrays, radix
from passbook.session import saved, shared_dir

BUCKETS, SEED, PERCENT, LEAST_WORDS = 10_000, 2024, 10, 20


def _checksum_table() -> np.ndarray:
    """What a byte adds to a CRC-32, by its rule."""
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = (value >> np.uint32(1)) ^ ((value & np.uint32(1)) * np.uint32(0xEDB88320))
    return value


CHECKSUM = _checksum_table()
#: Below so many spans, the ones that are left are faster one by one.
FEW = 64


def checksums(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each byte span; all spans go forward byte by byte, the longest ones at last alone."""
    order = np.argsort(start - end, kind="stable")
    first, size = start[order], (end - start)[order]
    state = np.full(len(order), 0xFFFFFFFF, np.uint32)
    left, j = len(order), 0
    while left:
        left = int(np.searchsorted(-size[:left], -j, side="left"))
        if left <= FEW:
            for i in range(left):
                state[i] = ~np.uint32(zlib.crc32(data[first[i] : first[i] + size[i]]))
            break
        now = state[:left]
        state[:left] = CHECKSUM[(now ^ data[first[:left] + j]) & np.uint32(255)] ^ (now >> np.uint32(8))
        j += 1
    out = np.empty(len(order), np.uint32)
    out[order] = ~state
    return out


def features(texts: arrays.Texts, runs: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text index of every feature of a block, and the words of each text.

    Words are runs of digits, letters a-z after folding A-Z, and bytes from 0x80 up; features
    are all runs of 1 to ``runs`` words of a text, joined by one space.
    """
    data, bounds = texts.data, texts.bounds
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    inside = (data >= 128) | ((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 122))
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edge = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(data))]
    opens[edge] |= inside[edge]
    closes[edge - 1] |= inside[edge - 1]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    doc = np.searchsorted(bounds, first, side="right") - 1
    # The words again, with exactly one byte, a space, after each.
    size = last - first
    at = np.cumsum(size + 1) - size - 1
    joined = np.full(int(size.sum()) + len(size), 32, np.uint8)
    joined[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = data[inside]
    found = [(checksums(joined, at, at + size) % np.uint32(buckets), doc)]
    for n in range(2, runs + 1):
        head = np.flatnonzero(doc[: 1 - n] == doc[n - 1 :])
        tail = head + n - 1
        found.append((checksums(joined, at[head], at[tail] + size[tail]) % np.uint32(buckets), doc[head]))
    bucket, of = (np.concatenate(part) for part in zip(*found, strict=True))
    return bucket.astype(np.int64), of, np.bincount(doc, minlength=len(texts))


def bucket_counts(texts: DataFrame, runs: int, buckets: int) -> np.ndarray:
    """Features of all rows of ``texts`` (text) by bucket. Each task sums its rows first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for whole in batches:
            for batch in arrays.blocks(whole):
                bucket, _, _ = features(arrays.texts_of(batch.column("text")), runs, buckets)
                total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    summed = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n"))
    for bucket, n in summed.collect():  # as many rows as there are buckets at most
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of smoothed target over source frequency, floored."""
    n = len(source)
    all_source, all_target = float(source.sum()) + n, float(target.sum()) + n
    ratio = ((t + 1.0) * all_source / ((s + 1.0) * all_target) for s, t in zip(source, target, strict=True))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, runs: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean of the gains of all features."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrays.blocks(whole):
                bucket, of, words = features(arrays.texts_of(batch.column("text")), runs, len(gain))
                n = np.bincount(of, minlength=batch.num_rows)
                total = np.bincount(of, weights=gain[bucket], minlength=batch.num_rows)  # exact below 2 ** 53
                weight = total.astype(np.int64) // np.maximum(n, 1)
                columns = [batch.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in (words, n, weight))]
                yield pa.record_batch(columns, names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        score, "doc_id long, n_words long, n_features long, weight long"
    )


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variate of ``doc_id``, floored."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8)
    uniform = (F.conv(head, 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln(uniform)))


def resample(
    docs: DataFrame,
    target: DataFrame,
    runs: int = 1,
    buckets: int = BUCKETS,
    seed: int = SEED,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, n_features, weight, score, rank), all long.

    Of the documents with at least ``least_words`` words, ``percent`` % are drawn, those with
    the highest scores; ties go to the smaller doc_id. Their ranks count from 1, the others'
    are null. ``target`` (text) shows what is wanted; with no rows, it is taken as even.
    Null and empty texts have no features and weight 0. Rows that repeat a doc_id are each
    drawn by their own; of equal scores, the one with fewer features comes first. A null
    doc_id has no noise, so no score, and is not drawn. No rows in, no rows out.
    """
    gain = gains(bucket_counts(docs, runs, buckets), bucket_counts(target, runs, buckets))
    scored = weighed(docs, gain, runs).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = saved(scored, shared_dir(docs.sparkSession, "resample-score"))
    able = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    columns = ["doc_id", "n_features", "weight", "score"]
    entered = scored.where(able).select(*columns)
    keys = [("score", True), ("doc_id", False)]
    if not entered.groupBy("doc_id").count().where("count > 1").isEmpty():
        keys.append(("n_features", False))
    sorted_ = radix.positions(entered, keys)
    drawn = sorted_.count() * percent // 100
    rank = F.when(F.col("pos") < drawn, F.col("pos") + 1).alias("rank")
    rest = scored.where(~able).select(*columns, F.lit(None).cast("long").alias("rank"))
    return sorted_.select(*columns, rank).unionByName(rest)
