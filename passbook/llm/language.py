"""Language of a text: known words first, then shorter and shorter character n-grams.

A word that was seen in training is scored by its log frequency in each language. Any other
word is scored at each of its characters by the longest known n-gram that starts there
(with marks for the word's ends), and gets their mean. A text's scores are the sums over its
words; the best language wins, with its posterior as the score.

The model is counted on a sample of labelled rows of bounded expected size, with an equal
share for each language, so that a rare one is learned as well; priors come from all rows.
It holds a bounded number of words and, apart from them, of n-grams, and tells how many were
left out; all bounds are parameters. Every text is scored whole.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passbook.llm import arrays
from passbook.llm.quality import held_out
from passbook.session import saved, shared_dir

#: Expected number of labelled rows that the model is counted on; languages with fewer rows than
#: their share of it are counted on all of them.
SAMPLE_ROWS = 10_000
#: Longest character n-gram.
LONGEST = 4
#: Words in the model at most, the most frequent ones, and n-grams, shorter ones first; and how
#: often each occurs at least.
MOST_WORDS, MOST_GRAMS, LEAST_COUNT = 400_000, 400_000, 2
#: Added to each count.
SMOOTH = 0.5
#: Result where there is nothing to decide by.
UNKNOWN = "und"


def letter_words(texts: arrays.Texts) -> arrays.Words:
    """Runs of ASCII letters and non-ASCII bytes."""
    data = texts.data
    letter = ((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 128)
    return arrays.words_of(arrays.Texts(np.where(letter, data, np.uint8(32)), texts.bounds))


def char_grams(data: np.ndarray, words: arrays.Words) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For n = 1 to LONGEST the hash of the n-gram at each character (0 where the word is too
    short), then each character's word, and the number of characters of each word.

    Words get a mark in front and behind, which count as characters.
    """
    size = words.end - words.start
    bounds = np.concatenate([[0], np.cumsum(size + 2)])
    marked = np.full(int(bounds[-1]), 2, np.uint8)
    marked[bounds[1:] - 1] = 3
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    marked[inner + np.repeat(bounds[:-1] + 1, size)] = data[inner + np.repeat(words.start, size)]
    first = np.flatnonzero((marked & 0xC0) != 0x80)
    word = np.searchsorted(bounds, first, side="right") - 1
    ends = np.append(first[1:], len(marked))
    single = arrays.span_hashes(marked, first, ends)
    out = []
    for n in range(1, LONGEST + 1):
        value = np.zeros(len(first), np.uint64)
        m = len(first) - n + 1
        if m > 0:
            total = np.zeros(m, np.uint64)
            factor = arrays.numbers(n, 10 + n) | np.uint64(1)
            for k in range(n):
                total += single[k : k + m] * factor[k]
            value[:m] = np.where(word[:m] == word[n - 1 :], arrays.mix(total) | np.uint64(1), np.uint64(0))
        out.append(value)
    return out, word, np.bincount(word, minlength=len(words))


@dataclass
class Lookup:
    """Rows by 64-bit key, found without a Python object per key."""

    keys: np.ndarray
    rows: np.ndarray
    bits: int = 16

    def __post_init__(self) -> None:
        order = np.argsort(self.keys)
        self.keys, self.rows = self.keys[order], self.rows[order]
        self.bits = max(1, min(22, int(np.ceil(np.log2(len(self.keys) + 2)))))
        edges = np.arange(2**self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)
        self.first = np.append(np.searchsorted(self.keys, edges), len(self.keys)).astype(np.int32)
        self.longest = int(np.diff(self.first).max()) if len(self.keys) else 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row number of each key, -1 where it is unknown."""
        cell = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.first[cell], self.first[cell + 1]
        out = np.full(len(keys), -1, np.int32)
        open_ = np.flatnonzero(at < end)
        for step in range(self.longest):
            hit = self.keys[at[open_] + step] == keys[open_]
            out[open_[hit]] = at[open_[hit]] + step
            open_ = open_[~hit]
            open_ = open_[at[open_] + step + 1 < end[open_]]
        return out


@dataclass
class Model:
    """Languages, log priors, and log frequencies of words (order 0) and n-grams by order."""

    languages: list[str]
    priors: np.ndarray
    tables: dict[int, Lookup]
    #: Words and n-grams that occur often enough, but are beyond the bounds.
    left_out: tuple[int, int] = (0, 0)

    def parts(self) -> tuple:
        """The model as plain arrays, for a broadcast."""
        return self.languages, self.priors, {o: (t.keys, t.rows) for o, t in self.tables.items()}

    def scores(self, texts: arrays.Texts) -> np.ndarray:
        """Log scores of the languages, one row per text."""
        words = letter_words(texts)
        at = self.tables[0].find(words.hash)
        value = self.tables[0].rows[np.maximum(at, 0)]
        new = np.flatnonzero(at < 0)
        if len(new):
            _, one, which = np.unique(words.hash[new], return_index=True, return_inverse=True)
            pick = new[one]
            value[new] = self._backed_off(texts.data, arrays.Words(words.start[pick], words.end[pick], None, None))[which]
        out = np.tile(self.priors, (len(texts), 1))
        for k in range(len(self.languages)):
            out[:, k] += np.bincount(words.doc, value[:, k], minlength=len(texts))
        return out

    def _backed_off(self, data: np.ndarray, words: arrays.Words) -> np.ndarray:
        grams, word, n_chars = char_grams(data, words)
        value = np.zeros((len(word), len(self.languages)))
        rest = np.arange(len(word))
        for n in range(LONGEST, 0, -1):
            table = self.tables[n]
            at = table.find(grams[n - 1][rest])
            value[rest[at >= 0]] = table.rows[at[at >= 0]]
            rest = rest[at < 0]
        out = np.empty((len(words), len(self.languages)))
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(word, value[:, k], minlength=len(words)) / n_chars
        return out


def counted(rows: DataFrame) -> DataFrame:
    """Counts (order, key, lang, n) of the words and n-grams of ``rows`` (text, lang)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrays.blocks(whole):
                texts = arrays.texts_of(batch.column("text"))
                words = letter_words(texts)
                names, of_doc = np.unique(np.asarray(batch.column("lang").to_pylist(), object).astype(str), return_inverse=True)
                for i, name in enumerate(names):
                    own = np.flatnonzero(of_doc[words.doc] == i)
                    key, one, times = np.unique(words.hash[own], return_index=True, return_counts=True)
                    pick = own[one]
                    parts = [(0, key, times)]
                    found, word, _ = char_grams(texts.data, arrays.Words(words.start[pick], words.end[pick], None, None))
                    for n, value in enumerate(found, 1):
                        there = value != 0
                        gram, which = np.unique(value[there], return_inverse=True)
                        parts.append((n, gram, np.bincount(which, times[word[there]], minlength=len(gram))))
                    for order, keys, n_times in parts:
                        yield pa.record_batch(
                            [
                                pa.array(np.full(len(keys), order, np.int32)),
                                pa.array(keys.view(np.int64)),
                                pa.array([name] * len(keys), pa.string()),
                                pa.array(n_times.astype(np.int64)),
                            ],
                            names=["order", "key", "lang", "n"],
                        )

    return (
        rows.select(F.lower("text").alias("text"), "lang")
        .mapInArrow(count, "order int, key long, lang string, n long")
        .groupBy("order", "key", "lang")
        .agg(F.sum("n").alias("n"))
    )


def learn(
    docs: DataFrame, sample_rows: int = SAMPLE_ROWS, most_words: int = MOST_WORDS, most_grams: int = MOST_GRAMS
) -> Model:
    """The model of ``docs`` (doc_id, text, lang), from rows with a text and a language."""
    spark = docs.sparkSession
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    by_lang = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if sum(by_lang.values()) > sample_rows:
        share = sample_rows / len(by_lang)
        keep = [(v, min(1 << 40, int(share / n * (1 << 40)))) for v, n in by_lang.items()]
        shares = F.broadcast(spark.createDataFrame(keep, "lang string, below long"))  # a row a language
        rows = rows.join(shares, "lang").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) < F.col("below"))
    counts = saved(counted(rows), shared_dir(spark, "language-count"))
    totals = {(r.order, r.lang): r.n for r in counts.groupBy("order", "lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted({lang for _, lang in totals})
    kept = (
        counts.groupBy("order", "key")
        .agg(
            F.sum("n").alias("n"),
            *(F.sum(F.when(F.col("lang") == v, F.col("n")).otherwise(0)).alias(f"n{i}") for i, v in enumerate(languages)),
        )
        .where(F.col("n") >= LEAST_COUNT)
    )
    words, grams = kept.where(F.col("order") == 0), kept.where(F.col("order") > 0)
    many = kept.agg(F.count_if(F.col("order") == 0).alias("words"), F.count_if(F.col("order") > 0).alias("grams")).first()
    left_out = max(0, many.words - most_words), max(0, many.grams - most_grams)
    if any(left_out):
        warnings.warn(f"{left_out[0]} words and {left_out[1]} n-grams are beyond the bounds of the model", stacklevel=2)
    frequent = [F.col("n").desc(), F.col("key")]
    table = pa.concat_tables(
        [words.orderBy(*frequent).limit(most_words).toArrow(), grams.orderBy("order", *frequent).limit(most_grams).toArrow()]
    )
    order, key = np.asarray(table["order"]), np.asarray(table["key"]).view(np.uint64)
    number = np.stack([np.asarray(table[f"n{i}"], float) for i in range(len(languages))], axis=1) if languages else None
    tables = {}
    for o in range(LONGEST + 1):
        own = order == o
        if languages:
            whole = np.array([totals.get((o, v), 0) for v in languages], float)
            rows_ = np.log((number[own] + SMOOTH) / (whole + SMOOTH * max(1, own.sum())))
        else:
            rows_ = np.zeros((0, 0))
        tables[o] = Lookup(key[own], rows_)
    priors = np.log(np.array([by_lang.get(v, 0) + 1.0 for v in languages])) if languages else np.zeros(0)
    return Model(languages, priors, tables, left_out)


def predicted(text: Column, shared: Broadcast) -> Column:
    """struct(lang, score) of a text; ``shared`` holds the parts of a model."""
    held = {}

    def predict(column: pa.Array) -> pa.Array:
        if not held:
            languages, priors, tables = shared.value
            held["model"] = Model(languages, priors, {o: Lookup(*t) for o, t in tables.items()})
        model = held["model"]
        batch = pa.record_batch([column], names=["text"])
        langs, scores = [], []
        for block in arrays.blocks(batch):
            log = model.scores(arrays.texts_of(block.column("text")))
            best = log.argmax(axis=1)
            scores.append(1.0 / np.exp(log - log.max(axis=1, keepdims=True)).sum(axis=1))
            langs.extend(model.languages[i] for i in best)
        return pa.StructArray.from_arrays(
            [pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())],
            names=["lang", "score"],
        )

    return F.arrow_udf(predict, "lang string, score double")(F.lower(text))


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` (doc_id, text, lang) as (doc_id, held_out, lang_pred, score).

    Learned from rows that have a text, a language and an id that is not held out; a null id
    is none of those. ``und`` with score 0 where a text is null or has no letter, or nothing
    was learned. Rows that repeat are scored each; equal scores go to the language that sorts
    first. No rows in, no rows out. Other columns are ignored.
    """
    spark = docs.sparkSession
    model = learn(docs.where(~held_out(F.col("doc_id"))), sample_rows)
    rows = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    if not model.languages:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(model.parts())
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    found = rows.withColumn("lettered", lettered).withColumn("found", predicted(F.col("text"), shared))
    return found.select(
        "doc_id",
        "held_out",
        F.when(F.col("lettered"), F.col("found.lang")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("lettered"), F.col("found.score")).otherwise(0.0).alias("score"),
    )
