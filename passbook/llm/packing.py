"""Packing of documents into sequences by length patterns and non-negative least squares.

Documents are cut into pieces of at most a sequence; only the numbers of pieces by length
are packed, which is a table of fixed size however many documents there are:

1. Patterns of two and three lengths that fill a sequence without a gap are enumerated.
   Non-negative least squares fits how often each pattern repeats to the histogram; counts
   are rounded to what the histogram holds, and full pieces stand alone.
2. What is left of the histogram is packed by best fit, longest first; pieces of one length
   and sequences with equal space are handled as one run.
3. A piece's rank among the pieces of its length, which Spark counts in ranges of a hash,
   names its slot in the plan, and the slot its sequence and offset.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passbook.llm import arrays, tokens
from passbook.session import saved, shared_dir

#: Tokens of a sequence.
SEQUENCE = 2048
#: The smallest length in a pattern of three is a multiple of this; rounds of the fit.
STEP, ROUNDS = 64, 400
#: Short pieces fill gaps best, so the fit may leave them: lengths up to this, and their weight.
SHORT, SHORT_WEIGHT = 128, 0.1
#: Id that ends a document.
END = 0
#: Bytes of text that are encoded at once: a worker needs up to a hundred times as many.
ENCODED_BYTES = 1 << 19


def cutter(tokenizer: str, sequence: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task does for ``pieces``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.Encoder.of(tokenizer, spaced=False)
        for whole in batches:
            for batch in arrays.blocks(whole, most=ENCODED_BYTES):
                ids, bounds = encoder.encode(arrays.texts_of(batch.column("text")))
                size = np.diff(bounds) + 1
                out = np.full(int(size.sum()), END, "<u4")
                out[np.arange(len(ids)) + np.repeat(np.arange(len(size)), size - 1)] = ids
                count = -(-size // sequence)
                doc = np.repeat(np.arange(len(size)), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * sequence
                length = np.minimum(sequence, size[doc] - start)
                ends = np.concatenate([[0], np.cumsum(length)]) * 4
                column = pa.Array.from_buffers(
                    pa.binary(), len(doc), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(out)]
                )
                yield pa.record_batch(
                    [
                        batch.column("doc_id").take(pa.array(doc)),
                        pa.array(piece.astype(np.int32)),
                        pa.array(start),
                        pa.array(length),
                        column,
                    ],
                    names=["doc_id", "piece", "start", "length", "ids"],
                )

    return cut


def pieces(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, piece, start, length, ids).

    A document is its ids and the end id; null text is empty. Documents longer than a
    sequence are cut into full pieces and a last one. ``ids`` are little-endian unsigned
    32-bit integers.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        cutter(tokenizer, sequence), "doc_id long, piece int, start long, length long, ids binary"
    )


def patterns(sequence: int, step: int = STEP) -> np.ndarray:
    """Rows (a, b, c) of lengths that fill a sequence: all pairs (c is 0), and all triples
    whose smallest length is a multiple of ``step``."""
    rows = []
    for c in range(0, sequence // 3 + 1, step):
        b = np.arange(max(1, c), (sequence - c) // 2 + 1)
        rows.append(np.stack([sequence - c - b, b, np.full(len(b), c)], axis=1))
    return np.concatenate(rows)


def non_negative_least_squares(
    rows: np.ndarray, target: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS
) -> np.ndarray:
    """x >= 0 with least weighted distance of what the patterns x take from ``target``.

    Row i of ``rows`` takes one of each of its lengths; length 0 is none. Accelerated
    projected gradients: every pattern has three entries, so a round is two sums over them.
    """
    weight = np.where(np.arange(len(target)) == 0, 0.0, weight**2)
    flat = rows.ravel()
    uses = np.bincount(flat, minlength=len(target)) * weight
    # Bounds the curvature: each pattern's entries, by what shares their lengths.
    curve = max(1.0, float(uses[rows].sum(axis=1).max(initial=0.0)))
    x = y = np.zeros(len(rows))
    momentum = 1.0
    for _ in range(rounds):
        missing = weight * (target - np.bincount(flat, np.repeat(y, rows.shape[1]), minlength=len(target)))
        new = np.maximum(0.0, y + missing[rows].sum(axis=1) / curve)
        faster = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        y = new + (momentum - 1) / faster * (new - x)
        x, momentum = new, faster
    return x


class Plan:
    """Runs of slots: for a length, slots from ``slot`` on are sequences from ``first`` on."""

    def __init__(self, sequence: int = SEQUENCE):
        self.sequence = sequence
        self.n_sequences = 0
        self.used = np.zeros(sequence + 1, np.int64)
        self.runs: list[tuple[int, int, int, int]] = []
        self.spaces: list[int] = []
        self.open: dict[int, list[tuple[int, int]]] = {}

    def put(self, length: int, n: int, first: int, offset: int) -> None:
        """The next ``n`` pieces of a length go to sequences first, first + 1, ..."""
        self.runs.append((length, int(self.used[length]), first, offset))
        self.used[length] += n

    def new(self, n: int) -> int:
        self.n_sequences += n
        return self.n_sequences - n

    def leave(self, space: int, first: int, n: int) -> None:
        """``n`` sequences from ``first`` on have so much space."""
        if space and n:
            if space not in self.open:
                insort(self.spaces, space)
                self.open[space] = []
            self.open[space].append((first, n))

    def best_fit(self, length: int, n: int) -> None:
        """Pack ``n`` pieces of a length, each where it leaves the least space."""
        while n:
            i = bisect_left(self.spaces, length)
            if i == len(self.spaces):
                each = self.sequence // length
                for some, count in ((n // each, each), (min(1, n % each), n % each)):
                    if some:
                        first = self.new(some)
                        for k in range(count):
                            self.put(length, some, first, k * length)
                        self.leave(self.sequence - count * length, first, some)
                return
            space = self.spaces[i]
            first, there = self.open[space].pop()
            take = min(n, there)
            if take < there:
                self.open[space].append((first + take, there - take))
            if not self.open[space]:
                del self.open[space], self.spaces[i]
            self.put(length, take, first, self.sequence - space)
            self.leave(space - length, first, take)
            n -= take


def plan(histogram: np.ndarray, sequence: int = SEQUENCE) -> Plan:
    """The plan for ``histogram[length]`` pieces of each length."""
    out = Plan(sequence)
    rest = histogram.astype(np.int64).copy()
    if rest[sequence]:
        out.put(sequence, int(rest[sequence]), out.new(int(rest[sequence])), 0)
        rest[sequence] = 0
    shapes = patterns(sequence)
    weight = np.where(np.arange(sequence + 1) <= SHORT, SHORT_WEIGHT, 1.0)
    times = non_negative_least_squares(shapes, rest.astype(float), weight)
    for i in np.argsort(-times, kind="stable"):
        wanted = int(round(times[i]))
        if not wanted:
            break
        lengths, need = np.unique(shapes[i][shapes[i] > 0], return_counts=True)
        n = min(wanted, int((rest[lengths] // need).min()))
        if n:
            rest[lengths] -= n * need
            first, offset = out.new(n), 0
            for length in shapes[i][shapes[i] > 0].tolist():
                out.put(length, n, first, offset)
                offset += length
    for length in range(sequence - 1, 0, -1):
        out.best_fit(length, int(rest[length]))
    return out


def pack(cut: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """``cut`` (doc_id, piece, length, ...), a stored table, with sequence_id and offset.

    Lengths are 1 to ``sequence``. Rows that repeat are packed each, and null doc_ids like
    others. No rows in, no rows out.
    """
    spark = cut.sparkSession
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    histogram = np.zeros(sequence + 1, np.int64)
    for length, n in counts.items():
        histogram[length] = n
    runs = np.array(sorted(plan(histogram, sequence).runs), np.int64).reshape(-1, 4)
    # Runs of all lengths as one ascending key: length, then slot.
    shift = int(histogram.max(initial=0)) + 1
    shared = spark.sparkContext.broadcast((runs[:, 0] * shift + runs[:, 1], runs[:, 1], runs[:, 2], runs[:, 3]))

    def slot(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        key, slots, firsts, offsets = shared.value
        rank = np.asarray(ranks, np.int64)
        at = np.searchsorted(key, np.asarray(lengths, np.int64) * shift + rank, side="right") - 1
        return pa.StructArray.from_arrays(
            [pa.array(firsts[at] + rank - slots[at]), pa.array(offsets[at])], names=["sequence_id", "offset"]
        )

    # About as many ranges of a hash, over all lengths, as rows in each.
    n_cells = max(1, int(np.sqrt(histogram.max(initial=0))))
    celled = cut.withColumn("cell", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n_cells)))
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    bases = saved(
        celled.groupBy("length", "cell")
        .agg(F.count("*").alias("n"))
        .withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .drop("n"),
        shared_dir(spark, "pack"),
    )
    inner = Window.partitionBy("length", "cell").orderBy("doc_id", "piece")
    ranked = celled.join(bases, ["length", "cell"]).withColumn("rank", F.col("base") + F.row_number().over(inner) - 1)
    found = F.arrow_udf(slot, "sequence_id long, offset long")(F.col("length"), F.col("rank"))
    return ranked.withColumn("slot", found).select(
        *cut.columns, F.col("slot.sequence_id").alias("sequence_id"), F.col("slot.offset").alias("offset")
    )


def packed_documents(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, piece, start, length, ids, sequence_id, offset).

    A sequence is the ``ids`` of its rows by offset. Null and empty texts are one piece with
    the end id. No rows in, no rows out; other columns are ignored.
    """
    cut = pieces(docs, tokenizer, sequence)
    return pack(saved(cut, shared_dir(docs.sparkSession, "pieces")), sequence)
