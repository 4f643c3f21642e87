"""Token files with ids packed to the vocabulary's bits.

A file is one block of consecutive documents, little-endian throughout:

    8 bytes   magic ``PBTOKEN1``
    4 x u32   bits of an id, documents, ids in a group, 1 if the first documents may have null ids
    u64       ids in the block
    u8  [documents]      1 where the doc_id is null
    i64 [documents]      doc_id
    u64 [documents + 1]  place of each document's first id in the block
    u64 [groups + 1]     byte of each group in the packed ids
    ...       packed ids, then a line break that the text writer adds

Ids are packed in groups, each on a byte of its own, so any document is unpacked from its
groups alone, by shifts over whole arrays. Files are written and read by Spark, so they can
be in any store that it reaches, and a lost task is written again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passbook.llm import arrays, tokens
from passbook.session import saved, shared_dir

MAGIC = b"PBTOKEN1"
#: Ids of a file at least, but for the last one of a task; a document is never split.
BLOCK_IDS = 1 << 21
#: Ids of a group: a multiple of 64.
GROUP_IDS = 1 << 12
#: Id that ends a document.
END = 0


def bits_of(vocabulary: int) -> int:
    """Least bits that hold every id of a vocabulary."""
    return max(1, int(vocabulary - 1).bit_length())


def packed(ids: np.ndarray, bits: int) -> bytes:
    """64 ids at a time fill ``bits`` words of 64 bits; the last ones are padded with 0."""
    lanes = np.zeros((-(-len(ids) // 64), 64), np.uint64)
    lanes.ravel()[: len(ids)] = ids
    out = np.zeros((len(lanes), bits), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        out[:, word] |= lanes[:, j] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= lanes[:, j] >> np.uint64(64 - shift)
    return out.astype("<u8").tobytes()


def unpacked(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of ``data``."""
    words = np.frombuffer(data, "<u8", -(-n // 64) * bits).reshape(-1, bits)
    out = np.empty((len(words), 64), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | (words[:, word + 1] << np.uint64(64 - shift))
        out[:, j] = value & mask
    return out.ravel()[:n]


def block(doc_ids: list, ids: np.ndarray, bounds: np.ndarray, bits: int) -> bytes:
    """The bytes of one file."""
    none = np.array([d is None for d in doc_ids], np.uint8)
    n_groups = -(-len(ids) // GROUP_IDS)
    body = packed(ids, bits)
    at = np.minimum(np.arange(n_groups + 1, dtype=np.int64) * (GROUP_IDS // 8 * bits), len(body))
    return b"".join(
        (
            MAGIC,
            np.array([bits, len(doc_ids), GROUP_IDS, int(none.any())], "<u4").tobytes(),
            np.array([len(ids)], "<u8").tobytes(),
            none.tobytes(),
            np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
            bounds.astype("<u8").tobytes(),
            at.astype("<u8").tobytes(),
            body,
        )
    )


@dataclass
class Block:
    """A file's documents; ``ids(i)`` unpacks those groups only that hold document i."""

    data: bytes
    bits: int
    group: int
    doc_ids: np.ndarray
    null: np.ndarray
    bounds: np.ndarray
    group_at: np.ndarray
    body: int

    @staticmethod
    def of(data: bytes) -> Block:
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        bits, docs, group, _ = np.frombuffer(data, "<u4", 4, 8).tolist()
        n = int(np.frombuffer(data, "<u8", 1, 24)[0])
        at = 32
        null = np.frombuffer(data, np.uint8, docs, at).astype(bool)
        at += docs
        doc_ids = np.frombuffer(data[at : at + 8 * docs], "<i8")
        at += 8 * docs
        bounds = np.frombuffer(data[at : at + 8 * (docs + 1)], "<u8").astype(np.int64)
        at += 8 * (docs + 1)
        groups = -(-n // group)
        group_at = np.frombuffer(data[at : at + 8 * (groups + 1)], "<u8").astype(np.int64)
        return Block(data, bits, group, doc_ids, null, bounds, group_at, at + 8 * (groups + 1))

    def span(self, start: int, end: int) -> np.ndarray:
        """Ids from place ``start`` to ``end`` of the block."""
        first, last = start // self.group, -(-end // self.group)
        piece = self.data[self.body + self.group_at[first] : self.body + self.group_at[last]]
        n = min(last * self.group, int(self.bounds[-1])) - first * self.group
        return unpacked(piece, self.bits, n)[start - first * self.group : end - first * self.group]

    def ids(self, i: int) -> np.ndarray:
        return self.span(int(self.bounds[i]), int(self.bounds[i + 1]))


def write(docs: DataFrame, path: str, tokenizer: str, block_ids: int = BLOCK_IDS) -> None:
    """Write ``docs`` (doc_id, text) as token files in ascending doc_id order, nulls first.

    A null text is empty; each document ends with id 0. Rows that repeat are written each.
    Documents are dealt by ranges of doc_id, so files hold consecutive documents and their
    names ascend with them.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.Encoder.of(tokenizer, spaced=True)
        bits = bits_of(encoder.vocabulary)
        doc_ids: list = []
        parts: list = []
        sizes: list = []
        held = 0

        def flush() -> pa.RecordBatch:
            bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            return pa.record_batch(
                [pa.array([block(doc_ids, np.concatenate(parts), bounds, bits)], pa.binary())], names=["block"]
            )

        for whole in batches:
            for batch in arrays.blocks(whole):
                ids, bounds = encoder.encode(arrays.texts_of(batch.column("text")))
                bounds = np.asarray(bounds)
                n = np.diff(bounds) + 1
                out = np.full(int(n.sum()), END, np.uint32)
                out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n - 1)] = ids
                doc_ids.extend(batch.column("doc_id").to_pylist())
                parts.append(out)
                sizes.append(n)
                held += len(out)
                if held >= block_ids:
                    yield flush()
                    doc_ids, parts, sizes, held = [], [], [], 0
        if doc_ids:
            yield flush()

    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(pack, "block binary")
        .select(F.col("block").cast("string").alias("value"))
        .write.option("maxRecordsPerFile", 1)
        .option("compression", "none")
        .text(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of token files as (file, doc_id, place, n_tokens, ids).

    ``place`` is the first id's place in the file; ``ids`` are little-endian unsigned 32-bit
    integers with the end id.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                found = Block.of(content.as_buffer().to_pybytes())
                n = len(found.doc_ids)
                step = max(1, 64 * n // max(1, int(found.bounds[-1]) // 4096 + 1))
                for at in range(0, n, step):
                    to = min(n, at + step)
                    ids = found.span(int(found.bounds[at]), int(found.bounds[to])).astype("<u4").tobytes()
                    ends = (found.bounds[at : to + 1] - found.bounds[at]) * 4
                    column = pa.Array.from_buffers(
                        pa.large_binary(), to - at, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids)]
                    )
                    yield pa.record_batch(
                        [
                            pa.array([name] * (to - at), pa.string()),
                            pa.array(found.doc_ids[at:to], mask=found.null[at:to]),
                            pa.array(found.bounds[at:to]),
                            pa.array(np.diff(found.bounds[at : to + 1])),
                            column.cast(pa.binary()),
                        ],
                        names=["file", "doc_id", "place", "n_tokens", "ids"],
                    )

    files = spark.read.format("binaryFile").load(path).where(F.col("length") > 0).select("path", "content")
    return files.mapInArrow(parse, "file string, doc_id long, place long, n_tokens long, ids binary")


def starts(placed: DataFrame) -> DataFrame:
    """``placed`` (file, doc_id, place, n_tokens, ...) with ``start``: ids of all before.

    One row for each file is accumulated, in the order of their documents.
    """
    order = Window.orderBy(F.col("first").asc_nulls_first(), F.col("last").asc_nulls_first(), "file")
    files = (
        placed.groupBy("file")
        .agg(
            F.sum("n_tokens").alias("n"),
            F.when(F.count("*") > F.count("doc_id"), None).otherwise(F.min("doc_id")).alias("first"),
            F.max("doc_id").alias("last"),
        )
        .withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select("file", "before")
    )
    return placed.join(files, "file").withColumn("start", F.col("before") + F.col("place")).drop("before")


def round_trip(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write ``docs`` (doc_id, text) and read them back: (doc_id, start, n_tokens, ids_crc32).

    No rows in, no files and no rows out. Other columns are ignored.
    """
    spark = docs.sparkSession
    path = path or shared_dir(spark, "tokens")
    write(docs, path, tokenizer)
    found = read(spark, path).select("file", "doc_id", "place", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    placed = saved(found, shared_dir(spark, "tokens-read"))
    return starts(placed).select("doc_id", "start", "n_tokens", "ids_crc32")
