"""Near duplicates by SimHash: a Gray-order hierarchical index, joined with itself.

1. Each text becomes a 64-bit fingerprint: the majority of each bit over its shingles' hashes.
   Equal fingerprints form a class, and only its smallest doc_id goes on.
2. Fingerprints are sorted by Gray rank, where neighbours share most bits, and cut into blocks.
   A block's node holds the bits that all its members share (mask and values); 16 nodes in a
   row share a parent with what they have in common, up to one root.
3. The index is joined with itself from the root down: two nodes differ in at least as many
   bits as differ among those that both share. Where these are more than allowed, the pair
   goes, and with it all pairs of members. Pairs of blocks that are left are joined by the
   same descent inside tasks, down to single fingerprints.
4. A pair of blocks gives a spanning forest of its links, which keeps what is connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passbook.llm import arrays
from passbook.llm.components import components
from passbook.session import saved, shared_dir

#: Words of a shingle, seed of its hash, and differing bits of a link.
WORDS, SEED, MOST = 3, 42, 2
#: Members of a block, and children of a node above blocks as a power of two.
BLOCK, FANOUT_BITS = 4096, 4
#: Pairs of nodes that a task looks at together.
AT_ONCE = 1 << 20


def fingerprints(docs: DataFrame, n: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, code): the fingerprint of each document as a signed long.

    Words are runs of bytes outside ``\\x20`` and ``\\x09-\\x0D``, A-Z lower-cased. A bit is 1 if
    set in over half the XXH64 values of all ``n``-word shingles, repeats included. A text of
    fewer words has one shingle; without words, the fingerprint is zero.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for whole in batches:
            for batch in arrays.blocks(whole):
                texts = arrays.texts_of(batch.column("text"))
                hashes, count = [], np.zeros(len(texts), np.int64)
                for i in range(len(texts)):
                    words = texts.get(i).lower().split()
                    last = len(words) - n + 1
                    if last > 1:
                        joined = b" ".join(words)
                        size = np.array([len(w) for w in words]) + 1
                        end = np.cumsum(size) - 1
                        start = (end - size + 1).tolist()
                        hashes += [digest(joined[a:b], seed) for a, b in zip(start, end[n - 1 :].tolist(), strict=False)]
                        count[i] = last
                    elif words:
                        hashes.append(digest(b" ".join(words), seed))
                        count[i] = 1
                value = np.array(hashes, np.uint64)
                code = np.zeros(len(texts), np.uint64)
                some = np.flatnonzero(count)
                if len(some):
                    starts = (np.cumsum(count) - count)[some]
                    for bit in range(64):
                        set_ = np.add.reduceat((value >> np.uint64(bit)) & np.uint64(1), starts).astype(np.int64)
                        code[some] |= (2 * set_ > count[some]).astype(np.uint64) << np.uint64(bit)
                yield pa.record_batch([batch.column("doc_id"), pa.array(code.view(np.int64))], names=["doc_id", "code"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, "doc_id long, code long")


def gray_rank(code: Column) -> Column:
    """The place of a 64-bit code in Gray order, as a signed long in the order of places."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code.bitwiseXOR(F.lit(-(1 << 63)))


def blocks_of(codes: DataFrame) -> DataFrame:
    """``codes`` (code, node), codes distinct, in Gray order as a stored table of blocks
    (seq, codes, nodes, shared, bits): numbered from 0, with the bits that all members share."""
    spark = codes.sparkSession
    ordered = codes.withColumn("rank", gray_rank(F.col("code"))).repartitionByRange("rank").sortWithinPartitions("rank")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def block(table: pa.Table) -> pa.RecordBatch:
            lists = [pa.array([table.column(c).to_numpy()], pa.list_(pa.int64())) for c in ("code", "node")]
            first = table.column("rank")[0].as_py()
            code = table.column("code").to_numpy()
            shared = ~(np.bitwise_or.reduce(code) ^ np.bitwise_and.reduce(code))
            ends = [pa.array([x], pa.int64()) for x in (first, int(shared), int(code[0] & shared))]
            return pa.record_batch([ends[0], *lists, *ends[1:]], names=["first", "codes", "nodes", "shared", "bits"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            while size >= BLOCK:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, BLOCK))
                held, size = table.slice(BLOCK).to_batches(), size - BLOCK
        if size:
            yield block(pa.Table.from_batches(held))

    cut_ = ordered.mapInArrow(cut, "first long, codes array<long>, nodes array<long>, shared long, bits long")
    cut_ = saved(cut_.withColumn("part", F.spark_partition_id()), shared_dir(spark, "simhash-cut"))
    # Numbers of blocks: one row for each range partition gives where it starts.
    parts = sorted((r[0], r[1]) for r in cut_.groupBy("part").count().collect())
    at, starts = 0, []
    for part, n in parts:
        starts.append((part, at))
        at += n
    base = F.broadcast(spark.createDataFrame(starts, "part int, base long"))  # a row for each partition
    within = F.row_number().over(Window.partitionBy("part").orderBy("first"))
    numbered = cut_.select("part", "first", within.alias("i")).join(base, "part")
    seq = numbered.select("first", (F.col("base") + F.col("i") - 1).alias("seq"))
    return saved(cut_.drop("part").join(seq, "first").drop("first"), shared_dir(spark, "simhash-block"))


def nodes_above(nodes: DataFrame) -> DataFrame:
    """The parents (seq, shared, bits) of ``nodes``: what all 2 ** FANOUT_BITS children share."""
    parts = nodes.groupBy(F.shiftright("seq", FANOUT_BITS).alias("seq")).agg(
        F.bit_and("shared").alias("all"), F.bit_or("bits").alias("any"), F.bit_and(F.col("bits").bitwiseOR(F.bitwise_not("shared"))).alias("ones")
    )
    # Shared by all children, and of one value: all ones, or no one.
    same = F.col("all").bitwiseAND(F.bitwise_not(F.col("any").bitwiseXOR(F.col("ones"))))
    return parts.select("seq", same.alias("shared"), F.col("any").bitwiseAND(same).alias("bits"))


def near(shared_a: Column, bits_a: Column, shared_b: Column, bits_b: Column, most: int) -> Column:
    """Whether the bits that two nodes both share differ in ``most`` places or fewer."""
    return F.bit_count(bits_a.bitwiseXOR(bits_b).bitwiseAND(shared_a).bitwiseAND(shared_b)) <= most


def near_blocks(blocks: DataFrame, most: int) -> DataFrame:
    """Stored pairs (a, b), a <= b, of blocks with members that may be near, from the root down."""
    spark = blocks.sparkSession
    levels = [blocks.select("seq", "shared", "bits")]
    last = blocks.agg(F.max("seq")).first()[0]
    while last > 0:
        levels.append(saved(nodes_above(levels[-1]), shared_dir(spark, "simhash-node")))
        last >>= FANOUT_BITS
    pairs = spark.range(1).select(F.col("id").alias("a"), F.col("id").alias("b"))
    for parents, nodes in zip(levels[:0:-1], levels[-2::-1], strict=True):
        of_a = nodes.select(
            F.col("seq").alias("ca"), F.shiftright("seq", FANOUT_BITS).alias("a"), F.col("shared").alias("sa"), F.col("bits").alias("va")
        )
        of_b = nodes.select(
            F.col("seq").alias("cb"), F.shiftright("seq", FANOUT_BITS).alias("b"), F.col("shared").alias("sb"), F.col("bits").alias("vb")
        )
        over_b = parents.select(F.col("seq").alias("b"), F.col("shared").alias("pb"), F.col("bits").alias("wb"))
        # The children of a against b first, then against the children of b.
        half = pairs.join(over_b, "b").join(of_a, "a").where(near(F.col("sa"), F.col("va"), F.col("pb"), F.col("wb"), most))
        both = half.select("ca", "sa", "va", "b").join(of_b, "b")
        both = both.where((F.col("ca") <= F.col("cb")) & near(F.col("sa"), F.col("va"), F.col("sb"), F.col("vb"), most))
        pairs = saved(both.select(F.col("ca").alias("a"), F.col("cb").alias("b")), shared_dir(spark, "simhash-pair"))
    return pairs


def _levels(code: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(shared, bits) of the nodes over ``code`` from the single codes up to one root."""
    shared, bits = np.full(len(code), ~np.uint64(0)), code
    out = [(shared, bits)]
    while len(bits) > 1:
        at = np.arange(0, len(bits), 1 << FANOUT_BITS)
        ones = np.bitwise_and.reduceat(bits | ~shared, at)
        any_ = np.bitwise_or.reduceat(bits, at)
        shared = np.bitwise_and.reduceat(shared, at) & ~(ones ^ any_)
        bits = any_ & shared
        out.append((shared, bits))
    return out


def _children(node: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The children of each node among ``n``, and the place of their parent in ``node``."""
    first = node << FANOUT_BITS
    count = np.minimum(first + (1 << FANOUT_BITS), n) - first
    parent = np.repeat(np.arange(len(node)), count)
    return first[parent] + np.arange(len(parent)) - np.repeat(np.cumsum(count) - count, count), parent


def near_codes(x: np.ndarray, y: np.ndarray, most: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) in the Gray-ordered codes ``x`` and ``y`` that differ in ``most`` bits or
    fewer, by descent in both trees; with ``same``, x is y and each pair is given once."""
    of_x, of_y = _levels(x), _levels(y)
    (sa, va), (sb, vb) = of_x[-1], of_y[-1]
    if (same and len(x) == 1) or np.bitwise_count((va ^ vb) & sa & sb)[0] > most:
        return
    waiting = [(len(of_x) - 1, len(of_y) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while waiting:
        at_x, at_y, a, b = waiting.pop()
        if at_x == at_y == 0:
            yield a, b
            continue
        if at_x >= at_y:  # the higher tree goes down first
            at_x -= 1
            a, parent = _children(a, len(of_x[at_x][0]))
            b = b[parent]
        else:
            at_y -= 1
            b, parent = _children(b, len(of_y[at_y][0]))
            a = a[parent]
        (sa, va), (sb, vb) = of_x[at_x], of_y[at_y]
        keep = np.bitwise_count((va[a] ^ vb[b]) & sa[a] & sb[b]) <= most
        if same and at_x == at_y:
            keep &= a <= b if at_x else a < b
        a, b = a[keep], b[keep]
        for k in range(0, len(a), AT_ONCE >> FANOUT_BITS):
            part = slice(k, k + (AT_ONCE >> FANOUT_BITS))
            waiting.append((at_x, at_y, a[part], b[part]))


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining places ``i`` and ``j``: the smallest place that each can reach."""
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while True:  # labels of labels
            next_ = new[new]
            if (next_ == new).all():
                break
            new = next_
        if (new == label).all():
            return label
        label = new


def block_links(pairs: DataFrame, blocks: DataFrame, most: int) -> DataFrame:
    """Links (a, b) of nodes of the blocks in ``pairs``: a spanning forest for each pair."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x, y, of_x, of_y = (
                    np.asarray(batch.column(c)[row].values) for c in ("codes_a", "codes_b", "nodes_a", "nodes_b")
                )
                same = batch.column("a")[row] == batch.column("b")[row]
                offset = 0 if same else len(x)
                label = np.arange(len(x) + len(y) - (len(x) if same else 0))
                for i, j in near_codes(x.view(np.uint64), y.view(np.uint64), most, same):
                    label = _joined(label, i, j + offset)
                nodes = of_x if same else np.concatenate([of_x, of_y])
                tied = np.flatnonzero(label != np.arange(len(label)))
                yield pa.record_batch([pa.array(nodes[label[tied]]), pa.array(nodes[tied])], names=["a", "b"])

    of_a = blocks.select(F.col("seq").alias("a"), F.col("codes").alias("codes_a"), F.col("nodes").alias("nodes_a"))
    of_b = blocks.select(F.col("seq").alias("b"), F.col("codes").alias("codes_b"), F.col("nodes").alias("nodes_b"))
    return pairs.join(of_a, "a").join(of_b, "b").mapInArrow(link, "a long, b long")


def cluster(docs: DataFrame, n: int = WORDS, most: int = MOST) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, fingerprint, component_id).

    Documents whose fingerprints differ in ``most`` bits or fewer are linked; a component's id
    is the smallest doc_id that can be reached. Null texts, empty ones and those of white space
    have the fingerprint zero and are linked like any other. Rows that repeat a doc_id count
    as one document: their links are shared, and each row is returned. A null doc_id has a
    null component and links nothing. No rows in, no rows out.
    """
    spark = docs.sparkSession
    signed = saved(fingerprints(docs, n), shared_dir(spark, "simhash"))
    known = signed.where(F.col("doc_id").isNotNull())
    codes = saved(known.groupBy("code").agg(F.min("doc_id").alias("node")), shared_dir(spark, "simhash-code"))
    if codes.isEmpty():
        links = spark.createDataFrame([], "a long, b long")
    else:
        blocks = blocks_of(codes)
        links = saved(block_links(near_blocks(blocks, most), blocks, most), shared_dir(spark, "simhash-link"))
    # A doc_id that repeats with another text has several fingerprints and links them.
    several = known.groupBy("doc_id").agg(F.min("code").alias("lo"), F.max("code").alias("hi")).where("lo <> hi")
    split = several.select("doc_id").join(known, "doc_id").join(codes, "code")
    split = split.select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    labels = components(links.unionByName(split))
    of_code = codes.join(labels, "node", "left").select("code", F.coalesce("component", "node").alias("component_id"))
    found = signed.join(saved(of_code, shared_dir(spark, "simhash-component")), "code", "left")
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )
