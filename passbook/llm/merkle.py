"""Merkle manifest of a dataset: a root over all rows, and a proof for each of them.

1. Each row's leaf is the SHA-256 of its columns. Leaves are numbered in order inside their
   group, and aligned runs of 8 ** LOCAL of them become blocks, each the work of one task.
2. A block's root is hashed from its leaves alone. Then blocks trade roots in a butterfly: in
   each round, every block meets those of its aligned group of 8 subtrees that stand at the
   same place in theirs, takes their roots as its siblings, and hashes the common parent, as
   the others do too. After the last round each block has its path to the group's root,
   without a pass back down.
3. The roots of the groups are leaves of one more such tree, whose root is the dataset's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from passbook.session import saved, shared_dir

#: Children of a node, and levels that a block holds: blocks have FANOUT ** LOCAL leaves.
FANOUT, LOCAL = 8, 3
#: One step of a path: the other nodes of a run, before and after the own one.
STEP = "struct<left: string, right: string>"


def leaf_hash(columns: list[Column]) -> Column:
    """SHA-256 of the columns: ``-`` for null, else UTF-8 byte count, ``:``, value."""
    texts = [c.cast("string") for c in columns]
    parts = [
        F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts
    ]
    return F.sha2(F.concat(*parts), 256)


def _levels(leaves: list[str], n_levels: int) -> list[list[str]]:
    """The nodes of ``n_levels`` levels over the leaves, lowest first, and the top."""
    out = [leaves]
    for _ in range(n_levels):
        below = out[-1]
        runs = ("".join(below[i : i + FANOUT]) for i in range(0, len(below), FANOUT))
        out.append([hashlib.sha256(run.encode()).hexdigest() for run in runs])
    return out


def _local_levels(n: int, total: int) -> int:
    """Levels inside a block of ``n`` of a group's ``total`` leaves: all, or up to one root."""
    if total > FANOUT**LOCAL:
        return LOCAL
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def _step(level: list[str], i: int) -> tuple[str, str]:
    first = i - i % FANOUT
    return "".join(level[first:i]), "".join(level[i + 1 : first + FANOUT])


def leaf_blocks(leaves: DataFrame) -> DataFrame:
    """``leaves`` (grp, key, leaf, changed) as a stored table of blocks (grp, block, total,
    keys, leaves, changes, top), ordered by key and leaf inside each group, nulls first.

    Rows are numbered by ranges of (grp, key), so a group may hold most rows; equal keys are
    split over ranges as well.
    """
    spark = leaves.sparkSession
    order = ["grp", "key", "leaf", "spread"]
    ranged = (
        leaves.withColumn("spread", F.xxhash64(F.monotonically_increasing_id()))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .drop("spread")
        .withColumn("at", F.monotonically_increasing_id())
    )
    ranged = saved(ranged, shared_dir(spark, "merkle-range"))
    # How many leaves of a group stand before each range: a row for each range and group in it.
    part = F.shiftright("at", 33).alias("part")
    parts = ranged.groupBy("grp", part).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    by_group = Window.partitionBy("grp").orderBy("part")
    before = F.coalesce(F.sum("n").over(by_group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(by_group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    parts = parts.select("grp", "part", (before - F.col("first")).alias("shift"), total.alias("total"))
    parts = saved(parts.withColumnRenamed("grp", "g"), shared_dir(spark, "merkle-part"))
    placed = ranged.withColumn("part", part).join(parts.withColumnRenamed("part", "p"), (F.col("part") == F.col("p")) & F.col("grp").eqNullSafe(F.col("g")))
    index = F.col("at") + F.col("shift")
    size = FANOUT**LOCAL
    rows = F.sort_array(F.collect_list(F.struct((index % size).alias("i"), "key", "leaf", "changed"))).alias("rows")
    blocks = placed.groupBy("grp", F.floor(index / F.lit(size)).alias("block"), "total").agg(rows)
    blocks = blocks.select(
        "grp",
        "block",
        "total",
        F.col("rows.key").alias("keys"),
        F.col("rows.leaf").alias("leaves"),
        F.col("rows.changed").alias("changes"),
    )
    names = [f.name for f in blocks.schema.fields]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = []
            for own, n in zip(batch.column("leaves").to_pylist(), batch.column("total").to_pylist(), strict=True):
                tops.append(_levels(own, _local_levels(len(own), n))[-1][0])
            yield pa.record_batch([*batch.columns, pa.array(tops, pa.string())], names=[*names, "top"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema.fields) + ", top string"
    return saved(blocks.mapInArrow(hashed, schema), shared_dir(spark, "merkle-block"))


def exchanged(blocks: DataFrame) -> DataFrame:
    """(grp, block, path, top) of ``blocks`` (grp, block, total, top): the steps from a block's
    root up to its group's root, as a stored table.

    In the round with subtrees of ``size`` blocks, the blocks at one place (lane) of the 8
    subtrees of an aligned group meet. The last subtree may be short; its blocks then stand
    in for the lanes that it lacks, in turn, so that every block is met by all subtrees.
    """
    spark = blocks.sparkSession
    n_blocks = F.ceil(F.col("total") / F.lit(FANOUT**LOCAL)).cast("long")
    held = blocks.select("grp", "block", n_blocks.alias("n"), "top", F.array().cast(f"array<{STEP}>").alias("path"))
    held = saved(held, shared_dir(spark, "merkle-held"))
    most = held.agg(F.max("n")).first()[0] or 0
    size = 1
    while size < most:
        tree = F.floor(F.col("block") / F.lit(size))
        lane = F.col("block") % size
        members = F.least(F.lit(size), F.col("n") - tree * size)
        alone = (tree % FANOUT == 0) & (members < size)  # no other subtree to stand in for
        lanes = F.when(alone, F.array(lane)).otherwise(F.sequence(lane, F.lit(size - 1).cast("long"), members))
        active = F.col("n") > size
        sent = held.where(active).select(
            "grp", "n", "block", "top", "path", tree.alias("tree"), lane.alias("own"), F.explode(lanes).alias("lane")
        )
        sent = sent.withColumn("path", F.when(F.col("own") == F.col("lane"), F.col("path")))
        met = sent.groupBy("grp", "n", F.floor(F.col("tree") / F.lit(FANOUT)).alias("meet"), "lane").agg(
            F.sort_array(F.collect_list(F.struct("tree", "top", "own", "block", "path"))).alias("all")
        )
        parent = F.sha2(F.array_join("all.top", ""), 256)
        each = met.select("grp", "n", "lane", "all", parent.alias("parent"), F.posexplode("all").alias("i", "one"))
        each = each.where(F.col("one.own") == F.col("lane"))
        left = F.array_join(F.slice("all.top", F.lit(1), F.col("i")), "")
        right = F.array_join(F.slice("all.top", F.col("i") + 2, F.lit(FANOUT)), "")
        step = F.struct(left.alias("left"), right.alias("right"))
        up = each.select(
            "grp", F.col("one.block").alias("block"), "n", F.col("parent").alias("top"), F.concat("one.path", F.array(step)).alias("path")
        )
        held = saved(up.unionByName(held.where(~active)), shared_dir(spark, "merkle-held"))
        size *= FANOUT
    return held.select(F.col("grp").alias("g"), F.col("block").alias("b"), "path", F.col("top").alias("root"))


def tree(leaves: DataFrame) -> DataFrame:
    """Stored blocks of ``leaves`` (a stored table, see ``leaf_blocks``) with ``path`` and the group's ``root``."""
    blocks = leaf_blocks(leaves)
    above = exchanged(blocks)
    met = blocks.drop("top").join(above, F.col("grp").eqNullSafe(F.col("g")) & (F.col("block") == F.col("b")))
    return saved(met.drop("g", "b"), shared_dir(leaves.sparkSession, "merkle-tree"))


def each_leaf(blocks: DataFrame, result: Callable, names: list[str], schema: str) -> DataFrame:
    """One row for each leaf of ``tree``'s blocks: ``result(row, i, steps)`` gives its columns."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                own = row["leaves"]
                levels = _levels(own, _local_levels(len(own), row["total"]))[:-1]
                above = [(s["left"], s["right"]) for s in row["path"]]
                out = []
                for i in range(len(own)):
                    steps = [_step(level, i // FANOUT**up) for up, level in enumerate(levels)]
                    out.append(dict(zip(names, result(row, i, steps + above), strict=True)))
                yield pa.RecordBatch.from_pylist(out, kinds)

    kinds = to_arrow_schema(T.StructType.fromDDL(schema))
    return blocks.mapInArrow(walk, schema)


def fold(leaf: str, steps: list[tuple[str, str]]) -> str:
    """The root that a leaf and the steps of its path give."""
    for left, right in steps:
        leaf = hashlib.sha256(f"{left}{leaf}{right}".encode()).hexdigest()
    return leaf


def manifest(rows: DataFrame, group: str, key: str, columns: list[str], changed: dict[str, Column]) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) for each of ``rows``.

    A leaf hashes ``columns`` in their order. Leaves ascend by ``key`` (equal keys by leaf) in
    each value of ``group``; every ``FANOUT`` in a row become their hash, until one is left,
    the subroot. Subroots, by group with null first, give the root in the same way. A proof
    hashes all siblings on the path, left to right, level by level. ``changed`` maps columns
    to what is found instead, for the check of the proof; the others are found as they were.
    Rows that are equal get different places and so different proofs. A null key comes first.
    No rows in, no rows out.
    """
    leaf = leaf_hash([F.col(c) for c in columns])
    found = leaf_hash([changed.get(c, F.col(c)) for c in columns])
    leaves = rows.select(
        F.col(group).cast("string").alias("grp"), F.col(key).cast("long").alias("key"), leaf.alias("leaf"), found.alias("found")
    )
    leaves = leaves.select("grp", "key", "leaf", F.when(F.col("found") != F.col("leaf"), F.col("found")).alias("changed"))
    lower = tree(saved(leaves, shared_dir(rows.sparkSession, "merkle-leaf")))
    subroots = lower.select("grp", "root").distinct()
    upper = tree(
        subroots.select(
            F.lit(None).cast("string").alias("grp"), F.col("grp").alias("key"), F.col("root").alias("leaf"), F.lit(None).cast("string").alias("changed")
        )
    )

    def way(row: dict, i: int, steps: list[tuple[str, str]]) -> tuple:
        return row["keys"][i], row["root"], [{"left": left, "right": right} for left, right in steps]

    ways = each_leaf(upper, way, ["name", "whole", "rest"], f"name string, whole string, rest array<{STEP}>")
    ways = saved(ways, shared_dir(rows.sparkSession, "merkle-way"))
    blocks = lower.join(ways, F.col("grp").eqNullSafe(F.col("name")))
    blocks = blocks.withColumn("path", F.concat("path", "rest")).drop("name", "rest")

    def proof(row: dict, i: int, steps: list[tuple[str, str]]) -> tuple:
        leaf_, other = row["leaves"][i], row["changes"][i]
        siblings = "".join(left + right for left, right in steps)
        folded = fold(other or leaf_, steps)
        whole = row["whole"]
        return row["keys"][i], leaf_, row["root"], whole, hashlib.sha256(siblings.encode()).hexdigest(), folded, folded == whole

    texts = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    schema = ", ".join([f"{key} long", *(f"{c} string" for c in texts), "verified boolean"])
    return each_leaf(blocks, proof, [key, *texts, "verified"], schema)


def prove(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs`` (doc_id, source, lang, n_chars, text) by language, checked on
    copies of which a third, by checksum of doc_id, have A-Z of their text lower-cased.
    A null doc_id is left as it is."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    text = F.when(tampered, F.translate("text", upper, lower)).otherwise(F.col("text"))
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    return manifest(docs.select(*columns), "lang", "doc_id", columns, {"text": text})
