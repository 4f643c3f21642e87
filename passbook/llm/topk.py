"""Exact top-k search in three phases with a uniform threshold.

Vectors are cut into lists of components; a list knows its part of every score only.

1. Each list reports, block by block, a query's best parts. The scores of those vectors are
   resolved, and the k-th best is a cutoff that the result cannot fall below.
2. With m lists, a vector that reaches the cutoff has a part of at least cutoff / m in one of
   them. Each list reports all vectors with such a part.
3. The scores of the reported vectors are resolved exactly, and the best ones are the result.

Queries and vectors meet in blocks; what leaves a block is a list per query. Components are
whole numbers, and all sums are exact. Vectors are many times larger in memory than as stored,
so joins are merge joins on the side of vectors: the driver gets none to broadcast.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passbook.llm.neighbours import best, classes, finite, queries_of, ranked
from passbook.session import saved, shared_dir

#: Lists that the components are cut into.
LISTS = 2
#: Vectors and queries in a block, and queries of a block that are scored at a time. A vector is
#: sent to each block of queries once.
BLOCK_ROWS, BLOCK_QUERIES, SLICE = 4096, 4096, 256

HITS = "qid long, cids array<long>, firsts array<long>, score array<long>"
FOUND = "qid long, cids array<long>"


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers; raises where they leave 64 bits."""
    bound = float(np.abs(x.astype(float)).max(initial=0)) * float(np.abs(y.astype(float)).max(initial=0)) * x.shape[1]
    if bound < 2.0**53:
        return (x.astype(float) @ y.astype(float).T).astype(np.int64)
    if bound < 2.0**62:
        return x @ y.T
    raise OverflowError("an inner product does not fit 64 bits")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten(), np.int64).reshape(len(column), -1)


def _lists(qid, counts, cid, first, value) -> pa.Table:
    ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    return pa.table(
        {
            "qid": pa.array(np.asarray(qid, np.int64)),
            "cids": pa.ListArray.from_arrays(ends, pa.array(np.asarray(cid, np.int64))),
            "firsts": pa.ListArray.from_arrays(ends, pa.array(np.asarray(first, np.int64))),
            "score": pa.ListArray.from_arrays(ends, pa.array(np.asarray(value, np.int64))),
        }
    )


def _none() -> pa.Table:
    return _lists([], [], [], [], [])


def _slices(left: pa.Table, y: np.ndarray):
    """Scores of a block, some queries at a time: place of the first query, score matrix."""
    x = _matrix(left["v"])
    for at in range(0, len(x), SLICE):
        yield at, products(x[at : at + SLICE], y)


def _best_parts(most: int):
    """Phase 1: of a block's parts, the ``most`` highest for each query."""

    def report(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _none()
        cid, first = np.asarray(right["cid"]), np.asarray(right["first"])
        n = min(most, len(cid))
        picks, values = [], []
        for _, score in _slices(left, _matrix(right["v"])):
            picks.append(np.argpartition(-score, n - 1, axis=1)[:, :n])
            values.append(np.take_along_axis(score, picks[-1], axis=1))
        pick, value = np.concatenate(picks), np.concatenate(values)
        return _lists(left["cid"], np.full(len(pick), n), cid[pick].ravel(), first[pick].ravel(), value.ravel())

    return report


def _sufficient(lists: int):
    """Phase 2: all vectors of a block whose part is at least the cutoff's share."""

    def report(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _none().select(["qid", "cids"])
        cid = np.asarray(right["cid"])
        share = -(-np.asarray(left["cutoff"], np.int64) // min(lists, left["dim"][0].as_py()))
        counts, found = [], []
        for at, score in _slices(left, _matrix(right["v"])):
            enough = score >= share[at : at + SLICE, None]
            counts.append(enough.sum(axis=1))
            found.append(cid[np.nonzero(enough)[1]])
        ends = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32))
        lists_found = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found)))
        return pa.table({"qid": left["cid"], "cids": lists_found})

    return report


def _resolved(most: int):
    """Phase 3: exact scores of the reported vectors, the ``most`` best for each query."""

    def report(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _none()
        cid, first = np.asarray(right["cid"]), np.asarray(right["first"])
        order = np.argsort(cid)
        wanted = left["cids"].combine_chunks()
        at = order[np.searchsorted(cid, np.asarray(wanted.flatten()), sorter=order)]
        counts = np.asarray(pa.compute.list_value_length(wanted))
        q = np.repeat(np.arange(left.num_rows), counts)
        x, y = _matrix(left["v"]), _matrix(right["v"])
        score = np.empty(len(at), np.int64)
        for i in range(0, len(at), 1 << 16):
            a, b = x[q[i : i + (1 << 16)]], y[at[i : i + (1 << 16)]]
            products(np.abs(a).max(axis=0, keepdims=True), np.abs(b).max(axis=0, keepdims=True))
            score[i : i + (1 << 16)] = np.einsum("ij,ij->i", a, b)
        order = np.lexsort((first[at], -score, q))
        rank = np.arange(len(q)) - np.repeat(np.cumsum(counts) - counts, counts)
        pick = order[rank < most]
        return _lists(
            left["cid"], np.minimum(counts, most), cid[at[pick]], first[at[pick]], score[pick]
        )

    return report


def top(rows: DataFrame, chosen: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """``rows`` (vec_id, embedding): for each row that is ``chosen`` the ``k`` other rows with
    the largest inner product of floor(scale * x), as (query_id, rank, vec_id, score).

    Ties go to smaller vec_ids. Vectors that are null or hold a null, NaN or infinite
    component take no part, nor do null ids; empty ones neither. Only vectors of equal length
    meet. Rows that repeat an id with one vector count once, and a query never finds its own
    id. Scores beyond 64 bits raise. No rows in, no rows out. Other columns are ignored.
    """
    spark = rows.sparkSession
    given = F.col("embedding").cast("array<double>")
    valid = rows.select(F.col("vec_id").cast("long").alias("vec_id"), given.alias("v")).where(finite(F.col("v")))
    valid = valid.withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("long")))
    known = classes(valid, k)
    asked = queries_of(valid, known.hint("merge"), chosen)
    most = k + 1
    n_blocks = max(1, -(-known.count() // BLOCK_ROWS))
    asking = known.join(asked.select("cid").distinct(), "cid", "left_semi")
    asking = saved(asking, shared_dir(spark, "asking"))
    n_query_blocks = max(1, -(-asking.count() // BLOCK_QUERIES))

    def numbers(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    own = F.col("ids")[0].alias("first")
    size = F.size("v").alias("dim")
    block = F.pmod(F.xxhash64("cid"), F.lit(n_blocks)).cast("int").alias("block")
    query_block = F.pmod(F.xxhash64(F.lit("query"), "cid"), F.lit(n_query_blocks)).cast("int").alias("query_block")
    members = known.select("cid", own, "v", size, block).withColumn("query_block", numbers(n_query_blocks))
    placed = asking.select("cid", "v", size, query_block)
    queries = placed.withColumn("block", numbers(n_blocks))
    width = F.ceil(F.col("dim") / LISTS).cast("int")

    def cut(frame: DataFrame) -> DataFrame:
        """One row for each list, with the list's components."""
        each = frame.withColumn("list", numbers(LISTS))
        part = F.slice("v", F.col("list") * width + 1, width)
        return each.withColumn("v", part).where(F.size("v") > 0)

    where = ["dim", "block", "query_block"]

    def met(left: DataFrame, right: DataFrame, keys: list[str], report, out: str = HITS) -> DataFrame:
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(report, out)

    in_lists = [*where, "list"]
    first_lists = met(cut(queries), cut(members), in_lists, _best_parts(most))
    seen = saved(
        first_lists.select("qid", F.explode("cids").alias("cid")).distinct(), shared_dir(spark, "seen")
    )
    of_query = asking.select(F.col("cid").alias("qid"), F.col("v").alias("q"))
    total = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x)
    totals = seen.join(of_query.hint("merge"), "qid").join(known.select("cid", "v").hint("merge"), "cid")
    totals = totals.select("qid", "cid", total.alias("score"))
    # The k-th best of what was seen, or nothing to go by where less was seen.
    # Found in shares first, as the scores that were seen grow in number with the blocks.
    shares = max(1, math.isqrt(n_blocks))
    found = F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, most)
    totals = totals.groupBy("qid", F.pmod(F.xxhash64("cid"), F.lit(shares)).alias("share")).agg(found.alias("score"))
    totals = totals.select("qid", F.explode("score").alias("score"))
    cutoff = F.when(F.size("s") >= most, F.element_at("s", F.least(F.lit(most), F.size("s"))))
    cutoffs = totals.groupBy("qid").agg(found.alias("s")).select(
        F.col("qid").alias("cid"), F.coalesce(cutoff, F.lit(-(1 << 62))).alias("cutoff")
    )
    cutoffs = saved(cutoffs, shared_dir(spark, "cutoffs"))
    limited = placed.hint("merge").join(cutoffs, "cid").withColumn("block", numbers(n_blocks))
    reported = met(cut(limited), cut(members), in_lists, _sufficient(LISTS), FOUND)
    each = reported.select("qid", F.explode("cids").alias("cid")).distinct()
    wanted = each.withColumn("block", F.pmod(F.xxhash64("cid"), F.lit(n_blocks)).cast("int"))
    wanted = wanted.groupBy("qid", "block").agg(F.collect_list("cid").alias("cids"))
    wanted = wanted.withColumnRenamed("qid", "cid").join(placed.hint("merge"), "cid")
    resolved = met(wanted, members, where, _resolved(most))
    scored = resolved.groupBy("qid").applyInArrow(
        lambda t: best(t, most), "qid long, cid long, first long, score long"
    )
    scored = saved(scored.select("qid", "cid", "score"), shared_dir(spark, "resolved"))
    return ranked(scored, known, asked, k)
