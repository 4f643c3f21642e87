"""Approximate nearest neighbours by cross-polytope hashing.

A fast pseudo-rotation (three rounds of random signs and a Hadamard transform) turns a unit
vector, and its nearest signed axis is the hash; a second rotation cuts the cells finer when
there are many vectors. Several tables have rotations of their own. A query visits, in each
table, the cells whose axes are nearest to it, and all vectors of those cells are compared
exactly, and more cells while these hold too few. Vectors of any length are searched by inner
product: they are hashed by direction, in bands of similar length that are searched each.

A cell is dealt in chunks of bounded size, and the queries that visit it, which are counted, in
parts of bounded size; each part meets each chunk. What comes back from a chunk is a query's few
best classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passbook.llm import arrays
from passbook.llm.neighbours import best, classes, finite, queries_of, ranked
from passbook.session import saved, shared_dir

#: Tables, cells that a query visits in each, and the same with the finer cells.
TABLES, PROBES, FINE_PROBES = 8, 20, 80
#: Vectors for each cell before the second rotation is used, and vectors in a chunk.
CELL_ROWS, CHUNK_ROWS = 4096, 4096
#: A query goes on to further cells until a table's hold this many times k classes.
ENOUGH = 20
#: Queries in a part of those that visit a cell.
QUERY_ROWS = 16384
#: Costs of cells that a task holds at a time.
COSTS = 1 << 22
#: Lengths of a band are within this factor.
BAND = 1.1
#: Seed of the signs.
SEED = 31


def rotated(rows: np.ndarray, table: int, which: int) -> np.ndarray:
    """Rows, padded to a power of two, turned by the table's first or second rotation."""
    size = 1 << max(0, rows.shape[1] - 1).bit_length()
    out = np.zeros((len(rows), size))
    out[:, : rows.shape[1]] = rows
    for turn in range(3):
        draw = arrays.numbers(size, SEED + 1000 * table + 10 * which + turn)
        out *= np.where(draw >> np.uint64(63), 1.0, -1.0)
        step = 1
        while step < size:
            pair = out.reshape(len(out), -1, 2, step)
            out = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(len(out), size)
            step *= 2
        out /= np.sqrt(size)
    return out


def axis_values(rows: np.ndarray, table: int, axes: int) -> list[np.ndarray]:
    """For each rotation in use the values along its signed axes: + axes, then - axes."""
    first = rotated(rows, table, 0)
    parts = [np.concatenate([first, -first], axis=1)]
    if axes:
        second = rotated(rows, table, 1)[:, :axes]
        parts.append(np.concatenate([second, -second], axis=1))
    return parts


def costs(values: list[np.ndarray]) -> np.ndarray:
    """For each row and cell the sum of squared gaps to the nearest axes."""
    gaps = [np.square(v.max(axis=1, keepdims=True) - v) for v in values]
    if len(gaps) == 1:
        return gaps[0]
    return (gaps[0][:, :, None] + gaps[1][:, None, :]).reshape(len(gaps[0]), -1)


def visited(cost: np.ndarray, held: np.ndarray, n: int, enough: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and the occupied cells each of them visits: the ``n`` of least cost, and further
    ones, nearest first, until they hold ``enough`` classes or none is left.

    ``held`` is the number of classes in each cell.
    """
    n = min(n, cost.shape[1])
    near = np.argpartition(cost, n - 1, axis=1)[:, :n] if n < cost.shape[1] else np.argsort(cost, axis=1)
    few = held[near].sum(axis=1) < min(enough, int(held.sum()))
    at, pick = np.nonzero((held[near] > 0) & ~few[:, None])
    rows, found = [at], [near[at, pick]]
    if few.any():
        order = np.argsort(cost[few], axis=1, kind="stable")
        before = np.cumsum(held[order], axis=1) - held[order]
        at, pick = np.nonzero((held[order] > 0) & (before < enough))
        rows.append(np.flatnonzero(few)[at])
        found.append(order[at, pick])
    return np.concatenate(rows), np.concatenate(found)


def units(whole: pa.RecordBatch, axes: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
    """Parts of a batch with vectors of one length: the part, the length, directions, bands.

    The more cells, the fewer rows a part has.
    """
    dims = np.asarray(pa.compute.list_value_length(whole.column("v")))
    for dim in np.unique(dims).tolist():
        batch = whole.filter(pa.array(dims == dim))
        cells = (2 << max(0, dim - 1).bit_length()) * max(1, 2 * axes)
        step = min(512, max(1, COSTS // cells))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            rows = np.asarray(part.column("v").flatten(), float).reshape(-1, dim)
            most = np.abs(rows).max(axis=1, keepdims=True)
            rows = rows / most
            size = np.linalg.norm(rows, axis=1, keepdims=True)
            band = np.rint((np.log(most) + np.log(size)) / np.log(BAND)).astype(np.int32).ravel()
            yield part, dim, rows / size, band


def placed_in(known: DataFrame, axes: int) -> DataFrame:
    """(cid, tab, cell, dim, band, first, v) for the nearest cell in each table."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part, dim, unit, band in units(whole, axes):
                for table in range(TABLES):
                    cell = costs(axis_values(unit, table, axes)).argmin(axis=1)
                    yield pa.record_batch(
                        [
                            part.column("cid"),
                            pa.array(np.full(len(unit), table, np.int32)),
                            pa.array(cell.astype(np.int64)),
                            pa.array(np.full(len(unit), dim, np.int32)),
                            pa.array(band),
                            part.column("first"),
                            part.column("v"),
                        ],
                        names=["cid", "tab", "cell", "dim", "band", "first", "v"],
                    )

    return known.select("cid", F.col("ids")[0].alias("first"), "v").mapInArrow(
        spread, "cid long, tab int, cell long, dim int, band int, first long, v array<double>"
    )


def probed(asking: DataFrame, sizes: DataFrame, axes: int, n: int, enough: int) -> DataFrame:
    """(cid, tab, dim, band, cells, v) with the cells that a query visits in each table and band:
    ``n``, and further ones until there are ``enough`` classes.

    ``sizes`` (dim, band, tab, cell, n) go to all tasks, at most cells x tables x bands rows.
    """
    held: dict[int, dict[int, dict[int, tuple[np.ndarray, np.ndarray]]]] = {}
    listed = sizes.groupBy("dim", "band", "tab").agg(F.collect_list("cell").alias("cell"), F.collect_list("n").alias("n"))
    for r in listed.collect():
        held.setdefault(r.dim, {}).setdefault(r.tab, {})[r.band] = (np.array(r.cell, np.int64), np.array(r.n, np.int64))
    shared = asking.sparkSession.sparkContext.broadcast(held)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part, dim, unit, _ in units(whole, axes):
                for table in range(TABLES):
                    cost = costs(axis_values(unit, table, axes))
                    for band, (cell, count) in shared.value[dim].get(table, {}).items():
                        of_cell = np.zeros(cost.shape[1], np.int64)
                        of_cell[cell] = count
                        rows, near = visited(cost, of_cell, n, enough)
                        near = near[np.argsort(rows, kind="stable")]
                        counts = np.bincount(rows, minlength=len(unit))
                        ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                        yield pa.record_batch(
                            [
                                part.column("cid"),
                                pa.array(np.full(len(unit), table, np.int32)),
                                pa.array(np.full(len(unit), dim, np.int32)),
                                pa.array(np.full(len(unit), band, np.int32)),
                                pa.ListArray.from_arrays(pa.array(ends), pa.array(near.astype(np.int64))),
                                part.column("v"),
                            ],
                            names=["cid", "tab", "dim", "band", "cells", "v"],
                        )

    return asking.select("cid", "v").mapInArrow(
        spread, "cid long, tab int, dim int, band int, cells array<long>, v array<double>"
    )


def nearest(rows: DataFrame, chosen: Column, k: int = 20) -> DataFrame:
    """``rows`` (vec_id, embedding): for each row that is ``chosen`` its ``k`` nearest found
    other rows, as (query_id, rank, vec_id, score), by largest inner product in double
    precision, ties by smaller vec_id.

    Vectors that are null, zero or hold a null, NaN or infinite component take no part, nor do
    null ids. Only vectors of equal length meet. Equal vectors are found together; rows that
    repeat an id with one vector count once, and a query never finds its own id. No rows in,
    no rows out. Other columns are ignored.
    """
    spark = rows.sparkSession
    v = F.col("embedding").cast("array<double>")
    valid = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        finite(F.col("v")) & F.exists("v", lambda x: x != 0)
    )
    valid = valid.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    known = classes(valid, k)
    asked = queries_of(valid, known, chosen)
    facts = known.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    first_cells = 2 << max(0, (facts.dim or 1) - 1).bit_length()
    axes = 0
    while facts.n > CELL_ROWS * first_cells * max(1, 2 * axes) and 2 * axes < first_cells // 2:
        axes = max(2, 2 * axes)
    placed = saved(placed_in(known, axes), shared_dir(spark, "cells"))
    asking = known.join(asked.select("cid").distinct(), "cid")
    enough = ENOUGH * k
    where = ["dim", "band", "tab", "cell"]
    # A band that holds no more than enough is one cell of one table.
    in_bands = placed.where("tab = 0").groupBy("dim", "band").agg(F.count("*").alias("in_band"))
    placed = placed.join(in_bands, ["dim", "band"]).where((F.col("in_band") > enough) | (F.col("tab") == 0))
    placed = placed.withColumn("cell", F.when(F.col("in_band") > enough, F.col("cell")).otherwise(0)).drop("in_band")
    sizes = saved(placed.groupBy(*where).agg(F.count("*").alias("n")), shared_dir(spark, "cell-sizes"))
    probes = saved(probed(asking, sizes, axes, FINE_PROBES if axes else PROBES, enough), shared_dir(spark, "probes"))
    visits = probes.select("dim", "band", "tab", F.explode("cells").alias("cell")).groupBy(*where)
    # Cells without a visit meet no query.
    dealt = sizes.join(visits.agg(F.count("*").alias("asked")), where).select(
        *where,
        F.ceil(F.col("asked") / QUERY_ROWS).cast("int").alias("parts"),
        F.ceil(F.col("n") / CHUNK_ROWS).cast("int").alias("chunks"),
    )
    dealt = saved(dealt, shared_dir(spark, "dealt"))

    def shares(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    members = placed.join(dealt, where).withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int"))
    members = members.withColumn("part", shares("parts"))
    probes = probes.withColumn("cell", F.explode("cells")).drop("cells").join(dealt, where)
    probes = probes.withColumn("part", F.pmod(F.xxhash64(F.lit("query"), "cid"), F.col("parts")).cast("int"))
    probes = probes.withColumn("chunk", shares("chunks"))
    most = k + 1

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        n_q, n_m = left.num_rows, right.num_rows
        kinds = {"qid": pa.int64(), "cids": pa.list_(pa.int64()), "firsts": pa.list_(pa.int64()), "score": pa.list_(pa.float64())}
        if not n_q or not n_m:
            return pa.table({name: pa.array([], kind) for name, kind in kinds.items()})
        x = np.asarray(left["v"].combine_chunks().flatten()).reshape(n_q, -1)
        y = np.asarray(right["v"].combine_chunks().flatten()).reshape(n_m, -1)
        cid, first = np.asarray(right["cid"]), np.asarray(right["first"])
        by_first = np.argsort(first)
        y, cid, first = y[by_first], cid[by_first], first[by_first]
        n = min(most, n_m)
        picks, values = [], []
        for at in range(0, n_q, 256):
            score = x[at : at + 256] @ y.T
            pick = np.argpartition(-score, n - 1, axis=1)[:, :n] if n < n_m else np.tile(np.arange(n_m), (len(score), 1))
            picks.append(pick)
            values.append(np.take_along_axis(score, pick, axis=1))
        pick, value = np.concatenate(picks), np.concatenate(values)
        ends = pa.array(np.arange(0, n * n_q + 1, n, dtype=np.int32))
        return pa.table(
            {
                "qid": left["cid"].combine_chunks(),
                "cids": pa.ListArray.from_arrays(ends, pa.array(cid[pick].ravel())),
                "firsts": pa.ListArray.from_arrays(ends, pa.array(first[pick].ravel())),
                "score": pa.ListArray.from_arrays(ends, pa.array(value.ravel())),
            }
        )

    keys = [*where, "chunk", "part"]
    lists = (
        probes.select(*keys, "cid", "v")
        .groupBy(*keys)
        .cogroup(members.select(*keys, "cid", "first", "v").groupBy(*keys))
        .applyInArrow(compare, "qid long, cids array<long>, firsts array<long>, score array<double>")
    )
    merged = lists.groupBy("qid").applyInArrow(lambda t: best(t, most), "qid long, cid long, first long, score double")
    merged = saved(merged.select("qid", "cid"), shared_dir(spark, "near"))
    # The score in a fixed order of additions, the same for a pair wherever it was found.
    of_query = known.select(F.col("cid").alias("qid"), F.col("v").alias("q"))
    exact = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    scored = merged.join(of_query, "qid").join(known.select("cid", "v"), "cid").select("qid", "cid", exact.alias("score"))
    return ranked(scored, known, asked, k)
