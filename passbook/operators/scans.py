"""Per-key running values over an ordered log, whatever the size of a key.

A plain window puts all rows of a key in one task. Here the order column is cut
into ranges of ``width``: rows are first reduced to one summary per (key, range),
summaries are carried forward over the ranges of a key, and the carried value
enters each range as its first row. A window task then never holds more rows than
a range has positions, and rows are shuffled once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 1 << 20


@dataclass(frozen=True)
class Running:
    """One running column: ``how`` is sum, last (non-null, this row included) or lag."""

    name: str
    value: Column
    how: str = "sum"


def running(
    df: DataFrame,
    key: str,
    order: str,
    columns: list[Running],
    width: int = WIDTH,
    start: DataFrame | None = None,
) -> DataFrame:
    """Add the running ``columns``; ``order`` is a number, unique within a key.

    ``start`` holds, per key, the values of ``columns`` before the first row.
    """
    values = {f"__v{i}": c for i, c in enumerate(columns)}
    rows = df.select(
        "*",
        F.expr(f"`{order}` div {width}").cast("long").alias("__range"),
        F.col(order).cast("long").alias("__at"),
        *[c.value.alias(v) for v, c in values.items()],
    )

    def summary(v: str, c: Running) -> Column:
        if c.how == "sum":
            return F.sum(v).alias(v)
        at = F.when(F.col(v).isNotNull(), F.col("__at")) if c.how == "last" else F.col("__at")
        return F.max_by(v, at).alias(v)

    earlier = Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)

    def carry(v: str, c: Running) -> Column:
        if c.how == "sum":
            return F.sum(v).over(earlier).alias(v)
        return F.last(v, ignorenulls=c.how == "last").over(earlier).alias(v)

    previous = Window.partitionBy(key).orderBy("__range")
    summaries = rows.groupBy(key, "__range").agg(*[summary(v, c) for v, c in values.items()])
    if start is not None:
        before_all = F.lit(-(1 << 62)).cast("long").alias("__range")
        summaries = summaries.unionByName(
            start.join(df.select(key).distinct(), key, "left_semi").select(
                key, before_all, *[F.col(c.name).alias(v) for v, c in values.items()]
            )
        )
    carried = (
        summaries.select(
            key,
            "__range",
            F.lag("__range").over(previous).alias("__before"),
            *[carry(v, c) for v, c in values.items()],
        )
        .where(F.col("__before").isNotNull())
        .drop("__before")
    )
    within = Window.partitionBy(key, "__range").orderBy(F.col("__at").asc_nulls_first())
    upto = within.rowsBetween(Window.unboundedPreceding, 0)

    def final(v: str, c: Running) -> Column:
        if c.how == "sum":
            out = F.sum(v).over(upto)
        elif c.how == "last":
            out = F.last(v, ignorenulls=True).over(upto)
        else:
            out = F.lag(v).over(within)
        return out.alias(c.name)

    return (
        rows.unionByName(carried, allowMissingColumns=True)
        .select(*df.columns, "__at", *[final(v, c) for v, c in values.items()])
        .where(F.col("__at").isNotNull())
        .drop("__at")
    )


def assign_versions(
    log: DataFrame, existing: DataFrame | None = None, width: int = WIDTH
) -> DataFrame:
    """Dense 1-based versions per aggregate in log order, after those in ``existing``."""
    start = None
    if existing is not None:
        start = existing.select("aggregate_id", F.col("last_version").alias("aggregate_version"))
    version = Running("aggregate_version", F.lit(1))
    return running(log, "aggregate_id", "seq", [version], width, start)
