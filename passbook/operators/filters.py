"""Row selection over event logs."""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passbook.functions.containment import contains
from passbook.functions.ids import is_canonical_uuid
from passbook.functions.money import disabled_reason
from passbook.schema import ACCOUNT, EVENT_BODIES, OPEN, REACTOR_KINDS, TERMINAL_KINDS


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def of_aggregate(df: DataFrame, kind: str = ACCOUNT) -> DataFrame:
    return df.where(F.col("aggregate_kind").isin(kind))


def of_kinds(df: DataFrame, kinds: Collection[str] = REACTOR_KINDS) -> DataFrame:
    return df.where(F.col("kind").isin(*kinds))


def above_mark(df: DataFrame, mark: DataFrame, keys: Collection[str] = ()) -> DataFrame:
    """Rows past the highest applied sequence.

    ``mark`` has one ``mark`` row in all, or one per ``keys`` (a topic partition,
    so that a slow partition loses nothing). A key without a mark passes whole.
    There are no more marks than topic partitions, hence the broadcast.
    """
    if not keys:
        lowest = F.lit(-(1 << 63)).cast("long")
        return df.where(F.col("seq") > mark.agg(F.coalesce(F.max("mark"), lowest)).scalar())
    m = mark.groupBy(*keys).agg(F.max("mark").alias("__mark"))
    return (
        df.join(F.broadcast(m), list(keys), "left")
        .where(F.col("__mark").isNull() | (F.col("seq") > F.col("__mark")))
        .drop("__mark")
    )


def needs_rollback(df: DataFrame) -> DataFrame:
    return df.where((F.col("kind") == "TransactionFailed") & F.col("rollback"))


def with_leg(df: DataFrame, column: str) -> DataFrame:
    """Transfers that have this leg: an absent id means no leg."""
    return df.where(F.col(column).isNotNull())


def unknown_kinds(df: DataFrame, registry: Collection[str] = tuple(EVENT_BODIES)) -> DataFrame:
    return df.where(~F.col("kind").isin(*registry))


def strict_kinds(df: DataFrame, registry: Collection[str] = tuple(EVENT_BODIES)) -> DataFrame:
    """As aggregates do: an unregistered kind ends the job with an error."""
    message = F.concat(
        F.lit("unknown event '"), F.col("kind"), F.lit("' for '"), F.col("aggregate_kind"), F.lit("'")
    )
    checked = F.when(F.col("kind").isin(*registry), F.col("kind")).otherwise(F.raise_error(message))
    return df.withColumn("kind", checked)


def first_terminal(df: DataFrame) -> DataFrame:
    """The event that ended each transaction; later ones found it no longer PENDING."""
    return (
        df.where(F.col("kind").isin(*TERMINAL_KINDS))
        .groupBy("tx_id")
        .agg(F.min("seq").alias("seq"), F.min_by("kind", "seq").alias("kind"))
    )


def closed_to_transfers(status: Column) -> Column:
    return status != OPEN


def split_open(df: DataFrame, side: str = "From") -> DataFrame:
    """Mark rows whose account may not move money, with the reason."""
    return df.withColumn(
        "reason", F.when(closed_to_transfers(F.col("status")), disabled_reason(side, F.col("status")))
    )


def by_label(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.where(F.get_json_object("labels", f"$.{key}") == value)


def holding(df: DataFrame, **wanted: Any) -> DataFrame:
    """Rows whose JSON columns hold the given values, as ``contains`` tells: keys at any depth,
    elements of lists, all at once."""
    return df.where(reduce(Column.__and__, [contains(c, value) for c, value in wanted.items()], F.lit(True)))


def bad_ids(df: DataFrame, column: str = "aggregate_id") -> DataFrame:
    return df.where(~is_canonical_uuid(column))
