"""Reports of broken invariants: each returns the offending rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passbook.operators.scans import WIDTH, Running, running


def duplicate_versions(log: DataFrame) -> DataFrame:
    return (
        log.groupBy("aggregate_id", "aggregate_version")
        .agg(F.count("*").alias("copies"))
        .where("copies > 1")
    )


def duplicate_keys(log: DataFrame) -> DataFrame:
    return (
        log.where(F.col("idempotency_key") > "")
        .groupBy("idempotency_key")
        .agg(F.count("*").alias("copies"))
        .where("copies > 1")
    )


def orphan_snapshots(snapshots: DataFrame, log: DataFrame) -> DataFrame:
    return snapshots.join(log.select("id"), "id", "left_anti")


def version_gaps(log: DataFrame, width: int = WIDTH) -> DataFrame:
    """Versions that do not follow the one before, with that one.

    Of repeated versions one copy is looked at; the repeats are for
    ``duplicate_versions``.
    """
    versions = log.select("aggregate_id", "aggregate_version").distinct()
    return running(
        versions,
        "aggregate_id",
        "aggregate_version",
        [Running("previous_version", F.col("aggregate_version"), "lag")],
        width,
    ).where(F.col("aggregate_version") != F.col("previous_version") + 1)


def transactions_by_status(transactions: DataFrame) -> DataFrame:
    return transactions.groupBy("status", "failure_reason").agg(F.count("*").alias("transactions"))
