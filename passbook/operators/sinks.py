"""Writes to the log, to topics and to the balance table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passbook.operators.folds import last_versions, snapshot_states
from passbook.operators.joins import new_keys
from passbook.operators.scans import Running, assign_versions, running
from passbook.schema import CATCH_UP, OPEN, SNAPSHOT_THRESHOLD
from passbook.session import saved

#: Buckets of a table; a batch of changes rewrites those that its ids fall into.
BUCKETS = 64


class ConcurrentWrite(RuntimeError):
    """Another writer changes one of the buckets."""


class BucketedTable:
    """A Parquet table partitioned by a hash bucket of its key, for changes of single rows.

    New rows are appended to their buckets. Rows that replace others are merged with the
    buckets they fall into, and Spark writes these by dynamic partition overwrite; the files
    of all other buckets stay. While a writer merges a bucket it holds a marker file there;
    a second one fails with ``ConcurrentWrite`` and can come again, so neither's change is
    lost in silence. A writer that died leaves its markers to ``unlock``.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self.schema = schema
        self._stored = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket")

    def create(self) -> BucketedTable:
        """Make sure that the folder can be read before the first row."""
        self._write(self.spark.createDataFrame([], self.schema), "append")
        return self

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows, of all buckets or the given ones; the others are pruned."""
        rows = self.spark.read.schema(self._stored).parquet(f"{self.path}/rows")
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets))
        return rows.select(*self.schema.names)

    def _write(self, rows: DataFrame, mode: str) -> None:
        # A task a bucket, or several for a large one, instead of files of every task in each.
        placed = rows.select(*self.schema.names, self.bucket()).hint("rebalance", "bucket")
        placed.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/rows")

    def _marker(self, bucket: int) -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/locks/{bucket}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def lock(self, buckets: list[int]) -> None:
        held = []
        for bucket in sorted(buckets):
            files, path = self._marker(bucket)
            if not files.createNewFile(path):
                self.unlock(held)
                raise ConcurrentWrite(f"bucket {bucket} of {self.path} is being written")
            held.append(bucket)

    def unlock(self, buckets: list[int]) -> None:
        for bucket in buckets:
            files, path = self._marker(bucket)
            files.delete(path, False)

    def change(self, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], append: bool = False) -> DataFrame:
        """Put ``merge(stored rows, rows)`` in place of the buckets that ``rows`` fall into, or
        add it to them with ``append``. Returns what was written."""
        rows = saved(rows, f"{self.path}/change-{uuid.uuid4().hex}")
        touched = [r[0] for r in rows.select(self.bucket()).distinct().collect()]  # no more than buckets
        self.lock(touched)
        try:
            merged = saved(merge(self.read(touched), rows), f"{self.path}/merged-{uuid.uuid4().hex}")
            self._write(merged, "append" if append else "overwrite")
        finally:
            self.unlock(touched)
        return merged


def store_new(table: BucketedTable, new: DataFrame) -> DataFrame:
    """Append rows of unknown ids to the table; each requested id with whether it was ``inserted``."""
    fresh = table.change(new, lambda known, rows: create_if_new(rows, known, table.key), append=True)
    asked = new.select(table.key).distinct()
    return asked.join(fresh.select(table.key, F.lit(True).alias("inserted")), table.key, "left").select(
        table.key, F.coalesce("inserted", F.lit(False)).alias("inserted")
    )


def store_documents(table: BucketedTable, documents: DataFrame) -> DataFrame:
    """Replace or add whole balance documents; returns the table."""
    table.change(documents, index_balance_full)
    return table.read()


def store_changes(table: BucketedTable, partial: DataFrame) -> DataFrame:
    """Merge partial balance documents into the table; returns those of unknown ids, which
    change nothing."""
    table.change(partial, update_balance_partial)
    return partial.join(table.read().select("id"), "id", "left_anti")


def store_tokens(table: BucketedTable, tokens: DataFrame) -> DataFrame:
    """Set the tokens (id, token) of their keys, later positions over earlier ones."""
    position = parse_token(F.col("token"))[1]

    def merge(known: DataFrame, rows: DataFrame) -> DataFrame:
        both = known.unionByName(rows.select("id", "token"))
        return both.groupBy("id").agg(F.max_by("token", position).alias("token"))

    table.change(tokens, merge)
    return table.read()


def resume_token(table: BucketedTable, keys: DataFrame) -> DataFrame:
    """The token of each of ``keys`` (id); empty where nothing is stored yet."""
    found = keys.join(table.read(), "id", "left")
    return found.select("id", F.coalesce("token", F.lit("")).alias("token"))


def versioned_events(new: DataFrame, stored: DataFrame | None) -> DataFrame:
    """New events with the next versions of their aggregates, without repeated ones.

    A row whose idempotency key is stored, or stands at an earlier position, is left out.
    """
    if stored is None:
        return assign_versions(new_keys(new, new.limit(0)))
    return assign_versions(new_keys(new, stored), last_versions(stored))


def append_events(new: DataFrame, stored: DataFrame | None, path: str) -> DataFrame:
    """Append new events with the next versions of their aggregates.

    Rows whose idempotency key is stored or repeated are left out. ``path`` is the
    folder of this append; returns the appended rows.
    """
    return saved(versioned_events(new, stored), path)


def create_if_new(new: DataFrame, known: DataFrame, key: str = "tx_id") -> DataFrame:
    """Rows of unknown ids, one per id; the earliest of repeated ones is inserted."""
    rest = [c for c in new.columns if c not in (key, "seq")]
    return (
        new.groupBy(key)
        .agg(F.min(F.struct("seq", *rest)).alias("row"))
        .join(known.select(key).distinct(), key, "left_anti")
        .select(key, "row.*")
    )


def topic_partition(partitions: int, key: str = "aggregate_id") -> Column:
    return F.pmod(F.xxhash64(key), F.lit(partitions)) + 1


def partitioned_topic(topic: str, partitions: int, key: str = "aggregate_id") -> Column:
    """Topic name and partition number, ``topic.1`` to ``topic.n``."""
    return F.concat(F.lit(f"{topic}."), topic_partition(partitions, key).cast("string"))


def write_ranges(log: DataFrame, path: str, width: int) -> None:
    """The log in folders of ``width`` positions each, so that readers of a part of it skip the
    others (``files.read_ranges``)."""
    placed = log.withColumn("range", F.expr(f"seq div {width}")).hint("rebalance", "range")
    placed.write.partitionBy("range").parquet(path)


def numbered(log: DataFrame, topic: str, partitions: int, ends: DataFrame | None = None) -> DataFrame:
    """``log`` with ``topic`` (its partition) and ``offset``: from 1 on end in each partition,
    in order of ``seq``, after the last offsets in ``ends`` (topic, offset)."""
    routed = log.withColumn("topic", partitioned_topic(topic, partitions))
    return running(routed, "topic", "seq", [Running("offset", F.lit(1))], start=ends)


def publish_partitioned(log: DataFrame, topic: str, partitions: int, path: str) -> None:
    """Rows of each topic partition with their offsets, in files of offsets on end.

    A busy aggregate fills many files of its partition, not one task.
    """
    rows = numbered(log, topic, partitions)
    ordered = rows.repartitionByRange("topic", "offset").sortWithinPartitions("topic", "offset")
    ordered.write.partitionBy("topic").parquet(path)


def row_to_json(log: DataFrame) -> DataFrame:
    """Every row as one JSON text; body and labels stay JSON, absent values are null."""
    nested = [
        F.parse_json(c).alias(c) if c in ("body", "labels") else F.col(c) for c in log.columns
    ]
    return log.select(
        F.to_json(F.struct(*nested), {"ignoreNullFields": "false"}).alias("notification")
    )


def index_balance_full(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Replace whole documents: of each id the one with the highest sequence stays."""
    columns = current.columns
    rest = [c for c in columns if c not in ("id", "sequence")]
    return (
        current.unionByName(updates.select(*columns))
        .groupBy("id")
        .agg(F.max(F.struct("sequence", *rest)).alias("doc"))
        .select("id", "doc.*")
        .select(*columns)
    )


def update_balance_partial(
    current: DataFrame, partial: DataFrame, drop_zero: bool = False
) -> DataFrame:
    """Merge partial documents: an absent field keeps its old value.

    ``partial`` is unique on id. ``drop_zero`` treats a new balance of 0 as absent,
    as an encoder that omits zero values does; a withdrawal to zero is then lost.
    """
    given = [c for c in partial.columns if c != "id"]
    new = partial.select("id", *[F.col(c).alias(f"__{c}") for c in given])

    def merged(c: str) -> Column:
        if c not in given:
            return F.col(c)
        value = F.col(f"__{c}")
        if drop_zero and c == "balance":
            value = F.nullif(value, F.lit(0))
        return F.coalesce(value, F.col(c)).alias(c)

    return current.join(new, "id", "left").select(*[merged(c) for c in current.columns])


def opening_documents(log: DataFrame, token_kind: str = CATCH_UP) -> DataFrame:
    """The documents that ``AccountCreated`` writes."""
    return log.where(F.col("kind") == "AccountCreated").select(
        F.col("aggregate_id").alias("id"),
        F.lit(1).cast("long").alias("version"),
        F.col("seq").alias("sequence"),
        F.lit(token_kind).alias("kind"),
        F.lit(OPEN).alias("status"),
        F.col("money").alias("balance"),
        "owner",
    )


def resume_key(topic: str, projection: str) -> str:
    return f"{topic}/{projection}"


def resume_tokens(applied: DataFrame, projection: str, token_kind: str = CATCH_UP) -> DataFrame:
    """Last token of each topic partition; ``applied`` has topic and seq."""
    return (
        applied.groupBy("topic")
        .agg(F.max("seq").alias("sequence"))
        .select(
            F.concat(F.col("topic"), F.lit(f"/{projection}")).alias("id"),
            F.concat(F.lit(f"{token_kind}:"), F.col("sequence").cast("string")).alias("token"),
        )
    )


def parse_token(token: Column) -> tuple[Column, Column]:
    """Kind and sequence of a token text."""
    return F.substring_index(token, ":", 1), F.substring_index(token, ":", -1).cast("long")


def write_snapshots(log: DataFrame, path: str, every: int = SNAPSHOT_THRESHOLD) -> DataFrame:
    snapshots = snapshot_states(log, every).withColumn(
        "id", F.concat(F.lit("ev-"), F.col("seq").cast("string"))
    )
    return saved(snapshots, path, mode="append")
