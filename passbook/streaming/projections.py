"""Streaming projections and the reactor.

Every function starts a query and returns it; ``until_caught_up`` waits for a run
over what is there now. Queries resume from their checkpoint. Sinks write one folder
per micro-batch and keep it on retry, so effects are applied once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from passbook.functions.money import signed_money
from passbook.operators import settlement
from passbook.operators.filters import above_mark
from passbook.operators.folds import fold_balance_projection
from passbook.operators.sinks import numbered
from passbook.schema import (
    ACCOUNT,
    CATCH_UP,
    FAILED,
    OPEN,
    PENDING,
    PROJECTED_KINDS,
    SNAPSHOT_THRESHOLD,
    SUCCEEDED,
    TERMINAL_KINDS,
    TRANSACTION_KINDS,
)
from passbook.streaming.batches import NO_BATCH, BatchTable

_S, _L, _B = T.StringType(), T.LongType(), T.BooleanType()


def _schema(*pairs: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in pairs])


def start(writer: DataStreamWriter, name: str, folder: str, every: str | None = None) -> StreamingQuery:
    """Start under the checkpoint of ``name``: over what is there now, or for good."""
    writer = writer.option("checkpointLocation", f"{folder}/checkpoint-{name}")
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def until_caught_up(query: StreamingQuery) -> None:
    query.awaitTermination()


def run_projection(
    stream: DataFrame,
    name: str,
    transform: Callable[[DataFrame], DataFrame],
    sink: Callable[[DataFrame, int], None],
    folder: str,
    mode: str = "append",
    every: str | None = None,
) -> StreamingQuery:
    """A user's projection: a transformation and a sink, with its own checkpoint."""
    writer = stream.transform(transform).writeStream.outputMode(mode).foreachBatch(sink)
    return start(writer, name, folder, every)


# Read model kept by a streaming aggregate ------------------------------------------------

BALANCE_ROWS = _schema(
    ("id", _S), ("version", _L), ("sequence", _L), ("balance", _L), ("owner", _S)
)


def deduplicated(stream: DataFrame, watermark: str | None = None, spread: int = 16) -> DataFrame:
    """One row per log position. State grows with the log unless ``watermark`` bounds
    how late a redelivery may come (by ``created_at``).

    Copies are dropped twice: first within ``spread`` random shares of each position,
    so that a row delivered very often is worked off by many tasks, then across them.
    """
    shared = stream.withColumn("__share", F.floor(F.rand() * spread))
    if watermark is None:
        return shared.dropDuplicates(["seq", "__share"]).dropDuplicates(["seq"]).drop("__share")
    return (
        shared.withColumn("created_at", F.col("created_at").cast("timestamp"))
        .withWatermark("created_at", watermark)
        .dropDuplicatesWithinWatermark(["seq", "__share"])
        .dropDuplicatesWithinWatermark(["seq"])
        .drop("__share")
    )


def _balance_rows(applied: DataFrame) -> DataFrame:
    return applied.groupBy(F.col("aggregate_id").alias("id")).agg(
        F.count("*").alias("version"),
        F.max("seq").alias("sequence"),
        F.sum(signed_money()).alias("balance"),
        F.max(F.when(F.col("kind") == "AccountCreated", F.col("owner"))).alias("owner"),
    )


def balance_projection(
    stream: DataFrame,
    folder: str,
    name: str = "balance",
    dedup: bool = False,
    watermark: str | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """Keep balances per account; each batch writes the accounts that it changed."""
    table = BatchTable(stream.sparkSession, f"{folder}/{name}", BALANCE_ROWS, _newest).create()

    def transform(df: DataFrame) -> DataFrame:
        applied = df.where(
            F.col("aggregate_kind").isin(ACCOUNT) & F.col("kind").isin(*PROJECTED_KINDS)
        )
        return _balance_rows(deduplicated(applied, watermark) if dedup else applied)

    return run_projection(stream, name, transform, table.write, folder, "update", every)


def _newest(rows: DataFrame) -> DataFrame:
    """Of each id the row that was written last."""
    values = [c for c in rows.columns if c not in ("id", "batch_id")]
    return rows.groupBy("id").agg(F.max(F.struct("batch_id", *values)).alias("doc")).select("id", "doc.*")


def read_projection(spark: SparkSession, folder: str, name: str = "balance") -> DataFrame:
    """The documents: of each account the last written row; unknown accounts are left out."""
    rows = BatchTable(spark, f"{folder}/{name}", BALANCE_ROWS).read()
    return (
        _newest(rows)
        .where("owner IS NOT NULL")
        .select(
            "id",
            "version",
            "sequence",
            F.lit(CATCH_UP).alias("kind"),
            F.lit(OPEN).alias("status"),
            "balance",
            "owner",
        )
    )


# Read model kept by marks instead of state ------------------------------------------------

DELTA_ROWS = _schema(
    ("topic", _S), ("id", _S), ("events", _L), ("sequence", _L), ("amount", _L), ("owner", _S)
)


def mark_projection(
    stream: DataFrame,
    folder: str,
    name: str = "marks",
    global_mark: bool = False,
    every: str | None = None,
    checkpoint: str | None = None,
) -> StreamingQuery:
    """Apply events above the highest sequence applied so far, and drop the others.

    The mark is kept per topic partition; ``global_mark`` keeps one for all, which is
    safe only with one ordered partition. Rows of a topic partition must come in the order
    of ``seq``; where they may not, ``frontier_projection`` waits for those that are missing.
    A batch writes what it adds to each account and the marks of all topic partitions by
    then, in one write; the next batch reads the marks of this one only, so its work does
    not grow with the batches before.
    """
    table = BatchTable(stream.sparkSession, f"{folder}/{name}", DELTA_ROWS, _summed).create()

    def apply(batch: DataFrame, batch_id: int) -> None:
        keys = [] if global_mark else ["topic"]
        known = _marks(table.previous(batch_id))
        mark = known.withColumnRenamed("sequence", "mark")
        fresh = above_mark(batch, mark, keys).dropDuplicates(["seq"])
        changes = (
            fresh.where(F.col("kind").isin(*PROJECTED_KINDS))
            .groupBy("topic", F.col("aggregate_id").alias("id"))
            .agg(
                F.count("*").alias("events"),
                F.max("seq").alias("sequence"),
                F.sum(signed_money()).alias("amount"),
                F.max(F.when(F.col("kind") == "AccountCreated", F.col("owner"))).alias("owner"),
            )
        )
        token = _marks_of(known.unionByName(changes.select("topic", "sequence")))
        table.write(changes.unionByName(token, allowMissingColumns=True), batch_id)

    return run_projection(
        stream, checkpoint or name, lambda df: df, apply, folder, every=every
    )


def _summed(rows: DataFrame) -> DataFrame:
    """What many batches added to an account as one row; of marks the highest."""
    return rows.groupBy("topic", "id").agg(
        F.sum("events").alias("events"),
        F.max("sequence").alias("sequence"),
        F.sum("amount").alias("amount"),
        F.max("owner").alias("owner"),
    )


def _marks(rows: DataFrame) -> DataFrame:
    """Highest applied sequence per topic partition, from the token rows (no id)."""
    return _marks_of(rows.where("id IS NULL"))


def _marks_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy("topic").agg(F.max("sequence").alias("sequence"))


def read_marked(spark: SparkSession, folder: str, name: str = "marks") -> DataFrame:
    """Documents summed up from what the batches added."""
    rows = BatchTable(spark, f"{folder}/{name}", DELTA_ROWS).read().where("id IS NOT NULL")
    return (
        rows.groupBy("id")
        .agg(
            F.sum("events").alias("version"),
            F.max("sequence").alias("sequence"),
            F.sum("amount").alias("balance"),
            F.max("owner").alias("owner"),
        )
        .where("owner IS NOT NULL")
    )


def read_marks(
    spark: SparkSession, folder: str, name: str = "marks", projection: str = "balance"
) -> DataFrame:
    """Resume tokens, as saved with the effects."""
    marks = _marks(BatchTable(spark, f"{folder}/{name}", DELTA_ROWS).read())
    return marks.select(
        F.concat(F.col("topic"), F.lit(f"/{projection}")).alias("id"),
        F.concat(F.lit(f"{CATCH_UP}:"), F.col("sequence").cast("string")).alias("token"),
    )


# Rebuild, forward, transaction status -----------------------------------------------------


def rebuild(log: DataFrame, folder: str, build: int) -> None:
    """Replay the whole log into a build of its own; readers stay on the last one until
    this one is committed."""
    documents = fold_balance_projection(log)
    documents.write.mode("overwrite").parquet(f"{folder}/build={build}")


def read_rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the newest build."""
    builds = spark.read.option("basePath", folder).parquet(folder)
    newest = builds.agg(F.max("build")).scalar()
    return builds.where(F.col("build") == newest).drop("build")


def forward(
    stream: DataFrame, topic: str, partitions: int, folder: str, every: str | None = None
) -> StreamingQuery:
    """Log rows to a topic, numbered on end in each of its partitions.

    A batch writes its rows in order of ``seq`` and then how far each partition is numbered,
    from which the next batch goes on; both are kept as they are when the batch is repeated.
    """
    spark = stream.sparkSession
    rows = T.StructType([*stream.schema.fields, T.StructField("topic", _S), T.StructField("offset", _L)])
    table = BatchTable(spark, f"{folder}/{topic}", rows).create()
    ends = BatchTable(spark, f"{folder}/{topic}-ends", _schema(("topic", _S), ("offset", _L))).create()

    def apply(batch: DataFrame, batch_id: int) -> None:
        known = ends.previous(batch_id)
        table.write(numbered(batch, topic, partitions, known), batch_id)
        last = table.rows_of(batch_id).select("topic", "offset").unionByName(known)
        ends.write(last.groupBy("topic").agg(F.max("offset").alias("offset")), batch_id)

    return run_projection(stream, f"forward-{topic}", lambda df: df, apply, folder, every=every)


def read_topic(spark: SparkSession, schema: T.StructType, topic: str, folder: str) -> DataFrame:
    """The rows that ``forward`` wrote, with topic partition and offset."""
    rows = T.StructType([*schema.fields, T.StructField("topic", _S), T.StructField("offset", _L)])
    return BatchTable(spark, f"{folder}/{topic}", rows).read().drop("batch_id")


STATUS_ROWS = _schema(("id", _S), ("first_seq", _L), ("kind", _S), ("reason", _S), ("created", _B))


def transaction_status(
    stream: DataFrame, folder: str, name: str = "status", every: str | None = None
) -> StreamingQuery:
    """Status per transaction: the first terminal event counts, later ones change nothing."""
    table = BatchTable(stream.sparkSession, f"{folder}/{name}", STATUS_ROWS, _newest).create()

    def transform(df: DataFrame) -> DataFrame:
        ended = F.when(
            F.col("kind").isin(*TERMINAL_KINDS), F.struct(F.col("seq"), F.col("kind"), F.col("reason"))
        )
        return (
            df.where(F.col("kind").isin(*TRANSACTION_KINDS))
            .groupBy(F.col("aggregate_id").alias("id"))
            .agg(
                F.min(ended).alias("end"),
                F.max(F.col("kind") == "TransactionCreated").alias("created"),
            )
            .select(
                "id",
                F.col("end.seq").alias("first_seq"),
                F.col("end.kind").alias("kind"),
                F.col("end.reason").alias("reason"),
                "created",
            )
        )

    return run_projection(stream, name, transform, table.write, folder, "update", every)


def read_status(spark: SparkSession, folder: str, name: str = "status") -> DataFrame:
    rows = BatchTable(spark, f"{folder}/{name}", STATUS_ROWS).read()
    kind = F.col("row.kind")
    return (
        _newest(rows)
        .select("id", F.struct("kind", "reason", "created").alias("row"))
        .where("row.created")
        .select(
            "id",
            F.when(kind == "TransactionFailed", FAILED)
            .when(kind == "TransactionSucceeded", SUCCEEDED)
            .otherwise(PENDING)
            .alias("status"),
            F.when(kind == "TransactionFailed", F.col("row.reason")).otherwise("").alias("reason"),
        )
    )


# Reactor ----------------------------------------------------------------------------------

def reactor(
    stream: DataFrame,
    accounts: DataFrame,
    folder: str,
    name: str = "reactor",
    every: str | None = None,
    compact_every: int = SNAPSHOT_THRESHOLD,
) -> StreamingQuery:
    """Settle the transfers of each batch on the balances left by those before.

    ``stream``: seq, from_id, to_id, money, in log order from batch to batch. Transfers
    settled before are skipped. Outcomes are the only thing written: balances and the
    mark follow from them, so effects and progress are one commit. Every
    ``compact_every`` batches the balances are written too, to bound what is read back.
    """
    spark = stream.sparkSession
    key = stream.schema["from_id"].dataType
    outcomes = BatchTable(spark, f"{folder}/{name}", outcome_schema(key)).create()
    state = BatchTable(
        spark, f"{folder}/{name}-balances", _schema(("account_id", key), ("balance", _L))
    ).create()

    def balances(written: int, before: int) -> DataFrame:
        """The state written by one batch, and what the later ones before another moved."""
        moved = settlement.balance_changes(
            outcomes.read(before=before, after=max(written, NO_BATCH))
        )
        return (
            state.read()
            .where(F.col("batch_id") == written)
            .select("account_id", "balance")
            .unionByName(moved.withColumnRenamed("amount", "balance"))
            .groupBy("account_id")
            .agg(F.sum("balance").alias("balance"))
        )

    def apply(batch: DataFrame, batch_id: int) -> None:
        new = batch.dropDuplicates(["seq"])
        # Only outcomes at or after the first position of the batch can repeat one.
        first = batch.agg(F.min("seq")).scalar()
        done = outcomes.read(before=batch_id).where(F.col("seq") >= first).select("seq")
        fresh = new.join(done, "seq", "left_anti")
        written = (batch_id - 1) // compact_every * compact_every
        settled = settlement.settle(fresh, accounts, balances(written, batch_id))
        outcomes.write(settled, batch_id)
        if batch_id % compact_every == 0:
            state.write(balances(written, batch_id + 1), batch_id)

    return run_projection(stream, name, lambda df: df, apply, folder, every=every)


def outcome_schema(key: T.DataType) -> T.StructType:
    return _schema(
        ("seq", _L),
        ("from_id", key),
        ("to_id", key),
        ("money", _L),
        ("status", _S),
        ("reason", _S),
        ("rollback", _B),
        ("withdrawn", _B),
        ("deposited", _B),
        ("refunded", _B),
    )


def read_outcomes(
    spark: SparkSession, folder: str, key: T.DataType, name: str = "reactor"
) -> DataFrame:
    return BatchTable(spark, f"{folder}/{name}", outcome_schema(key)).read().drop("batch_id")
