"""A reactor on messages: transfers that were requested are carried out, failed ones undone.

It reads ``TransactionCreated`` and ``TransactionFailed`` messages of the log and emits what
follows from them: withdrawals, deposits, and how the transfer ended, or the refund of a
transfer that failed after its withdrawal. A message that comes again emits nothing new, as
events carry idempotency keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from passbook.functions.ids import idempotency_key
from passbook.operators import settlement
from passbook.schema import ACCOUNT, CATCH_UP, REACTOR_KINDS, ROLLBACK
from passbook.session import saved, shared_dir
from passbook.streaming.batches import BatchTable
from passbook.streaming.projections import run_projection

#: Positions from that of a request on, up to which its events stand.
SLOTS = 10

_S, _L, _B = T.StringType(), T.LongType(), T.BooleanType()
#: Emitted events, and tokens: rows with a topic and the highest position that was handled.
EVENTS = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in (
            ("topic", _S),
            ("seq", _L),
            ("aggregate_id", _S),
            ("aggregate_kind", _S),
            ("kind", _S),
            ("money", _L),
            ("tx_id", _S),
            ("from_id", _S),
            ("to_id", _S),
            ("rollback", _B),
            ("reason", _S),
            ("idempotency_key", _S),
        )
    ]
)
MOVES = T.StructType([T.StructField("account_id", _S), T.StructField("balance", _L)])


def _added_up(moves: DataFrame) -> DataFrame:
    return moves.groupBy("account_id").agg(F.sum("balance").alias("balance"))


def react(
    stream: DataFrame,
    accounts: DataFrame,
    folder: str,
    name: str = "events",
    every: str | None = None,
    checkpoint: str | None = None,
) -> StreamingQuery:
    """Handle the messages of ``stream``: topic, seq, aggregate_id, kind, money, from_id, to_id,
    rollback; requests in log order from batch to batch. ``accounts``: account_id, status.

    The events of a batch and the tokens of its topic partitions are one write. Balances are
    kept beside them; they follow from the batches before, so a batch that is run again finds
    the same. Money whose refund is still to come counts as paid back already.
    """
    spark = stream.sparkSession
    events = BatchTable(spark, f"{folder}/{name}", EVENTS).create()
    moves = BatchTable(spark, f"{folder}/{name}-moves", MOVES, _added_up).create()

    def requested(new: DataFrame, history: DataFrame) -> DataFrame:
        """Requests that nothing was emitted for yet; events stand behind their request."""
        created = new.where(F.col("kind") == "TransactionCreated").withColumnRenamed("aggregate_id", "tx_id")
        first = created.agg(F.min("seq")).scalar()
        done = history.where(F.col("seq") >= first).select("tx_id")
        return created.select("seq", "tx_id", "from_id", "to_id", "money").join(done, "tx_id", "left_anti")

    def refunds(new: DataFrame, history: DataFrame) -> DataFrame:
        """Refunds of failures that ask for one. What they refer to stands close before them."""
        failed = new.where(F.col("kind") == "TransactionFailed").select(
            "seq", F.col("aggregate_id").alias("tx_id"), "rollback"
        )
        near = history.where(F.col("seq") >= failed.agg(F.min("seq")).scalar() - SLOTS)
        tx = near.where(F.col("kind") == "MoneyWithdrawn").select(
            F.col("tx_id").alias("id"), "money", F.col("aggregate_id").alias("from_id")
        )
        stored = near.where(F.col("kind") == "MoneyDeposited").select("idempotency_key")
        at = failed.groupBy("tx_id").agg((F.min("seq") + 2).alias("seq"))
        due = settlement.refunds(failed, tx, stored).join(at, "tx_id")
        return due.withColumn("aggregate_kind", F.lit(ACCOUNT))

    def apply(batch: DataFrame, batch_id: int) -> None:
        new = batch.where(F.col("kind").isin(*REACTOR_KINDS)).dropDuplicates(["seq"])
        new = saved(new, shared_dir(spark, "messages"))
        history = events.read(before=batch_id).where(F.col("topic").isNull())
        asked = saved(requested(new, history), shared_dir(spark, "requests"))
        opening = _added_up(moves.read(before=batch_id).select("account_id", "balance"))
        settled = settlement.settle(asked.drop("tx_id"), accounts, opening)
        settled = saved(settled.join(asked.select("seq", "tx_id"), "seq"), shared_dir(spark, "settled"))
        emitted = settlement.emitted_events(settled, 1, numbered=False)
        undone = F.coalesce(F.col("idempotency_key") == idempotency_key("tx_id", ROLLBACK), F.lit(False))
        emitted = emitted.where((F.col("kind") != "TransactionCreated") & ~undone)
        marks = events.previous(batch_id).where(F.col("topic").isNotNull()).select("topic", "seq")
        tokens = marks.unionByName(batch.select("topic", "seq")).groupBy("topic").agg(F.max("seq").alias("seq"))
        out = spark.createDataFrame([], EVENTS)
        for part in (emitted, refunds(new, history), tokens):
            out = out.unionByName(part, allowMissingColumns=True)
        moves.write(settlement.balance_changes(settled).withColumnRenamed("amount", "balance"), batch_id)
        events.write(out, batch_id)

    return run_projection(stream, checkpoint or name, lambda df: df, apply, folder, every=every)


def read_emitted(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """All events that were emitted."""
    return BatchTable(spark, f"{folder}/{name}", EVENTS).read().where("topic IS NULL").drop("topic", "batch_id")


def read_tokens(spark: SparkSession, folder: str, name: str = "events", reactor: str = "accounts-reactor") -> DataFrame:
    """Resume tokens, as committed with the events."""
    rows = BatchTable(spark, f"{folder}/{name}", EVENTS).read().where("topic IS NOT NULL")
    return rows.groupBy(F.concat("topic", F.lit(f"/{reactor}")).alias("id")).agg(
        F.concat(F.lit(f"{CATCH_UP}:"), F.max("seq").cast("string")).alias("token")
    )
