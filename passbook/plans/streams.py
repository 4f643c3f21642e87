"""Streaming queries, run over the tables until caught up and read back as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passbook.functions.ids import account_uuid
from passbook.operators import folds, sinks
from passbook.plans.batch import mixed_accounts, published
from passbook.schema import CATCH_UP, OPEN, TRANSACTION_KINDS, event_log_schema
from passbook.session import saved, shared_dir
from passbook.sources import canonical, files
from passbook.sources.canonical import halves, redelivered, stream_typed_log
from passbook.streaming import frontier, reactor, stateful
from passbook.streaming import projections as p
from passbook.streaming.batches import BatchTable


def _staged(spark: SparkSession, folder: str, part: DataFrame) -> DataFrame:
    """Append rows to the change feed in ``folder``; returns its stream."""
    part.write.mode("append").parquet(folder)
    return files.stream_table(spark, folder, part.schema)


def tail_event_log(spark: SparkSession, d: str) -> DataFrame:
    folder = shared_dir(spark, "tail")
    raw = canonical.raw_log(spark, d)
    # Versions play no part in following the log; the stored log has them.
    versioned = raw.withColumn("aggregate_version", F.lit(0)).select(*event_log_schema().names)
    versioned.write.parquet(f"{folder}/log")
    rows = files.tail_event_log(spark, f"{folder}/log", max_files=2)
    writer = rows.writeStream.format("parquet").option("path", f"{folder}/tail")
    p.until_caught_up(p.start(writer, "tail", folder))
    return spark.read.parquet(f"{folder}/tail").select("seq", "aggregate_id", "kind", "body")


def subscribe_topic(spark: SparkSession, d: str) -> DataFrame:
    folder = shared_dir(spark, "subscribe")
    log = stream_typed_log(spark, d).select("seq", "aggregate_kind", "kind")
    topic = F.concat(F.lower("aggregate_kind"), F.lit(".1"))
    mine = files.subscribe_topic(log.select("seq", topic.alias("topic"), "kind"), "account")
    writer = mine.writeStream.format("parquet").option("path", f"{folder}/messages")
    p.until_caught_up(p.start(writer, "subscribe", folder))
    return spark.read.parquet(f"{folder}/messages")


def stream_balance_projection(spark: SparkSession, d: str) -> DataFrame:
    folder = shared_dir(spark, "projection")
    p.until_caught_up(p.balance_projection(stream_typed_log(spark, d), folder))
    return p.read_projection(spark, folder)


def stream_dedup_redelivery(spark: SparkSession, d: str) -> DataFrame:
    """A topic of four partitions that delivers every seventh row again, some later than others."""
    folder = shared_dir(spark, "dedup")
    rows = sinks.numbered(canonical.typed_log(spark, d), "accounts", 4)
    for part in (redelivered(rows), rows.where(F.pmod("seq", F.lit(7)) == 0)):
        p.until_caught_up(stateful.dedup_projection(_staged(spark, f"{folder}/feed", part), folder))
    found = p.read_marked(spark, folder, "once")
    return found.withColumn("kind", F.lit(CATCH_UP)).withColumn("status", F.lit(OPEN))


#: Files of a topic, at least, and the rows of a larger file.
TOPIC_FILES, FILE_ROWS = 4, 1 << 19


def _topic_files(n_rows: int, rows: int = FILE_ROWS) -> int:
    """Files that a topic of so many rows is written in: they grow in number, not in size."""
    return TOPIC_FILES * max(1, -(-n_rows // (TOPIC_FILES * rows)))


def _published(spark: SparkSession, log: DataFrame, folder: str) -> int:
    """Add the log to the one topic partition in ``folder``, in files that many tasks wrote;
    returns how many of them are a quarter."""
    files_of_all = _topic_files(log.count())
    numbers = sinks.numbered(log, "accounts", 1)
    numbers.repartition(files_of_all, "seq").write.mode("append").parquet(f"{folder}/topic")
    return files_of_all // TOPIC_FILES


def _consumed(spark: SparkSession, folder: str, max_files: int, checkpoint: str | None = None) -> None:
    """The topic as it is by now, a quarter of the files that were published at a time."""
    schema = spark.read.parquet(f"{folder}/topic").schema
    feed = files.stream_table(spark, f"{folder}/topic", schema, max_files=max_files)
    p.until_caught_up(frontier.frontier_projection(feed, folder, checkpoint=checkpoint))


def stream_drop_late(spark: SparkSession, d: str) -> DataFrame:
    """A topic read in the order in which tasks wrote its files, and then every seventh row
    again: rows wait for those before them, and late copies are dropped."""
    folder = shared_dir(spark, "late")
    log = canonical.typed_log(spark, d)
    quarter = _published(spark, log, folder)
    _consumed(spark, folder, quarter)
    again = spark.read.parquet(f"{folder}/topic").where(F.pmod("seq", F.lit(7)) == 0)
    saved(again, f"{folder}/again").write.mode("append").parquet(f"{folder}/topic")
    _consumed(spark, folder, quarter)
    return frontier.read_frontier(spark, folder)


def stream_resume(spark: SparkSession, d: str) -> DataFrame:
    """Stopped after the first half of the log, started again for the second."""
    folder = shared_dir(spark, "resume")
    for part in halves(canonical.typed_log(spark, d)):
        p.until_caught_up(p.balance_projection(_staged(spark, f"{folder}/feed", part), folder))
    return p.read_projection(spark, folder)


def stream_progress(spark: SparkSession, d: str) -> DataFrame:
    """What the checkpoint of a stopped projection holds: its operator, its last batch, and a row
    of state for each account that it has seen."""
    folder = shared_dir(spark, "progress")
    for part in halves(canonical.typed_log(spark, d)):
        p.until_caught_up(p.balance_projection(_staged(spark, f"{folder}/feed", part), folder))
    return stateful.progress(spark, folder, "balance")


def stream_catch_up_then_live(spark: SparkSession, d: str) -> DataFrame:
    """History folded as a batch, then a live feed in two parts that overlaps it."""
    folder = shared_dir(spark, "catchup")
    history, live = halves(canonical.typed_log(spark, d))
    overlap = history.where(F.pmod("seq", F.lit(7)) == 0)
    for part in (overlap.unionByName(live.where("seq % 20 < 10")), live.where("seq % 20 >= 10")):
        feed = _staged(spark, f"{folder}/feed", part)
        p.until_caught_up(stateful.catch_up_then_live(history, feed, folder))
    return stateful.read_live(spark, folder)


#: A day.
OVERDUE_MS = 24 * 60 * 60 * 1000


def stream_overdue_transactions(spark: SparkSession, d: str) -> DataFrame:
    """Transfers that were still PENDING a day after their request; the ends of every fifth
    transfer are withheld."""
    folder = shared_dir(spark, "overdue")
    log = canonical.typed_log(spark, d, TRANSACTION_KINDS)
    kept = log.where((F.col("kind") == "TransactionCreated") | (F.expr("seq div 10") % 5 != 0))
    p.until_caught_up(stateful.overdue_transactions(_staged(spark, f"{folder}/feed", kept), folder, OVERDUE_MS))
    return stateful.read_overdue(spark, folder).select("id", F.date_format("since", "yyyy-MM-dd HH:mm:ss.SSS").alias("since"))


def stream_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """A build over the first half of the log, replaced by one over all of it."""
    folder = shared_dir(spark, "rebuild")
    log = canonical.typed_log(spark, d)
    for build, part in enumerate((halves(log)[0], log), start=1):
        p.rebuild(part, folder, build)
    return p.read_rebuilt(spark, folder)


def stream_forward(spark: SparkSession, d: str) -> DataFrame:
    folder = shared_dir(spark, "forward")
    rows = canonical.log_rows(stream_typed_log(spark, d))
    p.until_caught_up(p.forward(rows, "accounts", 4, folder))
    return published(p.read_topic(spark, rows.schema, "accounts", folder))


def stream_transaction_status(spark: SparkSession, d: str) -> DataFrame:
    folder = shared_dir(spark, "status")
    p.until_caught_up(p.transaction_status(stream_typed_log(spark, d), folder))
    return p.read_status(spark, folder)


def stream_reactor(spark: SparkSession, d: str) -> DataFrame:
    """Transfers in two deliveries, the second with repeats of the first."""
    folder = shared_dir(spark, "reactor")
    early, late = halves(canonical.transfers(spark, d))
    accounts = mixed_accounts(spark, d)
    for part in (early, late.unionByName(early.where(F.col("seq") % 7 == 0))):
        feed = _staged(spark, f"{folder}/feed", part)
        p.until_caught_up(p.reactor(feed, accounts, folder))
    return p.read_outcomes(spark, folder, early.schema["from_id"].dataType)


def stream_reactor_events(spark: SparkSession, d: str) -> DataFrame:
    """Balances after a reactor carried out the requests of the log: requests in two deliveries,
    the second with repeats, then its own failures, twice, which it refunds."""
    folder = shared_dir(spark, "react")
    columns = ("topic", "seq", "aggregate_id", "kind", "money", "from_id", "to_id", "rollback")
    log = canonical.typed_log(spark, d, ["TransactionCreated"]).withColumn("topic", F.lit("accounts.1"))
    early, late = halves(log.select(*columns))
    accounts = mixed_accounts(spark, d).select(account_uuid("account_id").alias("account_id"), "status")
    for part in (early, late.unionByName(early.where(F.col("seq") % 7 == 0))):
        p.until_caught_up(reactor.react(_staged(spark, f"{folder}/feed", part), accounts, folder))
    for _ in range(2):
        failed = reactor.read_emitted(spark, folder).where("kind = 'TransactionFailed'")
        part = saved(failed.withColumn("topic", F.lit("accounts.1")).select(*columns), shared_dir(spark, "failed"))
        p.until_caught_up(reactor.react(_staged(spark, f"{folder}/feed", part), accounts, folder))
    opened = canonical.typed_log(spark, d, ["AccountCreated"])
    whole = opened.unionByName(reactor.read_emitted(spark, folder), allowMissingColumns=True)
    return folds.fold_balance_projection(whole).select("id", "balance", "owner")


def stream_atomic_commit(spark: SparkSession, d: str) -> DataFrame:
    """The token and the effects it stands for, after the checkpoint was lost: the engine then
    reads everything again, and nothing of it counts twice."""
    folder = shared_dir(spark, "atomic")
    quarter = _published(spark, canonical.typed_log(spark, d), folder)
    _consumed(spark, folder, quarter)
    _consumed(spark, folder, quarter, checkpoint="again")
    effects = frontier.read_frontier(spark, folder).agg(
        F.sum("balance").alias("held"), F.sum("version").alias("events")
    )
    token = frontier.read_tokens(spark, folder)
    return token.select(
        "id",
        "token",
        effects.select("held").scalar().alias("held"),
        effects.select("events").scalar().alias("events"),
    )


def run_projection(spark: SparkSession, d: str) -> DataFrame:
    """A user's projection: deposits per account, each batch adding the changed ones."""
    folder = shared_dir(spark, "custom")
    rows = T.StructType(
        [T.StructField("aggregate_id", T.StringType()), T.StructField("deposited", T.LongType())]
    )
    table = BatchTable(spark, f"{folder}/deposits", rows).create()

    def deposits(log: DataFrame) -> DataFrame:
        paid = log.where(F.col("kind") == "MoneyDeposited")
        return paid.groupBy("aggregate_id").agg(F.sum("money").alias("deposited"))

    query = p.run_projection(
        stream_typed_log(spark, d), "deposits", deposits, table.write, folder, mode="update"
    )
    p.until_caught_up(query)
    latest = table.read().groupBy("aggregate_id")
    return latest.agg(F.max_by("deposited", "batch_id").alias("deposited"))


QUERIES = {
    f.__name__: f
    for f in (
        tail_event_log,
        subscribe_topic,
        stream_balance_projection,
        stream_dedup_redelivery,
        stream_drop_late,
        stream_resume,
        stream_catch_up_then_live,
        stream_progress,
        stream_overdue_transactions,
        stream_rebuild,
        stream_forward,
        stream_transaction_status,
        stream_reactor,
        stream_reactor_events,
        stream_atomic_commit,
        run_projection,
    )
}
