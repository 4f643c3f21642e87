"""Batch queries over the ledger derived from the test tables, by name."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passbook import functions as fn
from passbook.operators import checks, filters, folds, joins, scans, settlement, sinks, views
from passbook.schema import (
    ACCOUNT,
    ACCOUNT_KINDS,
    EVENT_BODIES,
    LIST_PAGE,
    MONEY_KINDS,
    NIL_UUID,
    OPEN,
    PROJECTED_KINDS,
    REACTOR_KINDS,
    TERMINAL_KINDS,
    TRANSACTION_KINDS,
    event_log_schema,
)
from passbook.session import saved, shared_dir
from passbook.sources import canonical, files

POINT_ID = "00000000-0000-4000-8000-000000000007"

# Inputs ----------------------------------------------------------------------------------


def account_log(spark: SparkSession, d: str) -> DataFrame:
    return canonical.typed_log(spark, d, ACCOUNT_KINDS)


def projected_log(spark: SparkSession, d: str) -> DataFrame:
    return canonical.typed_log(spark, d, PROJECTED_KINDS)


def transaction_log(spark: SparkSession, d: str) -> DataFrame:
    return canonical.typed_log(spark, d, TRANSACTION_KINDS)


def balances(spark: SparkSession, d: str) -> DataFrame:
    return folds.fold_balance_projection(projected_log(spark, d))


def account_states(spark: SparkSession, d: str) -> DataFrame:
    return folds.fold_account_state(account_log(spark, d))


def transaction_states(spark: SparkSession, d: str) -> DataFrame:
    return folds.fold_transaction_state(transaction_log(spark, d))


def known_accounts(spark: SparkSession, d: str) -> DataFrame:
    return canonical.typed_log(spark, d, ["AccountCreated"]).select(
        F.col("aggregate_id").alias("id"), "owner"
    )


def mixed_accounts(spark: SparkSession, d: str) -> DataFrame:
    return canonical.accounts(spark, d, mixed_status=True)


def outcomes(spark: SparkSession, d: str, mixed: bool = True) -> DataFrame:
    return settlement.settle(
        canonical.transfers(spark, d), canonical.accounts(spark, d, mixed_status=mixed)
    )


def transfer_requests(spark: SparkSession, d: str) -> DataFrame:
    created = canonical.typed_log(spark, d, ["TransactionCreated"])
    return created.select("seq", "tx_id", "from_id", "to_id", "money")


def versioned_log(spark: SparkSession, d: str) -> DataFrame:
    return scans.assign_versions(account_log(spark, d))


# Sources ---------------------------------------------------------------------------------


_STAGED: dict[tuple[str, str, str], str] = {}


def staged(spark: SparkSession, d: str, what: str, write: Callable[[str], None]) -> str:
    """The folder of a table that queries of one session share; the first one writes it."""
    key = (spark.sparkContext.applicationId, d, what)
    if key not in _STAGED:
        path = shared_dir(spark, what)
        write(path)
        _STAGED[key] = path
    return _STAGED[key]


def stored_log(spark: SparkSession, d: str) -> str:
    """The folder of the raw log with versions, partitioned by kind."""

    def write(path: str) -> None:
        raw = scans.assign_versions(canonical.raw_log(spark, d))
        raw.withColumn("aggregate_version", F.col("aggregate_version").cast("int")).write.partitionBy("kind").parquet(path)

    return staged(spark, d, "log", write)


def stored_ranges(spark: SparkSession, d: str) -> tuple[str, int]:
    """The folder of the account log in about 16 ranges of positions, and their width."""
    log = account_log(spark, d).select("seq", "aggregate_id", "kind", "money", "owner")
    width = log.agg(F.expr("max(seq) div 16 + 1")).first()[0]
    return staged(spark, d, "ranges", lambda path: sinks.write_ranges(log, path, width)), width


def stored_states(spark: SparkSession, d: str) -> tuple[str, int]:
    """The folder of all accounts' states after the first 14 ranges, and the last position of these."""
    path, width = stored_ranges(spark, d)
    last = 14 * width - 1
    log = files.read_ranges(spark, path, RANGED, width, -(1 << 62))
    return staged(spark, d, "states", lambda p: saved(folds.states_at(log, last), p)), last


RANGED = T.StructType(
    [T.StructField(n, T.LongType() if n in ("seq", "money") else T.StringType()) for n in ("seq", "aggregate_id", "kind", "money", "owner")]
)


def scan_event_log(spark: SparkSession, d: str) -> DataFrame:
    log = files.read_event_log(spark, stored_log(spark, d))
    return log.withColumn("aggregate_version", F.col("aggregate_version").cast("long")).withColumn(
        "created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    )


def read_account_commands(spark: SparkSession, d: str) -> DataFrame:
    path = shared_dir(spark, "commands")
    line = F.when(F.col("account_id") % 50 == 0, "not a command").otherwise(
        F.to_json(F.struct("owner"))
    )
    canonical.accounts(spark, d).select(line.alias("value")).write.text(path)
    return files.read_account_commands(spark, path)


def read_transfer_commands(spark: SparkSession, d: str) -> DataFrame:
    """An absent id is left out, empty or nil; some destinations are malformed."""
    path = shared_dir(spark, "commands")
    n = F.col("seq") / 10
    missing = F.when(n % 3 == 0, "").when(n % 3 == 1, fn.null_to_nil(F.lit(None)))
    to_id = F.when(n % 50 == 0, "not-an-id").otherwise(F.coalesce("to_id", missing))
    command = F.struct(
        F.coalesce("from_id", missing).alias("from"), to_id.alias("to"), F.col("money")
    )
    transfer_requests(spark, d).select(F.to_json(command).alias("value")).write.text(path)
    return files.read_transfer_commands(spark, path)


def scan_balances(spark: SparkSession, d: str) -> DataFrame:
    path = shared_dir(spark, "balances")
    balances(spark, d).write.parquet(path)
    return files.read_balances(spark, path)


# Sinks -----------------------------------------------------------------------------------


def append_events(spark: SparkSession, d: str) -> DataFrame:
    """Two appends; the second repeats the deposits of the first."""
    path = shared_dir(spark, "append")
    keep = ("seq", "aggregate_id", "kind", "idempotency_key")
    raw = canonical.raw_log(spark, d).select(*keep)
    early = F.col("kind") != "MoneyWithdrawn"
    stored = sinks.append_events(raw.where(early), None, f"{path}/append=1")
    later = raw.where(F.col("kind").isin(*MONEY_KINDS))
    added = sinks.append_events(later, stored, f"{path}/append=2")
    return stored.unionByName(added).drop("idempotency_key")


def create_if_new(spark: SparkSession, d: str) -> DataFrame:
    requests = canonical.transfers(spark, d).select(
        fn.transaction_uuid("seq").alias("tx_id"), "seq", "money", "from_id"
    )
    known = requests.where(F.col("from_id").isNull()).select("tx_id")
    return sinks.create_if_new(canonical.redelivered(requests), known).drop("from_id")


def published(log: DataFrame) -> DataFrame:
    """What each aggregate finds in its topic: how many events from where to where, whether
    they stand in one partition and in order, and whether that one has all its offsets."""
    follows = scans.running(log, "topic", "offset", [scans.Running("before", F.col("seq"), "lag")])
    ends = log.groupBy("topic").agg((F.max("offset") == F.count("*")).alias("dense"))
    return (
        follows.join(F.broadcast(ends), "topic")  # a row for each topic partition
        .groupBy("aggregate_id")
        .agg(
            F.count("*").alias("events"),
            F.min("seq").alias("first_seq"),
            F.max("seq").alias("last_seq"),
            F.countDistinct("topic").alias("partitions"),
            F.bool_and(F.col("before").isNull() | (F.col("before") < F.col("seq"))).alias("ordered"),
            F.bool_and("dense").alias("dense"),
        )
    )


def publish_partitioned(spark: SparkSession, d: str) -> DataFrame:
    path = shared_dir(spark, "topics")
    sinks.publish_partitioned(canonical.raw_log(spark, d), "accounts", 4, path)
    return published(spark.read.parquet(path))


def row_to_json_notify(spark: SparkSession, d: str) -> DataFrame:
    raw = canonical.raw_log(spark, d)
    return sinks.row_to_json(raw.select("seq", "aggregate_id", "kind", "body", "labels"))


def index_balance_full(spark: SparkSession, d: str) -> DataFrame:
    opened = sinks.opening_documents(projected_log(spark, d))
    return sinks.index_balance_full(opened, balances(spark, d))


def update_balance_partial(spark: SparkSession, d: str) -> DataFrame:
    opened = sinks.opening_documents(projected_log(spark, d))
    moved = (
        canonical.typed_log(spark, d, MONEY_KINDS)
        .groupBy(F.col("aggregate_id").alias("id"))
        .agg(F.sum(fn.signed_money()).alias("balance"), F.max("seq").alias("sequence"))
    )
    return sinks.update_balance_partial(opened, moved)


def upsert_resume_token(spark: SparkSession, d: str) -> DataFrame:
    applied = projected_log(spark, d).withColumn("topic", F.lit("accounts.1"))
    return sinks.resume_tokens(applied, "balance")


def store_transactions(spark: SparkSession, d: str) -> DataFrame:
    """Repeated requests against a table that holds the outside deposits."""
    requests = canonical.transfers(spark, d).select(
        fn.transaction_uuid("seq").alias("tx_id"), "seq", "money", "from_id"
    )
    stored = sinks.BucketedTable(spark, shared_dir(spark, "transactions"), requests.schema, "tx_id").create()
    sinks.store_new(stored, requests.where(F.col("from_id").isNull()))
    return sinks.store_new(stored, canonical.redelivered(requests))


def store_balances(spark: SparkSession, d: str) -> DataFrame:
    """Openings, then all movements as partial changes, then the whole documents."""
    opened = sinks.opening_documents(projected_log(spark, d))
    stored = sinks.BucketedTable(spark, shared_dir(spark, "documents"), opened.schema, "id").create()
    sinks.store_documents(stored, opened)
    moved = (
        canonical.typed_log(spark, d, MONEY_KINDS)
        .groupBy(F.col("aggregate_id").alias("id"))
        .agg(F.sum(fn.signed_money()).alias("balance"), F.max("seq").alias("sequence"))
    )
    sinks.store_changes(stored, moved)
    return sinks.store_documents(stored, balances(spark, d))


def store_resume_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of two topics after both halves of the log, and of a topic nobody read."""
    applied = canonical.typed_log(spark, d).select(
        "seq", F.concat(F.lower("aggregate_kind"), F.lit(".1")).alias("topic")
    )
    early, late = canonical.halves(applied)
    tokens = sinks.resume_tokens(early, "balance")
    stored = sinks.BucketedTable(spark, shared_dir(spark, "tokens"), tokens.schema, "id", buckets=4).create()
    sinks.store_tokens(stored, tokens)
    sinks.store_tokens(stored, sinks.resume_tokens(late, "balance"))
    keys = applied.select(F.concat("topic", F.lit("/balance")).alias("id")).distinct()
    return sinks.resume_token(stored, keys.union(spark.createDataFrame([("other.1/balance",)], "id string")))


def write_snapshots(spark: SparkSession, d: str) -> DataFrame:
    return sinks.write_snapshots(account_log(spark, d), shared_dir(spark, "snapshots"))


# Filters and projections -----------------------------------------------------------------


def filter_aggregate_kind(spark: SparkSession, d: str) -> DataFrame:
    return filters.of_aggregate(canonical.typed_log(spark, d), ACCOUNT).select(
        "seq", "aggregate_id", "kind"
    )


def filter_event_kind(spark: SparkSession, d: str) -> DataFrame:
    return filters.of_kinds(canonical.typed_log(spark, d), REACTOR_KINDS).select("seq", "tx_id", "kind")


def filter_high_water_mark(spark: SparkSession, d: str) -> DataFrame:
    log = canonical.typed_log(spark, d).select("seq", "kind")
    mark = log.agg(F.expr("max(seq) div 2").alias("mark"))
    return filters.above_mark(canonical.redelivered(log), mark)


def filter_rollback_needed(spark: SparkSession, d: str) -> DataFrame:
    log = canonical.typed_log(spark, d, ["TransactionFailed"])
    return filters.needs_rollback(log).select("seq", "tx_id", "reason")


def filter_optional_leg(spark: SparkSession, d: str) -> DataFrame:
    requests = transfer_requests(spark, d).drop("tx_id")
    return (
        filters.with_leg(requests, "from_id")
        .withColumn("side", F.lit("from"))
        .unionByName(filters.with_leg(requests, "to_id").withColumn("side", F.lit("to")))
    )


def route_unknown_kinds(spark: SparkSession, d: str) -> DataFrame:
    return filters.unknown_kinds(canonical.typed_log(spark, d)).select("seq", "aggregate_id", "kind")


def filter_pending_only(spark: SparkSession, d: str) -> DataFrame:
    return filters.first_terminal(canonical.typed_log(spark, d, TERMINAL_KINDS))


def filter_open_accounts(spark: SparkSession, d: str) -> DataFrame:
    origins = canonical.transfers(spark, d).where("from_id IS NOT NULL")
    statuses = mixed_accounts(spark, d).select(F.col("account_id").alias("from_id"), "status")
    return filters.split_open(origins.join(statuses, "from_id"), "From").select(
        "seq", "from_id", "status", "reason"
    )


def filter_sufficient_funds(spark: SparkSession, d: str) -> DataFrame:
    legs = settlement.withdrawals(outcomes(spark, d))
    return legs.where("accepted").select("seq", "account_id", "money")


def filter_by_label(spark: SparkSession, d: str) -> DataFrame:
    return filters.by_label(canonical.raw_log(spark, d), "topic", "transaction").select("id", "kind")


def filter_by_containment(spark: SparkSession, d: str) -> DataFrame:
    """Transfers from outside, by what their labels and bodies hold."""
    raw = canonical.raw_log(spark, d)
    found = filters.holding(raw, labels={"topic": "transaction"}, body={"from": NIL_UUID})
    return found.select("id", "kind")


def project_account_view(spark: SparkSession, d: str) -> DataFrame:
    return views.account_view(account_states(spark, d))


def search_responses(docs: DataFrame) -> DataFrame:
    """Search responses of at most 16 documents, grouped by the last id digit."""
    hit = F.struct(
        F.col("id").alias("_id"),
        F.col("version").alias("_version"),
        F.struct("sequence", "kind", "status", "balance", "owner").alias("_source"),
    )
    page = F.substring("id", 1, 35)
    return (
        docs.groupBy(page.alias("page"))
        .agg(F.collect_list(hit).alias("hits"))
        .select(F.to_json(F.struct(F.struct("hits").alias("hits"))).alias("response"))
    )


def project_search_hits(spark: SparkSession, d: str) -> DataFrame:
    return views.search_hits(search_responses(balances(spark, d)))


def project_transaction_view(spark: SparkSession, d: str) -> DataFrame:
    return views.transaction_view(transaction_states(spark, d))


def project_saga_legs(spark: SparkSession, d: str) -> DataFrame:
    return views.saga_legs(transfer_requests(spark, d), ("tx_id", "money"))


# Joins -----------------------------------------------------------------------------------


def join_event_to_balance(spark: SparkSession, d: str) -> DataFrame:
    log = canonical.typed_log(spark, d, MONEY_KINDS)
    return joins.event_to_balance(log, balances(spark, d)).select(
        "seq", "aggregate_id", "kind", "money", "owner", "final_balance"
    )


def anti_unknown_account(spark: SparkSession, d: str) -> DataFrame:
    log = canonical.typed_log(spark, d, MONEY_KINDS)
    return joins.unknown_account(log, known_accounts(spark, d)).select(
        "seq", "aggregate_id", "kind", "money"
    )


def join_failed_to_transaction(spark: SparkSession, d: str) -> DataFrame:
    return joins.failed_to_transaction(transaction_log(spark, d), transaction_states(spark, d))


def join_withdraw_leg(spark: SparkSession, d: str) -> DataFrame:
    tx = joins.leg_account(transaction_states(spark, d).drop("status"), account_states(spark, d), "from_id")
    return tx.select("id", "from_id", "money", "owner", "status")


def join_deposit_leg(spark: SparkSession, d: str) -> DataFrame:
    tx = joins.leg_account(transaction_states(spark, d).drop("status"), account_states(spark, d), "to_id")
    return tx.select("id", "to_id", "money", "owner", "status")


def anti_idempotency_key(spark: SparkSession, d: str) -> DataFrame:
    raw = canonical.raw_log(spark, d).select("seq", "kind", "idempotency_key")
    stored = raw.where(F.col("kind") == "MoneyWithdrawn")
    return joins.new_keys(canonical.redelivered(raw), stored)


def semi_account_exists(spark: SparkSession, d: str) -> DataFrame:
    requests = transfer_requests(spark, d).where("to_id IS NOT NULL").select("seq", "to_id")
    known = known_accounts(spark, d)
    found = joins.existing_accounts(requests, known, "to_id").withColumn("found", F.lit(True))
    lost = joins.missing_accounts(requests, known, "to_id").withColumn("found", F.lit(False))
    return found.unionByName(lost)


def reconcile_write_vs_read(spark: SparkSession, d: str) -> DataFrame:
    return joins.reconcile(account_states(spark, d), balances(spark, d))


def join_events_to_transaction(spark: SparkSession, d: str) -> DataFrame:
    log = canonical.typed_log(spark, d, MONEY_KINDS)
    created = canonical.typed_log(spark, d, ["TransactionCreated"])
    tx = created.select(F.col("aggregate_id").alias("id"), "money", "from_id", "to_id")
    return joins.events_to_transaction(log, tx).select(
        "seq", "tx_id", "kind", "money", "tx_money", "from_id", "to_id"
    )


def join_snapshot_tail(spark: SparkSession, d: str) -> DataFrame:
    return folds.join_snapshot_tail(account_log(spark, d), write_snapshots(spark, d)).select(
        "seq", "aggregate_id", "kind", "snapshot_seq"
    )


# Folds and checks ------------------------------------------------------------------------


def sum_deposits(spark: SparkSession, d: str) -> DataFrame:
    return folds.sum_of(canonical.typed_log(spark, d), "MoneyDeposited", "deposited")


def sum_withdrawals(spark: SparkSession, d: str) -> DataFrame:
    return folds.sum_of(canonical.typed_log(spark, d), "MoneyWithdrawn", "withdrawn")


def max_sequence(spark: SparkSession, d: str) -> DataFrame:
    return folds.max_sequence(balances(spark, d))


def aggregate_version(spark: SparkSession, d: str) -> DataFrame:
    return folds.last_versions(versioned_log(spark, d))


def snapshot_states(spark: SparkSession, d: str) -> DataFrame:
    return folds.snapshot_states(account_log(spark, d))


def fold_from_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """From the stored states of all accounts at a position; of the log only what is behind it."""
    path, width = stored_ranges(spark, d)
    states, last = stored_states(spark, d)
    tail = files.read_ranges(spark, path, RANGED, width, last)
    return folds.fold_from_states(spark.read.parquet(states), tail)


def fold_from_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """From the newest snapshot of each account, which not all have."""
    return folds.fold_from_snapshot(account_log(spark, d), write_snapshots(spark, d))


def check_version_unique(spark: SparkSession, d: str) -> DataFrame:
    return checks.duplicate_versions(canonical.redelivered(versioned_log(spark, d)))


def check_idempotency_unique(spark: SparkSession, d: str) -> DataFrame:
    raw = canonical.raw_log(spark, d).select("seq", "idempotency_key")
    return checks.duplicate_keys(canonical.redelivered(raw))


def count_tx_by_status(spark: SparkSession, d: str) -> DataFrame:
    settled = outcomes(spark, d).withColumnRenamed("reason", "failure_reason")
    return checks.transactions_by_status(settled)


def check_snapshot_fk(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots against a log that lost its withdrawals."""
    snapshots = write_snapshots(spark, d)
    kept = [k for k in ACCOUNT_KINDS if k != "MoneyWithdrawn"]
    log = canonical.raw_log(spark, d, kept).select("id")
    return checks.orphan_snapshots(snapshots, log).select("id", "aggregate_id", "aggregate_version")


def assign_versions(spark: SparkSession, d: str) -> DataFrame:
    return versioned_log(spark, d).select("seq", "aggregate_id", "aggregate_version")


def balance_history(spark: SparkSession, d: str) -> DataFrame:
    return folds.account_history(account_log(spark, d)).select(
        "seq", "aggregate_id", "aggregate_version", "balance"
    )


def owner_history(spark: SparkSession, d: str) -> DataFrame:
    return folds.account_history(account_log(spark, d)).select(
        "seq", "aggregate_id", F.col("owner_now").alias("owner")
    )


def check_version_gaps(spark: SparkSession, d: str) -> DataFrame:
    log = versioned_log(spark, d).where(F.col("kind") != "MoneyWithdrawn")
    return checks.version_gaps(log)


# Lookups and set operations --------------------------------------------------------------


def list_by_owner(spark: SparkSession, d: str) -> DataFrame:
    return views.list_by_owner(balances(spark, d))


def list_by_owner_page(spark: SparkSession, d: str) -> DataFrame:
    return views.list_by_owner(balances(spark, d), LIST_PAGE)


def top1_by_sequence(spark: SparkSession, d: str) -> DataFrame:
    return views.top_by_sequence(balances(spark, d))


def get_balance_by_id(spark: SparkSession, d: str) -> DataFrame:
    return views.by_id(balances(spark, d), POINT_ID)


def get_account_by_id(spark: SparkSession, d: str) -> DataFrame:
    return views.account_by_id(account_log(spark, d), POINT_ID)


def ordered_replay(spark: SparkSession, d: str) -> DataFrame:
    log = account_log(spark, d).select("seq", "aggregate_id", "kind", "money", "owner")
    return views.ordered_replay(log, POINT_ID)


_BODY_COLUMNS = {
    "id": "aggregate_id",
    "TransactionID": "tx_id",
    "from": "from_id",
    "to": "to_id",
}


def union_event_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Seven typed tables, each with the fields of its kind only, as one log."""
    out = None
    for kind, body in EVENT_BODIES.items():
        fields = [F.col(_BODY_COLUMNS.get(f, f)).alias(f) for f in body.names]
        one = canonical.typed_log(spark, d, [kind]).select("seq", "kind", *fields)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def union_history_and_live(spark: SparkSession, d: str) -> DataFrame:
    """History up to a mark, then a live feed that starts before it and repeats rows."""
    log = canonical.typed_log(spark, d).select("seq", "aggregate_id", "kind")
    history, _ = canonical.halves(log)
    mark = log.agg(F.expr("max(seq) div 2").alias("mark"))
    live = filters.above_mark(canonical.redelivered(log), mark).dropDuplicates(["seq"])
    return history.unionByName(live)


# Scalar jobs -----------------------------------------------------------------------------


def quarantine_bad_ids(spark: SparkSession, d: str) -> DataFrame:
    """The log with the ids of some commands cut short."""
    cut = F.when(
        F.expr("seq div 10") % 50 == 0, F.substring("aggregate_id", 2, 40)
    ).otherwise(F.col("aggregate_id"))
    log = canonical.typed_log(spark, d).select("seq", cut.alias("aggregate_id"), "kind")
    return filters.bad_ids(log)


def nil_uuid_to_null(spark: SparkSession, d: str) -> DataFrame:
    requests = transfer_requests(spark, d)
    nil = requests.select(
        "seq", fn.null_to_nil("from_id").alias("from_id"), fn.null_to_nil("to_id").alias("to_id")
    )
    return nil.select(
        "seq",
        "from_id",
        "to_id",
        fn.nil_to_null("from_id").alias("origin"),
        fn.nil_to_null("to_id").alias("destination"),
    )


def idempotency_key(spark: SparkSession, d: str) -> DataFrame:
    steps = ("withdraw", "deposit", "rollback")
    return transfer_requests(spark, d).select(
        "seq", *[fn.idempotency_key("tx_id", s).alias(f"{s}_key") for s in steps]
    )


def failure_reason(spark: SparkSession, d: str) -> DataFrame:
    status = F.col("status")
    return mixed_accounts(spark, d).select(
        "account_id",
        F.when(status == OPEN, fn.failure_reason("From"))
        .otherwise(fn.disabled_reason("From", status))
        .alias("withdraw_reason"),
        F.when(status != OPEN, fn.disabled_reason("To", status)).alias("deposit_reason"),
    )


def decode_event_body(spark: SparkSession, d: str) -> DataFrame:
    raw = canonical.raw_log(spark, d).select("seq", "kind", "body")
    return fn.decode_body(raw).drop("body")


def encode_event_body(spark: SparkSession, d: str) -> DataFrame:
    return canonical.raw_log(spark, d).select("seq", "kind", "body")


def signed_money(spark: SparkSession, d: str) -> DataFrame:
    return canonical.typed_log(spark, d).select("seq", fn.signed_money().alias("amount"))


# Settlement ------------------------------------------------------------------------------


def settle_withdrawals(spark: SparkSession, d: str) -> DataFrame:
    return settlement.withdrawals(outcomes(spark, d))


def settle_deposits(spark: SparkSession, d: str) -> DataFrame:
    return settlement.deposits(outcomes(spark, d))


def complete_transactions(spark: SparkSession, d: str) -> DataFrame:
    return settlement.completions(outcomes(spark, d)).select("seq", "aggregate_id", "kind")


def fail_transactions(spark: SparkSession, d: str) -> DataFrame:
    return settlement.failures(outcomes(spark, d)).select(
        "seq", "aggregate_id", "kind", "rollback", "reason", "idempotency_key"
    )


def refund_rollbacks(spark: SparkSession, d: str) -> DataFrame:
    """Refunds of failures that are delivered more than once, some already refunded."""
    settled = outcomes(spark, d)
    failed = canonical.redelivered(settlement.failures(settled).select("seq", "tx_id", "rollback"))
    tx = settled.select(
        fn.transaction_uuid("seq").alias("id"),
        "seq",
        "money",
        fn.account_uuid("from_id").alias("from_id"),
    )
    stored = tx.where(F.col("seq") % 3 == 0).select(
        fn.idempotency_key("id", "rollback").alias("idempotency_key")
    )
    return settlement.refunds(failed, tx, stored)


def settle_transfers(spark: SparkSession, d: str) -> DataFrame:
    return outcomes(spark, d)


def settle_in_parts(spark: SparkSession, d: str) -> DataFrame:
    """The same with limits that small tables reach: accounts folded in parts, rounds that
    fold only some accounts, and groups of accounts run in turns."""
    return settlement.settle(
        canonical.transfers(spark, d), mixed_accounts(spark, d), width=500, split_legs=40, max_dirty=200, slice_width=50
    )


def classify_transfers(spark: SparkSession, d: str) -> DataFrame:
    return settlement.classify_transfers(canonical.transfers(spark, d)).select("seq", "type", "money")


def create_accounts(spark: SparkSession, d: str) -> DataFrame:
    """Account commands as ``AccountCreated`` events at version 1."""
    created = canonical.typed_log(spark, d, ["AccountCreated"])
    return scans.assign_versions(created.select("seq", "aggregate_id", "kind", "owner", "money")).withColumn(
        "status", F.lit(OPEN)
    )


def update_owner(spark: SparkSession, d: str) -> DataFrame:
    """Renames appended after all other events of their account."""
    before = scans.assign_versions(
        canonical.typed_log(spark, d, PROJECTED_KINDS).select("seq", "aggregate_id")
    )
    renames = canonical.typed_log(spark, d, ["OwnerUpdated"]).select("seq", "aggregate_id", "owner")
    return scans.assign_versions(renames, folds.last_versions(before))


def replay_idempotent(spark: SparkSession, d: str) -> DataFrame:
    """Settlement of a feed with repeats, run twice: the second run finds nothing new."""
    key = fn.idempotency_key(fn.transaction_uuid("seq"), "withdraw").alias("idempotency_key")
    feed = canonical.redelivered(canonical.transfers(spark, d))
    keyed = feed.select("*", key)
    accounts = mixed_accounts(spark, d)
    nothing = spark.createDataFrame([], T.StructType([T.StructField("idempotency_key", T.StringType())]))
    first = settlement.settle(joins.new_keys(keyed, nothing).drop("idempotency_key"), accounts)
    first = saved(first, shared_dir(spark, "first-run"))
    again = joins.new_keys(keyed, first.select(key)).drop("idempotency_key")
    return first.unionByName(settlement.settle(again, accounts))


def stuck_transfers(spark: SparkSession, d: str) -> DataFrame:
    return settlement.stuck_transfers(outcomes(spark, d))


def conserve_money(spark: SparkSession, d: str) -> DataFrame:
    settled = saved(outcomes(spark, d), shared_dir(spark, "outcomes"))
    held = settlement.settled_balances(settled, mixed_accounts(spark, d))
    return settlement.conserve_money(settled, held)


# The whole way ---------------------------------------------------------------------------


def settled_rows(spark: SparkSession, d: str) -> DataFrame:
    """Commands settled, and their events appended to a stored log with their keys."""
    emitted = settlement.emitted_events(outcomes(spark, d))
    opened = canonical.typed_log(spark, d, ["AccountCreated"])
    rows = canonical.log_rows(opened.unionByName(emitted, allowMissingColumns=True))
    path = shared_dir(spark, "settled-log")
    versioned = sinks.versioned_events(rows, None)
    kept = versioned.withColumn("aggregate_version", F.col("aggregate_version").cast("int"))
    kept.select(*event_log_schema().names).write.parquet(path)
    return files.read_event_log(spark, path)


def settled_log(spark: SparkSession, d: str) -> DataFrame:
    """The log of ``settled_rows``, decoded again."""
    return fn.decode_body(settled_rows(spark, d)).drop("id")


def end_to_end_keys(spark: SparkSession, d: str) -> DataFrame:
    """The events of the settled log that carry an idempotency key."""
    keyed = settled_rows(spark, d).where(F.col("idempotency_key") > "")
    return keyed.select("idempotency_key", "kind", "aggregate_id")


def end_to_end_balances(spark: SparkSession, d: str) -> DataFrame:
    """Balances that the read model shows after all commands were settled."""
    return folds.fold_balance_projection(settled_log(spark, d)).select("id", "balance", "owner")


def end_to_end_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """For each account, both models of the settled log and whether they agree."""
    log = saved(settled_log(spark, d), shared_dir(spark, "decoded"))
    write_side = folds.fold_account_state(log)
    read_side = saved(folds.fold_balance_projection(log), shared_dir(spark, "read-side"))
    differs = joins.reconcile(write_side, read_side).select("id", F.lit(True).alias("differs"))
    return read_side.select("id", F.col("balance").alias("read_balance")).join(differs, "id", "left").select(
        "id", "read_balance", F.coalesce("differs", F.lit(False)).alias("differs")
    )


# User-defined kinds and folds ------------------------------------------------------------


def decode_custom_kind(spark: SparkSession, d: str) -> DataFrame:
    """A log with a kind of the user's own, decoded next to the built-in kinds."""
    limit = T.StructType([T.StructField("limit", T.LongType())])
    registry = fn.register_kind(canonical.UNKNOWN_KIND, limit)
    body = F.when(
        F.col("kind") == canonical.UNKNOWN_KIND, F.to_json(F.struct(F.col("money").alias("limit")))
    ).otherwise(F.coalesce(fn.encode_body(canonical.body_fields()), F.lit("{}")))
    raw = canonical.typed_log(spark, d).select("seq", "kind", body.alias("body"))
    return fn.decode_body(raw, registry).select("seq", "kind", "limit", "owner")


def fold_custom(spark: SparkSession, d: str) -> DataFrame:
    log = account_log(spark, d)
    one = F.lit(1).cast("long")
    return folds.fold_custom(
        log,
        "aggregate_id",
        sums={
            "turnover": {"MoneyDeposited": F.col("money"), "MoneyWithdrawn": F.col("money")},
            "renames": {"OwnerUpdated": one},
        },
        latest={
            "last_movement": {"MoneyDeposited": F.col("money"), "MoneyWithdrawn": -F.col("money")}
        },
    )


def covered_balance(state: dict, events: pd.DataFrame) -> None:
    """A handler that depends on order: withdrawals that the balance does not cover change nothing."""
    balance, refused = state.get("balance", 0), state.get("refused", 0)
    for amount in events["amount"].tolist():
        if amount < 0 and balance + amount < 0:
            refused += 1
        else:
            balance += amount
    state.update(balance=balance, refused=refused)


def fold_ordered(spark: SparkSession, d: str) -> DataFrame:
    """Balances of accounts that reject overdrafts, event by event."""
    log = canonical.typed_log(spark, d, MONEY_KINDS).select("seq", "aggregate_id", fn.signed_money().alias("amount"))
    return folds.fold_ordered(log, "aggregate_id", covered_balance, "balance long, refused long")


QUERIES = {
    f.__name__: f
    for f in (
        scan_event_log,
        read_account_commands,
        read_transfer_commands,
        scan_balances,
        append_events,
        create_if_new,
        publish_partitioned,
        row_to_json_notify,
        index_balance_full,
        update_balance_partial,
        upsert_resume_token,
        write_snapshots,
        filter_aggregate_kind,
        filter_event_kind,
        filter_high_water_mark,
        filter_rollback_needed,
        filter_optional_leg,
        route_unknown_kinds,
        filter_pending_only,
        filter_open_accounts,
        filter_sufficient_funds,
        filter_by_label,
        filter_by_containment,
        project_account_view,
        project_search_hits,
        project_transaction_view,
        project_saga_legs,
        join_event_to_balance,
        anti_unknown_account,
        join_failed_to_transaction,
        join_withdraw_leg,
        join_deposit_leg,
        anti_idempotency_key,
        semi_account_exists,
        reconcile_write_vs_read,
        join_events_to_transaction,
        join_snapshot_tail,
        sum_deposits,
        sum_withdrawals,
        max_sequence,
        aggregate_version,
        snapshot_states,
        fold_from_snapshot,
        fold_from_snapshots,
        fold_ordered,
        check_version_unique,
        check_idempotency_unique,
        count_tx_by_status,
        check_snapshot_fk,
        assign_versions,
        balance_history,
        owner_history,
        check_version_gaps,
        list_by_owner,
        list_by_owner_page,
        top1_by_sequence,
        get_balance_by_id,
        get_account_by_id,
        ordered_replay,
        union_event_kinds,
        union_history_and_live,
        quarantine_bad_ids,
        nil_uuid_to_null,
        idempotency_key,
        failure_reason,
        decode_event_body,
        encode_event_body,
        signed_money,
        settle_withdrawals,
        settle_deposits,
        complete_transactions,
        fail_transactions,
        refund_rollbacks,
        settle_transfers,
        settle_in_parts,
        classify_transfers,
        create_accounts,
        update_owner,
        replay_idempotent,
        store_transactions,
        store_balances,
        store_resume_tokens,
        end_to_end_balances,
        end_to_end_keys,
        end_to_end_reconcile,
        stuck_transfers,
        conserve_money,
        decode_custom_kind,
        fold_custom,
    )
} | {
    "fold_account_state": account_states,
    "fold_transaction_state": transaction_states,
    "fold_balance_projection": balances,
}
