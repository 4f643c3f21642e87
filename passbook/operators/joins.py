"""Joins of events, transactions, accounts and balances. All are equi joins on an id.

One side of each is unique on the key. A key that holds a large share of the other
side is split at run time (``spark.sql.adaptive.skewJoin``). Spark does so only where
both inputs come straight from a shuffle, so a folded side is stored first: joined as
it is, its aggregate would take the join's place behind the shuffle. Rows without a
key are kept out of the exchange or spread by ``spread_nulls``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passbook.operators.bloom import MOST_KEYS, only_met
from passbook.schema import MONEY_KINDS
from passbook.session import saved, shared_dir

SPREAD = 1024


def stored(dim: DataFrame) -> DataFrame:
    """The table written and read again, so that the join shuffles it by itself."""
    return saved(dim, shared_dir(dim.sparkSession, "dim"))


def money_events(log: DataFrame) -> DataFrame:
    return log.where(F.col("kind").isin(*MONEY_KINDS))


def spread_nulls(key: str, by: str) -> Column:
    """Second join key that scatters rows with a null key; 0 for all others."""
    return F.when(F.col(key).isNull(), F.pmod(F.xxhash64(by), F.lit(SPREAD))).otherwise(
        F.lit(0).cast("long")
    )


def lookup(facts: DataFrame, key: str, by: str, dim: DataFrame, dim_key: str) -> DataFrame:
    """Left join to a table unique on ``dim_key``, safe for many null keys."""
    left = facts.withColumn("__spread", spread_nulls(key, by))
    right = dim.withColumn("__zero", F.lit(0).cast("long"))
    on = (F.col(key) == F.col(dim_key)) & (F.col("__spread") == F.col("__zero"))
    return left.join(right, on, "left").drop("__spread", "__zero", dim_key)


def event_to_balance(log: DataFrame, balances: DataFrame) -> DataFrame:
    """Each money event with the account document it applies to (null when unknown)."""
    docs = balances.select(
        F.col("id").alias("aggregate_id"), "owner", F.col("balance").alias("final_balance")
    )
    return money_events(log).drop("owner").join(stored(docs), "aggregate_id", "left")


def unknown_account(log: DataFrame, accounts: DataFrame) -> DataFrame:
    """Money events of accounts that do not exist, for the quarantine table."""
    return money_events(log).join(
        accounts.select(F.col("id").alias("aggregate_id")), "aggregate_id", "left_anti"
    )


def failed_to_transaction(log: DataFrame, transactions: DataFrame) -> DataFrame:
    """Failures with the transaction that tells whom to refund."""
    failed = log.where(F.col("kind") == "TransactionFailed").select(
        "seq", "tx_id", "rollback", "reason"
    )
    tx = transactions.select(F.col("id").alias("tx_id"), "money", "from_id", "to_id")
    return failed.join(tx, "tx_id")


def leg_account(transactions: DataFrame, accounts: DataFrame, side: str) -> DataFrame:
    """Transactions with the account on one side (``from_id`` or ``to_id``)."""
    acc = accounts.select(F.col("id").alias(side), "owner", "status")
    legs = stored(transactions.where(F.col(side).isNotNull()))
    return legs.join(stored(acc), side, "left")


def new_keys(log: DataFrame, stored: DataFrame, most_keys: int = MOST_KEYS) -> DataFrame:
    """Rows whose idempotency key is neither stored nor repeated before in the batch.

    Rows without a key always pass. Of a repeated key the first row stays. Stored keys are
    shuffled only as far as a Bloom filter of the batch's keys lets them pass, so the shuffle
    does not grow with what is stored.
    """
    keyed = log.where(F.col("idempotency_key") > "").select("idempotency_key")
    keyed = saved(keyed, shared_dir(log.sparkSession, "keys"))  # counted and read once more
    stored = only_met(stored.select("idempotency_key"), keyed, "idempotency_key", most_keys)
    rest = [c for c in log.columns if c not in ("idempotency_key", "seq")]
    # Repeats are combined before the shuffle, so a key with many copies is one row in it.
    first = (
        log.where(F.col("idempotency_key") > "")
        .groupBy("idempotency_key")
        .agg(F.min(F.struct("seq", *rest)).alias("row"))
        .join(stored.select("idempotency_key"), "idempotency_key", "left_anti")
        .select("idempotency_key", "row.*")
        .select(*log.columns)
    )
    free = log.where(F.col("idempotency_key").isNull() | (F.col("idempotency_key") <= ""))
    return first.unionByName(free)


def existing_accounts(requests: DataFrame, accounts: DataFrame, key: str) -> DataFrame:
    return requests.join(accounts.select(F.col("id").alias(key)), key, "left_semi")


def missing_accounts(requests: DataFrame, accounts: DataFrame, key: str) -> DataFrame:
    return requests.join(accounts.select(F.col("id").alias(key)), key, "left_anti")


def reconcile(write_side: DataFrame, read_side: DataFrame) -> DataFrame:
    """Accounts on which the two models differ, or that only one of them has."""
    w = write_side.select(
        "id",
        F.col("owner").alias("write_owner"),
        F.col("balance").alias("write_balance"),
        F.lit(1).alias("__w"),
    )
    r = read_side.select(
        "id",
        F.col("owner").alias("read_owner"),
        F.col("balance").alias("read_balance"),
        F.lit(1).alias("__r"),
    )
    same = (
        F.col("write_owner").eqNullSafe(F.col("read_owner"))
        & F.col("write_balance").eqNullSafe(F.col("read_balance"))
        & F.col("__w").isNotNull()
        & F.col("__r").isNotNull()
    )
    return w.join(r, "id", "full_outer").where(~same).drop("__w", "__r")


def events_to_transaction(log: DataFrame, transactions: DataFrame) -> DataFrame:
    """Money events with the transfer that caused them."""
    tx = transactions.select(
        F.col("id").alias("tx_id"), F.col("money").alias("tx_money"), "from_id", "to_id"
    )
    return money_events(log).drop("from_id", "to_id").join(tx, "tx_id", "left")
