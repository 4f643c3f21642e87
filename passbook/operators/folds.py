"""Replay of events to state: sums and latest values per aggregate.

Sums and maxima of numbers run as hash aggregates with map-side combine. Text
attributes are picked in their own aggregate, over the few rows that set them, so
that money events never take the sort-based path; both sides are hashed on the
same id and join without another exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passbook.functions.money import signed_money
from passbook.operators.scans import WIDTH, Running, running
from passbook.schema import (
    ACCOUNT_KINDS,
    CATCH_UP,
    FAILED,
    OPEN,
    PENDING,
    PROJECTED_KINDS,
    SNAPSHOT_THRESHOLD,
    SUCCEEDED,
    TERMINAL_KINDS,
)
from passbook.session import saved, shared_dir

OWNER_KINDS = ("AccountCreated", "OwnerUpdated")


def fold_account_state(log: DataFrame) -> DataFrame:
    """Write-side accounts: id, owner, balance, status. Only created accounts appear."""
    money = (
        log.where(F.col("kind").isin(*PROJECTED_KINDS))
        .groupBy("aggregate_id")
        .agg(F.sum(signed_money()).alias("balance"))
    )
    owner = (
        log.where(F.col("kind").isin(*OWNER_KINDS))
        .groupBy("aggregate_id")
        .agg(
            F.max_by("owner", "seq").alias("owner"),
            F.max(F.col("kind") == "AccountCreated").alias("created"),
        )
        .where("created")
    )
    return owner.join(money, "aggregate_id").select(
        F.col("aggregate_id").alias("id"), "owner", "balance", F.lit(OPEN).alias("status")
    )


def fold_transaction_state(log: DataFrame) -> DataFrame:
    """Transactions: last status wins, success clears the reason."""
    created = log.where(F.col("kind") == "TransactionCreated").select(
        F.col("aggregate_id").alias("id"), "money", "from_id", "to_id"
    )
    ended = (
        log.where(F.col("kind").isin(*TERMINAL_KINDS))
        .groupBy(F.col("aggregate_id").alias("id"))
        .agg(F.max_by(F.struct("kind", "reason"), "seq").alias("end"))
    )
    kind = F.col("end.kind")
    return created.join(ended, "id", "left").select(
        "id",
        "money",
        "from_id",
        "to_id",
        F.when(kind == "TransactionFailed", FAILED)
        .when(kind == "TransactionSucceeded", SUCCEEDED)
        .otherwise(PENDING)
        .alias("status"),
        F.when(kind == "TransactionFailed", F.col("end.reason")).otherwise("").alias("failure_reason"),
    )


def fold_balance_projection(log: DataFrame, token_kind: str = CATCH_UP) -> DataFrame:
    """Read-side documents; ``OwnerUpdated`` neither applies nor moves the sequence."""
    projected = log.where(F.col("kind").isin(*PROJECTED_KINDS))
    sums = projected.groupBy("aggregate_id").agg(
        F.sum(signed_money()).alias("balance"),
        F.max("seq").alias("sequence"),
        F.count("*").alias("version"),
    )
    created = log.where(F.col("kind") == "AccountCreated").select("aggregate_id", "owner")
    return created.join(sums, "aggregate_id").select(
        F.col("aggregate_id").alias("id"),
        "version",
        "sequence",
        F.lit(token_kind).alias("kind"),
        F.lit(OPEN).alias("status"),
        "balance",
        "owner",
    )


def sum_of(log: DataFrame, kind: str, name: str) -> DataFrame:
    return (
        log.where(F.col("kind") == kind)
        .groupBy("aggregate_id")
        .agg(F.sum("money").alias(name), F.count("*").alias("events"))
    )


def max_sequence(balances: DataFrame) -> DataFrame:
    """Highest applied sequence, 0 when nothing was applied."""
    return balances.agg(F.coalesce(F.max("sequence"), F.lit(0)).alias("sequence")).select(
        F.lit(CATCH_UP).alias("kind"), "sequence"
    )


def last_versions(log: DataFrame) -> DataFrame:
    return log.groupBy("aggregate_id").agg(F.max("aggregate_version").alias("last_version"))


def account_history(log: DataFrame, width: int = WIDTH) -> DataFrame:
    """State of the account after each of its events: version, balance, owner."""
    owner = F.when(F.col("kind").isin(*OWNER_KINDS), F.col("owner"))
    return running(
        log.where(F.col("kind").isin(*ACCOUNT_KINDS)).select(
            "aggregate_id", "seq", "kind", "money", "owner"
        ),
        "aggregate_id",
        "seq",
        [
            Running("aggregate_version", F.lit(1)),
            Running("balance", signed_money()),
            Running("owner_now", owner, "last"),
            Running("created", (F.col("kind") == "AccountCreated").cast("int")),
        ],
        width,
    )


def snapshot_states(
    log: DataFrame, every: int = SNAPSHOT_THRESHOLD, width: int = WIDTH
) -> DataFrame:
    """Folded account state at each version that ``every`` divides.

    An account that was never created has no state, so no snapshot either.
    """
    return (
        account_history(log, width)
        .where((F.col("aggregate_version") % every == 0) & (F.col("created") > 0))
        .select("aggregate_id", "seq", "aggregate_version", "balance", F.col("owner_now").alias("owner"))
    )


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("aggregate_id").agg(
        F.max("aggregate_version").alias("aggregate_version"),
        F.max("seq").alias("snapshot_seq"),
        F.max_by("balance", "aggregate_version").alias("balance"),
        F.max_by("owner", "aggregate_version").alias("owner"),
    )


def join_snapshot_tail(log: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Events after the newest snapshot of their aggregate (all, where there is none)."""
    s = latest_snapshots(snapshots).select("aggregate_id", "snapshot_seq")
    # Stored, so that the join shuffles it by itself and can split a busy account.
    s = saved(s, shared_dir(s.sparkSession, "dim"))
    return (
        log.where(F.col("kind").isin(*ACCOUNT_KINDS))
        .join(s, "aggregate_id", "left")
        .where(F.col("snapshot_seq").isNull() | (F.col("seq") > F.col("snapshot_seq")))
    )


def fold_from_snapshot(log: DataFrame, snapshots: DataFrame, width: int = WIDTH) -> DataFrame:
    """Account state from the newest snapshot and the events after it.

    Events are first summed per account and range of positions, before any shuffle by
    account, so a busy account enters the join with its snapshot as one row per range.
    Only the range that a snapshot falls into is looked at event by event, keyed by
    account and range.
    """
    events = log.where(F.col("kind").isin(*ACCOUNT_KINDS)).select(
        "aggregate_id",
        "seq",
        F.expr(f"seq div {width}").alias("range"),
        signed_money().alias("amount"),
        F.when(F.col("kind").isin(*OWNER_KINDS), F.col("owner")).alias("owner"),
        F.when(F.col("kind").isin(*OWNER_KINDS), F.col("seq")).alias("owner_seq"),
        (F.col("kind") == "AccountCreated").alias("created"),
    )
    latest = latest_snapshots(snapshots).withColumn("at", F.expr(f"snapshot_seq div {width}"))
    mark = latest.select("aggregate_id", "at", "snapshot_seq")
    state = [
        F.sum("amount").alias("amount"),
        F.max_by("owner", "owner_seq").alias("owner"),
        F.max("owner_seq").alias("owner_seq"),
        F.max("created").alias("created"),
    ]
    columns = ("aggregate_id", "amount", "owner", "owner_seq", "created")
    later = (
        events.groupBy("aggregate_id", "range")
        .agg(*state)
        .join(mark, "aggregate_id", "left")
        .where(F.col("at").isNull() | (F.col("range") > F.col("at")))
    )
    edge = events.join(mark.withColumnRenamed("at", "range"), ["aggregate_id", "range"]).where(
        F.col("seq") > F.col("snapshot_seq")
    )
    base = latest.select(
        "aggregate_id",
        F.col("balance").alias("amount"),
        "owner",
        F.col("snapshot_seq").alias("owner_seq"),
        F.lit(True).alias("created"),
    )
    parts = later.select(*columns).unionByName(edge.select(*columns)).unionByName(base)
    return (
        parts.groupBy(F.col("aggregate_id").alias("id"))
        .agg(*state)
        .where("created")
        .select("id", "owner", F.col("amount").alias("balance"), F.lit(OPEN).alias("status"))
    )


def states_at(log: DataFrame, position: int) -> DataFrame:
    """The state of every account after the events up to ``position``, to fold on from."""
    return _account_parts(log.where(F.col("seq") <= position))


def _account_parts(log: DataFrame) -> DataFrame:
    """aggregate_id, amount, owner, owner_seq, created: what adds up to an account's state."""
    money = log.where(F.col("kind").isin(*PROJECTED_KINDS)).groupBy("aggregate_id").agg(
        F.sum(signed_money()).alias("amount")
    )
    owner = log.where(F.col("kind").isin(*OWNER_KINDS)).groupBy("aggregate_id").agg(
        F.max_by("owner", "seq").alias("owner"),
        F.max("seq").alias("owner_seq"),
        F.max(F.col("kind") == "AccountCreated").alias("created"),
    )
    return money.join(owner, "aggregate_id", "full").select(
        "aggregate_id",
        F.coalesce("amount", F.lit(0)).alias("amount"),
        "owner",
        "owner_seq",
        F.coalesce("created", F.lit(False)).alias("created"),
    )


def fold_from_states(states: DataFrame, tail: DataFrame) -> DataFrame:
    """Account state from ``states_at`` a position and the events after it, ``tail``: with a log
    in ranges of positions, all before it is neither read nor summed again."""
    parts = states.unionByName(_account_parts(tail))
    return (
        parts.groupBy(F.col("aggregate_id").alias("id"))
        .agg(
            F.max_by("owner", "owner_seq").alias("owner"),
            F.sum("amount").alias("balance"),
            F.max("created").alias("created"),
        )
        .where("created")
        .select("id", "owner", "balance", F.lit(OPEN).alias("status"))
    )


def fold_ordered(
    log: DataFrame,
    key: str,
    handler: Callable[[dict, pd.DataFrame], None],
    schema: str,
    order: str = "seq",
) -> DataFrame:
    """User-defined fold that depends on order: a row of ``schema`` for each value of ``key``.

    ``handler(state, events)`` changes the state, an empty dictionary at first, by the next
    events of one key, in order; when the key ends, the state's values are its row. Events come
    in Arrow batches of a sorted partition, so a key with many of them is worked off piece by
    piece, by one task, as the order demands; no group is collected.
    """
    kept = T.StructType([log.schema[key], *T.StructType.fromDDL(schema).fields])
    names = kept.names[1:]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def ended(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame([(k, *(state.get(n) for n in names)) for k, state in rows], columns=kept.names)

        now, state = None, None
        for batch in batches:
            done = []
            for value, events in batch.groupby(key, sort=False, dropna=False):
                if state is None or value != now:
                    if state is not None:
                        done.append((now, state))
                    now, state = value, {}
                handler(state, events)
            yield ended(done)
        if state is not None:
            yield ended([(now, state)])

    sorted_ = log.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, order)
    return sorted_.mapInPandas(fold, kept)


def fold_custom(
    log: DataFrame,
    key: str,
    sums: Mapping[str, Mapping[str, Column]] | None = None,
    latest: Mapping[str, Mapping[str, Column]] | None = None,
    order: str = "seq",
) -> DataFrame:
    """User-defined fold: per output column, a handler column for each event kind.

    ``sums`` adds its handlers up; ``latest`` keeps the newest handled value. Both
    combine map-side, so no group is ever collected.
    """

    def handled(handlers: Mapping[str, Column]) -> Column:
        out = None
        for kind, value in handlers.items():
            hit = F.col("kind") == kind
            out = F.when(hit, value) if out is None else out.when(hit, value)
        return out

    aggs = []
    for name, handlers in (sums or {}).items():
        aggs.append(F.coalesce(F.sum(handled(handlers)), F.lit(0)).alias(name))
    for name, handlers in (latest or {}).items():
        at = F.when(F.col("kind").isin(*handlers), F.col(order))
        aggs.append(F.max_by(handled(handlers), at).alias(name))
    kinds = {k for m in (*(sums or {}).values(), *(latest or {}).values()) for k in m}
    return log.where(F.col("kind").isin(*sorted(kinds))).groupBy(key).agg(*aggs)
