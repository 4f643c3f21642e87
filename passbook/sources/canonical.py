"""A ledger derived from the ``events`` and ``customer`` tables.

Every customer is an account. ``view`` is a deposit, ``purchase`` a withdrawal,
``click`` a transfer to account ``k``; ``error`` is a transfer to an account that
does not exist (``k < 50``) or an event of an unregistered kind, and ``signup``
renames the owner. Accounts that do not exist have the negative keys ``-1 - k``. ``seq`` of a command is its ``event_id``; the event in slot s
of a command sits at log position ``seq * 10 + s``.

``typed_log`` takes every command as accepted, whatever the balance: it is the
input for decoding, folds, joins and checks. To give those something to find, a
transfer to an unknown account ends in ``TransactionFailed`` (rollback for even
k), and a transfer with ``k % 10 = 3`` gets a second terminal event of the other
kind. Real outcomes come from ``operators.settlement``.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passbook.functions.codec import encode_body
from passbook.functions.ids import account_uuid, idempotency_key, transaction_uuid
from passbook.operators.filters import table
from passbook.schema import (
    ACCOUNT,
    CLOSED,
    FROZEN,
    OPEN,
    TRANSACTION,
)
from passbook.sources.files import stream_table

# Fixed values of the mapping.
SLOTS = 10
UNKNOWN_KIND = "LimitRaised"
OPENED_AT = "2024-01-01 00:00:00"

_TX_TYPES = ("view", "purchase", "click", "error")


def accounts(spark: SparkSession, sf_dir: str, mixed_status: bool = False) -> DataFrame:
    """account_id, owner, status; ``mixed_status`` freezes and closes some accounts."""
    c = table(spark, sf_dir, "customer")
    status = F.lit(OPEN)
    if mixed_status:
        key = F.col("c_custkey")
        status = (
            F.when(key % 37 == 5, F.lit(FROZEN)).when(key % 41 == 7, F.lit(CLOSED)).otherwise(OPEN)
        )
    return c.select(
        F.col("c_custkey").alias("account_id"), F.col("c_name").alias("owner"), status.alias("status")
    )


def commands(events: DataFrame) -> DataFrame:
    """The ``events`` table (batch or stream) as commands with integer money."""
    return events.select(
        F.col("event_id").alias("seq"),
        F.col("user_id"),
        F.col("event_type"),
        F.round(F.col("value") * 100).cast("long").alias("money"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.col("ts").alias("created_at"),
    )


def _is_transfer() -> Column:
    return F.col("event_type").isin("view", "purchase", "click") | (
        (F.col("event_type") == "error") & (F.col("k") < 50)
    )


def _origin() -> Column:
    return F.when(F.col("event_type").isin("purchase", "click", "error"), F.col("user_id"))


def _destination() -> Column:
    kind = F.col("event_type")
    return (
        F.when(kind == "view", F.col("user_id"))
        .when(kind == "click", F.col("k"))
        .when(kind == "error", -1 - F.col("k"))
    )


def transfers_of(events: DataFrame) -> DataFrame:
    """seq, from_id, to_id, money of every transfer command; ids are numbers."""
    return (
        commands(events.where(F.col("event_type").isin(*_TX_TYPES)))
        .where(_is_transfer())
        .select("seq", _origin().alias("from_id"), _destination().alias("to_id"), "money")
    )


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transfers_of(table(spark, sf_dir, "events"))


def _slot_rows() -> list[tuple[str, str, int, Column, Column, dict[str, Column]]]:
    """(kind, aggregate kind, slot, applies, aggregate id, fields) of each emitted event."""
    tx = transaction_uuid("seq")
    origin, dest = account_uuid("f"), account_uuid("o")
    failed = F.col("event_type") == "error"
    late = F.col("is_tx") & (F.col("k") % 10 == 3)
    fail_fields = {
        "tx_id": tx,
        "rollback": F.col("k") % 2 == 0,
        "reason": F.lit("To account: unknown"),
    }
    late_fail = {"tx_id": tx, "rollback": F.lit(False), "reason": F.lit("late")}
    money = {"money": F.col("money"), "tx_id": tx}
    return [
        (
            "TransactionCreated",
            TRANSACTION,
            0,
            F.col("is_tx"),
            tx,
            {"money": F.col("money"), "tx_id": tx, "from_id": origin, "to_id": dest},
        ),
        ("MoneyWithdrawn", ACCOUNT, 1, F.col("f").isNotNull(), origin, money),
        ("MoneyDeposited", ACCOUNT, 2, F.col("o").isNotNull(), dest, money),
        ("TransactionSucceeded", TRANSACTION, 3, F.col("is_tx") & ~failed, tx, {"tx_id": tx}),
        ("TransactionFailed", TRANSACTION, 3, F.col("is_tx") & failed, tx, fail_fields),
        ("TransactionSucceeded", TRANSACTION, 4, late & failed, tx, {"tx_id": tx}),
        ("TransactionFailed", TRANSACTION, 4, late & ~failed, tx, late_fail),
        (
            "OwnerUpdated",
            ACCOUNT,
            0,
            F.col("event_type") == "signup",
            account_uuid("user_id"),
            {
                "owner": F.concat(
                    F.lit("Customer#"),
                    F.lpad(F.col("user_id").cast("string"), 9, "0"),
                    F.lit("/"),
                    F.col("seq").cast("string"),
                )
            },
        ),
        (
            UNKNOWN_KIND,
            ACCOUNT,
            0,
            (F.col("event_type") == "error") & ~F.col("is_tx"),
            account_uuid("user_id"),
            {"money": F.col("k")},
        ),
    ]


_TYPES = {
    "money": "long",
    "owner": "string",
    "tx_id": "string",
    "from_id": "string",
    "to_id": "string",
    "rollback": "boolean",
    "reason": "string",
}

# Command types that can emit each kind, to push the choice of kinds to the scan.
_SOURCES = {
    "TransactionCreated": _TX_TYPES,
    "MoneyWithdrawn": ("purchase", "click", "error"),
    "MoneyDeposited": ("view", "click", "error"),
    "TransactionSucceeded": _TX_TYPES,
    "TransactionFailed": _TX_TYPES,
    "OwnerUpdated": ("signup",),
    UNKNOWN_KIND: ("error",),
}


def typed_events(events: DataFrame, kinds: Collection[str] | None = None) -> DataFrame:
    """Events emitted by the commands of ``events``; one scan, one generate."""
    rows = [r for r in _slot_rows() if kinds is None or r[0] in kinds]
    if kinds is not None:
        types = sorted({t for r in rows for t in _SOURCES[r[0]]})
        events = events.where(F.col("event_type").isin(*types))
    cmd = commands(events).withColumn("is_tx", _is_transfer())
    cmd = cmd.withColumn("f", F.when(F.col("is_tx"), _origin()))
    cmd = cmd.withColumn("o", F.when(F.col("is_tx"), _destination()))
    # Only the numbers of the emitted events are exploded; their columns come after, so
    # that unused ones are never computed.
    emitted = F.array(*[F.when(r[3], F.lit(i)) for i, r in enumerate(rows)])
    out = cmd.select("*", F.explode(emitted).alias("n")).where("n IS NOT NULL")

    def by_event(values: list[Column], dtype: str) -> Column:
        """The value of event n: one branch per distinct value."""
        branches: dict[str, tuple[Column, list[int]]] = {}
        for i, v in enumerate(values):
            branches.setdefault(str(v), (v, []))[1].append(i)
        out = None
        for value, numbers in branches.values():
            hit = F.col("n").isin(numbers)
            out = F.when(hit, value) if out is None else out.when(hit, value)
        return out.cast(dtype)

    null = F.lit(None)
    return out.select(
        (F.col("seq") * SLOTS + by_event([F.lit(r[2]) for r in rows], "int")).alias("seq"),
        by_event([r[4] for r in rows], "string").alias("aggregate_id"),
        by_event([F.lit(r[1]) for r in rows], "string").alias("aggregate_kind"),
        by_event([F.lit(r[0]) for r in rows], "string").alias("kind"),
        *[by_event([r[5].get(n, null) for r in rows], t).alias(n) for n, t in _TYPES.items()],
        "created_at",
    )


def account_openings(customer: DataFrame) -> DataFrame:
    """One ``AccountCreated`` per customer, placed before all commands.

    Customer keys and command positions are not negative, so the position ``-1 - key`` is
    the customer's own and comes before every command.
    """
    fields = {"money": F.lit(0), "owner": F.col("c_name")}
    return customer.select(
        (-1 - F.col("c_custkey")).alias("seq"),
        account_uuid("c_custkey").alias("aggregate_id"),
        F.lit(ACCOUNT).alias("aggregate_kind"),
        F.lit("AccountCreated").alias("kind"),
        *[fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in _TYPES.items()],
        F.lit(OPENED_AT).cast("timestamp_ntz").alias("created_at"),
    )


def typed_log(spark: SparkSession, sf_dir: str, kinds: Collection[str] | None = None) -> DataFrame:
    """The decoded log, all kinds or the given ones."""
    parts = []
    if kinds is None or "AccountCreated" in kinds:
        parts.append(account_openings(table(spark, sf_dir, "customer")))
    if kinds is None or set(kinds) - {"AccountCreated"}:
        parts.append(typed_events(table(spark, sf_dir, "events"), kinds))
    return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0]


def body_fields() -> dict[str, Column]:
    """Body fields that typed events hold under other names."""
    return {
        "id": F.col("aggregate_id"),
        "TransactionID": F.col("tx_id"),
        "from": F.col("from_id"),
        "to": F.col("to_id"),
    }


def log_rows(typed: DataFrame) -> DataFrame:
    """Typed events as raw log rows with JSON body, idempotency key and labels.

    Events that come with their ``idempotency_key`` keep it.
    """
    body = encode_body(body_fields())
    key = (
        F.when(F.col("kind") == "MoneyWithdrawn", idempotency_key("tx_id", "withdraw"))
        .when(F.col("kind") == "MoneyDeposited", idempotency_key("tx_id", "deposit"))
        .otherwise(F.lit(""))
    )
    if "idempotency_key" in typed.columns:
        key = F.coalesce("idempotency_key", F.lit(""))
    return typed.select(
        "seq",
        F.concat(F.lit("ev-"), F.col("seq").cast("string")).alias("id"),
        "aggregate_id",
        "aggregate_kind",
        "kind",
        F.coalesce(body, F.lit("{}")).alias("body"),
        key.alias("idempotency_key"),
        F.to_json(F.struct(F.lower("aggregate_kind").alias("topic"))).alias("labels"),
        "created_at",
    )


def raw_log(spark: SparkSession, sf_dir: str, kinds: Collection[str] | None = None) -> DataFrame:
    return log_rows(typed_log(spark, sf_dir, kinds))


def redelivered(log: DataFrame) -> DataFrame:
    """The log with every row whose position divides by 7 delivered twice."""
    again = log.where(F.pmod(F.col("seq"), F.lit(7)) == 0)
    return log.unionByName(again)


def stream_typed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decoded log as a change feed of both tables."""
    return account_openings(_stream(spark, sf_dir, "customer")).unionByName(
        typed_events(_stream(spark, sf_dir, "events"))
    )


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return stream_table(spark, f"{sf_dir}/{name}.parquet", table(spark, sf_dir, name).schema)


def halves(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The log up to and after half of its highest position."""
    middle = F.expr("max(seq) div 2")
    return (
        log.where(F.col("seq") <= log.agg(middle).scalar()),
        log.where(F.col("seq") > log.agg(middle).scalar()),
    )
