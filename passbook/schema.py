"""Schemas of the event log and of the tables folded from it."""

from __future__ import annotations

from pyspark.sql import types as T

# Identifiers, enumerations and reason texts of the data model.
NIL_UUID = "00000000-0000-0000-0000-000000000000"
ACCOUNT, TRANSACTION = "Account", "Transaction"
OPEN, CLOSED, FROZEN = "OPEN", "CLOSED", "FROZEN"
PENDING, FAILED, SUCCEEDED = "PENDING", "FAILED", "SUCCEEDED"
CATCH_UP = "CatchUp"
NOT_ENOUGH_FUNDS = "not enough funds"
TRANSACTIONS_DISABLED = "transactions disabled"
WITHDRAW, DEPOSIT, ROLLBACK = "withdraw", "deposit", "rollback"
SNAPSHOT_THRESHOLD = 50
LIST_PAGE = 10

ACCOUNT_KINDS = ("AccountCreated", "MoneyWithdrawn", "MoneyDeposited", "OwnerUpdated")
MONEY_KINDS = ("MoneyWithdrawn", "MoneyDeposited")
PROJECTED_KINDS = ("AccountCreated", "MoneyWithdrawn", "MoneyDeposited")
TERMINAL_KINDS = ("TransactionFailed", "TransactionSucceeded")
TRANSACTION_KINDS = ("TransactionCreated",) + TERMINAL_KINDS
REACTOR_KINDS = ("TransactionCreated", "TransactionFailed")



def event_log_schema() -> T.StructType:
    return T.StructType(
        [
            T.StructField("seq", T.LongType(), False),
            T.StructField("id", T.StringType(), False),
            T.StructField("aggregate_id", T.StringType(), False),
            T.StructField("aggregate_version", T.IntegerType(), False),
            T.StructField("aggregate_kind", T.StringType(), False),
            T.StructField("kind", T.StringType(), False),
            T.StructField("body", T.StringType(), False),
            T.StructField("idempotency_key", T.StringType(), True),
            T.StructField("labels", T.StringType(), False),
            T.StructField("created_at", T.TimestampNTZType(), False),
        ]
    )


def _fields(*pairs: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in pairs])


_S, _L, _B = T.StringType(), T.LongType(), T.BooleanType()

# Body fields of each event kind, by their JSON names.
EVENT_BODIES: dict[str, T.StructType] = {
    "AccountCreated": _fields(("id", _S), ("money", _L), ("owner", _S)),
    "MoneyWithdrawn": _fields(("money", _L), ("TransactionID", _S)),
    "MoneyDeposited": _fields(("money", _L), ("TransactionID", _S)),
    "OwnerUpdated": _fields(("owner", _S)),
    "TransactionCreated": _fields(("id", _S), ("money", _L), ("from", _S), ("to", _S)),
    "TransactionFailed": _fields(("rollback", _B), ("reason", _S)),
    "TransactionSucceeded": _fields(),
}
# Body fields that hold ids: the nil id stands for "absent" and is always written.
ID_FIELDS = ("id", "from", "to", "TransactionID")

# Columns of the decoded ("typed") log, one row per event.
TYPED_COLUMNS = (
    "seq",
    "aggregate_id",
    "aggregate_kind",
    "kind",
    "money",
    "owner",
    "tx_id",
    "from_id",
    "to_id",
    "rollback",
    "reason",
    "created_at",
)

ACCOUNT_COMMAND = _fields(("owner", _S))
TRANSFER_COMMAND = _fields(("from", _S), ("to", _S), ("money", _L))

SEARCH_RESPONSE = _fields(
    (
        "hits",
        _fields(
            (
                "hits",
                T.ArrayType(
                    _fields(
                        ("_id", _S),
                        ("_version", _L),
                        (
                            "_source",
                            _fields(
                                ("sequence", _L),
                                ("kind", _S),
                                ("status", _S),
                                ("balance", _L),
                                ("owner", _S),
                            ),
                        ),
                    )
                ),
            )
        ),
    )
)
