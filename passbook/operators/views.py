"""Projections, lookups and ordered reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passbook.operators.folds import fold_account_state
from passbook.schema import SEARCH_RESPONSE


def account_view(accounts: DataFrame) -> DataFrame:
    return accounts.select("owner", "balance", "status")


def transaction_view(transactions: DataFrame) -> DataFrame:
    return transactions.select(
        F.col("id").alias("tx_id"), "money", "from_id", "to_id", "status", "failure_reason"
    )


def search_hits(responses: DataFrame, column: str = "response") -> DataFrame:
    """Rows of search responses; whole numbers stay whole at any size."""
    parsed = responses.select(F.from_json(column, SEARCH_RESPONSE).alias("r"))
    hits = parsed.select(F.inline("r.hits.hits"))
    return hits.select(
        F.col("_id").alias("id"),
        F.coalesce("_version", F.lit(0)).alias("version"),
        F.coalesce("_source.sequence", F.lit(0)).alias("sequence"),
        F.coalesce("_source.kind", F.lit("")).alias("kind"),
        F.coalesce("_source.status", F.lit("")).alias("status"),
        F.coalesce("_source.balance", F.lit(0)).alias("balance"),
        F.coalesce("_source.owner", F.lit("")).alias("owner"),
    )


def saga_legs(transactions: DataFrame, keep: tuple[str, ...] = ("seq", "money")) -> DataFrame:
    """Withdraw leg (0), then deposit leg (1) of each transfer; absent legs are left out."""
    legs = F.array(
        F.when(
            F.col("from_id").isNotNull(),
            F.struct(F.lit(0).alias("leg"), F.col("from_id").alias("account_id")),
        ),
        F.when(
            F.col("to_id").isNotNull(),
            F.struct(F.lit(1).alias("leg"), F.col("to_id").alias("account_id")),
        ),
    )
    return transactions.select(*keep, F.inline(legs)).where("leg IS NOT NULL")


def list_by_owner(balances: DataFrame, limit: int | None = None) -> DataFrame:
    """All documents by owner, or the first ``limit``; ``LIST_PAGE`` is the served page."""
    out = balances.orderBy("owner", "id")
    return out if limit is None else out.limit(limit)


def top_by_sequence(balances: DataFrame) -> DataFrame:
    return balances.orderBy(F.desc("sequence")).limit(1)


def by_id(df: DataFrame, value: str, column: str = "id") -> DataFrame:
    return df.where(F.col(column) == value)


def account_by_id(log: DataFrame, account_id: str) -> DataFrame:
    """One account, folded from its own events only."""
    return account_view(fold_account_state(by_id(log, account_id, "aggregate_id")))


def ordered_replay(log: DataFrame, aggregate_id: str) -> DataFrame:
    return by_id(log, aggregate_id, "aggregate_id").orderBy("seq")
