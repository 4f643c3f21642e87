"""Money effects and failure texts of events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from passbook.schema import NOT_ENOUGH_FUNDS, TRANSACTIONS_DISABLED


def signed_money(kind: Column | str = "kind", money: Column | str = "money") -> Column:
    """+money for opening and deposit, -money for withdrawal, 0 for all else."""
    k = F.col(kind) if isinstance(kind, str) else kind
    m = F.col(money) if isinstance(money, str) else money
    return (
        F.when(k.isin("AccountCreated", "MoneyDeposited"), m)
        .when(k == "MoneyWithdrawn", -m)
        .otherwise(F.lit(0).cast("long"))
    )


def failure_reason(side: str, text: Column | str = NOT_ENOUGH_FUNDS) -> Column:
    """Reason of a failed leg; ``side`` is ``From`` or ``To``."""
    body = F.lit(text) if isinstance(text, str) else text
    return F.concat(F.lit(f"{side} account: "), body)


def disabled_reason(side: str, status: Column) -> Column:
    return failure_reason(
        side, F.concat(F.lit("Status: "), status, F.lit(f": {TRANSACTIONS_DISABLED}"))
    )
