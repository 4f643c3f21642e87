"""Identifier columns: canonical form, the nil id, idempotency keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from passbook.schema import NIL_UUID

# The canonical text form of an id, and the parts around which
# numeric keys become ids (account and transaction ids never collide).
CANONICAL_UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
ID_HEAD, ACCOUNT_MIDDLE, TRANSACTION_MIDDLE = "00000000-", "-4000-8000-", "-4000-9000-"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _numbered(middle: str, number: Column | str) -> Column:
    """All 64 bits of the key: its upper 16 in the second group, the others in the last."""
    digits = F.lpad(F.lower(F.hex(_col(number).cast("long"))), 16, "0")
    return F.concat(F.lit(ID_HEAD), F.substring(digits, 1, 4), F.lit(middle), F.substring(digits, 5, 12))


def account_uuid(number: Column | str) -> Column:
    """Id of the account with this numeric key, another one for each key; null stays null."""
    return _numbered(ACCOUNT_MIDDLE, number)


def transaction_uuid(number: Column | str) -> Column:
    return _numbered(TRANSACTION_MIDDLE, number)


def is_canonical_uuid(c: Column | str) -> Column:
    return F.coalesce(_col(c).rlike(CANONICAL_UUID), F.lit(False))


def nil_to_null(c: Column | str) -> Column:
    """The nil id means "no account"; so does an empty text."""
    return F.nullif(F.nullif(_col(c), F.lit(NIL_UUID)), F.lit(""))


def null_to_nil(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit(NIL_UUID))


def idempotency_key(tx_id: Column | str, step: str) -> Column:
    return F.concat(_col(tx_id), F.lit("/" + step))
