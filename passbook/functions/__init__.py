"""Column expressions over event rows."""

from passbook.functions.codec import decode_body, encode_body, register_kind
from passbook.functions.containment import contains
from passbook.functions.ids import (
    account_uuid,
    idempotency_key,
    is_canonical_uuid,
    nil_to_null,
    null_to_nil,
    transaction_uuid,
)
from passbook.functions.money import disabled_reason, failure_reason, signed_money

__all__ = [
    "account_uuid",
    "contains",
    "decode_body",
    "disabled_reason",
    "encode_body",
    "failure_reason",
    "idempotency_key",
    "is_canonical_uuid",
    "nil_to_null",
    "null_to_nil",
    "register_kind",
    "signed_money",
    "transaction_uuid",
]
