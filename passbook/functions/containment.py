"""Containment of JSON values: does a stored text hold at least what a given value states?"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits of whole numbers and fractions that are compared exactly.
EXACT = "decimal(38,18)"


def _step(key: str) -> str:
    """The path of a key in any spelling."""
    if "'" not in key:
        return f"$['{key}']"
    if '"' not in key:
        return f'$["{key}"]'
    raise ValueError(f"a key with both kinds of quotes: {key}")


def _number(value: Column, wanted: int | float | Decimal) -> Column:
    """Equal as numbers: 1 and 1.0 are, 1 and "1" are not."""
    kind = F.schema_of_variant(value)
    given = Decimal(str(wanted)).normalize()
    if given.as_tuple().exponent >= -18 and abs(given) < 10**20:
        exact = F.try_variant_get(value, "$", EXACT) == F.lit(given).cast(EXACT)
    else:
        exact = F.try_variant_get(value, "$", "string") == f"{given:f}"
    near = F.try_variant_get(value, "$", "double") == F.lit(float(given))
    return F.when(kind == "DOUBLE", near).when((kind == "BIGINT") | kind.startswith("DECIMAL"), exact)


def _holds(value: Column, wanted: Any) -> Column:
    kind = F.schema_of_variant(value)
    if wanted is None:
        return F.is_variant_null(value)
    if isinstance(wanted, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == wanted)
    if isinstance(wanted, str):
        return (kind == "STRING") & (F.try_variant_get(value, "$", "string") == wanted)
    if isinstance(wanted, dict):
        fields = [_known(_holds(F.try_variant_get(value, _step(k), "variant"), w)) for k, w in wanted.items()]
        return reduce(Column.__and__, fields, kind.startswith("OBJECT"))
    if isinstance(wanted, (list, tuple)):
        items = F.try_variant_get(value, "$", "array<variant>")
        found = [F.exists(items, _holder(w)) for w in wanted]
        return reduce(Column.__and__, found, kind.startswith("ARRAY"))
    if isinstance(wanted, (int, float, Decimal)):
        return _number(value, wanted)
    raise TypeError(f"no JSON value: {wanted!r}")


def _holder(wanted: Any) -> Callable[[Column], Column]:
    return lambda value: _known(_holds(value, wanted))


def _known(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def contains(column: Column | str, wanted: Any) -> Column:
    """Whether the JSON text holds ``wanted``, a value as ``json.loads`` gives it.

    An object holds another if it has all its keys with values that hold the other's; an
    array holds another if each element of that is held by some element, whatever their order
    and number; other values must be equal, numbers as numbers to 18 digits behind the point. At the top, an array also
    holds a plain value that is one of its elements. Texts that are null or no JSON hold
    nothing. The condition stays in the JVM, as nested column expressions.
    """
    value = F.try_parse_json(F.col(column) if isinstance(column, str) else column)
    found = _known(_holds(value, wanted))
    if not isinstance(wanted, (dict, list, tuple)):
        found = found | _known(_holds(value, [wanted]))
    return found
