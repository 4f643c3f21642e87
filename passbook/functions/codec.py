"""JSON bodies to typed columns and back, driven by a kind -> fields map."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passbook.functions.ids import nil_to_null, null_to_nil
from passbook.schema import EVENT_BODIES, ID_FIELDS

Registry = Mapping[str, T.StructType]


def register_kind(kind: str, fields: T.StructType, base: Registry = EVENT_BODIES) -> Registry:
    """A registry with one more event kind; a field name keeps one type in all kinds."""
    merged = dict(base) | {kind: fields}
    body_schema(merged)
    return merged


def body_schema(registry: Registry) -> T.StructType:
    """One struct that holds the fields of every kind, so a body is parsed once."""
    types: dict[str, T.DataType] = {}
    for kind, fields in registry.items():
        for f in fields.fields:
            if types.setdefault(f.name, f.dataType) != f.dataType:
                raise ValueError(f"{kind}.{f.name}: {f.dataType} clashes with {types[f.name]}")
    return T.StructType([T.StructField(n, t) for n, t in types.items()])


def _zero(t: T.DataType) -> Column | None:
    if isinstance(t, T.StringType):
        return F.lit("")
    if isinstance(t, T.BooleanType):
        return F.lit(False)
    if isinstance(t, T.NumericType):
        return F.lit(0).cast(t)
    return None


def decode_body(
    df: DataFrame, registry: Registry = EVENT_BODIES, body: str = "body", prefix: str = ""
) -> DataFrame:
    """Add one column per body field; rows of unregistered kinds are left out.

    A field that its kind declares and the body lacks gets the zero value of its
    type, ids become null when absent or nil, and fields of other kinds are null.
    """
    schema = body_schema(registry)
    parsed = df.where(F.col("kind").isin(*registry)).withColumn(
        "__body", F.from_json(F.col(body), schema)
    )
    columns = []
    for field in schema.fields:
        kinds = [k for k, fs in registry.items() if field.name in fs.names]
        value = F.col("__body").getField(field.name)
        if field.name in ID_FIELDS:
            value = nil_to_null(value)
        elif (zero := _zero(field.dataType)) is not None:
            value = F.coalesce(value, zero)
        columns.append(F.when(F.col("kind").isin(*kinds), value).alias(prefix + field.name))
    return parsed.select(*[F.col(c) for c in df.columns], *columns)


def encode_body(
    columns: Mapping[str, Column] | None = None, registry: Registry = EVENT_BODIES
) -> Column:
    """JSON body of a typed event; zero-valued fields are dropped, nil ids are kept."""
    columns = columns or {}
    out = None
    for kind, schema in registry.items():
        parts = []
        for f in schema.fields:
            value = columns.get(f.name, F.col(f"`{f.name}`"))
            zero = _zero(f.dataType)
            if f.name in ID_FIELDS:
                value = null_to_nil(value)
            elif zero is not None:
                value = F.nullif(value, zero)
            parts.append(value.alias(f.name))
        body = F.to_json(F.struct(*parts)) if parts else F.lit("{}")
        is_kind = F.col("kind") == kind
        out = F.when(is_kind, body) if out is None else out.when(is_kind, body)
    return out
