"""Rows as JSON text, and arguments that arrive as JSON."""

from __future__ import annotations

import base64
import binascii
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryValidationError
from ..schema.document import Field, Model, Schema

_COMPARED = frozenset("equals not lt lte gt gte".split())
_GROUPS = frozenset(("AND", "OR", "NOT"))


def _portable(col: Column, kind: T.DataType) -> Column:
    """Longs and moments as text, bytes as {$type: bytes, base64}; structs and arrays alike."""
    if isinstance(kind, T.LongType):
        return col.cast("string")
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    if isinstance(kind, T.BinaryType):
        return F.when(col.isNotNull(), F.struct(F.lit("bytes").alias("$type"), F.base64(col).alias("base64")))
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: _portable(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(col.isNotNull(), F.struct(*(_portable(col[f.name], f.dataType).alias(f.name) for f in kind)))
    return col


def json_rows(df: DataFrame) -> DataFrame:
    """A column `value` with every row of df as a JSON object, nulls included; times are of the session's zone (UTC)."""
    return df.select(F.to_json(F.struct(*(_portable(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema)), {"ignoreNullFields": "false"}).alias("value"))


def _is_bytes(value: Any) -> bool:
    return isinstance(value, Mapping) and value.get("$type") == "bytes" and isinstance(value.get("base64"), str)


def typed_value(field: Field, value: Any) -> Any:
    """A value of JSON as its field takes it: numbers, times and bytes may come as text."""
    if value is None or field.kind == "object":
        return value
    try:
        if _is_bytes(value):
            return base64.b64decode(value["base64"], validate=True)
        if not isinstance(value, str):
            return bool(value) if field.type == "Boolean" and value in (0, 1) else value
        if field.type in ("Int", "BigInt"):
            return int(value)
        if field.type == "Float":
            return float(value)
        if field.type == "Boolean":
            return {"true": True, "1": True, "false": False, "0": False}[value]
        if field.type == "Bytes":
            return base64.b64decode(value, validate=True)
    except (ValueError, KeyError, binascii.Error):
        raise QueryValidationError(f"{field.name} is a {field.type}, which {value!r} is not") from None
    return value  # text, and what literals take as text


def typed_data(schema: Schema, model: Model, data: Mapping[str, Any]) -> dict[str, Any]:
    """Data of a write from JSON; operations on numbers and nested writes alike, unknown names stay."""
    out: dict[str, Any] = {}
    for name, value in data.items():
        field = model.field(name)
        if field is None:
            out[name] = value
        elif field.kind == "object":
            out[name] = _nested(schema, schema.model(field.type), value)
        elif isinstance(value, Mapping) and not _is_bytes(value) and field.type != "Json":
            out[name] = {op: typed_value(field, v) for op, v in value.items()}
        else:
            out[name] = typed_value(field, value)
    return out


def _nested(schema: Schema, target: Model, value: Any) -> Any:
    if not isinstance(value, Mapping):
        return value
    each = lambda f, v: [f(x) for x in v] if isinstance(v, (list, tuple)) else f(v) if isinstance(v, Mapping) else v
    data, where = (lambda d: typed_data(schema, target, d)), (lambda w: typed_where(schema, target, w))
    both = lambda x: {"where": where(x["where"]), "create": data(x["create"])}
    kinds = {"create": data, "connectOrCreate": both}
    return {op: each(kinds.get(op, where), v) for op, v in value.items()}


def typed_where(schema: Schema, model: Model, where: Mapping[str, Any]) -> dict[str, Any]:
    """A filter from JSON, with groups and filters of related rows; unknown names stay."""
    inner = lambda w: typed_where(schema, model, w) if isinstance(w, Mapping) else w
    out: dict[str, Any] = {}
    for name, value in where.items():
        field = model.field(name)
        if name in _GROUPS:
            out[name] = [inner(w) for w in value] if isinstance(value, (list, tuple)) else inner(value)
        elif field is None:
            out[name] = value
        elif field.kind == "object":
            out[name] = _related(schema, schema.model(field.type), value)
        else:
            out[name] = _condition(field, value)
    return out


def _related(schema: Schema, target: Model, value: Any) -> Any:
    if not isinstance(value, Mapping):
        return value
    if any(op in value for op in ("some", "none", "every", "is", "isNot")):
        return {op: typed_where(schema, target, w) if isinstance(w, Mapping) else w for op, w in value.items()}
    return typed_where(schema, target, value)


def _condition(field: Field, value: Any) -> Any:
    if not isinstance(value, Mapping) or _is_bytes(value) or field.type == "Json":
        return typed_value(field, value)
    out: dict[str, Any] = {}
    for op, operand in value.items():
        if op in ("in", "notIn") and isinstance(operand, (list, tuple)):
            out[op] = [typed_value(field, v) for v in operand]
        elif op in _COMPARED:
            out[op] = _condition(field, operand)
        else:
            out[op] = operand
    return out
