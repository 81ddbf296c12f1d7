"""count, aggregate and groupBy with having. Results are flat: _count_all, _count_f, _sum_f, ..."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryValidationError
from ..functions.values import literal
from ..schema.document import Model
from .order import columns, fresh, normalized
from .read import Reader
from .where import Filter

_FUNCTIONS = {"_count": F.count, "_sum": F.sum, "_avg": F.avg, "_min": F.min, "_max": F.max}
_COMPARE = {"equals": Column.__eq__, "not": Column.__ne__, "gt": Column.__gt__, "gte": Column.__ge__, "lt": Column.__lt__, "lte": Column.__le__}


def _aggregate(model: Model, op: str, name: str) -> Column:
    if op == "_count" and name == "_all":
        return F.count("*").alias("_count_all")
    field = model.field(name)
    if field is None or field.kind == "object":
        raise QueryValidationError(f"{model.name} has no field {name} for {op}")
    return _FUNCTIONS[op](name).alias(f"{op}_{name}")


def requested(model: Model, args: Mapping[str, Any]) -> list[Column]:
    out = []
    for op in _FUNCTIONS:
        given = args.get(op)
        if given is True and op == "_count":
            given = {"_all": True}
        out += [_aggregate(model, op, name) for name, on in (given or {}).items() if on]
    return out


def count(reader: Reader, model: Model, args: Mapping[str, Any]) -> DataFrame:
    """One row: count, or with select a _count_f per field. take and skip choose input rows."""
    df, _ = reader.rows(model, {k: args.get(k) for k in ("where", "take", "skip", "orderBy", "cursor")})
    select = args.get("select")
    if isinstance(select, Mapping):
        return df.agg(*(_aggregate(model, "_count", n) for n, on in select.items() if on))
    return df.agg(F.count("*").alias("count"))


def aggregate(reader: Reader, model: Model, args: Mapping[str, Any]) -> DataFrame:
    """One row of aggregates; orderBy, take and skip don't matter for them."""
    found = requested(model, args)
    if not found:
        raise QueryValidationError("aggregate needs _count, _sum, _avg, _min or _max")
    return reader.rows(model, {"where": args.get("where")})[0].agg(*found)


def group_by(reader: Reader, model: Model, args: Mapping[str, Any]) -> DataFrame:
    by = [args["by"]] if isinstance(args.get("by"), str) else list(args.get("by") or [])
    if not by:
        raise QueryValidationError("groupBy needs fields")
    for n in by:
        if model.field(n) is None or model.field(n).kind == "object":
            raise QueryValidationError(f"{model.name} can't be grouped by {n}")
    df, _ = reader.rows(model, {"where": args.get("where")})
    shown, hidden = requested(model, args), {}
    having = _having(reader, model, by, args.get("having"), hidden)
    if shown or hidden:
        grouped = df.groupBy(*by).agg(*shown, *(c.alias(n) for n, c in hidden.items()))
    else:
        grouped = df.select(*by).distinct()
    grouped = grouped.alias("t0") if having is None else grouped.alias("t0").where(having)
    order = normalized(model, args.get("orderBy"))
    if any(n not in by for n, _ in order):
        raise QueryValidationError("groupBy is ordered by its own fields")
    return (grouped.orderBy(*columns(order)) if order else grouped).drop(*hidden)


def _having(reader: Reader, model: Model, by: list[str], given: Mapping | None, hidden: dict[str, Column]) -> Column | None:
    parts: list[Column | None] = []
    for key, value in (given or {}).items():
        if key in ("AND", "OR"):
            inner = [c for w in (value if isinstance(value, (list, tuple)) else [value]) if (c := _having(reader, model, by, w, hidden)) is not None]
            parts.append(reduce(Column.__and__ if key == "AND" else Column.__or__, inner) if inner else None)
        elif key == "NOT":
            inner = _having(reader, model, by, value, hidden)
            parts.append(None if inner is None else ~inner)
        elif key in _FUNCTIONS:  # {_count: {field: {gt: 1}}}
            parts += [_compared(model, key, n, c, hidden) for n, c in value.items() if n == "_all" or model.field(n)]
        elif isinstance(value, Mapping) and any(k in _FUNCTIONS for k in value):  # {field: {_sum: {gt: 1}}}
            parts += [_compared(model, op, key, c, hidden) for op, c in value.items() if op in _FUNCTIONS]
        else:
            if model.field(key) is None:
                raise QueryValidationError(f"{model.name} has no field {key}")
            if key not in by:
                raise QueryValidationError(f"having: {key} is not a field of the groups")
            parts.append(Filter(reader.source).where(model, "t0", {key: value}))
    parts = [p for p in parts if p is not None]
    return reduce(Column.__and__, parts) if parts else None


def _compared(model: Model, op: str, name: str, given: Any, hidden: dict[str, Column]) -> Column | None:
    hid = fresh(f"_h{op}_{name}", [f.name for f in model.scalars])
    hidden[hid] = _aggregate(model, op, name)
    col = F.col(hid)
    if not isinstance(given, Mapping):
        given = {"equals": given}
    field = model.field(name)
    exact = op in ("_min", "_max")
    parts = []
    for how, value in given.items():
        if how not in _COMPARE:
            raise QueryValidationError(f"unknown comparison {how} in having")
        parts.append(_COMPARE[how](col, literal(field, value) if exact else F.lit(value)))
    return reduce(Column.__and__, parts) if parts else None
