"""Filters: nested arguments as one Column.

Conditions on related rows are EXISTS subqueries, which Catalyst turns into semi, anti
and existence joins. Values are literals of their field's declared type, or of a wider
one where that can't hold them.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryValidationError
from ..functions.values import literal
from ..schema.document import Field, Model
from ..schema.relations import Join, resolve

OPERATORS = frozenset("equals not in notIn lt lte gt gte contains startsWith endsWith mode".split())
JSON_OPERATORS = frozenset("equals not path string_contains string_starts_with string_ends_with".split())
RELATION_OPERATORS = frozenset("some none every is isNot".split())
_COMPARE = {"lt": Column.__lt__, "lte": Column.__le__, "gt": Column.__gt__, "gte": Column.__ge__}
_MATCH = {"contains": Column.contains, "startsWith": Column.startswith, "endsWith": Column.endswith}


def _join(op, parts: list[Column | None]) -> Column | None:
    parts = [p for p in parts if p is not None]
    return reduce(op, parts) if parts else None


def _all(parts: list[Column | None]) -> Column | None:
    return _join(Column.__and__, parts)


def _listed(x: Any) -> list:
    return list(x) if isinstance(x, (list, tuple)) else [x]


class Filter:
    """Compiles filters against the tables of `source` (source.frame(model) -> DataFrame)."""

    def __init__(self, source):
        self.source = source
        self.schema = source.schema
        self._aliases = 0

    def alias(self) -> str:
        self._aliases += 1
        return f"r{self._aliases}"

    def where(self, model: Model, alias: str, given: Mapping | None) -> Column | None:
        """The condition, or None if there is none. Keys are ANDed."""
        parts: list[Column | None] = []
        for key, value in (given or {}).items():
            if key in ("AND", "OR"):
                inner = [self.where(model, alias, w) for w in _listed(value) if w is not None]
                parts.append(_join(Column.__and__ if key == "AND" else Column.__or__, inner))
            elif key == "NOT":
                inner = _all([self.where(model, alias, w) for w in _listed(value) if w is not None])
                parts.append(None if inner is None else ~inner)
            else:
                field = model.field(key)
                if field is None:
                    raise QueryValidationError(f"{model.name} has no field {key}")
                parts.append(self._related(model, alias, field, value) if field.kind == "object" else self.scalar(field, F.col(f"{alias}.{field.name}"), value))
        return _all(parts)

    def scalar(self, field: Field, col: Column, given: Any) -> Column | None:
        plain = isinstance(given, Mapping)
        if field.type == "Json" and plain and any(k in JSON_OPERATORS for k in given):
            return self._json(field, col, given)
        if not plain or not any(k in OPERATORS for k in given):
            if plain and field.type != "Json":
                unknown = next(iter(given), None)
                raise QueryValidationError(f"unknown operator {unknown} on {field.name}" if unknown else f"{field.name}: an empty filter")
            return col.isNull() if given is None else col == literal(field, given)
        folded = given.get("mode") == "insensitive"
        return _all([self._operator(field, col, op, value, folded) for op, value in given.items() if op != "mode"])

    def _operator(self, field: Field, col: Column, op: str, value: Any, folded: bool) -> Column | None:
        up = lambda v: folded and isinstance(v, str)
        side = lambda v: F.upper(col) if up(v) else col
        lit = lambda v: F.upper(literal(field, v)) if up(v) else literal(field, v)
        if op == "equals":
            return col.isNull() if value is None else side(value) == lit(value)
        if op == "not":
            if isinstance(value, Mapping):
                inner = {k: v for k, v in value.items() if k != "mode"} | ({"mode": "insensitive"} if folded else {})
                cond = self.scalar(field, col, inner) if set(inner) - {"mode"} else None
                return None if cond is None else ~cond
            return col.isNotNull() if value is None else side(value) != lit(value)
        if op in ("in", "notIn"):
            values = _listed(value)
            if not values:
                return F.lit(op == "notIn")
            left = F.upper(col) if folded and any(isinstance(v, str) for v in values) else col
            found = left.isin(*(lit(v) for v in values))
            return found if op == "in" else ~found
        if op in _COMPARE:
            return _COMPARE[op](side(value), lit(value))
        if op in _MATCH:
            text = F.lit(str(value))
            return _MATCH[op](F.upper(col), F.upper(text)) if folded else _MATCH[op](col, text)
        raise QueryValidationError(f"unknown operator {op} on {field.name}")

    def _json(self, field: Field, col: Column, given: Mapping) -> Column | None:
        parts = []
        for op, value in given.items():
            if op == "path":
                raise QueryValidationError(f"{field.name}: path filters are not supported, Json is text")
            if op in ("equals", "not"):
                same = None if value is None else col == literal(field, value)
                parts.append((col.isNull() if value is None else same) if op == "equals" else (col.isNotNull() if value is None else ~same))
            elif op in JSON_OPERATORS:
                match = {"string_contains": "contains", "string_starts_with": "startsWith", "string_ends_with": "endsWith"}[op]
                parts.append(_MATCH[match](col, F.lit(str(value))))
            else:
                raise QueryValidationError(f"unknown operator {op} on {field.name}")
        return _all(parts)

    def _related(self, model: Model, alias: str, field: Field, given: Any) -> Column | None:
        join = resolve(self.schema, model, field.name)
        operators = isinstance(given, Mapping) and any(k in RELATION_OPERATORS for k in given)
        if not operators:
            if field.is_list:
                return None
            if given is None:
                warnings.warn(f"{field.name}: None means that a related row exists; use {{'is': None}} for none", stacklevel=2)
            given = {"is": given or {}}
        parts: list[Column | None] = []
        for op, w in given.items():
            if op == "some":
                parts.append(self._exists(join, alias, w))
            elif op == "none":
                parts.append(~self._exists(join, alias, w))
            elif op == "every":
                parts.append(~self._exists(join, alias, w, negate=True))
            elif op in ("is", "isNot"):
                found = self._exists(join, alias, w or {})
                parts.append(found if (op == "is") == (w is not None) else ~found)
            else:
                raise QueryValidationError(f"unknown operator {op} on {field.name}")
        return _all(parts)

    def _exists(self, join: Join, alias: str, given: Mapping | None, negate: bool = False) -> Column:
        """Related rows that satisfy `given` (with negate: that violate it; without a condition: any)."""
        own = self.alias()
        cond = self.where(join.target, own, given)
        keys = [F.col(f"{own}.{o}") == F.col(f"{alias}.{k}").outer() for k, o in zip(join.own, join.other, strict=True)]
        return self.source.frame(join.target).alias(own).where(_all([*keys, ~cond if negate and cond is not None else cond])).exists()
