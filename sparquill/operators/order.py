"""Order, keyset cursors, distinct rows and pages."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import QueryValidationError
from ..functions.values import literal
from ..schema.document import Model

Order = list[tuple[str, bool]]  # (field, descending)


def normalized(model: Model, given: Any) -> Order:
    """orderBy as (field, descending); directions that are neither asc nor desc are dropped."""
    out = []
    for part in given if isinstance(given, (list, tuple)) else [given] if given else []:
        for name, direction in part.items():
            field = model.field(name)
            if field is None or field.kind == "object":
                raise QueryValidationError(f"{model.name} can't be ordered by {name}")
            if direction in ("asc", "desc"):
                out.append((name, direction == "desc"))
    return out


def columns(order: Order, prefix: str = "") -> list[Column]:
    """Ascending has nulls first, descending last."""
    return [F.desc_nulls_last(prefix + n) if down else F.asc_nulls_first(prefix + n) for n, down in order]


def by_key(model: Model) -> Order:
    return [(n, False) for n in model.id_fields or [f.name for f in model.scalars]]


def after_cursor(model: Model, alias: str, cursor: Mapping[str, Any], order: Order) -> Column:
    """Rows from the cursor on, itself included: an OR of prefixes that are equal and one step."""
    down = dict(order)
    names = [n for n, _ in order if n in cursor] + [n for n in cursor if n not in down]
    out = None
    for k, name in enumerate(names):
        field = model.field(name)
        if field is None or field.kind == "object":
            raise QueryValidationError(f"{model.name} has no field {name} for a cursor")
        col, value, last = F.col(f"{alias}.{name}"), literal(field, cursor[name]), k == len(names) - 1
        step = (col <= value if last else col < value) if down.get(name) else (col >= value if last else col > value)
        for before in names[:k]:
            step = (F.col(f"{alias}.{before}") == literal(model.field(before), cursor[before])) & step
        out = step if out is None else out | step
    return out if out is not None else F.lit(True)


def fresh(name: str, *taken: list[str]) -> str:
    """A column name that isn't taken."""
    known = {c.lower() for names in taken for c in names}
    while name.lower() in known:
        name += "_"
    return name


def distinct_rows(df: DataFrame, model: Model, names: list[str], order: Order) -> DataFrame:
    """The first row of every combination of values, by the order and then the key."""
    for n in names:
        if model.field(n) is None or model.field(n).kind == "object":
            raise QueryValidationError(f"{model.name} has no field {n} for distinct")
    order = order + [o for o in by_key(model) if o[0] not in dict(order)]
    rank = fresh("_rank", df.columns)
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*names).orderBy(*columns(order)))).where(F.col(rank) == 1).drop(rank)


def page(df: DataFrame, order: Order, take: int | None, skip: int | None) -> DataFrame:
    """Sort, then leave out `skip` rows and keep `take`; a negative take is none."""
    if order:
        df = df.orderBy(*columns(order))
    if skip and skip > 0:
        df = df.offset(int(skip))
    return df.limit(int(take)) if take is not None and take >= 0 else df
