"""Rows with their projection and the rows related to them.

Every level is one join in the same plan: a to-one relation onto a key joins the other
table as it is, and other related rows are first collected by their key. What is
collected for one parent is one row, so for parents with very many rows give `take`.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import QueryValidationError
from ..schema.document import Model
from ..schema.relations import Join, resolve
from .order import after_cursor, by_key, columns, distinct_rows, fresh, normalized, page
from .where import Filter


def projection(model: Model, args: Mapping[str, Any]) -> tuple[list[str], dict[str, Mapping], Any]:
    """(scalar fields, relations with their arguments, what _count asks for)."""
    select, include, omit = args.get("select"), args.get("include"), args.get("omit")
    if select and include:
        raise QueryValidationError("select and include exclude each other")
    chosen = {k: v for k, v in (select or include or {}).items() if v}
    count = chosen.pop("_count", None)
    for name in (*chosen, *(omit or {})):
        if model.field(name) is None:
            raise QueryValidationError(f"{model.name} has no field {name}")
    relations = {k: v if isinstance(v, Mapping) else {} for k, v in chosen.items() if model.field(k).kind == "object"}
    scalars = [f.name for f in model.scalars if not select or f.name in chosen]
    return [n for n in scalars if not (omit or {}).get(n)], relations, count


class Reader:
    def __init__(self, source):
        self.source = source
        self.schema = source.schema

    def rows(self, model: Model, args: Mapping[str, Any]) -> tuple[DataFrame, list]:
        """All scalar fields of the rows that args choose (filter, cursor, distinct, page), and their order."""
        df = self.source.frame(model).alias("t0")
        cond = Filter(self.source).where(model, "t0", args.get("where"))
        return self._chosen(df if cond is None else df.where(cond), model, args)

    @staticmethod
    def _chosen(df: DataFrame, model: Model, args: Mapping[str, Any]) -> tuple[DataFrame, list]:
        order = normalized(model, args.get("orderBy"))
        cursor = args.get("cursor")
        if cursor:
            order = order or [(n, False) for n in cursor]
            df = df.where(after_cursor(model, "t0", cursor, order))
        names = args.get("distinct")
        if names:
            df = distinct_rows(df, model, [names] if isinstance(names, str) else list(names), order)
        return page(df, order, args.get("take"), args.get("skip")), order

    def find_many(self, model: Model, args: Mapping[str, Any] | None = None) -> DataFrame:
        args = args or {}
        return self._shaped(*self.rows(model, args), model, args)

    def shape(self, df: DataFrame, model: Model, args: Mapping[str, Any]) -> DataFrame:
        """Rows of a model, ordered, paged and projected by args."""
        return self._shaped(*self._chosen(df.alias("t0"), model, args), model, args)

    def _shaped(self, df: DataFrame, order: list, model: Model, args: Mapping[str, Any]) -> DataFrame:
        scalars, relations, count = projection(model, args)
        if not relations and not count:
            return df.select(*scalars)
        df = self.load(df, model, relations, count)
        if order:
            df = df.orderBy(*columns(order))  # joins keep no order
        return df.select(*scalars, *relations, *(["_count"] if count else []))

    def load(self, df: DataFrame, model: Model, relations: Mapping[str, Mapping], count: Any = None) -> DataFrame:
        """df, which has all scalar fields of model, with a column for each relation."""
        for name, args in relations.items():
            df = self._attach(df, model, name, args)
        return self._counted(df, model, count) if count else df

    def _related(self, model: Model, args: Mapping[str, Any]) -> DataFrame:
        df = self.source.frame(model).alias("t0")
        cond = Filter(self.source).where(model, "t0", args.get("where"))
        return df if cond is None else df.where(cond)

    def _attach(self, df: DataFrame, model: Model, name: str, args: Mapping[str, Any]) -> DataFrame:
        join = resolve(self.schema, model, name)
        target = join.target
        keys = [fresh(f"_k{i}", df.columns, [name]) for i in range(len(join.own))]
        skip, take = max(0, args.get("skip") or 0), args.get("take")
        paged = skip > 0 or (take is not None and take >= 0) or bool(args.get("distinct"))
        # A null key joins nothing; left in, all of them would meet in one group.
        child = self._related(target, args).where(reduce(Column.__and__, [F.col(o).isNotNull() for o in join.other]))
        scalars, relations, count = projection(target, args)
        shown = lambda c: F.struct(*scalars, *relations, *(["_count"] if count else []))
        if not join.is_list and not paged and _is_key(target, join.other):
            child = self.load(child, target, relations, count)
            one = child.select(*(F.col(o).alias(k) for o, k in zip(join.other, keys, strict=True)), shown(child).alias(name))
            return self._joined(df, one, join, keys)
        order = normalized(target, args.get("orderBy"))
        order = order + [o for o in by_key(target) if o[0] not in dict(order)]
        if paged:
            child = self._page(child, target, join, args, order, skip, take)
        child = self.load(child, target, relations, count)
        placed = F.struct(*(F.col(n).alias(f"o{i}") for i, (n, _) in enumerate(order)), shown(child).alias("row"))
        rows = fresh("_rows", keys)
        child = child.select(*(F.col(o).alias(k) for o, k in zip(join.other, keys, strict=True)), placed.alias(rows))
        grouped = child.groupBy(*keys).agg(F.collect_list(rows).alias(rows))
        ordered = _ordered(F.col(rows), order)
        found = F.transform(ordered, lambda r: r["row"]) if join.is_list else F.get(ordered, F.lit(0))["row"]
        joined = self._joined(df, grouped.select(*keys, found.alias(name)), join, keys)
        return joined.withColumn(name, F.coalesce(name, F.array())) if join.is_list else joined

    @staticmethod
    def _joined(df: DataFrame, child: DataFrame, join: Join, keys: list[str]) -> DataFrame:
        return df.join(child, [df[o] == child[k] for o, k in zip(join.own, keys, strict=True)], "left").drop(*keys)

    @staticmethod
    def _page(child: DataFrame, target: Model, join: Join, args: Mapping[str, Any], order: list, skip: int, take: int | None) -> DataFrame:
        """Of every parent's rows the first of each combination that distinct names, and then a page."""
        at, names = fresh("_at", child.columns), args.get("distinct")
        if names:
            own = [names] if isinstance(names, str) else list(names)
            child = child.withColumn(at, F.row_number().over(Window.partitionBy(*join.other, *own).orderBy(*columns(order)))).where(F.col(at) == 1).drop(at)
        if skip or (take is not None and take >= 0):
            child = child.withColumn(at, F.row_number().over(Window.partitionBy(*join.other).orderBy(*columns(order)))).where(F.col(at) > skip)
            child = (child.where(F.col(at) <= skip + take) if take is not None and take >= 0 else child).drop(at)
        return child

    def _counted(self, df: DataFrame, model: Model, given: Any) -> DataFrame:
        asked = given.get("select", {}) if isinstance(given, Mapping) else {f.name: True for f in model.fields if f.kind == "object" and f.is_list}
        parts = []
        for i, (name, args) in enumerate((k, v) for k, v in asked.items() if v):
            join = resolve(self.schema, model, name)
            n = fresh(f"_n{i}", df.columns)
            keys = [fresh(f"_c{i}_{j}", df.columns, [n]) for j in range(len(join.own))]
            child = self._related(join.target, args if isinstance(args, Mapping) else {}).where(reduce(Column.__and__, [F.col(o).isNotNull() for o in join.other]))
            counts = child.groupBy(*(F.col(o).alias(k) for o, k in zip(join.other, keys, strict=True))).agg(F.count("*").alias(n))
            df = self._joined(df, counts, join, keys)
            parts.append((n, F.coalesce(n, F.lit(0)).cast("long").alias(name)))
        return df.withColumn("_count", F.struct(*(p for _, p in parts))).drop(*(n for n, _ in parts))


def _is_key(model: Model, names: tuple[str, ...]) -> bool:
    """Whether the schema says that at most one row has given values of these fields."""
    keys = [model.id_fields, *((f.name,) for f in model.scalars if f.unique), *(k.fields for k in model.uniques)]
    return any(k and set(k) <= set(names) for k in keys)


def _ordered(rows: Column, order: list) -> Column:
    """Arrays of structs (o0, o1, ... by `order`, row) in that order; nulls are least."""
    return F.array_sort(rows, _comparing(order))


def _comparing(order: list):
    def compare(x: Column, y: Column) -> Column:
        out = F.lit(0)
        for i, (_, down) in reversed(list(enumerate(order))):
            a, b = x[f"o{i}"], y[f"o{i}"]
            less, more = (1, -1) if down else (-1, 1)
            out = F.when(a.eqNullSafe(b), out).when(a.isNull(), less).when(b.isNull(), more).when(a < b, less).otherwise(more)
        return out

    return compare
