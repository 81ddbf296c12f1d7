"""Writes: new versions of tables from inserts, updates and deletes, with nested relation data.

Rows that are written come from arguments, so they are few and pass through the driver;
the tables themselves never do. Deletes and updates are one plan over the table.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryValidationError, RecordNotFoundError, UniqueConstraintError
from ..functions.defaults import is_generated, stamped, with_defaults
from ..functions.values import stored
from ..schema.document import NUMERIC, Field, Model
from ..schema.relations import resolve
from ..sources.snapshots import Snapshots, as_held, typed_rows
from .order import fresh
from .where import Filter

#: In this order: the first that is given counts.
ATOMIC = ("set", "increment", "decrement", "multiply", "divide")


def _listed(x: Any) -> list:
    return [] if x is None else list(x) if isinstance(x, (list, tuple)) else [x]


def _constant(field: Field, value: Any) -> Column:
    value = stored(field, value)
    return F.lit(value.isoformat()) if isinstance(value, date) else F.lit(value)


class Writer:
    def __init__(self, source: Snapshots):
        self.source, self.schema = source, source.schema

    # -- rows ---------------------------------------------------------------

    def matching(self, model: Model, where: Mapping | None) -> DataFrame:
        df = self.source.frame(model).alias("t0")
        cond = Filter(self.source).where(model, "t0", where)
        return df if cond is None else df.where(cond)

    def _rest(self, model: Model, where: Mapping | None) -> DataFrame:
        """Rows that a filter doesn't choose, those for which it is null included."""
        df = self.source.frame(model).alias("t0")
        cond = Filter(self.source).where(model, "t0", where)
        return df.where(F.lit(False)) if cond is None else df.where(~F.coalesce(cond, F.lit(False)))

    def first(self, model: Model, where: Mapping | None) -> dict[str, Any] | None:
        row = self.matching(model, where).limit(1).first()
        return row.asDict() if row else None

    @staticmethod
    def key(model: Model, row: Mapping[str, Any]) -> dict[str, Any]:
        return {n: row[n] for n in model.id_fields}

    # -- inserts ------------------------------------------------------------

    def _parted(self, model: Model, data: Mapping[str, Any]) -> tuple[dict, list, list]:
        """Scalars, relations whose key this model holds, and relations that hold this one's."""
        scalars, owning, children = {}, [], []
        for name, value in data.items():
            field = model.field(name)
            if field is None:
                raise QueryValidationError(f"{model.name} has no field {name}")
            if field.kind != "object":
                scalars[name] = value
            elif not isinstance(value, Mapping):
                raise QueryValidationError(f"{model.name}.{name} takes connect, create and the like")
            else:
                join = resolve(self.schema, model, name)
                (owning if join.owns else children).append((join, value))
        return scalars, owning, children

    def _owned(self, model: Model, owning: list, update: bool) -> dict[str, Any]:
        """Values of reference fields, from the first of connect, create, connectOrCreate, disconnect."""
        out: dict[str, Any] = {}
        for join, value in owning:
            if "connect" in value:
                row = self.first(join.target, value["connect"])
                if row is None:
                    raise RecordNotFoundError(f"{join.target.name} to connect {model.name} to")
            elif "create" in value:
                row = self.create(join.target, value["create"])
            elif "connectOrCreate" in value:
                row = self.first(join.target, value["connectOrCreate"]["where"]) or self.create(join.target, value["connectOrCreate"]["create"])
            elif update and value.get("disconnect"):
                row = {}
            else:
                continue
            out |= {own: row.get(other) for own, other in zip(join.own, join.other, strict=True)}
        return out

    def _insert(self, model: Model, rows: list[dict[str, Any]]) -> DataFrame:
        """Add rows, with generated numbers filled in; the rows as a table."""
        df = self.source.frame(model)
        for f in model.scalars:
            lacking = [r for r in rows if r.get(f.name) is None] if is_generated(model, f.name) else []
            if lacking:
                last = df.agg(F.max(f.name)).first()[0] or 0
                for k, r in enumerate(lacking, 1):
                    r[f.name] = last + k
        new = typed_rows(self.source.spark, df, model, rows)
        self.source.put(model, df.unionByName(new))
        return new

    @staticmethod
    def _keys(model: Model) -> list[tuple[str, ...]]:
        keys = [tuple(model.id_fields), *((f.name,) for f in model.scalars if f.unique), *(tuple(k.fields) for k in model.uniques)]
        return [k for k in dict.fromkeys(keys) if k]

    def _taken(self, model: Model, rows: list[dict[str, Any]]) -> dict[int, tuple[str, ...]]:
        """The rows (their places) that repeat a key of the table or of an earlier row, and that key.

        All keys are looked up in one job; a key with a null is none.
        """
        out: dict[int, tuple[str, ...]] = {}
        df = self.source.frame(model)
        at = fresh("_row", df.columns)
        found = []
        for names in self._keys(model):
            seen: set[tuple] = set()
            asked = []
            for k, r in enumerate(rows):
                value = tuple(None if r.get(n) is None else stored(model.field(n), r[n]) for n in names)
                if None in value:
                    continue
                if value in seen:
                    out.setdefault(k, names)
                seen.add(value)
                asked.append((k, *(as_held(v, df.schema[n].dataType) for v, n in zip(value, names, strict=True))))
            if asked:
                kinds = T.StructType([T.StructField(at, T.IntegerType()), *(T.StructField(n, df.schema[n].dataType) for n in names)])
                mine = self.source.spark.createDataFrame(asked, kinds)
                found.append(mine.join(df.select(*names), list(names), "left_semi").select(at, F.lit(",".join(names)).alias("key")))
        if found:
            for r in reduce(DataFrame.unionByName, found).collect():  # no more rows than were given, for each key
                out.setdefault(r[at], tuple(r["key"].split(",")))
        return out

    def create(self, model: Model, data: Mapping[str, Any]) -> dict[str, Any]:
        """Insert a row and what is nested in its data; the row."""
        scalars, owning, children = self._parted(model, data)
        row = with_defaults(model, scalars | self._owned(model, owning, False))
        self._free(model, [row])
        self._insert(model, [row])
        row = {f.name: None if row.get(f.name) is None else stored(f, row[f.name]) for f in model.scalars}
        self._children(children, row)
        return row

    def _free(self, model: Model, rows: list[dict[str, Any]]) -> None:
        for k, names in self._taken(model, rows).items():
            raise UniqueConstraintError(f"{model.name} already has {', '.join(names)} = {[rows[k][n] for n in names]}")

    def create_many(self, model: Model, data: list[Mapping[str, Any]], skip_duplicates: bool = False) -> DataFrame:
        """Insert rows of scalar values as one table; the rows that were inserted.

        A row that repeats a key, of the table or of an earlier row, raises; with
        skip_duplicates it is left out.
        """
        rows = []
        for d in data:
            scalars, owning, children = self._parted(model, d)
            if owning or children:
                raise QueryValidationError("createMany takes no nested writes")
            rows.append(with_defaults(model, scalars))
        if skip_duplicates:
            taken = self._taken(model, rows)
            rows = [r for k, r in enumerate(rows) if k not in taken]
        else:
            self._free(model, rows)
        return self._insert(model, rows) if rows else self.source.frame(model).limit(0)

    # -- updates ------------------------------------------------------------

    def _assigned(self, model: Model, df: DataFrame, data: Mapping[str, Any]) -> dict[str, Column]:
        out = {}
        for name, value in data.items():
            field = model.field(name)
            kind = df.schema[name].dataType
            atomic = isinstance(value, Mapping) and field.type != "Json" and next((op for op in ATOMIC if op in value), None)
            if atomic == "set":
                value, atomic = value["set"], None
            out[name] = self._arithmetic(field, atomic, value[atomic]).cast(kind) if atomic else _constant(field, value).cast(kind)
        return out

    @staticmethod
    def _arithmetic(field: Field, op: str, by: Any) -> Column:
        if field.type not in NUMERIC:
            raise QueryValidationError(f"{op} on {field.name}, which isn't a number")
        col, by_ = F.col(field.name), F.lit(by)
        if op == "divide" and field.type in ("Int", "BigInt") and isinstance(by, int):
            return F.expr(f"`{field.name}` div {by}")
        return {"increment": col + by_, "decrement": col - by_, "multiply": col * by_, "divide": col / by_}[op]

    def _apply(self, model: Model, where: Mapping | None, data: Mapping[str, Any]) -> None:
        """One pass over the table: rows for which the condition is null stay as they are, too."""
        if not data:
            return
        df = self.source.frame(model).alias("t0")
        cond = Filter(self.source).where(model, "t0", where)
        new = self._assigned(model, df, data)
        if cond is not None:
            hit = fresh("_hit", df.columns)
            df = df.withColumn(hit, F.coalesce(cond, F.lit(False)))
            new = {n: F.when(F.col(hit), c).otherwise(F.col(n)) for n, c in new.items()}
        self.source.put(model, df.select(*(new.get(f.name, F.col(f.name)).alias(f.name) for f in model.scalars)))

    def update(self, model: Model, where: Mapping, data: Mapping[str, Any]) -> dict[str, Any]:
        """Update the row that `where` finds and what is nested; its key afterwards."""
        row = self.first(model, where)
        if row is None:
            raise RecordNotFoundError(f"{model.name} to update")
        scalars, owning, children = self._parted(model, data)
        values = stamped(model, scalars | self._owned(model, owning, True)) if scalars or owning else {}
        self._apply(model, self.key(model, row), values)
        plain = {n: v["set"] if isinstance(v, Mapping) and "set" in v else v for n, v in values.items() if n in model.id_fields}
        key = self.key(model, row | plain)
        if children:
            self._children(children, self.first(model, key))
        return key

    def update_many(self, model: Model, where: Mapping | None, data: Mapping[str, Any]) -> int:
        scalars, owning, children = self._parted(model, data)
        if owning or children:
            raise QueryValidationError("updateMany takes no nested writes")
        n = self.matching(model, where).count()
        self._apply(model, where, stamped(model, scalars) if scalars else {})
        return n

    # -- deletes ------------------------------------------------------------

    def delete_many(self, model: Model, where: Mapping | None) -> int:
        gone = self.matching(model, where)
        n = gone.count()
        if n:
            kept = self._rest(model, where)
            self._follow(model, gone)
            self.source.put(model, kept)
        return n

    def _follow(self, model: Model, gone: DataFrame) -> None:
        """What references to deleted rows ask for: Cascade and SetNull."""
        for child in self.schema.models:
            for f in child.fields:
                if f.kind != "object" or f.type != model.name or not f.relation or f.relation.on_delete not in ("Cascade", "SetNull"):
                    continue
                join = resolve(self.schema, child, f.name)
                df = self.source.frame(child)
                names = [fresh(f"_{o}", df.columns) for o in join.other]
                keys = gone.select(*(F.col(o).alias(n) for o, n in zip(join.other, names, strict=True))).distinct()
                same = [df[k] == keys[n] for k, n in zip(join.own, names, strict=True)]
                left, hit = df.join(keys, same, "left_anti"), df.join(keys, same, "left_semi")
                if f.relation.on_delete == "Cascade":
                    if child.name != model.name:
                        self._follow(child, hit)
                    self.source.put(child, left)
                else:
                    self.source.put(child, left.unionByName(hit.withColumns({k: F.lit(None).cast(df.schema[k].dataType) for k in join.own})))

    # -- children -----------------------------------------------------------

    def _children(self, children: list, parent: Mapping[str, Any]) -> None:
        """create, connect, set, disconnect, delete and connectOrCreate of rows that refer to parent, in this order.

        connect, disconnect and delete choose by their own filter, whoever's children it finds.
        """
        for join, value in children:
            ref = {o: parent[k] for k, o in zip(join.own, join.other, strict=True)}
            none = dict.fromkeys(ref)
            for data in _listed(value.get("create")):
                self.create(join.target, {**data, **ref})
            for w in _listed(value.get("connect")):
                self._apply(join.target, w, ref)
            if "set" in value:
                self._apply(join.target, ref, none)
                for w in _listed(value["set"]):
                    self._apply(join.target, w, ref)
            for w in _listed(value.get("disconnect")):
                self._apply(join.target, ref if w is True else w, none)
            for w in _listed(value.get("delete")):
                self.delete_many(join.target, w)
            for both in _listed(value.get("connectOrCreate")):
                if self.first(join.target, both["where"]) is None:
                    self.create(join.target, {**both["create"], **ref})
                else:
                    self._apply(join.target, both["where"], ref)


