"""Schema documents from tables that exist: their StructTypes, and what is known of keys and references."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import SchemaError
from .document import Field, Key, Model, Relation, Schema
from .relations import complete
from .validate import validate


@dataclass(frozen=True)
class Reference:
    """Columns of a table that hold the key of a row of another one."""

    table: str
    columns: tuple[str, ...]
    to: str
    to_columns: tuple[str, ...]


_TYPES = {T.StringType: "String", T.BooleanType: "Boolean", T.ByteType: "Int", T.ShortType: "Int", T.IntegerType: "Int", T.LongType: "BigInt", T.FloatType: "Float", T.DoubleType: "Float", T.DecimalType: "Decimal", T.DateType: "DateTime", T.TimestampType: "DateTime", T.TimestampNTZType: "DateTime", T.BinaryType: "Bytes"}


def _native(kind: T.DataType) -> tuple[str, tuple] | None:
    if isinstance(kind, T.DecimalType):
        return "Decimal", (kind.precision, kind.scale)
    return {T.ShortType: ("SmallInt", ()), T.FloatType: ("Float", ()), T.DateType: ("Date", ())}.get(type(kind))


def _words(name: str) -> list[str]:
    return [w for w in re.split(r"[^A-Za-z0-9]+", name if name != name.upper() else name.lower()) if w]


def model_name(table: str) -> str:
    return "".join(w[:1].upper() + w[1:] for w in _words(table)) or "Model"


def field_name(column: str) -> str:
    first, *more = _words(column) or ["field"]
    return first[:1].lower() + first[1:] + "".join(w[:1].upper() + w[1:] for w in more)


def _names(given: Iterable[str], make) -> dict[str, str]:
    """A name for each, by `make`; those that would be equal get numbers."""
    out: dict[str, str] = {}
    for name in given:
        own, k = make(name), 2
        while own in out.values():
            own, k = f"{make(name)}{k}", k + 1
        out[name] = own
    return out


def introspect(tables: Mapping[str, DataFrame | T.StructType], keys: Mapping[str, Iterable[str]] | None = None, uniques: Mapping[str, Iterable[Iterable[str]]] | None = None, references: Iterable[Reference] = ()) -> Schema:
    """A schema document with a model for each table; names are mapped where they differ.

    Columns that may be null are optional, but not those of a key. Arrays, maps and
    structs are Json. References become relations with both ends. A table without a key
    gets all its columns as key if it has none that could be one: tables of files say
    nothing about keys, so give them.
    """
    models = _names(tables, model_name)
    fields = {}
    built = []
    for table, given in tables.items():
        schema = given if isinstance(given, T.StructType) else given.schema
        fields[table] = _names(schema.fieldNames(), field_name)
        key = list((keys or {}).get(table, ()))
        own_uniques = [tuple(u) for u in (uniques or {}).get(table, ())]
        for c in [*key, *(c for u in own_uniques for c in u)]:
            if c not in fields[table]:
                raise SchemaError(f"{table} has no column {c}")
        single = {u[0] for u in own_uniques if len(u) == 1}
        made = tuple(
            Field(fields[table][c.name], _TYPES.get(type(c.dataType), "Json"), optional=c.nullable and c.name not in key, column=c.name if c.name != fields[table][c.name] else None, is_id=key == [c.name], unique=c.name in single, native=_native(c.dataType))
            for c in schema
        )
        composite = tuple(fields[table][c] for c in (key or schema.fieldNames())) if len(key) != 1 else ()
        built.append(Model(models[table], made, table=table if table != models[table] else None, key=Key(composite) if composite else None, uniques=tuple(Key(tuple(fields[table][c] for c in u)) for u in own_uniques if len(u) > 1)))
    by_table = dict(zip(tables, built, strict=True))
    for r in references:
        own, target = by_table[r.table], by_table[r.to]
        name, k = target.name[:1].lower() + target.name[1:], 2
        base = name
        while own.field(name):
            name, k = f"{base}{k}", k + 1
        held = tuple(fields[r.table][c] for c in r.columns)
        label = f"{r.table}_{'_'.join(r.columns)}" if sum(x.table == r.table and x.to == r.to for x in references) > 1 else None
        optional = any(own.field(f).optional for f in held)
        by_table[r.table] = replace(own, fields=(*own.fields, Field(name, target.name, optional=optional, kind="object", relation=Relation(label, held, tuple(fields[r.to][c] for c in r.to_columns)))))
    return validate(complete(Schema(tuple(by_table.values())).with_kinds()))


def catalog_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """What the catalog knows: a row per column of its tables: table, column, type, nullable, position."""
    rows = []
    for t in spark.catalog.listTables(database):
        name = f"{database}.{t.name}" if database and not t.isTemporary else t.name
        rows += [(t.name, c.name, c.dataType.simpleString(), c.nullable, k) for k, c in enumerate(spark.table(name).schema)]
    return spark.createDataFrame(rows, "table string, column string, type string, nullable boolean, position int")


def introspect_catalog(spark: SparkSession, database: str | None = None, **known) -> Schema:
    """introspect() over the tables of a database of the catalog."""
    tables = {t.name: spark.table(f"{database}.{t.name}" if database and not t.isTemporary else t.name) for t in spark.catalog.listTables(database)}
    return introspect(tables, **known)
