"""The parts of a schema document."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

#: The scalar types and what they are in Spark.
SCALARS = {
    "String": T.StringType(),
    "Boolean": T.BooleanType(),
    "Int": T.IntegerType(),
    "BigInt": T.LongType(),
    "Float": T.DoubleType(),
    "Decimal": T.DecimalType(18, 4),
    "DateTime": T.TimestampNTZType(),
    "Bytes": T.BinaryType(),
    "Json": T.StringType(),
}
NUMERIC = frozenset(("Int", "BigInt", "Float", "Decimal"))


@dataclass(frozen=True)
class Default:
    """A literal, or a function's name: now, uuid, cuid, autoincrement."""

    value: Any = None
    function: str | None = None


@dataclass(frozen=True)
class Relation:
    """name, the own fields that refer, the other model's fields that they refer to, and actions."""

    name: str | None = None
    fields: tuple[str, ...] = ()
    references: tuple[str, ...] = ()
    on_delete: str | None = None
    on_update: str | None = None


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    optional: bool = False
    is_list: bool = False
    kind: str = "scalar"  # scalar, enum or object (another model)
    column: str | None = None
    is_id: bool = False
    unique: bool = False
    updated_at: bool = False
    default: Default | None = None
    relation: Relation | None = None
    native: tuple[str, tuple] | None = None
    doc: str | None = None

    @property
    def db_name(self) -> str:
        return self.column or self.name

    @property
    def spark_type(self) -> T.DataType:
        name, args = self.native or (None, ())
        special = {"SmallInt": T.ShortType(), "Float": T.FloatType(), "Date": T.DateType()}
        if self.type == "Decimal" and args:
            return T.DecimalType(int(args[0]), int(args[1]) if len(args) > 1 else 0)
        return special.get(name) or SCALARS.get(self.type, T.StringType())


@dataclass(frozen=True)
class Key:
    """Fields of a composite key, unique constraint or index."""

    fields: tuple[str, ...]
    name: str | None = None


@dataclass(frozen=True)
class Model:
    name: str
    fields: tuple[Field, ...]
    table: str | None = None
    key: Key | None = None
    uniques: tuple[Key, ...] = ()
    indexes: tuple[Key, ...] = ()
    doc: str | None = None

    @property
    def db_name(self) -> str:
        return self.table or self.name

    def field(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    @property
    def scalars(self) -> tuple[Field, ...]:
        return tuple(f for f in self.fields if f.kind != "object")

    @property
    def id_fields(self) -> tuple[str, ...]:
        return self.key.fields if self.key else tuple(f.name for f in self.fields if f.is_id)


@dataclass(frozen=True)
class Enum:
    name: str
    values: tuple[str, ...]
    columns: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Schema:
    models: tuple[Model, ...] = ()
    enums: tuple[Enum, ...] = ()
    datasource: dict[str, Any] = field(default_factory=dict)
    generators: tuple[tuple[str, dict[str, Any]], ...] = ()

    def model(self, name: str) -> Model | None:
        return next((m for m in self.models if m.name == name), None)

    def enum(self, name: str) -> Enum | None:
        return next((e for e in self.enums if e.name == name), None)

    def with_kinds(self) -> Schema:
        """The same document with every field's kind taken from the types declared in it."""
        kind = lambda t: "enum" if self.enum(t) else "object" if self.model(t) else "scalar"
        return replace(self, models=tuple(replace(m, fields=tuple(replace(f, kind=kind(f.type)) for f in m.fields)) for m in self.models))
