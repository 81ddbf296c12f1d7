"""Versions of tables. A write makes a new DataFrame; files are never changed."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator, Mapping
from contextvars import ContextVar
from datetime import UTC, datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import stored
from ..schema.document import Model, Schema

_open: ContextVar[dict[int, dict[str, DataFrame]] | None] = ContextVar("transactions", default=None)


class Snapshots:
    """The current version of every table, and in a transaction its own versions.

    There is one writer. A transaction sees its own writes; others see them when it
    ends well, all at once.
    """

    def __init__(self, spark: SparkSession, schema: Schema, read: Callable[[str], DataFrame] | Mapping[str, DataFrame]):
        self.spark, self.schema = spark, schema
        self.read = read if callable(read) else read.__getitem__
        self._current: dict[str, DataFrame] = {}

    def _versions(self) -> dict[str, DataFrame]:
        return (_open.get() or {}).get(id(self), self._current)

    def frame(self, model: Model) -> DataFrame:
        """The table of a model with its fields' names."""
        own = self._versions()
        if model.name not in own:
            df = self.read(model.db_name)
            own[model.name] = df.select(*(F.col(f"`{f.db_name}`").alias(f.name) for f in model.scalars))
        return own[model.name]

    def put(self, model: Model, df: DataFrame) -> None:
        self._versions()[model.name] = df

    @contextlib.contextmanager
    def transaction(self) -> Iterator[None]:
        """Writes within take effect together, or not at all; an inner transaction joins the outer."""
        outer = _open.get() or {}
        if id(self) in outer:
            yield
            return
        own = dict(self._current)
        token = _open.set(outer | {id(self): own})
        try:
            yield
            self._current = own
        finally:
            _open.reset(token)

    def save(self, folder: str, models: list[str] | None = None) -> None:
        """Write current versions as Parquet into a folder, with their columns' names, and go on from there.

        That also ends the lineage of many writes.
        """
        for m in self.schema.models:
            if models is None or m.name in models:
                path = f"{folder.rstrip('/')}/{m.db_name}.parquet"
                self.frame(m).select(*(F.col(f.name).alias(f.db_name) for f in m.scalars)).write.mode("errorifexists").parquet(path)
                df = self.spark.read.parquet(path)
                self.put(m, df.select(*(F.col(f"`{f.db_name}`").alias(f.name) for f in m.scalars)))


def typed_rows(spark: SparkSession, df: DataFrame, model: Model, rows: list[Mapping[str, Any]]) -> DataFrame:
    """Rows of values as one local table with the columns and types of df."""
    fields = [model.field(f.name) for f in df.schema]
    values = [tuple(None if f is None or r.get(f.name) is None else as_held(stored(f, r[f.name]), c.dataType) for f, c in zip(fields, df.schema, strict=True)) for r in rows]
    return spark.createDataFrame(values, T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema]))


def as_held(value: Any, kind: T.DataType) -> Any:
    """A value in the form that a column of a table takes, whose type may be another than the declared one."""
    if isinstance(kind, T.DoubleType | T.FloatType):
        return float(value)
    if isinstance(kind, T.DecimalType):
        return round(Decimal(str(value)), kind.scale)
    if isinstance(kind, T.IntegralType):
        return int(value)
    if isinstance(kind, T.BinaryType):
        return bytearray(value)
    if isinstance(kind, T.DateType) and isinstance(value, datetime):
        return value.date()
    if isinstance(kind, T.TimestampType):
        return value.replace(tzinfo=UTC)
    return str(value) if isinstance(kind, T.StringType) else value
