"""Readers of tables by the URL of a data source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..errors import ModelError


def open_source(spark: SparkSession, url: str, **options: str) -> Callable[[str], DataFrame]:
    """A function from a table's name to its DataFrame.

    parquet:/dir, orc:/dir, json:/dir, csv:/dir   /dir/NAME.EXT, a file or a folder
    table:database                                a table of the catalog
    jdbc:...                                      a table behind JDBC, with options
    """
    kind, _, place = url.partition(":")
    if kind in ("parquet", "orc", "json", "csv"):
        given = {"header": "true"} | options if kind == "csv" else options
        return lambda name: spark.read.format(kind).options(**given).load(f"{place.rstrip('/')}/{name}.{kind}")
    if kind == "table":
        return lambda name: spark.table(f"{place}.{name}" if place else name)
    if kind == "jdbc":
        return lambda name: spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()
    raise ModelError(f"unknown data source {url!r}")
