"""The stateless part of the queries on streams: filters and projections of a model's rows."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..client import Client
from ..errors import QueryValidationError
from ..operators.read import projection
from ..operators.where import Filter


def find_in_stream(client: Client, model: str, stream: DataFrame, where: Mapping[str, Any] | None = None, select: Mapping[str, Any] | None = None, omit: Mapping[str, Any] | None = None) -> DataFrame:
    """Rows of a stream of a model's table that a filter chooses, as a stream.

    Filters on related rows are joins of the stream with the tables as they are when a
    batch begins. What needs all rows (order, pages, distinct, includes) raises.
    """
    m = client.schema.model(model)
    if m is None:
        raise QueryValidationError(f"no model {model}")
    rows = stream.select(*(F.col(f"`{f.db_name}`").alias(f.name) for f in m.scalars)).alias("t0")
    cond = Filter(client.source).where(m, "t0", where)
    scalars, relations, count = projection(m, {"select": select, "omit": omit})
    if relations or count:
        raise QueryValidationError("a stream has no related rows in its result")
    return (rows if cond is None else rows.where(cond)).select(*scalars)
