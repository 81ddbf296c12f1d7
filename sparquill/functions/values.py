"""Values of arguments as what their fields hold: checked before any plan is made."""

from __future__ import annotations

import math
from datetime import UTC, date, datetime
from decimal import Decimal, InvalidOperation
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryValidationError
from ..schema.document import Field
from .json_text import json_text

_BITS = {T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}


def _wrong(field: Field, value: Any) -> QueryValidationError:
    return QueryValidationError(f"{field.name} is a {field.type}, which {value!r} is not")


def _number(field: Field, value: Any) -> int | float | Decimal:
    if isinstance(value, bool) or not isinstance(value, (int, float, Decimal)):
        if field.type != "Decimal" or not isinstance(value, str):
            raise _wrong(field, value)
        try:
            value = Decimal(value)
        except InvalidOperation:
            raise _wrong(field, value) from None
    if isinstance(value, (float, Decimal)) and (math.isnan(value) or math.isinf(value)):
        return float(value)
    return int(value) if value == int(value) and field.type in ("Int", "BigInt") else value


def _moment(field: Field, value: Any) -> datetime | date:
    if isinstance(value, str):
        try:
            value = datetime.fromisoformat(value)
        except ValueError:
            raise _wrong(field, value) from None
    if not isinstance(value, date):
        raise _wrong(field, value)
    if isinstance(value, datetime) and value.tzinfo:
        value = value.astimezone(UTC).replace(tzinfo=None)
    return value


def plain(field: Field, value: Any) -> Any:
    """The value as Python has it: numbers, naive UTC datetimes, text, bytes; wrong kinds raise."""
    if value is None:
        return None
    if field.kind == "enum" or field.type == "String":
        if not isinstance(value, str):
            raise _wrong(field, value)
        return value
    if field.type == "Json":
        return value if isinstance(value, str) else json_text(value)
    if field.type == "Boolean":
        if not isinstance(value, bool):
            raise _wrong(field, value)
        return value
    if field.type == "DateTime":
        return _moment(field, value)
    if field.type == "Bytes":
        if not isinstance(value, (bytes, bytearray)):
            raise _wrong(field, value)
        return bytes(value)
    return _number(field, value)


def _fits(field: Field, value: Any) -> bool:
    """Whether a field's type holds a plain value as it is."""
    kind = field.spark_type
    if type(kind) in _BITS:
        return isinstance(value, int) and -(1 << _BITS[type(kind)]) <= value < 1 << _BITS[type(kind)]
    if isinstance(kind, T.DecimalType):
        exact = Decimal(str(value)) if not isinstance(value, Decimal) else value
        return exact.is_finite() and abs(exact) < Decimal(10) ** (kind.precision - kind.scale) and exact == round(exact, kind.scale)
    if isinstance(kind, T.DateType):
        return not isinstance(value, datetime) or value.time() == datetime.min.time()
    return True


def literal(field: Field, value: Any) -> Column:
    """A value to compare with a field: a literal of the field's type, or of a wider one if that can't hold it exactly."""
    value = plain(field, value)
    kind = field.spark_type
    if value is None or isinstance(value, (str, bool, bytes)):
        return F.lit(value).cast(kind)
    if isinstance(value, date):  # as text, so the session's zone doesn't matter
        text = F.lit(value.isoformat())
        return text.cast("date" if isinstance(kind, T.DateType) and not isinstance(value, datetime) else "timestamp_ntz")
    if isinstance(kind, T.DoubleType | T.FloatType):
        return F.lit(float(value)).cast(kind)
    if _fits(field, value):
        return F.lit(Decimal(str(value)) if isinstance(kind, T.DecimalType) else value).cast(kind)
    if isinstance(value, float) and not math.isfinite(value):
        return F.lit(value)
    exact = Decimal(str(value))
    digits = exact.adjusted() + 1
    if digits > 30 or exact.as_tuple().exponent < -(38 - max(digits, 20)):
        return F.lit(float(value))
    return F.lit(exact)


def stored(field: Field, value: Any) -> Any:
    """A value to write into a field; one that its type can't hold raises."""
    value = plain(field, value)
    kind = field.spark_type
    if value is None:
        return None
    if isinstance(kind, T.DecimalType) and isinstance(value, (int, float, Decimal)) and math.isfinite(value):
        value = round(Decimal(str(value)), kind.scale)
    if not _fits(field, value):
        raise QueryValidationError(f"{field.name} can't hold {value!r}")
    if isinstance(kind, T.DoubleType | T.FloatType):
        return float(value)
    if isinstance(kind, T.DateType):
        return value.date() if isinstance(value, datetime) else value
    if isinstance(kind, T.TimestampNTZType) and not isinstance(value, datetime):
        return datetime(value.year, value.month, value.day)
    return value
