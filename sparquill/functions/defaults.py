"""Values that a new row gets where none is given."""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping
from datetime import UTC, datetime
from itertools import count
from typing import Any

from ..schema.document import Model

_serial = count()
_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


def _base36(n: int) -> str:
    out = ""
    while n or not out:
        n, k = divmod(n, 36)
        out = _DIGITS[k] + out
    return out


def cuid() -> str:
    """A collision-resistant id: time, a counter, randomness, all in base 36."""
    return "c" + _base36(time.time_ns() // 1_000_000) + _base36(next(_serial) % 36**4).rjust(4, "0") + _base36(uuid.uuid4().int % 36**12).rjust(12, "0")


def now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


_FUNCTIONS = {"now": now, "uuid": lambda: str(uuid.uuid4()), "cuid": cuid}


def with_defaults(model: Model, data: Mapping[str, Any]) -> dict[str, Any]:
    """The data of a new row: defaults where a key is absent, an explicit None stays."""
    out = dict(data)
    for f in model.scalars:
        if f.name in out:
            continue
        if f.updated_at:
            out[f.name] = now()
        elif f.default is not None and f.default.function != "autoincrement":
            out[f.name] = _FUNCTIONS[f.default.function]() if f.default.function else f.default.value
    return out


def stamped(model: Model, data: Mapping[str, Any]) -> dict[str, Any]:
    """The data of an update: fields that keep its time, unless they are given."""
    return {f.name: now() for f in model.scalars if f.updated_at} | dict(data)


def is_generated(model: Model, name: str) -> bool:
    f = model.field(name)
    return f is not None and f.default is not None and f.default.function == "autoincrement"
