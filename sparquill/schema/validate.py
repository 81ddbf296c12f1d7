"""Faults of a schema document, all at once."""

from __future__ import annotations

from ..errors import SchemaError
from .document import SCALARS, Schema


def faults(schema: Schema) -> list[str]:
    out: list[str] = []
    seen: set[str] = set()
    for m in schema.models:
        if m.name in seen:
            out.append(f"model {m.name} is declared twice")
        seen.add(m.name)
        names = [f.name for f in m.fields]
        out += [f"{m.name}.{n} is declared twice" for n in dict.fromkeys(names) if names.count(n) > 1]
        for f in m.fields:
            if f.type not in SCALARS and not schema.enum(f.type) and not schema.model(f.type):
                out.append(f"{m.name}.{f.name} has an unknown type {f.type}")
            if f.relation:
                out += [f"{m.name}.{f.name} refers by {n}, which {m.name} doesn't have" for n in f.relation.fields if n not in names]
        if m.key:
            out += [f"the key of {m.name} has {n}, which isn't one of its fields" for n in m.key.fields if n not in names]
        if not m.id_fields:
            out.append(f"model {m.name} has no key")
    return out + [f"enum {e.name} has no values" for e in schema.enums if not e.values]


def validate(schema: Schema) -> Schema:
    """The schema itself if it has no faults; else a SchemaError with all of them."""
    found = faults(schema)
    if found:
        raise SchemaError("; ".join(found), tuple(found))
    return schema
