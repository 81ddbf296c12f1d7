"""How relation fields join their models."""

from __future__ import annotations

from dataclasses import dataclass, replace

from ..errors import QueryValidationError
from .document import Field, Model, Relation, Schema


@dataclass(frozen=True)
class Join:
    """own fields of the model equal other fields of the target; owns: the model holds the reference."""

    target: Model
    own: tuple[str, ...]
    other: tuple[str, ...]
    is_list: bool
    owns: bool


def _partner(schema: Schema, model: Model, field: Field) -> Field | None:
    """The field of the other model that is the other end of the same relation."""
    target = schema.model(field.type)
    ends = [f for f in target.fields if f.type == model.name and f.kind == "object" and not (target.name == model.name and f.name == field.name)]
    name = field.relation and field.relation.name
    named = [f for f in ends if (f.relation and f.relation.name) == name]
    return next((f for f in named or ends if f.relation and f.relation.fields), None) or next(iter(named or ends), None)


def resolve(schema: Schema, model: Model, name: str) -> Join:
    """The join of a relation field: by its own references, its partner's, or key to key."""
    field = model.field(name)
    if field is None or field.kind != "object":
        raise QueryValidationError(f"{model.name}.{name} is not a relation")
    target = schema.model(field.type)
    if field.relation and field.relation.fields:
        return _checked(model, Join(target, field.relation.fields, field.relation.references or target.id_fields, field.is_list, True))
    partner = _partner(schema, model, field)
    if partner and partner.relation and partner.relation.fields:
        return _checked(model, Join(target, partner.relation.references or model.id_fields, partner.relation.fields, field.is_list, False))
    return _checked(model, Join(target, model.id_fields, target.id_fields, field.is_list, False))


def _checked(model: Model, join: Join) -> Join:
    for m, names in ((model, join.own), (join.target, join.other)):
        missing = [n for n in names if m.field(n) is None]
        if missing:
            raise QueryValidationError(f"{m.name} has no field {missing[0]}, by which a relation joins it")
    if not join.own or len(join.own) != len(join.other):
        raise QueryValidationError(f"a relation of {model.name} joins {len(join.own)} fields with {len(join.other)}")
    return join


def inverse(schema: Schema, model: Model, name: str) -> Field | None:
    """The field of the target that leads back."""
    field = model.field(name)
    return _partner(schema, model, field) if field and field.kind == "object" else None


def _lower(name: str) -> str:
    return name[:1].lower() + name[1:]


def complete(schema: Schema) -> Schema:
    """The schema with the missing ends of relations added; complete ones stay as they are."""
    for m in schema.models:
        for f in m.fields:
            if f.kind != "object" or schema.model(f.type) is None or _partner(schema, m, f):
                continue
            target = schema.model(f.type)
            name = f.relation and f.relation.name
            if f.is_list:  # its other end refers to this model's key
                own = tuple(_lower(m.name) + k[:1].upper() + k[1:] for k in m.id_fields)
                keys = tuple(replace(m.field(k), name=n, is_id=False, unique=False, default=None, column=None) for n, k in zip(own, m.id_fields, strict=True) if target.field(n) is None)
                added = (*keys, Field(_lower(m.name), m.name, kind="object", relation=Relation(name, own, m.id_fields)))
            else:
                single = bool(f.relation) and len(f.relation.fields) == 1 and m.field(f.relation.fields[0]) is not None and m.field(f.relation.fields[0]).unique
                back = _lower(m.name) if single else _lower(m.name) + ("es" if m.name.endswith(("s", "x", "ch", "sh")) else "s")
                added = (Field(back, m.name, optional=single, is_list=not single, kind="object", relation=Relation(name) if name else None),)
            taken = {g.name for g in target.fields}
            target = replace(target, fields=(*target.fields, *(g for g in added if g.name not in taken)))
            schema = replace(schema, models=tuple(target if x.name == target.name else x for x in schema.models))
            return complete(schema) if all(g.name not in taken for g in added) else schema
    return schema
