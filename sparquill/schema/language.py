"""The schema language: text to document and back."""

from __future__ import annotations

import json
import re
from dataclasses import replace
from typing import Any

from ..errors import SchemaError
from .document import Default, Enum, Field, Key, Model, Relation, Schema

_TOKEN = re.compile(
    r"""(?P<space>[\x20\t\r\n]+|//(?!/)[^\n]*|/\*.*?\*/)|(?P<doc>///[^\n]*)|(?P<word>[A-Za-z_]\w*)|(?P<number>-?\d[\d.]*)|(?P<string>"(?:[^"\\]|\\.)*")|(?P<mark>@@|[@{}()\[\]?=:,.])""",
    re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\"}


class _Reader:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str, int]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise SchemaError(f"line {text.count(chr(10), 0, at) + 1}: unexpected {text[at]!r}")
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m[0], text.count("\n", 0, at) + 1))
            at = m.end()
        self.at = 0

    def peek(self, value: str | None = None) -> Any:
        kind, text, _ = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "", 0)
        return (kind, text) if value is None else text == value and kind != "string"

    def take(self, expected: str | None = None, kind: str | None = None) -> str:
        found, text = self.peek()
        if expected not in (None, text) or kind not in (None, found) or found == "end":
            line = self.tokens[min(self.at, len(self.tokens) - 1)][2] if self.tokens else 1
            raise SchemaError(f"line {line}: expected {expected or kind or 'more'}, found {text or 'the end'}")
        self.at += 1
        return text

    def maybe(self, value: str) -> bool:
        if self.peek(value):
            self.at += 1
            return True
        return False

    def docs(self) -> str | None:
        lines = []
        while self.peek()[0] == "doc":
            lines.append(self.take()[3:].strip())
        return "\n".join(lines) or None

    def value(self) -> Any:
        kind, text = self.peek()
        if kind == "string":
            self.take()
            return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S)
        if kind == "number":
            self.take()
            return float(text) if "." in text else int(text)
        if self.maybe("["):
            out = []
            while not self.maybe("]"):
                out.append(self.value())
                self.maybe(",")
            return out
        word = self.take(kind="word")
        if self.peek("("):
            return Default(function=word) if not self.args() else (word, ())
        return {"true": True, "false": False, "null": None}.get(word, word)

    def args(self) -> dict[Any, Any]:
        """Arguments in parentheses, if any: by position and by name."""
        out: dict[Any, Any] = {}
        if self.maybe("("):
            while not self.maybe(")"):
                name: Any = len(out)
                if self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][1] == ":":
                    name = self.take(kind="word")
                    self.take(":")
                out[name] = self.value()
                self.maybe(",")
        return out


def _names(x: Any) -> tuple[str, ...]:
    return tuple(x) if isinstance(x, list) else (x,)


def _field(r: _Reader) -> Field:
    f = Field(r.take(kind="word"), r.take(kind="word"))
    while r.peek("[") or r.peek("?"):
        if r.maybe("?"):
            f = replace(f, optional=True)
        else:
            r.take("[")
            r.take("]")
            f = replace(f, is_list=True)
    while r.maybe("@"):
        name = r.take(kind="word")
        if name == "db":
            r.take(".")
            f = replace(f, native=(r.take(kind="word"), tuple(r.args().values())))
            continue
        args = r.args()
        first = args.get(0, args.get("name"))
        if name == "id":
            f = replace(f, is_id=True)
        elif name == "unique":
            f = replace(f, unique=True)
        elif name == "updatedAt":
            f = replace(f, updated_at=True)
        elif name == "default":
            f = replace(f, default=first if isinstance(first, Default) else Default(first))
        elif name == "map":
            f = replace(f, column=first)
        elif name == "relation":
            f = replace(f, relation=Relation(first if isinstance(first, str) else None, _names(args.get("fields", [])), _names(args.get("references", [])), args.get("onDelete"), args.get("onUpdate")))
        else:
            raise SchemaError(f"unknown attribute @{name} of {f.name}")
    return f


def _model(r: _Reader, doc: str | None) -> Model:
    m = Model(r.take(kind="word"), (), doc=doc)
    r.take("{")
    fields, uniques, indexes = [], [], []
    while not r.maybe("}"):
        said = r.docs()
        if r.peek("}"):
            continue
        if not r.maybe("@@"):
            fields.append(replace(_field(r), doc=said))
            continue
        name, args = r.take(kind="word"), r.args()
        key = Key(_names(args.get(0, args.get("fields", []))), args.get("name") or args.get("map"))
        if name == "id":
            m = replace(m, key=key)
        elif name == "unique":
            uniques.append(key)
        elif name == "index":
            indexes.append(key)
        elif name == "map":
            m = replace(m, table=args.get(0, args.get("name")))
        else:
            raise SchemaError(f"unknown attribute @@{name} of {m.name}")
    return replace(m, fields=tuple(fields), uniques=tuple(uniques), indexes=tuple(indexes))


def _settings(r: _Reader) -> dict[str, Any]:
    out = {}
    r.take("{")
    while not r.maybe("}"):
        name = r.take(kind="word")
        r.take("=")
        out[name] = r.value()
    return out


def _enum(r: _Reader) -> Enum:
    name, values, columns = r.take(kind="word"), [], {}
    r.take("{")
    while not r.maybe("}"):
        r.docs()
        values.append(r.take(kind="word"))
        if r.maybe("@"):
            r.take("map")
            columns[values[-1]] = r.args()[0]
    return Enum(name, tuple(values), columns)


def parse(text: str) -> Schema:
    """A schema text as a document. Faults in the text raise SchemaError with their line."""
    r = _Reader(text)
    models, enums, generators, datasource = [], [], [], {}
    while r.at < len(r.tokens):
        doc = r.docs()
        if r.at == len(r.tokens):
            break
        block = r.take(kind="word")
        if block == "model":
            models.append(_model(r, doc))
        elif block == "enum":
            enums.append(_enum(r))
        elif block == "generator":
            generators.append((r.take(kind="word"), _settings(r)))
        elif block == "datasource":
            r.take(kind="word")
            datasource = _settings(r)
        else:
            raise SchemaError(f"unknown block {block}")
    return Schema(tuple(models), tuple(enums), datasource, tuple(generators)).with_kinds()


def _said(x: Any) -> str:
    if isinstance(x, Default):
        return f"{x.function}()" if x.function else _said(x.value)
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(str, x)) + "]"
    return json.dumps(x, ensure_ascii=False)


def _attributes(f: Field, enum: bool) -> str:
    out = []
    if f.is_id:
        out.append("@id")
    if f.unique:
        out.append("@unique")
    if f.updated_at:
        out.append("@updatedAt")
    if f.default is not None:
        out.append(f"@default({f.default.value if enum and f.default.function is None else _said(f.default)})")
    if f.column:
        out.append(f"@map({_said(f.column)})")
    if f.relation:
        rel = f.relation
        parts = [_said(rel.name)] * bool(rel.name) + [f"fields: {_said(rel.fields)}", f"references: {_said(rel.references)}"] * bool(rel.fields)
        parts += [f"onDelete: {rel.on_delete}"] * bool(rel.on_delete) + [f"onUpdate: {rel.on_update}"] * bool(rel.on_update)
        out.append(f"@relation({', '.join(parts)})")
    if f.native:
        out.append(f"@db.{f.native[0]}" + f"({', '.join(map(str, f.native[1]))})" * bool(f.native[1]))
    return " ".join(out)


def render(schema: Schema) -> str:
    """The text of a document, in columns; parsing it gives the same document."""
    blocks = []
    if schema.datasource:
        blocks.append("datasource db {\n" + "".join(f"  {k} = {_said(v)}\n" for k, v in schema.datasource.items()) + "}\n")
    blocks += [f"generator {name} {{\n" + "".join(f"  {k} = {_said(v)}\n" for k, v in given.items()) + "}\n" for name, given in schema.generators]
    blocks += [f"enum {e.name} {{\n" + "".join(f"  {v}" + f" @map({_said(e.columns.get(v))})" * (v in e.columns) + "\n" for v in e.values) + "}\n" for e in schema.enums]
    for m in schema.models:
        kind = lambda f: f.type + "[]" * f.is_list + "?" * f.optional
        wide, wider = (max((len(x(f)) for f in m.fields), default=0) for x in (lambda f: f.name, kind))
        lines = []
        for f in m.fields:
            lines += [f"  /// {said}" for said in (f.doc or "").split("\n") if said]
            lines.append(f"  {f.name:<{wide}} {kind(f):<{wider}} {_attributes(f, f.kind == 'enum')}".rstrip())
        extra = [f"  @@id({_said(k.fields)})" for k in (m.key,) if k] + [f"  @@unique({_said(k.fields)})" for k in m.uniques] + [f"  @@index({_said(k.fields)})" for k in m.indexes]
        extra += [f"  @@map({_said(m.table)})"] * bool(m.table)
        blocks.append("".join(f"/// {s}\n" for s in (m.doc or "").split("\n") if s) + f"model {m.name} {{\n" + "\n".join(lines + ([""] + extra if extra else [])) + "\n}\n")
    return "\n".join(blocks)
