"""Schema documents: models, fields, relations; read from text or from DataFrames."""

from .document import Default, Enum, Field, Key, Model, Relation, Schema
from .language import parse
from .relations import complete, resolve
from .validate import validate

__all__ = ["Default", "Enum", "Field", "Key", "Model", "Relation", "Schema", "complete", "load", "parse", "resolve", "validate"]


def load(text: str) -> Schema:
    """Parse, complete and validate a schema text."""
    return validate(complete(parse(text)))
