"""Errors that this library raises."""


class ModelError(Exception):
    """The parent of all of them."""


class SchemaError(ModelError):
    """A schema text that can't be read, or a document with faults (all in `faults`)."""

    def __init__(self, message: str, faults: tuple[str, ...] = ()):
        super().__init__(message)
        self.faults = faults


class QueryValidationError(ModelError):
    """Arguments that don't fit the schema."""


class RecordNotFoundError(ModelError):
    """A row that has to exist doesn't."""


class UniqueConstraintError(ModelError):
    """A write that would repeat a key."""
