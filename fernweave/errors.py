"""Errors that callers may tell apart."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all errors raised on purpose."""


class SchemaError(EngineError):
    """A schema text that can't be resolved."""


class UnknownModel(EngineError):
    """No such model or action."""


class UnknownField(EngineError):
    """A strict projection names a field that the model lacks."""


class NotAnObject(EngineError):
    """A document or an embedded struct is no JSON object."""


class EmptyObject(EngineError):
    """A document that names no declared field."""


class TypeMismatch(EngineError):
    def __init__(self, field: str, expected: str) -> None:
        super().__init__(f"{field}: expected {expected}")
        self.field, self.expected = field, expected


class IdRequired(EngineError):
    """An update or delete without an unsigned id."""


class ForeignKeyViolation(EngineError):
    def __init__(self, field: str, id_: int) -> None:
        super().__init__(f"{field}: no row with id {id_}")
        self.field, self.id = field, id_


class ItemNotFound(EngineError):
    def __init__(self, id_: int) -> None:
        super().__init__(f"no row with id {id_}")
        self.id = id_


class DerivedFieldReadOnly(EngineError):
    """A list derived from a foreign key changes only through that key."""


class RestrictedDelete(EngineError):
    """Other rows refer to a row that was to go."""


class ConcurrentModification(EngineError):
    """Another writer has committed the version that this one was to be."""
