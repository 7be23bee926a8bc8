"""Errors. path is the dotted way to the field, from the outermost record."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any


class RowweaveError(ValueError):
    """Base of all errors of this package."""


class SchemaError(RowweaveError):
    """A schema that can't be parsed, built or mapped."""


class CompatibilityError(RowweaveError):
    """A reader schema that can't read what a writer schema wrote."""

    def __init__(self, path: str, reader: str, writer: str, detail: str):
        super().__init__(f"{path or '(root)'}: reader {reader}, writer {writer}: {detail}")
        self.path, self.reader, self.writer, self.detail = path, reader, writer, detail

    def __reduce__(self):
        return type(self), (self.path, self.reader, self.writer, self.detail)


class DataError(RowweaveError):
    """A value that doesn't fit its schema, or bytes that can't be read. rows: those of a batch that are at fault, where that is
    known, and say: the detail of each, by its place in rows."""

    def __init__(self, path: str, detail: str, rows: Any = None, say: Callable[[int], str] | None = None):
        super().__init__(f"{path}: {detail}" if path else detail)
        self.path, self.detail, self.rows, self.say = path, detail, rows, say

    def __reduce__(self):
        return type(self), (self.path, self.detail)

    def under(self, name: str) -> DataError:
        return type(self)(f"{name}.{self.path}" if self.path else name, self.detail, self.rows, self.say)


class ShortBufferError(DataError):
    """The bytes end before the value does."""


class ContainerError(RowweaveError):
    """A container file that is damaged or isn't one."""
