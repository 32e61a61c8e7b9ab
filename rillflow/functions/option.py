"""Null safety on columns: absent is null, and every other value is present."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rillflow.exceptions import StreamEmptyError


class Option:
    """A nullable Column, or a driver-side value, with the methods of an optional."""

    def __init__(self, value):
        self._v = value

    @staticmethod
    def of(value) -> Option:
        """Present for sure: None is refused, a null in a Column fails the query."""
        if value is None:
            raise ValueError("Option.of() needs a value")
        if isinstance(value, Column):
            value = F.when(value.isNull(), F.raise_error(F.lit("Option.of() met a null"))).otherwise(value)
        return Option(value)

    @staticmethod
    def of_nullable(value) -> Option:
        return Option(value)

    @staticmethod
    def empty() -> Option:
        return Option(None)

    @property
    def value(self):
        """The Column, or the value (None if absent)."""
        return F.lit(None) if self._v is None else self._v

    def _column(self) -> bool:
        return isinstance(self._v, Column)

    def is_present(self):
        return self._v.isNotNull() if self._column() else self._v is not None

    def is_empty(self):
        return self._v.isNull() if self._column() else self._v is None

    def __bool__(self) -> bool:
        if self._column():
            raise TypeError("a Column has no truth value; use is_present()")
        return self._v is not None

    def if_present(self, action: Callable) -> None:
        if self:
            action(self._v)

    def filter(self, predicate: Callable) -> Option:
        if self._column():
            return Option(F.when(predicate(self._v), self._v))
        return self if self and predicate(self._v) else Option(None)

    def map(self, f: Callable) -> Option:
        if self._column():
            return Option(F.when(self._v.isNotNull(), f(self._v)))
        return Option(f(self._v)) if self else Option(None)

    def flat_map(self, f: Callable[..., Option]) -> Option:
        if self._column():
            return Option(F.when(self._v.isNotNull(), f(self._v)._v))
        return f(self._v) if self else Option(None)

    def or_else(self, other):
        if self._column():
            return F.coalesce(self._v, other if isinstance(other, Column) else F.lit(other))
        return self._v if self else other

    def or_else_get(self, supplier: Callable):
        return self.or_else(supplier()) if self._column() or not self else self._v

    def or_else_throw(self, error: Callable[[], Exception] = lambda: StreamEmptyError("no value")):
        if self._column():
            return F.coalesce(self._v, F.raise_error(F.lit(str(error()))))
        if not self:
            raise error()
        return self._v

    def __repr__(self) -> str:
        return f"Option({self._v!r})" if self._v is not None else "Option.empty()"
