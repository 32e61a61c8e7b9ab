"""Expressions: a Column, a column's name, or a callable of a row that builds Columns."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Expr = Column | str | Callable[..., Any]


class RowOf:
    """Stands for the row of a frame: attributes and keys are its Columns."""

    def __init__(self, df: DataFrame):
        self._df = df

    def __getattr__(self, name: str) -> Column:
        return F.col(f"`{name}`")

    __getitem__ = __getattr__


def column(df: DataFrame, e: Expr) -> Column:
    """``e`` as a Column over ``df``; a plain value that a callable returns becomes a literal."""
    if isinstance(e, str):
        return F.col(e)
    if callable(e) and not isinstance(e, Column):
        e = e(RowOf(df))
    return e if isinstance(e, Column) else F.lit(e)


def truth(df: DataFrame, e: Expr) -> Column:
    """A predicate that is never null: null counts as false."""
    return F.coalesce(column(df, e).cast("boolean"), F.lit(False))


def pick(df: DataFrame, of: Expr, key: str | int) -> Column:
    """A struct's field, a map's value, an array's element by non-negative index, or a field of JSON text (no quote or question mark in its name); null if missing."""
    c = column(df, of)
    kind = df.select(c.alias("c")).schema[0].dataType
    if isinstance(kind, T.ArrayType):
        return F.get(c, F.lit(key)) if isinstance(key, int) and key >= 0 else F.lit(None).cast(kind.elementType)
    if isinstance(kind, T.MapType):
        return F.try_element_at(c, F.lit(key))
    if isinstance(kind, T.StructType):
        return c.getField(key) if key in kind.names else F.lit(None)
    if kind.simpleString() == "string":
        return F.get_json_object(c, f"$['{key}']")
    return F.lit(None)


def text(c: Column, kind: T.DataType) -> Column:
    """A value as it prints in Python: None, True, False; numbers as Spark prints them."""
    if isinstance(kind, T.BooleanType):
        c = F.when(c, "True").when(~c, "False")
    return F.coalesce(c.cast("string"), F.lit("None"))
