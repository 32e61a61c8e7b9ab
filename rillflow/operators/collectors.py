"""Collectors: mergeable aggregates that compose.

A collector makes an aggregate Column for a frame; grouping_by makes one row per group,
and its downstream may be any collector or another grouping, also nested in mapping. An
inner grouping becomes an array of (key, value) structs in order of key.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.functions.exprs import Expr, column, text, truth
from rillflow.operators.order import ordered_list


@dataclass(frozen=True)
class Collector:
    """build(df, order, value) -> aggregate Column."""

    build: Callable[[DataFrame, list[Column], Column], Column]


@dataclass(frozen=True)
class Grouping:
    keys: dict[str, Expr]
    downstream: dict[str, Collector]
    complete: tuple = ()
    mapper: Expr | None = None


def to_list() -> Collector:
    return Collector(lambda df, order, x: ordered_list(x, *order))


def to_set() -> Collector:
    return Collector(lambda df, order, x: F.transform(F.collect_set(F.struct(x.alias("x"))), lambda e: e["x"]))


def joining(delimiter: str = "") -> Collector:
    return Collector(lambda df, order, x: F.array_join(ordered_list(text(x, df.select(x.alias("x")).schema[0].dataType), *order), delimiter))


def counting() -> Collector:
    return Collector(lambda df, order, x: F.count(F.lit(1)))


def summing(mapper: Expr | None = None) -> Collector:
    return Collector(lambda df, order, x: F.coalesce(F.sum(_of(df, mapper, x)), F.lit(0)))


def averaging(mapper: Expr | None = None) -> Collector:
    return Collector(lambda df, order, x: F.coalesce(F.avg(_of(df, mapper, x)), F.lit(0.0)))


def summarizing(mapper: Expr | None = None) -> Collector:
    """struct<count, sum, min, max, average>; zeros when empty."""

    def build(df, order, x):
        x = _of(df, mapper, x)
        zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
        return F.struct(F.count(F.lit(1)).alias("count"), zero(F.sum(x)).alias("sum"), zero(F.min(x)).alias("min"), zero(F.max(x)).alias("max"), zero(F.avg(x)).alias("average"))

    return Collector(build)


def mapping(mapper: Expr, downstream: Collector | Grouping) -> Collector | Grouping:
    if isinstance(downstream, Grouping):
        return replace(downstream, mapper=downstream.mapper or mapper)
    return Collector(lambda df, order, x: downstream.build(df, order, column(df, mapper)))


def to_dict(key: Expr, value: Expr) -> Grouping:
    """(key, value): of equal keys the last value wins, null or not."""
    last = Collector(lambda df, order, x: F.max_by(F.struct(column(df, value).alias("v")), F.struct(*order))["v"])
    return Grouping({"key": key}, {"value": last})


def grouping_by(key: Expr | dict[str, Expr], downstream: Collector | dict[str, Collector] | None = None) -> Grouping:
    keys = key if isinstance(key, dict) else {"key": key}
    down = downstream if isinstance(downstream, dict) else {"value": downstream or to_list()}
    return Grouping(keys, down)


def partitioning_by(predicate: Expr, downstream: Collector | None = None) -> Grouping:
    """Always two rows, key true and key false; a null predicate counts as false."""
    return Grouping({"key": lambda r: predicate}, {"value": downstream or to_list()}, complete=(True, False))


def to_columns() -> Collector:
    """A struct of aligned lists, one for each column of the schema."""
    return Collector(lambda df, order, x: F.struct(*(ordered_list(F.col(c), *order).alias(c) for c in df.columns)))


def _of(df: DataFrame, mapper: Expr | None, x: Column) -> Column:
    return x if mapper is None else column(df, mapper)


def run(df: DataFrame, order: list[Column], x: Column, c: Collector | Grouping) -> DataFrame:
    """The frame of a collector (one row, column value) or grouping (a row per group)."""
    if isinstance(c, Collector):
        return df.agg(c.build(df, order, x).alias("value"))
    x = x if c.mapper is None else column(df, c.mapper)
    if any(isinstance(d, Grouping) for d in c.downstream.values()):
        return _nested(df, order, x, c)
    if not c.complete:
        keys = {k: column(df, e) for k, e in c.keys.items()}
        return df.groupBy(*(e.alias(k) for k, e in keys.items())).agg(*(d.build(df, order, x).alias(n) for n, d in c.downstream.items()))
    (predicate,) = (column(df, e(None)) for e in c.keys.values())
    held = truth(df, predicate)
    parts = [df.where(held if want else ~held).agg(*(d.build(df, order, x).alias(n) for n, d in c.downstream.items())).select(F.lit(want).alias("key"), *c.downstream) for want in c.complete]
    return parts[0].unionByName(parts[1])


def _nested(df: DataFrame, order: list[Column], x: Column, c: Grouping) -> DataFrame:
    """A grouping with inner groupings: each is one aggregation by both keys, gathered by the outer ones."""
    if c.complete:
        raise ValueError("partitioning_by() takes collectors only")
    plain = {n: d for n, d in c.downstream.items() if isinstance(d, Collector)}
    out = run(df, order, x, Grouping(c.keys, plain or {"_n": counting()}))
    for name, inner in c.downstream.items():
        if isinstance(inner, Collector):
            continue
        outer = {f"_outer{len(c.keys)}_{i}": e for i, e in enumerate(c.keys.values())}
        flat = run(df, order, x, Grouping(outer | {f"_inner_{k}": e for k, e in inner.keys.items()}, inner.downstream, mapper=inner.mapper))
        entry = F.struct(*(F.col(f"_inner_{k}").alias(k) for k in inner.keys), *inner.downstream)
        flat = flat.groupBy(*outer).agg(F.sort_array(F.collect_list(entry)).alias(name))
        on = functools.reduce(operator.and_, (out[k].eqNullSafe(flat[o]) for k, o in zip(c.keys, outer, strict=True)))
        out = out.join(flat, on).drop(*outer)
    return out.select(*c.keys, *c.downstream)
