"""Dataset: an immutable, lazy DataFrame with a declared encounter order.

Steps that need the order use the declared key, which must be unique; the others ignore
it. Expressions are Columns, column names, or callables of a row that build Columns.
The element of a dataset is its row, or one column of it (``value``).
"""

from __future__ import annotations

import asyncio
import functools
import graphlib
from collections.abc import AsyncIterable, Callable, Iterable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.exceptions import StreamEmptyError, task_errors
from rillflow.functions import exprs
from rillflow.functions.exprs import Expr
from rillflow.functions.option import Option
from rillflow.functions.result import Result
from rillflow.operators import collectors, order, windows


class Dataset:
    def __init__(self, df: DataFrame, order_by: str | list[str], value: str | None = None):
        self.df, self.order_by = df, [order_by] if isinstance(order_by, str) else list(order_by)
        rest = [c for c in df.columns if c not in self.order_by]
        self.value = value or (rest[0] if len(rest) == 1 else None)

    # --- sources -----------------------------------------------------------------------

    @staticmethod
    def of(spark: SparkSession, *elements: Any, schema: str | None = None) -> Dataset:
        """From values, in order; ``schema``: the type of an element (needed when there are none)."""
        return Dataset.from_rows(spark, elements, schema)

    @staticmethod
    def from_rows(spark: SparkSession, elements: Iterable[Any], schema: str | None = None) -> Dataset:
        rows = list(enumerate(elements))
        if schema:
            df = spark.createDataFrame(rows, f"ord long, value {schema}")
        elif rows and all(isinstance(x, dict) for _, x in rows):
            names = list(dict.fromkeys(k for _, x in rows for k in x))  # a missing key is null
            df = spark.createDataFrame([(i, *(x.get(k) for k in names)) for i, x in rows], ["ord", *names])
        else:
            df = spark.createDataFrame(rows, ["ord", "value"])
        return Dataset(df, "ord")

    @staticmethod
    def from_aiterable(spark: SparkSession, elements: AsyncIterable[Any], schema: str | None = None, n: int | None = None) -> Dataset:
        """From an async iterable, read on the driver: all of it, or ``n`` elements, after which it is closed."""

        async def gathered() -> list:
            out, source = [], aiter(elements)
            try:
                while n is None or len(out) < n:
                    try:
                        out.append(await anext(source))
                    except StopAsyncIteration:
                        break
            finally:
                if close := getattr(source, "aclose", None):
                    await close()
            return out

        return Dataset.from_rows(spark, asyncio.run(gathered()), schema)

    @staticmethod
    def generate(spark: SparkSession, supplier: Expr | Callable[[], Any], n: int, schema: str | None = None) -> Dataset:
        """``n`` values of a supplier: a Column (F.rand(), say), or with ``schema`` a Python function, called in order on the driver."""
        if schema:
            return Dataset.from_rows(spark, [supplier() for _ in range(n)], schema)
        df = spark.range(n).withColumnRenamed("id", "ord")
        return Dataset(df.withColumn("value", exprs.column(df, supplier)), "ord")

    @staticmethod
    def iterate(spark: SparkSession, seed: Any, f: Callable[[Column], Column], n: int, kind: str = "bigint") -> Dataset:
        """seed, f(seed), f(f(seed)), ...: ``n`` values, as a fold inside one row."""
        steps = F.sequence(F.lit(1), F.lit(n - 1)) if n > 1 else F.array().cast("array<int>")
        values = order.folds(steps, F.lit(seed).cast(kind), lambda total, _: f(total).cast(kind))
        return Dataset(spark.range(1).select(F.posexplode(values).alias("ord", "value")).where(F.col("ord") < n), "ord")

    @staticmethod
    def chain(first: Dataset, *others: Dataset) -> Dataset:
        """One after the other, each in its own order; columns that one lacks are null.

        Where datasets name their elements differently, the others' take the name of the first's.
        Keys that two of them hold in opposite orders are refused, as are keys that are no key of another.
        """
        parts = [first, *(d._named(first.value) for d in others)]
        sorter = graphlib.TopologicalSorter()
        for d in parts:
            for before, key in zip([None, *d.order_by], d.order_by, strict=False):
                sorter.add(key, *([before] if before else []))
        keys = list(sorter.static_order())  # holds the keys of each in its own order
        for d in parts:
            if mixed := set(keys).intersection(d.df.columns).difference(d.order_by):
                raise ValueError(f"{sorted(mixed)} are keys of one dataset and plain columns of another: rename them")
        source = _free("_source", [c for d in parts for c in d.df.columns])
        df = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (d.df.withColumn(source, F.lit(i)) for i, d in enumerate(parts)))
        return Dataset(df, [source, *keys], first.value)

    def _named(self, value: str | None) -> Dataset:
        """The same elements by the name ``value``, if both have one."""
        if not value or not self.value or value == self.value or value in self.order_by:
            return self
        return Dataset(self.df.select(*self._order(), F.col(self.value).alias(value)), self.order_by, value)

    # --- row by row --------------------------------------------------------------------

    def _with(self, df: DataFrame, value: str | None = None) -> Dataset:
        return Dataset(df, self.order_by, value or (self.value if self.value in df.columns else None))

    def _x(self) -> Column:
        rest = [c for c in self.df.columns if c not in self.order_by]
        return F.col(self.value) if self.value else F.struct(*rest) if rest else F.col(self.order_by[0])

    def _order(self) -> list[Column]:
        return [F.col(c) for c in self.order_by]

    def map(self, f: Expr | None = None, **columns: Expr) -> Dataset:
        """One value from an expression, or named columns; a udf() is an expression too."""
        if f is not None:
            columns = {"value": f}
        return self._with(self.df.select(*self._order(), *(exprs.column(self.df, e).alias(k) for k, e in columns.items())), next(iter(columns)) if len(columns) == 1 else None)

    def filter(self, predicate: Expr) -> Dataset:
        return self._with(self.df.where(exprs.column(self.df, predicate)))

    def flat_map(self, f: Expr) -> Dataset:
        """A row per element of an array; none for an empty or null one."""
        item = _free("item", self.order_by)
        return Dataset(self.df.select(*self._order(), F.posexplode(exprs.column(self.df, f)).alias(item, "value")), [*self.order_by, item], "value")

    def pick(self, key: str | int) -> Dataset:
        found = F.col(key) if not self.value and key in self.df.columns else exprs.pick(self.df, self._x(), key) if self.value else F.lit(None)
        return self._with(self.df.select(*self._order(), found.alias("value")), "value")

    def filter_none(self, key: str | int | None = None) -> Dataset:
        if key is None:
            kept = self._x().isNotNull()
        else:
            kept = F.col(key).isNotNull() if not self.value and key in self.df.columns else exprs.pick(self.df, self._x(), key).isNotNull()
        return self._with(self.df.where(kept))

    def peek(self, observation, *metrics: Column) -> Dataset:
        """Passes rows through and reports metrics to an Observation."""
        return self._with(self.df.observe(observation, *metrics))

    def flat_map_result(self, column: str | None = None) -> Dataset:
        r = Result(F.col(column or self.value))
        return self._with(self.df.where(F.coalesce(r.is_success(), F.lit(False))).select(*self._order(), r.c["value"].alias("value")), "value")

    def partition_results(self, column: str | None = None) -> tuple[Dataset, Dataset]:
        """(values, errors), each in order."""
        r = Result(F.col(column or self.value))
        bad = self.df.where(r.is_failure()).select(*self._order(), r.error().alias("value"))
        return self.flat_map_result(column), self._with(bad, "value")

    # --- order ---------------------------------------------------------------------------

    def sorted(self, key: Expr | None = None, reverse: bool = False) -> Dataset:
        """Stable: equal keys keep their order, also in reverse. Nulls come first, or last in reverse."""
        d = order.with_position(self.df.withColumn("_key", exprs.column(self.df, key) if key is not None else self._x()), [F.desc("_key") if reverse else F.asc("_key"), *self._order()], "_sorted")
        return Dataset(d.drop("_key"), "_sorted", self.value)

    def limit(self, n: int) -> Dataset:
        _check(n)
        return self._with(self.df.orderBy(*self._order()).limit(n))

    def skip(self, n: int) -> Dataset:
        _check(n)
        return self._with(self.with_position("_pos").where(F.col("_pos") >= n).drop("_pos"))

    def top(self, k: int, key: Expr, reverse: bool = True) -> Dataset:
        """sorted().limit(k) in one pass: no task keeps more than ``k`` rows."""
        by = exprs.column(self.df, key)
        return self._with(self.df.orderBy(by.desc() if reverse else by.asc(), *self._order()).limit(k))

    def with_position(self, name: str = "pos", start: int = 0) -> DataFrame:
        return order.with_position(self.df, self._order(), name, start)

    def take_while(self, predicate: Expr) -> Dataset:
        return self._with(windows.prefix(self.df, self.order_by, exprs.column(self.df, predicate), True))

    def drop_while(self, predicate: Expr) -> Dataset:
        return self._with(windows.prefix(self.df, self.order_by, exprs.column(self.df, predicate), False))

    def zip_with_index(self, start: int = 0) -> Dataset:
        return self._with(self.with_position("index", start))

    def _zipped(self, other: Dataset, how: str) -> DataFrame:
        a = order.with_position(self.df.select(*self._order(), self._x().alias("left"), F.lit(True).alias("_left")), self._order(), "pos")
        b = order.with_position(other.df.select(*other._order(), other._x().alias("right"), F.lit(True).alias("_right")), other._order(), "pos")
        return a.select("pos", "left", "_left").join(b.select("pos", "right", "_right"), "pos", how)

    def zip(self, other: Dataset) -> Dataset:
        return Dataset(self._zipped(other, "inner").select("pos", "left", "right"), "pos")

    def zip_longest(self, other: Dataset, fillvalue: Any = None) -> Dataset:
        """Fills only where a side has ended; nulls among its elements stay."""
        d = self._zipped(other, "full")
        return Dataset(d.select("pos", *(F.when(F.col(f"_{s}"), F.col(s)).otherwise(F.lit(fillvalue)).alias(s) for s in ("left", "right"))), "pos")

    def batch(self, size: int) -> Dataset:
        return Dataset(windows.batch(self.df, self._order(), size, self._x()), "batch", "items")

    def window(self, size: int, step: int = 1) -> Dataset:
        return Dataset(windows.window(self.df, self._order(), size, step, self._x()), "window", "items")

    def window_by_time(self, time: Expr, seconds: float, keys: list[str] | None = None) -> Dataset:
        return self._with(windows.anchored(self.df, keys or [], self.order_by, exprs.column(self.df, time), seconds))

    def debounce(self, time: Expr, seconds: float, keys: list[str] | None = None) -> Dataset:
        return self._with(windows.throttle(self.df, keys or [], self.order_by, exprs.column(self.df, time), seconds))

    def scan(self, how: str | Callable[[Any, Any], Any], identity: Any, value: Expr | None = None, kind: str = "bigint") -> Dataset:
        """The identity (index -1), then the running sum, min, max or count joined with it.

        Any other Python function f(total, x) -> ``kind`` is a sequential fold: one task runs it, batch by batch.
        """
        if callable(how):
            return self._scan_with(how, identity, value, kind)
        join = {"sum": lambda a: a + F.lit(identity), "count": lambda a: a + F.lit(identity), "min": lambda a: F.least(a, F.lit(identity)), "max": lambda a: F.greatest(a, F.lit(identity))}[how]
        x = self._x() if value is None else exprs.column(self.df, value)
        d = order.running(self.with_position("index").select("index", x.alias("_x")), ["index"], F.col("_x"), how, "value").select("index", join(F.col("value")).alias("value"))
        first = self.df.sparkSession.range(1).select(F.lit(-1).cast("long").alias("index"), F.lit(identity).cast(d.schema["value"].dataType).alias("value"))
        return Dataset(first.unionByName(d), "index")

    def _scan_with(self, f: Callable[[Any, Any], Any], identity: Any, value: Expr | None, kind: str) -> Dataset:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        x = self._x() if value is None else exprs.column(self.df, value)
        arrow = to_arrow_type(T._parse_datatype_string(kind))

        def run(batches):
            total, at = identity, -1
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([total], arrow)], ["index", "value"])
            for batch in batches:
                totals = []
                for y in batch.column(0).to_pylist():
                    total = f(total, y)
                    totals.append(total)
                yield pa.RecordBatch.from_arrays([pa.array(range(at + 1, at + 1 + len(totals)), pa.int64()), pa.array(totals, arrow)], ["index", "value"])
                at += len(totals)

        one = self.df.select(*self._order(), x.alias("_x")).repartition(1).sortWithinPartitions(*self._order()).select("_x")
        return Dataset(one.mapInArrow(run, f"index long, value {kind}"), "index")

    def scan_by(self, keys: list[str], identity: Column, f: Callable[[Column, Column], Column], value: Expr | None = None) -> DataFrame:
        """A general running fold for each key: (keys, index, value), identity first. A key's values meet in one row."""
        x = self._x() if value is None else exprs.column(self.df, value)
        held = self.df.groupBy(*keys).agg(order.ordered_list(x, *self._order()).alias("_xs"))
        return held.select(*keys, F.posexplode(order.folds(F.col("_xs"), identity, f)).alias("index", "value"))

    def distinct(self) -> Dataset:
        rest = [c for c in self.df.columns if c not in self.order_by]
        return self.distinct_by(*rest)

    def distinct_by(self, *keys: Expr) -> Dataset:
        """The first row of each key."""
        named = {f"_k{i}": exprs.column(self.df, k) for i, k in enumerate(keys)}
        d = self.df.withColumns(named).groupBy(*named).agg(F.min_by(F.struct(*self.df.columns), F.struct(*self.order_by)).alias("_row"))
        return self._with(d.select("_row.*"))

    def to_async(self, column: str, f: Callable, kind: str, **options) -> Dataset:
        """The rows with a result struct of ``await f(value)``: see streaming.aio.map_async."""
        from rillflow.streaming import aio

        return self._with(aio.map_async(self.df, column, f, kind, **options))

    def parallel(self, processes: int | None = None) -> Dataset:
        """Other partitions, same result."""
        return self._with(self.df.repartition(processes) if processes else self.df)

    # --- terminals -------------------------------------------------------------------------

    @task_errors()
    def count(self) -> int:
        return self.df.count()

    def aggregate(self, *columns: Column) -> DataFrame:
        return self.df.agg(*columns)

    @task_errors()
    def sum(self, value: Expr | None = None):
        return self.df.agg(F.coalesce(F.sum(self._x() if value is None else exprs.column(self.df, value)), F.lit(0))).first()[0]

    @task_errors()
    def _extreme(self, key: Expr | None, low: bool) -> Option:
        by = self._x() if key is None else exprs.column(self.df, key)
        return Option(self.df.where(by.isNotNull()).orderBy(by.asc() if low else by.desc(), *self._order()).select(self._x().alias("x")).limit(1).first()).map(lambda r: r[0])

    def min(self, key: Expr | None = None) -> Option:
        return self._extreme(key, True)

    def max(self, key: Expr | None = None) -> Option:
        return self._extreme(key, False)

    @task_errors()
    def find_first(self) -> Option:
        """The first element; empty also if it is null."""
        return Option(self.df.orderBy(*self._order()).select(self._x().alias("x")).first()).map(lambda r: r[0])

    def any_match(self, predicate: Expr) -> bool:
        return not self.df.where(exprs.truth(self.df, predicate)).isEmpty()

    def all_match(self, predicate: Expr) -> bool:
        return self.df.where(~exprs.truth(self.df, predicate)).isEmpty()

    def none_match(self, predicate: Expr) -> bool:
        return not self.any_match(predicate)

    def reduce(self, *args):
        """reduce(identity, f) or reduce(f): an ordered left fold on the driver, row by row."""
        rows = (r[0] for r in self.df.orderBy(*self._order()).select(self._x().alias("x")).toLocalIterator())
        f = args[-1]
        if len(args) == 2:
            total = args[0]
        else:
            try:
                total = next(rows)
            except StopIteration:
                raise StreamEmptyError("reduce() of no elements needs an identity") from None
        for x in rows:
            total = f(total, x)
        return total

    def combine(self, f: Callable[[Any, Any], Any], value: Expr | None = None) -> Option:
        """An associative reduce: each range of the order is folded in its task, the driver folds one value a range."""
        import pyarrow as pa

        x = self._x() if value is None else exprs.column(self.df, value)
        n = int(self.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranged = self.df.select(*self._order(), x.alias("_x")).repartitionByRange(n, *self._order()).sortWithinPartitions(*self._order()).select("_x")

        def run(batches):
            total, found, kind = None, False, None
            for batch in batches:
                kind = batch.schema.field(0).type
                for y in batch.column(0).to_pylist():
                    total, found = (f(total, y), True) if found else (y, True)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([total], kind)], ["_x"])

        parts = [r[0] for r in ranged.mapInArrow(run, ranged.schema).collect()]  # in order of ranges
        return Option(functools.reduce(f, parts)) if parts else Option.empty()

    def fold_by(self, keys: list[str], identity: Column, f: Callable[[Column, Column], Column], value: Expr | None = None) -> DataFrame:
        """(keys, value): an ordered left fold for each key."""
        x = self._x() if value is None else exprs.column(self.df, value)
        return self.df.groupBy(*keys).agg(F.aggregate(order.ordered_list(x, *self._order()), identity, f).alias("value"))

    def join(self, delimiter: str = "") -> str:
        return self.collect(collectors.joining(delimiter)).first()[0]

    def collect(self, collector: collectors.Collector | collectors.Grouping) -> DataFrame:
        return collectors.run(self.df, self._order(), self._x(), collector)

    def describe(self, value: Expr | None = None) -> dict:
        """count, and of numbers sum, min, max, mean and, for more than one, the sample's std; {} when empty."""
        x = self._x() if value is None else exprs.column(self.df, value)
        kind = self.df.select(x.alias("x")).schema[0].dataType
        if isinstance(kind, T.BooleanType):
            x, kind = x.cast("int"), T.IntegerType()
        if not isinstance(kind, T.NumericType):
            n = self.df.count()
            return {"count": n} if n else {}
        r = self.df.agg(F.count(F.lit(1)).alias("count"), F.sum(x).alias("sum"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std")).first().asDict()
        return {k: v for k, v in r.items() if v is not None} if r["count"] else {}

    @task_errors()
    def to_list(self) -> list:
        return [r[0] for r in self.df.orderBy(*self._order()).select(self._x().alias("x")).collect()]

    @task_errors()
    def to_set(self) -> set:
        return {r[0] for r in self.df.select(self._x().alias("x")).distinct().collect()}

    def __iter__(self) -> Iterator:
        return (r[0] for r in self.df.orderBy(*self._order()).select(self._x().alias("x")).toLocalIterator())

    @task_errors()
    def for_each(self, action: Callable) -> None:
        """Runs on the executors, at least once a row."""
        self.df.foreach(action)

    @task_errors()
    def to_df(self, columns: list[str] | None = None):
        rest = self.df.orderBy(*self._order()).drop(*self.order_by)
        return (rest.toDF(*columns) if columns else rest).toPandas()

    def to_np(self):
        return self.to_df().to_numpy()


def _free(name: str, taken: Iterable[str]) -> str:
    """``name``, with as many underscores as it takes to differ from all that are taken (in any case)."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name += "_"
    return name


def _check(n: int) -> None:
    if n < 0:
        raise ValueError("a count can't be negative")
