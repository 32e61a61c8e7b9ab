"""Stages that wait for I/O: a bounded number of coroutines in flight in each task."""

from __future__ import annotations

import asyncio
import functools
from collections.abc import Awaitable, Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rillflow.functions.functional import retry as with_retry

ERROR = T.StructType([T.StructField("type", T.StringType()), T.StructField("message", T.StringType())])


def map_async(df: DataFrame, column: str, f: Callable[..., Awaitable], kind: str, concurrency: int = 16, timeout: float | None = None, attempts: int = 1, backoff: float = 1.5, first_wait: float = 1.0, into: str = "result", ordered: bool = True) -> DataFrame:
    """``df`` with a result struct of ``await f(value)`` for each row; errors and timeouts are captured.

    No more than ``concurrency`` calls of a task are in flight, and never more than a
    batch of rows is held. Rows keep their columns, so any order can be restored; with
    ``ordered=False`` they come out as their calls finish.
    """
    if concurrency < 1 or attempts < 1:
        raise ValueError("concurrency and attempts must be at least 1")
    result = T.StructType([T.StructField("is_success", T.BooleanType()), T.StructField("value", T._parse_datatype_string(kind)), T.StructField("error", ERROR)])

    async def gather(values):
        gate = asyncio.Semaphore(concurrency)
        call = with_retry(attempts, backoff, first=first_wait)(f) if attempts > 1 else f

        async def one(x):
            async with gate:
                try:
                    return {"is_success": True, "value": await asyncio.wait_for(call(x), timeout), "error": None}
                except Exception as e:
                    return {"is_success": False, "value": None, "error": {"type": type(e).__name__, "message": str(e)}}

        finished: list[int] = []

        async def numbered(i, x):
            out = await one(x)
            finished.append(i)
            return out

        out = await asyncio.gather(*(numbered(i, x) for i, x in enumerate(values)))
        return out, range(len(out)) if ordered else finished

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 64 * concurrency):
                part = pdf.iloc[at : at + 64 * concurrency]
                found, places = asyncio.run(gather(part[column].tolist()))
                yield part.assign(**{into: pd.Series(found, index=part.index, dtype=object)}).iloc[list(places)]

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField(into, result)]))


def sequential(df: DataFrame, column: str, f: Callable[..., Awaitable], kind: str, **options) -> DataFrame:
    """map_async with one call at a time in each task."""
    return functools.partial(map_async, concurrency=1)(df, column, f, kind, **options)
