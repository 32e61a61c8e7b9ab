"""Structured Streaming: sources, keyed throttles and anchored windows, watermarked aggregates."""

from __future__ import annotations

import asyncio
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def interval(spark: SparkSession, per_second: float = 1.0) -> DataFrame:
    """0, 1, 2, ... as time passes (timestamp, value)."""
    if per_second >= 1:
        return spark.readStream.format("rate").option("rowsPerSecond", round(per_second)).load()
    return spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("advanceMillisPerBatch", round(1000 / per_second)).load()


def lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of the text files that arrive in a folder."""
    return spark.readStream.text(path)


def tables(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet", files: int | None = None) -> DataFrame:
    """The rows of the files that arrive in a folder, ``files`` of them a batch."""
    reader = spark.readStream.schema(schema).format(kind)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).load(path)


def _keyed(df: DataFrame, keys: list[str], time: Column, order: list[str], out: T.StructType, step) -> DataFrame:
    """Rows of each key in order through ``step(row time, state) -> (state, values or None)``; state is (number, start)."""
    rest = df.columns

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (-1, 0.0)
        pdf = pd.concat(list(frames)).sort_values(["_t", *order], kind="stable")  # a key's rows of one batch
        kept, values = [], []
        for i, t in enumerate(pdf["_t"].tolist()):
            held, found = step(t, held)
            if found is not None:
                kept.append(i)
                values.append(found)
        state.update(held)
        part = pdf.iloc[kept][rest].copy()
        for k, name in enumerate(f.name for f in out.fields[len(rest):]):
            part[name] = [v[k] for v in values]
        yield part

    timed = df.withColumn("_t", time.cast("double"))
    return timed.groupBy(*keys).applyInPandasWithState(run, out, "number long, start double", "append", GroupStateTimeout.NoTimeout)


def throttle(df: DataFrame, keys: list[str], time: Column, seconds: float, order: list[str] = []) -> DataFrame:  # noqa: B006
    """The first row of each key, then each that comes at least ``seconds`` after the last kept."""

    def step(t, held):
        return ((held[0] + 1, t), ()) if held[0] < 0 or t >= held[1] + seconds else (held, None)

    return _keyed(df, keys, time, order, df.schema, step)


def anchored(df: DataFrame, keys: list[str], time: Column, seconds: float, order: list[str] = []) -> DataFrame:  # noqa: B006
    """All rows with window_id and window_start; a late row joins its key's open window."""

    def step(t, held):
        held = (held[0] + 1, t) if held[0] < 0 or t >= held[1] + seconds else held
        return held, held

    return _keyed(df, keys, time, order, T.StructType([*df.schema.fields, T.StructField("window_id", T.LongType()), T.StructField("window_start", T.DoubleType())]), step)


def tumbling(df: DataFrame, time: str, width: str, late: str, keys: list[str], *aggregates: Column) -> DataFrame:
    """Aligned windows under a watermark; rows later than ``late`` are left out."""
    d = df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return d.groupBy(F.window(time, width), *keys).agg(*aggregates)


def sessions(df: DataFrame, time: str, gap: str, late: str, keys: list[str], *aggregates: Column) -> DataFrame:
    """Windows that a gap without rows ends, under a watermark."""
    d = df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return d.groupBy(F.session_window(time, gap), *keys).agg(*aggregates)


def drain(df: DataFrame, path: str, checkpoint: str, kind: str = "parquet", mode: str = "append") -> StreamingQuery:
    """Writes all that is there by now, exactly once, and stops."""
    query = df.writeStream.format(kind).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return query


def for_each_batch(df: DataFrame, action, checkpoint: str) -> StreamingQuery:
    """``action(frame, number)`` for each batch; a batch may be repeated after a failure, with its number."""
    query = df.writeStream.foreachBatch(action).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


class Running:
    """A streaming query that stops at the end of its ``with`` or ``async with`` block, whatever happens in it."""

    def __init__(self, query: StreamingQuery):
        self.query = query

    def __enter__(self) -> StreamingQuery:
        return self.query

    def __exit__(self, *_) -> None:
        self.query.stop()

    async def __aenter__(self) -> StreamingQuery:
        return self.query

    async def __aexit__(self, *_) -> None:
        await asyncio.to_thread(self.query.stop)
