"""Windows over position, time and prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.operators.order import ordered_list, with_position


def batch(df: DataFrame, order: list, size: int, value: Column) -> DataFrame:
    """(batch, items): consecutive chunks; the last may be short."""
    if size < 1:
        raise ValueError("size must be at least 1")
    d = with_position(df.withColumn("_x", value), order, "_pos")
    return d.groupBy(F.expr(f"_pos div {size}").alias("batch")).agg(ordered_list(F.col("_x"), F.col("_pos")).alias("items"))


def window(df: DataFrame, order: list, size: int, step: int, value: Column) -> DataFrame:
    """(window, items): full windows that start at 0, step, 2 * step, ...; each row goes to size / step of them."""
    if size < 1 or step < 1:
        raise ValueError("size and step must be at least 1")
    d = with_position(df.withColumn("_x", value), order, "_pos")
    first, last = F.greatest(F.lit(0), F.ceil((F.col("_pos") - size + 1) / step)).cast("long"), F.expr(f"_pos div {step}")
    d = d.withColumns({"_lo": first, "_hi": last}).where("_lo <= _hi").withColumn("window", F.explode(F.sequence("_lo", "_hi")))
    return d.groupBy("window").agg(ordered_list(F.col("_x"), F.col("_pos")).alias("items")).where(F.size("items") == size)


def anchored(df: DataFrame, keys: list[str], order: list[str], time: Column, seconds: float, opens: bool = False) -> DataFrame:
    """``df`` with window_id and window_start: a window opens at its first row's time and takes rows until time >= start + seconds.

    Late rows and rows without a time join the open window; one that opens with such rows
    starts at the first time that follows. The recurrence is sequential, so it runs side by
    side for the keys only; a key's rows are read in order, in batches.
    """
    import pyarrow as pa

    named = df.withColumn("_t", time.cast("double"))
    named = named.repartition(*keys).sortWithinPartitions(*keys, *order) if keys else named.coalesce(1).sortWithinPartitions(*order)
    at, columns = [named.columns.index(k) for k in keys], df.columns
    last = len(columns)

    def run(batches):
        key, number, start = None, -1, None
        for b in batches:
            ids, starts, opened = [], [], []
            groups = zip(*(b.column(i).to_pylist() for i in at), strict=True) if at else (() for _ in range(b.num_rows))
            for k, t in zip(groups, b.column(last).to_pylist(), strict=True):
                if number < 0 or k != key:
                    key, number, start = k, 0, t
                    opened.append(True)
                    ids.append(number)
                    starts.append(start)
                    continue
                start = t if start is None else start
                opened.append(t is not None and t >= start + seconds)
                if opened[-1]:
                    number, start = number + 1, t
                ids.append(number)
                starts.append(start)
            yield pa.RecordBatch.from_arrays([*b.columns[:last], pa.array(ids, pa.int64()), pa.array(starts, pa.float64()), pa.array(opened, pa.bool_())], [*columns, "window_id", "window_start", "_opens"])

    d = named.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("window_id", T.LongType()), T.StructField("window_start", T.DoubleType()), T.StructField("_opens", T.BooleanType())]))
    return d if opens else d.drop("_opens")


def throttle(df: DataFrame, keys: list[str], order: list[str], time: Column, seconds: float) -> DataFrame:
    """The rows that open an anchored window: the first, then each at least ``seconds`` after the last kept."""
    return anchored(df, keys, order, time, seconds, opens=True).where("_opens").drop("_opens", "window_id", "window_start")


def prefix(df: DataFrame, order: list[str], holds: Column, take: bool) -> DataFrame:
    """The rows before the first that doesn't hold (take), or from it on."""
    key = F.struct(*order)
    cut = df.where(~F.coalesce(holds.cast("boolean"), F.lit(False))).agg(F.min(key).alias("_cut"))
    d = df.join(F.broadcast(cut))  # one row
    return d.where(F.col("_cut").isNull() | (key < F.col("_cut")) if take else key >= F.col("_cut")).drop("_cut")
