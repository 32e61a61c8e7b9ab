"""Encounter order: positions and running totals over a declared order key.

No step sends all rows to one task: rows are range-partitioned by the key and numbered
inside their partition, and the counts of the earlier partitions (a row for each
partition, so a broadcast of bounded size) are added.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and written as Parquet into the session's checkpoint folder, so that later steps read only the columns they need.

    Columns are stored by number, since their names may differ only in case. Types that
    Parquet lacks (null, calendar intervals) take an ordinary checkpoint.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not where and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="rillflow-"))
    kinds = df.schema.json()
    if '"void"' in kinds or '"interval"' in kinds:
        return df.checkpoint(eager=True)
    stored = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    path = f"{sc.getCheckpointDir()}/ranged-{uuid.uuid4().hex}.parquet"
    stored.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(stored.schema).parquet(path).toDF(*df.columns)


def _ranged(df: DataFrame, order: list) -> DataFrame:
    """Sorted by ``order``, with _part and _row (from 0 in each part); written down, since ranges are sampled."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parted = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    low = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return durable(parted.select("*", F.spark_partition_id().alias("_part"), low.alias("_row")))


def with_position(df: DataFrame, order: list, name: str = "pos", start: int = 0) -> DataFrame:
    """``df`` with the position (bigint) of each row in the order of unique keys."""
    parted = _ranged(df, order)
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    counts = parted.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    return parted.join(F.broadcast(counts), "_part").withColumn(name, F.col("_before") + F.col("_row") + F.lit(start)).drop("_part", "_row", "_before")


def running(df: DataFrame, order: list, value: Column, how: str, name: str) -> DataFrame:
    """``df`` with the running sum, min, max or count of ``value`` up to each row."""
    total = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}[how]
    join = {"sum": lambda a, b: F.coalesce(a + b, a, b), "count": lambda a, b: F.coalesce(a, F.lit(0)) + b, "min": F.least, "max": F.greatest}[how]
    merge = F.sum if how == "count" else total
    parted = _ranged(df.withColumn("_value", value), order)
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parted.groupBy("_part").agg(total("_value").alias("_all")).select("_part", merge("_all").over(before).alias("_before"))
    inside = W.partitionBy("_part").orderBy("_row").rowsBetween(W.unboundedPreceding, 0)
    d = parted.join(F.broadcast(parts), "_part").withColumn(name, join(F.col("_before"), total("_value").over(inside)))
    return d.drop("_part", "_row", "_value", "_before")


def ordered_list(x: Column, *order: Column) -> Column:
    """An aggregate: the values in order, nulls included."""
    return F.transform(F.sort_array(F.collect_list(F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), x.alias("x")))), lambda e: e["x"])


def folds(xs: Column, identity: Column, f: Callable[[Column, Column], Column]) -> Column:
    """An array: the identity, then f(total, x) for each x of an array.

    An array is copied when a value is added to it, so the totals are gathered in chunks
    of about the square root of their number.
    """
    chunk = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(xs)))).cast("int")
    starts = F.when(F.size(xs) > 0, F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), chunk)).otherwise(F.array().cast("array<int>"))
    run = lambda total, at: F.aggregate(F.slice(xs, at, chunk), F.array(total), lambda acc, x: F.concat(acc, F.array(f(F.element_at(acc, -1), x))))
    more = lambda acc, at: F.concat(acc, F.array(F.slice(run(F.element_at(F.element_at(acc, -1), -1), at), F.lit(2), chunk)))
    return F.flatten(F.aggregate(starts, F.array(F.array(identity)), more))
