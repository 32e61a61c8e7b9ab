"""Readers and writers of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.dataset import Dataset


def read(spark: SparkSession, path: str, order_by: str | list[str], kind: str = "parquet", **options) -> Dataset:
    """Any format that Spark reads: parquet, csv, json, orc, text, avro, jdbc, ..."""
    return Dataset(spark.read.format(kind).options(**options).load(path), order_by)


def read_lines(spark: SparkSession, path: str, encoding: str = "utf-8") -> Dataset:
    """The lines of text files, in order of file and line; files stay splittable."""
    d = spark.read.option("encoding", encoding).text(path)
    d = d.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return Dataset(d, ["file", "block", "line"], "value")


def write_csv(data: Dataset, path: str, header: list[str] | None = None, one_file: bool = False) -> None:
    """Rows in order; with a header its columns and names, else all columns without names. Null is an empty cell."""
    d = data.df.orderBy(*data.order_by)
    d = d.select(*header) if header else d.drop(*data.order_by)
    (d.coalesce(1) if one_file else d).write.mode("overwrite").option("header", bool(header)).option("nullValue", "").option("emptyValue", "").csv(path)


def write_json(data: Dataset, path: str, array: bool = False) -> None:
    """JSON lines; with ``array`` one pretty-printed array, which one task must hold."""
    d = data.df.drop(*data.order_by)
    if array:
        whole = data.df.agg(F.transform(F.sort_array(F.collect_list(F.struct(F.struct(*data.order_by).alias("o"), F.struct(*d.columns).alias("x")))), lambda e: e["x"]).alias("x"))
        whole.select(F.to_json("x", {"pretty": "true", "ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)
    else:
        data.df.orderBy(*data.order_by).drop(*data.order_by).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_lines(data: Dataset, path: str) -> None:
    """One line per element, in order."""
    from rillflow.functions.exprs import text

    x = data._x()
    kind = data.df.select(x.alias("x")).schema[0].dataType
    data.df.orderBy(*data.order_by).select(text(x, kind).alias("value")).write.mode("overwrite").text(path)


def union_of(*frames: DataFrame) -> DataFrame:
    """Frames under each other by name; what one lacks is null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
