"""Mixing sources to target weights along a time-varying curriculum.

Each source has a target number of words and a schedule: its density over training time
t in [0, 1] is target * (1 + ramp * (2 t - 1)). The integral of the density is the
source's cumulative demand; a copy of a document whose words begin at c words into the
source's (repeated) stream trains at the time at which that demand reaches c. Copies
whose middle lies beyond the target are never demanded. Documents are then range-sorted
by position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillflow.llm.common import durable, words

#: Weights of the sources in order of name, repeated, and the ramp of each:
#: heavily weighted sources come rather early, lightly weighted ones rather late.
WEIGHTS, RAMPS = (5, 2, 1), (-0.4, 0.2, 0.6)
#: No document is used more often than this.
MOST = 3


def word_count(text: str = "text"):
    return F.size(words(F.col(text))).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target, ramp from a row per source (source, source_size).

    Targets share the sum of all sizes by weight; none exceeds MOST times its source's
    size, and the excess goes to the others by weight. With the sources in order of
    MOST * size / weight, those before the first that isn't full at the level that the
    rest would then share are the full ones.
    """
    rank = (F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1) % len(WEIGHTS)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), rank + 1)
    s = sizes.withColumns({"weight": pick(WEIGHTS), "ramp": pick(RAMPS)})
    s = s.withColumns({"limit": MOST * F.col("source_size"), "at": MOST * F.col("source_size") / F.col("weight")})
    every, before = W.partitionBy(), W.orderBy("at", F.asc_nulls_last("source")).rowsBetween(W.unboundedPreceding, -1)
    full = {c: F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("limit", "weight")}
    s = s.withColumn("level", (F.sum("source_size").over(every) - full["limit"]) / (F.sum("weight").over(every) - full["weight"]))
    s = s.withColumn("first", F.when(F.col("level") < F.col("at"), F.struct("at", "source", "level")))
    s = s.withColumn("shared", F.min("first").over(every)["level"])
    target = F.when(F.col("shared").isNull() | (F.col("at") <= F.col("shared")), F.col("limit").cast("double")).otherwise(F.col("shared") * F.col("weight"))
    return s.select("source", "source_size", target.alias("target"), "ramp")


def plan(docs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows with source, size, h (the order within a source) get source_size, target and positions.

    positions holds the training time of each copy taken, none to MOST. The running sum
    of a source is taken in 4096 buckets by the first digits of ``h`` and put together
    from their sums, so that no source is held by one task. ``sizes``: rows with source,
    size and h of the same documents, cheap to read twice.
    """
    aims = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    key = {"_null": F.col("source").isNull(), "_name": F.coalesce("source", F.lit(""))}
    bucket = F.substring("h", 1, 3)
    starts = sizes.withColumns(key).groupBy("_null", "_name", bucket.alias("_bucket")).agg(F.sum("size").alias("_sum"))
    earlier = W.partitionBy("_null", "_name").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = starts.select("_null", "_name", "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    starts = starts.join(aims.withColumns(key).drop("source"), ["_null", "_name"])
    inside = W.partitionBy("_null", "_name", "_bucket").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    d = docs.withColumns(key).withColumn("_bucket", bucket).withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    d = d.join(starts, ["_null", "_name", "_bucket"]).withColumn("_begin", F.col("_in") + F.col("_start"))
    copies = F.filter(F.sequence(F.lit(0), F.lit(MOST - 1)), lambda e: 2 * (e * F.col("source_size") + F.col("_begin")) + F.col("size") < 2 * F.col("target"))
    demand = lambda e: (e * F.col("source_size") + F.col("_begin")) / F.col("target")
    when = lambda e: (F.sqrt((1 - F.col("ramp")) * (1 - F.col("ramp")) + 4 * F.col("ramp") * demand(e)) - 1 + F.col("ramp")) / (2 * F.col("ramp"))
    return d.withColumn("positions", F.transform(copies, when)).drop("_null", "_name", "_bucket", "_in", "_start", "_begin", "ramp")


def _order():
    """The order within a source: a hash of the id, or of the text where there is none, so that such rows spread out too."""
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")))


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", word_count().alias("size"), _order().alias("h"))


def mixing_plan(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, positions of each row of ``docs``.

    Null text has size 0, null sources are one source, the last. Rows that share an id
    are ordered by size; equal rows are interchangeable. A table without words gets
    targets of 0 and no positions, an empty table an empty result. Texts are only counted,
    whole; other columns are not looked at.
    """
    slim = durable(_slim(docs))
    return plan(slim, slim).drop("h")


def mixture(docs: DataFrame) -> DataFrame:
    """The training stream: the columns of ``docs`` (whatever their names), a row for each copy, sorted by position."""
    slim = durable(_slim(docs))
    names = [f"_in_{i}" for i in range(len(docs.columns))]
    whole = docs.withColumns(dict(zip(names, map(F.col, docs.columns), strict=True))).select(*names, "doc_id", "source", word_count().alias("size"), _order().alias("h"))
    placed = plan(whole, slim).select(*names, "h", F.explode("positions").alias("_position"))
    return placed.orderBy("_position", "h").select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))
