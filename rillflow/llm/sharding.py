"""Sharding by a hierarchical weighted hash tree, in DataFrame expressions only.

A document descends region, rack and shard. At each node every child draws
-ln(u) / weight, with u a hash of (doc_id, child) in (0, 1), and the smallest draw wins,
so a child is chosen in proportion to its weight. A child's draw depends on nothing but
the document and itself: when a weight grows, documents move only into that subtree.
A shard added in a region of its own therefore takes documents only into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillflow.llm.common import durable

#: region -> rack -> shard -> weight
Tree = dict[int, dict[int, dict[int, float]]]
#: Buckets of each shard in which slots are counted side by side.
BUCKETS = 1024


def even_tree(shards: int = 8, racks: int = 2, regions: int = 2) -> Tree:
    """A tree of equal shards, numbered in order of the descent."""
    tree: Tree = {}
    for s in range(shards):
        region = s * regions // shards
        rack = s * regions * racks // shards
        tree.setdefault(region, {}).setdefault(rack, {})[s] = 1.0
    return tree


def grown(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a rack and region of its own."""
    ids = [s for racks in tree.values() for shards in racks.values() for s in shards]
    rack = max(k for racks in tree.values() for k in racks) + 1
    return {**tree, max(tree) + 1: {rack: {max(ids) + 1: weight}}}


def _weight(node) -> float:
    return sum(map(_weight, node.values())) if isinstance(node, dict) else float(node)


def _draw(key: Column, level: int, child: int, weight: float) -> Column:
    """-ln(u) / weight; 52 bits of the hash give u."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(level), F.lit(child)), 12).cast("double") + 0.5) / float(1 << 52)
    return -F.ln(u) / weight


def descend(key: Column, node, level: int = 0) -> Column:
    """The shard (int) that ``key`` reaches below ``node``."""
    children = sorted(node.items())
    below = [descend(key, n, level + 1) if isinstance(n, dict) else F.lit(c).cast("int") for c, n in children]
    if len(children) == 1:
        return below[0]
    draws = [_draw(key, level, c, _weight(n)) for c, n in children]
    won = F.array_min(F.array(*(F.struct(d.alias("draw"), F.lit(i).alias("at")) for i, d in enumerate(draws))))["at"]
    out = F.when(won == 0, below[0])
    for i, b in enumerate(below[1:], 1):
        out = out.when(won == i, b)
    return out


def place(docs: DataFrame, tree: Tree | None = None, key: str = "doc_id") -> DataFrame:
    """``docs`` with shard and grown_shard (int), the latter with one more shard.

    Only the key and the tree decide; rows with equal keys (null included) share a shard.
    Columns of these names in the input are replaced. No shuffle.
    """
    tree = tree or even_tree()
    return docs.withColumns({"shard": descend(F.col(key), tree), "grown_shard": descend(F.col(key), grown(tree))})


def shard_plan(docs: DataFrame, tree: Tree | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Slots number the rows of a shard without gaps in the order of a hash of the row, then
    of doc_id, text_crc32 and size. Equal rows are counted before they are shuffled and
    dealt out after; the others are ranked in BUCKETS buckets of each shard, so that no
    shard is held by one task. Null text has size 1 and checksum 0. Texts are only
    measured, whole; rows with null ids share a shard; other columns are not looked at;
    an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = place(docs.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")), tree)
    row = ["doc_id", "text_crc32", "size"]
    slim = slim.withColumn("_bucket", F.pmod(F.xxhash64(*row), F.lit(BUCKETS)).cast("int"))
    counted = durable(slim.groupBy("shard", "_bucket", "grown_shard", *row).agg(F.count(F.lit(1)).alias("_n")))
    totals = counted.groupBy("shard", "_bucket").agg(F.sum("_n").alias("_total"))
    before = W.partitionBy("shard").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("shard", "_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))  # BUCKETS rows a shard
    inside = W.partitionBy("shard", "_bucket").orderBy(*row).rowsBetween(W.unboundedPreceding, -1)
    out = counted.withColumn("_first", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    out = out.join(totals, ["shard", "_bucket"]).withColumn("_first", F.col("_first") + F.col("_start"))
    slot = F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_n") - 1)).alias("slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot, "grown_shard")
