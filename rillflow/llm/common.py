"""What several operators share: durable checkpoints, skew-proof look-ups, components, Arrow helpers.

Nothing here is bounded by the number of documents on the driver: look-ups broadcast at
most ``HOT_KEYS`` rows, and components are found with joins and aggregates only.
"""

from __future__ import annotations

import functools
import gc
import operator
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these characters: space, tab, newline, \v, \f, \r.
SPACES = " \t\n\x0b\x0c\r"
#: Java regular expression for a run of them.
SPACE_RUN = "[ \\t-\\r]+"

#: A key of more rows than this is hot, and at most so many hot keys are looked up by broadcast.
#: Any other key then has at most max(HOT_ROWS, rows / HOT_KEYS) rows.
HOT_ROWS, HOT_KEYS = 256, 4096
#: Edges of a graph that one task solves by union-find; larger graphs are contracted first.
LOCAL_EDGES = 200_000


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the folder for checkpoints, and read again.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset
    (tests, local runs) is one made. It is a folder for temporary data: what is written
    stays until it is emptied.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not where and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="rillflow-"))
    path = f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that no DataFrame still in use reads; others are left alone."""
    for df in tables:
        if path := df.__dict__.pop("_written", None):
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs, which stay until the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once into reliable storage, so that lost executors cost no recomputation.

    A written table, not an RDD checkpoint: its plan starts afresh, without the
    constraints and statistics of all that came before, which fill the driver's memory in loops.
    """
    return written(df, "step")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as it takes to differ from all columns (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words(text) -> F.Column:
    """The words of a text column as an array (null: none)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lookup(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", hot: list | None = None) -> DataFrame:
    """``left`` joined with ``right``, whose ``keys`` are unique, however many rows of ``left`` share a key.

    The hottest keys of ``left`` (at most HOT_KEYS; given, or counted here) meet their
    single row by a broadcast of that bounded size; all others meet by a shuffle in
    which no key is hot any more. ``left`` is read up to three times: give it written or
    cheap. Null keys match nothing.
    """
    if hot is None:
        hot = hot_keys(left.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")), keys)
    if not hot:
        return left.join(right, keys, how)
    known = F.broadcast(left.sparkSession.createDataFrame(hot, left.select(*keys).schema))
    met = right.join(known, keys, "left_semi")
    met = F.broadcast(known.join(met, keys, "left") if how == "left" else met)
    return left.join(met, keys).unionByName(left.join(known, keys, "left_anti").join(right, keys, how))


def hot_keys(counted: DataFrame, keys: list[str]) -> list[tuple]:
    """The keys of most ``rows`` in a table of counts: more than HOT_ROWS each, HOT_KEYS at most."""
    return [tuple(r) for r in counted.where(F.col("rows") > HOT_ROWS).orderBy(F.desc("rows"), *keys).limit(HOT_KEYS).select(*keys).collect()]


#: Bits of a filter for each key, the least and the most bits it has, and bits of a segment.
#: 64 MB is the bound of what is broadcast: beyond 2**26 keys a filter lets more through
#: (at 2**28 keys two thirds), so more rows reach the exact step after it.
KEY_BITS, LEAST_BITS, MOST_BITS, SEGMENT_BITS = 8, 1 << 18, 1 << 29, 1 << 18


def bit_filter(hashes: DataFrame, n: int | None = None) -> bytes:
    """A filter of the column ``h`` (long), sized by its number of rows (``n``, or counted here)."""
    n = hashes.count() if n is None else n
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (KEY_BITS * n - 1 if n else 0).bit_length()))

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            at = np.unique(batch.column(0).to_numpy() & (size - 1))
            for segment in np.unique(at // SEGMENT_BITS):
                bits = held.setdefault(int(segment), np.zeros(SEGMENT_BITS, bool))
                bits[at[at // SEGMENT_BITS == segment] % SEGMENT_BITS] = True
        for segment, bits in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["segment", "bits"])

    segment = F.shiftright(F.col("h").bitwiseAND(F.lit(size - 1)), SEGMENT_BITS.bit_length() - 1)
    parts = hashes.select("h").repartition(min(shuffle_width(hashes.sparkSession), size // SEGMENT_BITS), segment).mapInArrow(merge, "segment int, bits binary")
    out = np.zeros(size // 8, np.uint8)
    for at, bits in parts.collect():  # MOST_BITS / 8 bytes at most
        out[at * SEGMENT_BITS // 8 : (at + 1) * SEGMENT_BITS // 8] = np.frombuffer(bits, np.uint8)
    return out.tobytes()


def holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes (int64) a filter's bytes may hold."""
    at = hashes & (8 * len(bits) - 1)
    return ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)


def _solve(batches):
    """Edges (u, v) -> (node, to), to being the smallest node of the component."""
    parent: dict = {}

    def find(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for u, v in rows(batch, "u", "v"):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    if kind is not None:
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(x) for x in nodes], kind)], ["node", "to"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over the undirected ``edges`` (u, v).

    Each round merges every node into the neighbour of least priority, if that is less
    than its own, and rewrites the edges. Priorities are the nodes themselves in the
    first round, in which a star around its smallest node vanishes, and then hashes that
    differ from round to round, so that a constant part of any other graph's nodes goes.
    Once at most LOCAL_EDGES edges are left, one task solves them. Nodes without edges
    are absent.
    """
    edges = durable(edges.select("u", "v").where("u <> v").distinct())
    steps: list[DataFrame] = []
    while edges.limit(LOCAL_EDGES + 1).count() > LOCAL_EDGES:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        order = lambda c, r=len(steps): F.struct((F.xxhash64(c, F.lit(r)) if r else F.lit(0)).alias("_by"), F.col(c).alias("_is"))
        best = both.groupBy(F.col("u").alias("node")).agg(F.min(order("v")).alias("_best"), F.count(F.lit(1)).alias("rows"))
        best = durable(best.select("node", F.least("_best", order("node"))["_is"].alias("to"), "rows"))
        hot, moved = hot_keys(best, ["node"]), edges
        for side in ("u", "v"):
            moved = lookup(moved, best.select(F.col("node").alias(side), "to"), [side], hot=hot).drop(side).withColumnRenamed("to", side)
        before, edges = edges, durable(moved.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        discard(before)
        steps.append(best)
    kind = edges.schema["u"].dataType.simpleString()
    known = durable(edges.repartition(1).mapInArrow(_solve, f"node {kind}, to {kind}"))
    rounds = len(steps)
    while steps:  # from the last round back to the first
        further = known.select(F.col("node").alias("to"), F.col("to").alias("_root"))
        step, before = steps.pop(), known
        known = durable(lookup(step.drop("rows"), further, ["to"], "left").select("node", F.coalesce("_root", "to").alias("to")))
        discard(step, before)
    if rounds:
        least, before = durable(known.groupBy("to").agg(F.min("node").alias("component"))), known
        known = durable(lookup(known, least, ["to"]).select("node", F.col("component").alias("to")))
        discard(least, before)
    discard(edges)
    out = known.select("node", F.col("to").alias("component"))
    out._written = known._written
    return out


def same(df: DataFrame, other: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join in which null keys equal each other; the keys of ``other`` are dropped."""
    renamed = other.withColumnsRenamed({k: f"_{k}_" for k in keys})
    on = functools.reduce(operator.and_, (df[k].eqNullSafe(renamed[f"_{k}_"]) for k in keys))
    return df.join(renamed, on, how).drop(*(f"_{k}_" for k in keys))


def rows(batch: pa.RecordBatch, *names: str, step: int = 256, size: int = 1 << 22) -> Iterator[tuple]:
    """The rows of some columns as Python values: at most ``step`` at a time, and ``size`` bytes of text unless one row has more."""
    columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
    sizes = np.zeros(batch.num_rows + 1, np.int64)
    for c in columns:
        if pa.types.is_binary(c.type) or pa.types.is_string(c.type):
            sizes[1:] += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    sizes, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        to = max(at + 1, min(at + step, int(np.searchsorted(sizes, sizes[at] + size, "right")) - 1))
        yield from zip(*(c.slice(at, to - at).to_pylist() for c in columns), strict=True)
        at = to
