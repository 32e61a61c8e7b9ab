"""Embedding near-dedup: p-stable hashing for the Euclidean distance, then exact cosines.

Vectors are scaled to length 1; a table hashes one to the tuple of
floor((a_i . v + b_i) / WIDTH) over PROJECTIONS Gaussian directions. Vectors of a label
that share a bucket of any table are compared by their exact cosine. A pair counts in
the first table that brings it together only, so counts need no list of pairs: what
leaves a task is a number of links for each vector and a spanning forest. Buckets are
counted first, and vectors are sent to those of two or more only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import HOT_KEYS, bit_filter, components, discard, durable, holds, lookup, shuffle_width

#: Unit vectors of cosine 0.98 are 0.2 apart: they share one projection with probability
#: 0.84, all of a table with 0.29, and at least one table of 20 with 0.999.
TABLES, PROJECTIONS, WIDTH, SEED = 20, 7, 1.0, 20240229
#: Larger buckets are compared in blocks of about so many vectors.
BLOCK = 1024


def directions(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The directions (size, TABLES * PROJECTIONS) and offsets for vectors of a size."""
    r = np.random.default_rng([SEED, size])
    return r.standard_normal((size, TABLES * PROJECTIONS)), r.uniform(0, WIDTH, TABLES * PROJECTIONS)


def signatures(unit: np.ndarray) -> np.ndarray:
    """The bucket of each unit vector in each table, as a 64-bit hash of the tuple."""
    a, b = directions(unit.shape[1])
    cells = np.floor((unit @ a + b) / WIDTH).astype(np.int64).reshape(len(unit), TABLES, PROJECTIONS)
    odd = np.random.default_rng(SEED).integers(1, 2**63, PROJECTIONS, dtype=np.uint64) | np.uint64(1)
    with np.errstate(over="ignore"):
        mixed = (cells.view(np.uint64) * odd).sum(axis=2, dtype=np.uint64)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed ^ (mixed >> np.uint64(32))).view(np.int64)


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest one that the pairs (i, j) connect it with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(table: int, least: float, a: dict, b: dict | None) -> tuple[list, list, list]:
    """Rows (u, v, n) of one bucket, or of two blocks of it: numbers of links (v null) and edges (n null)."""
    both = a if b is None else {k: np.concatenate([a[k], b[k]]) for k in a}
    split = len(a["id"])
    i, j = np.nonzero(a["unit"] @ (a if b is None else b)["unit"].T >= least)
    if b is None:
        i, j = i[i < j], j[i < j]
    else:
        j = j + split
    new = ~(both["sig"][i, :table] == both["sig"][j, :table]).any(axis=1)
    i, j = i[new], j[new]
    if not len(i):
        return [], [], []
    n = np.bincount(i, both["n"][j], len(both["id"])) + np.bincount(j, both["n"][i], len(both["id"]))
    found = np.flatnonzero(n)
    root = local_roots(len(both["id"]), i, j)
    tied = np.flatnonzero(root != np.arange(len(root)))
    ids = both["id"]
    return [*ids[found].tolist(), *ids[tied].tolist()], [*[None] * len(found), *ids[root[tied]].tolist()], [*n[found].astype(int).tolist(), *[None] * len(tied)]


def near_duplicates(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors`` (vec_id, embedding, label).

    Only rows of the same non-null label and vector length are compared. Null, empty and
    zero vectors, vectors with null or non-finite components, and rows without vec_id
    link with nothing. Equal vectors (of a label) are one class that is compared once
    and counts with all its rows. Rows that share a vec_id count as vectors each, and
    kept is null-safe: false without vec_id. Other columns are not looked at; an empty
    table gives an empty result.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & ~bad & some, F.lit(False))
    rows = vectors.select("vec_id", "label", F.when(usable, F.col("embedding")).alias("embedding"))
    classes = durable(rows.where(F.col("embedding").isNotNull()).groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n")))

    def buckets(batch):
        """(rows, table, buckets, signatures, vectors) of a batch, by vector length and table."""
        labels = batch.column(0).to_pylist()
        column = batch.column(1)
        offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
        sizes = np.diff(offsets)
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            raw = values[offsets[at][:, None] + np.arange(size)].astype(np.float64)
            sig = signatures(unit_rows(raw / np.abs(raw).max(axis=1, keepdims=True)))
            for t in range(TABLES):
                yield at, t, np.array([xxhash.xxh3_64_intdigest(f"{labels[k]} {size} {t} {s}") - 2**63 for k, s in zip(at, sig[:, t].tolist(), strict=True)], np.int64), sig, raw

    def hash_only(batches):
        for batch in batches:
            for _, _, key, _, _ in buckets(batch):
                yield pa.RecordBatch.from_arrays([pa.array(key)], ["bucket"])

    sizes = durable(classes.select("label", "embedding").mapInArrow(hash_only, "bucket long").groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    shared = vectors.sparkSession.sparkContext.broadcast(bit_filter(sizes.select(F.col("bucket").alias("h"))))
    kind = np.float64 if dict(vectors.dtypes)["embedding"] == "array<double>" else np.float32

    def hash_rows(batches):
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            ids, counts = (np.array(batch.column(k).to_pylist(), np.int64) for k in (2, 3))
            for at, t, key, sig, raw in buckets(batch):
                kept = np.flatnonzero(holds(bits, key))
                if len(kept):
                    own = at[kept]
                    yield pa.RecordBatch.from_arrays([pa.array(key[kept]), pa.array([t] * len(own), pa.int32()), pa.array(ids[own]), pa.array(counts[own]), pa.array([raw[k].astype(kind).tobytes() for k in kept], pa.binary()), pa.array([sig[k].tobytes() for k in kept], pa.binary())], ["bucket", "table", "id", "n", "vector", "sigs"])

    hashed = classes.select("label", "embedding", "id", "n").mapInArrow(hash_rows, "bucket long, table int, id long, n long, vector binary, sigs binary")
    sizes = durable(sizes.where(F.col("size") > BLOCK))
    few = sizes.limit(HOT_KEYS + 1).count() <= HOT_KEYS
    parts = F.coalesce(F.ceil(F.col("size") / BLOCK), F.lit(1)).cast("int")
    dealt = hashed.join(F.broadcast(sizes) if few else sizes, "bucket", "left").withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "table", "id", "n", "vector", "sigs")
    dealt = dealt.repartition(shuffle_width(vectors.sparkSession), "bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "own")

    def compare(batches):
        held: list[tuple] = []

        def flush(group: list[tuple]):
            if len(group) < 2:
                return [], [], []
            _, lo, hi, own, table, ids, n, vector, sigs = zip(*group, strict=True)
            unit = np.frombuffer(b"".join(vector), kind).astype(np.float64).reshape(len(group), -1)
            unit = unit_rows(unit / np.abs(unit).max(axis=1, keepdims=True))
            all_ = {"id": np.array(ids), "n": np.array(n), "unit": unit, "sig": np.frombuffer(b"".join(sigs), np.int64).reshape(len(group), TABLES)}
            if lo[0] == hi[0]:
                return _compare(table[0], least, all_, None)
            split = sum(o == lo[0] for o in own)
            return _compare(table[0], least, {k: v[:split] for k, v in all_.items()}, {k: v[split:] for k, v in all_.items()})

        def out(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(f, pa.int64()) for f in found], ["u", "v", "n"])

        for batch in batches:
            keys = [np.array(batch.column(k).to_pylist(), dtype=np.int64) for k in range(3)]
            cut = np.flatnonzero(np.logical_or.reduce([np.diff(k) != 0 for k in keys])) + 1
            bounds, found = [0, *cut.tolist(), batch.num_rows], ([], [], [])
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if a and b - a == 1 and b < batch.num_rows:
                    continue  # alone in its bucket
                group = list(zip(*(c.slice(a, b - a).to_pylist() for c in batch.columns), strict=True))
                if a == 0 and held and held[-1][:3] == group[0][:3]:
                    group = held + group
                elif held:
                    for x, y in zip(found, flush(held), strict=True):
                        x += y
                held = []
                if b == batch.num_rows:
                    held = group
                else:
                    for x, y in zip(found, flush(group), strict=True):
                        x += y
            yield out(found)
        yield out(flush(held))

    found = durable(dealt.mapInArrow(compare, "u long, v long, n long"))
    linked = found.where("n is not null").groupBy(F.col("u").alias("id")).agg(F.sum("n").alias("links"))
    whole = components(found.where("v is not null").select("u", "v"))
    known = classes.join(linked, "id", "left").join(whole, F.col("id") == F.col("node"), "left")
    known = durable(known.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    discard(found, whole, classes, sizes)
    alone = rows.where(F.col("embedding").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = lookup(rows.where(F.col("embedding").isNotNull()), known, ["label", "embedding"]).select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
