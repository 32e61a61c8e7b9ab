"""Line dedup: lines that many documents share stay only in the document with the largest id.

Two Bloom filters, of hashes seen once and seen twice, are filled from the hashes of
all lines. Only lines whose hash the second filter holds are suspects; only they are
shuffled (a 32-byte digest and the document's id) to be confirmed exactly and to choose
the document that keeps them. A false positive costs a few shuffled bytes, never a
wrong result, and a false negative can't happen.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.llm.common import SPACES, bit_filter, discard, durable, free_name, holds, lookup, rows, same, shuffle_width

#: Bits of each Bloom filter (8 MB at any size of the input; a fuller filter only
#: means more suspects), bits of a segment, and hashes gathered before they are emitted.
FILTER_BITS, SEGMENT_BITS, GATHERED = 1 << 26, 1 << 18, 1 << 20
_STRIP = SPACES.encode()


def line_keys(text: bytes | None) -> list[bytes]:
    """The key of each line: stripped of white space and A-Z in lower case."""
    return [k.strip(_STRIP) for k in (text or b"").lower().split(b"\n")]  # bytes.lower() changes A-Z only


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or key.isascii() or len(key.decode("utf-8", "replace")) >= least)


def _bits(hashes: np.ndarray, filter_bits: int) -> np.ndarray:
    """Two bit positions for each hash, as a matrix of two rows."""
    return np.stack([hashes & np.uint64(filter_bits - 1), (hashes >> np.uint64(32)) & np.uint64(filter_bits - 1)]).astype(np.int64)


def _segments(hashes: np.ndarray, filter_bits: int) -> pa.RecordBatch:
    """The bits that these hashes set in the two filters, by segment."""
    distinct, times = np.unique(hashes, return_counts=True)
    out = {"segment": [], "once": [], "twice": []}
    once, twice = (np.unique(_bits(h, filter_bits)) for h in (distinct, distinct[times > 1]))
    for segment in np.unique(once // SEGMENT_BITS):
        lo, hi = segment * SEGMENT_BITS, (segment + 1) * SEGMENT_BITS
        out["segment"].append(int(segment))
        for name, all_bits in (("once", once), ("twice", twice)):
            part = all_bits[np.searchsorted(all_bits, lo) : np.searchsorted(all_bits, hi)] - lo
            out[name].append(part.astype(np.uint32).tobytes())
    return pa.RecordBatch.from_arrays([pa.array(out["segment"], pa.int32()), pa.array(out["once"], pa.binary()), pa.array(out["twice"], pa.binary())], list(out))


def twice_seen(docs: DataFrame, least: int, filter_bits: int) -> bytes:
    """The filter of hashes seen twice or more, filter_bits / 8 bytes."""

    def emit(batches):
        held, n = [], 0
        for batch in batches:
            for (text,) in rows(batch, "text"):
                found = {xxhash.xxh3_64_intdigest(k) for k in set(line_keys(text)) if long_enough(k, least)}
                if found:
                    held.append(np.fromiter(found, np.uint64, len(found)))
                    n += len(found)
                if n >= GATHERED:
                    yield _segments(np.concatenate(held), filter_bits)
                    held, n = [], 0
        if held:
            yield _segments(np.concatenate(held), filter_bits)

    def merge(batches):
        state: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for segment, once, twice in rows(batch, "segment", "once", "twice"):
                seen, again = state.setdefault(segment, (np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)))
                at = np.frombuffer(once, np.uint32)
                again[np.frombuffer(twice, np.uint32)] = True
                again[at[seen[at]]] = True
                seen[at] = True
        for segment, (_, again) in state.items():
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([np.packbits(again).tobytes()], pa.binary())], ["segment", "bits"])

    parts = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(emit, "segment int, once binary, twice binary")
    parts = parts.repartition(min(shuffle_width(docs.sparkSession), filter_bits // SEGMENT_BITS or 1), "segment").mapInArrow(merge, "segment int, bits binary")
    out = np.zeros(filter_bits // 8, np.uint8)
    for segment, bits in parts.collect():  # FILTER_BITS / 8 bytes at most
        at = segment * SEGMENT_BITS // 8
        out[at : at + SEGMENT_BITS // 8] = np.frombuffer(bits, np.uint8)[: filter_bits // 8 - at]
    return out.tobytes()


def suspects(text: bytes | None, bits: np.ndarray, least: int) -> list[bytes]:
    """The distinct keys of a document that the filter holds."""
    keys = [k for k in set(line_keys(text)) if long_enough(k, least)]
    if not keys:
        return []
    at = _bits(np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys)), len(bits) * 8)
    held = ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)
    return [keys[i] for i in np.flatnonzero(held)]


def drop_repeated_lines(docs: DataFrame, least: int = 20, documents: int = 3, filter_bits: int = FILTER_BITS) -> DataFrame:
    """``docs`` with their ``text`` rid of repeated lines, and the columns n_lines and n_dropped.

    A key of at least ``least`` code points that at least ``documents`` rows hold loses
    its lines in all rows but those with the largest doc_id among them. Null text counts
    as one empty line and stays null. A null doc_id counts as a document but is never the
    largest; where all holders have one, nothing is dropped. Rows that share a doc_id
    count as documents each and keep or lose a line alike. Other columns are passed on;
    an input column n_lines or n_dropped is replaced. Texts of any length are read whole,
    one at a time; a text without a line to drop is not shuffled. An empty table gives
    an empty result.
    """
    spark, docs = docs.sparkSession, docs.drop("n_lines", "n_dropped")
    shared = spark.sparkContext.broadcast(twice_seen(docs, least, filter_bits))
    id_type, names = dict(docs.dtypes)["doc_id"], docs.columns

    def occurrences(batches):
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            ids, keys = [], []
            for at, (text,) in enumerate(rows(batch, "text")):
                for key in suspects(text, bits, least):
                    ids.append(at)
                    keys.append(hashlib.sha256(key).digest())
            if ids:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids)), pa.array(keys, pa.binary())], ["doc_id", "key"])

    found = durable(docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(occurrences, f"doc_id {id_type}, key binary"))
    holders = found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")).where((F.col("n") >= documents) & F.col("last").isNotNull())
    holders = durable(holders.select("key", "last"))
    drops = lookup(found, holders, ["key"]).where(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("last")))
    mark, gone_ = free_name(docs, "_mark"), free_name(docs, "_drop")
    drops = durable(drops.groupBy("doc_id").agg(F.collect_set("key").alias(gone_)))
    discard(found, holders)
    marks = spark.sparkContext.broadcast(bit_filter(drops.select(F.xxhash64("doc_id").alias("h"))))
    marked = docs.withColumn(mark, F.xxhash64("doc_id"))

    def split(kept: bool):
        """Documents with (or without) a line to drop; those without need no shuffle."""

        def run(batches):
            bits = np.frombuffer(marks.value, np.uint8)
            for batch in batches:
                yield batch.filter(pa.array(holds(bits, batch.column(batch.schema.get_field_index(mark)).to_numpy()) == kept))

        return marked.mapInArrow(run, marked.schema)

    def rewrite(batches):
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, drop in rows(batch, "text", gone_):
                lines, kept = (text or "").split("\n"), text
                if drop:
                    gone = set(drop)
                    keep = [line for line, key in zip(lines, line_keys(text.encode()), strict=True) if not (long_enough(key, least) and hashlib.sha256(key).digest() in gone)]
                    kept = "\n".join(keep)
                    n_dropped.append(len(lines) - len(keep))
                else:
                    n_dropped.append(0)
                texts.append(kept)
                n_lines.append(len(lines))
            out = [batch.column(batch.schema.get_field_index(c)) if c != "text" else pa.array(texts, pa.string()) for c in names]
            yield pa.RecordBatch.from_arrays([*out, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*names, "n_lines", "n_dropped"])

    joined = same(split(True), drops, ["doc_id"], "left").unionByName(split(False).withColumn(gone_, F.lit(None).cast("array<binary>")))
    out = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return joined.mapInArrow(rewrite, out)
