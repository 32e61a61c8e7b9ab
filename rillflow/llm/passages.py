"""Bytes that belong to a passage found anywhere else are removed: longest previous factors of suffix arrays.

Every window of LENGTH bytes has an anchor, the gram of GRAM bytes in it with the least
hash, so equal windows have equal anchors at the same place. Anchors own runs of
windows; their grams divide the search among tasks.

1. Grams that occur once own no repeated window and are dropped.
2. Anchors of a gram that own the same bytes (a hash of the whole region) are one region;
   the windows of one that occurs twice all repeat. That settles exact copies and the
   insides of longer passages before any suffix array.
3. What is left are the borders of passages. The distinct regions of a gram meet in one
   task, which builds a suffix array over them; the previous and next smaller positions
   in suffix order give each position's longest previous factor and its start.
4. A gram of more than CROWD regions would outgrow a task. Its regions are cut into runs
   of STEPS[0] windows and dealt by what all windows of a run share; runs whose shared
   bytes occur once are dropped, the others go through 2 and 3 again, and where a crowd
   is left once more, so do single windows. Equal windows always stay together.

A contract may ask to remove all copies, so the starts of long factors count as well.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.llm.common import HOT_KEYS, bit_filter, discard, durable, free_name, holds, lookup, rows, same, shuffle_width

LENGTH, GRAM = 400, 128
#: Regions of a gram that one suffix array holds, bytes that a task gathers for one array or before it sends them.
CROWD, GATHERED = 512, 1 << 19
#: Windows of a run into which the regions of crowded grams are cut, and then those of crowded runs.
STEPS = (16, 1)
#: Windows of a text that are looked at together, and regions whose bytes a task remembers to have sent.
SLAB, REMEMBERED = 1 << 18, 200_000
#: Low bits that hold a position when the least hash of a window is sought.
PLACE = np.uint64((1 << 28) - 1)


@functools.lru_cache(1)
def _tables(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, powers of an odd base and of its inverse modulo 2 ** 64."""
    r = np.random.default_rng(77)
    base = int(r.integers(2**62, 2**63)) | 1
    powers = lambda b: np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, b, np.uint64))])
    return r.integers(0, 2**63, 256, dtype=np.uint64), powers(base), powers(pow(base, -1, 2**64))


def gram_keys(data: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each gram, and the same with its place in the low bits."""
    n = len(data)
    with np.errstate(over="ignore"):
        byte, power, inverse = _tables(1 << max(17, (n + 1).bit_length()))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(byte[data] * power[:n])])
        hashes = (sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1]
        hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        hashes ^= hashes >> np.uint64(29)
    return hashes, (hashes & ~PLACE) | (np.arange(len(hashes), dtype=np.uint64) & PLACE)


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM, slab: int = SLAB) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, first and last owned window) of each anchor of a document's bytes.

    Long texts are read in slabs; an anchor that owns windows on both sides of a border counts as two.
    """
    out, width = [[np.zeros(0, np.int64)] for _ in range(3)], length - gram + 1
    for start in range(0, len(data) - length + 1, slab):
        part = data[start : start + slab + length - 1]
        hashes, keyed = gram_keys(part, gram)
        padded = np.concatenate([keyed, np.full(-len(keyed) % width, np.uint64(2**64 - 1))]).reshape(-1, width)
        ahead = np.minimum.accumulate(padded, axis=1).ravel()
        behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = len(part) - length + 1
        at = (np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows]) & PLACE).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        for o, values in zip(out, (hashes[at[first]].view(np.int64), start + first, start + np.concatenate([first[1:] - 1, [windows - 1]])), strict=True):
            o.append(values)
    return tuple(map(np.concatenate, out))


def region_hashes(data: bytes, first: np.ndarray, last: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """A hash of the bytes that each anchor's windows cover."""
    view = memoryview(data)
    return np.fromiter((xxhash.xxh3_64_intdigest(view[a : b + length]) for a, b in zip(first.tolist(), last.tolist(), strict=True)), np.uint64, len(first)).view(np.int64)


def ranks(codes: np.ndarray) -> list[np.ndarray]:
    """For each power of two the rank at each position of so many codes from it on, by prefix doubling.

    The last ranks are all different: those of the suffixes. The end ranks lowest.
    """
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int32) + 1
    out = [rank]
    while len(rank) and (top := int(rank.max())) < len(rank):
        joined, by = rank.astype(np.int64) * (top + 1), 1 << (len(out) - 1)
        joined[: len(rank) - by] += rank[by:]
        rank = np.unique(joined, return_inverse=True)[1].astype(np.int32) + 1
        out.append(rank)
    return out


def smaller(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position the smaller positions nearest before and after it in suffix order, or -1."""
    before, after, stack = [-1] * len(order), [-1] * len(order), [-1]
    for i in order.tolist():
        while stack[-1] > i:
            after[stack.pop()] = i
        before[i] = stack[-1]
        stack.append(i)
    return np.array(before, np.int64), np.array(after, np.int64)


def common(levels: list[np.ndarray], one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How many codes from the positions ``one`` and ``other`` on are equal (0 where ``other`` is -1).

    The last code must be unique, so that a match ends before it.
    """
    out, there = np.zeros(len(one), np.int64), np.flatnonzero(other >= 0)
    a, b = one[there], other[there]
    size = np.zeros(len(there), np.int64)
    for k in range(len(levels) - 2, -1, -1):
        size += (levels[k][a + size] == levels[k][b + size]).astype(np.int64) << k
    out[there] = size
    return out


def factors(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position the length of its longest previous factor, and where that starts (-1: length 0).

    It is the longest match that starts at a smaller position, and may overlap. Of all
    smaller positions, the nearest before and after in suffix order match longest. The
    last code must be unique.
    """
    levels = ranks(codes)
    before, after = smaller(np.argsort(levels[-1]))
    places = np.arange(len(codes))
    left, right = common(levels, places, before), common(levels, places, after)
    sizes = np.maximum(left, right)
    return sizes, np.where(sizes == 0, -1, np.where(left >= right, before, after))


def repeated_windows(regions: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each region whether the window from each position on also starts anywhere else in them.

    Regions are joined with a separator of its own after each, which no match crosses. A
    window has an earlier match if its longest previous factor is of full length. The
    first of equal windows has only later ones: it is marked as the start of the factor
    of the second, which has no other earlier match of that length.
    """
    sizes = np.array([len(r) + 1 for r in regions])
    ends = np.cumsum(sizes)
    codes = np.zeros(ends[-1], np.int64)
    body = np.ones(ends[-1], bool)
    body[ends - 1] = False
    codes[body] = np.frombuffer(b"".join(regions), np.uint8)
    codes[~body] = 256 + np.arange(len(regions))
    lengths, starts = factors(codes)
    found = lengths >= length
    found[starts[found]] = True
    return [found[e - s : e - 1] for e, s in zip(ends, sizes, strict=True)]


def runs(found: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], found, [False]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def _regions_of_small_grams(batches):
    """Rows (gram, region, bytes) in order of gram -> (gram, region, spans of repeated windows)."""
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def solved(held):
        found = repeated_windows([h[2] for h in held])
        spans = [[{"a": a, "b": b} for a, b in runs(f)] for f in found]
        return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.int64()), pa.array(spans, kind)], ["gram", "region", "spans"])

    held, size, start = [], 0, 0
    for batch in batches:
        for row in rows(batch, "gram", "region", "bytes"):
            if held and row[0] != held[-1][0]:
                if len(held) == start + 1:  # a gram of one region owns no repeated window
                    size -= len(held.pop()[2])
                if size >= GATHERED:
                    yield solved(held)
                    held, size = [], 0
                start = len(held)
            held.append(row)
            size += len(row[2])
    if len(held) == start + 1:
        held.pop()
    if held:
        yield solved(held)


def pieces(data: bytes, step: int) -> list[tuple[int, int, int]]:
    """(hash of the bytes that all its windows share, first and last window) of each run of a region.

    Runs are counted from the anchor, so equal windows are in runs that share the same bytes.
    """
    windows = len(data) - LENGTH + 1
    _, keyed = gram_keys(np.frombuffer(data, np.uint8, LENGTH), GRAM)
    place, view, out = int(keyed.argmin()), memoryview(data), []
    for k in range(max(0, place - windows + 1) // step, place // step + 1):
        shared = view[place - k * step : place - k * step + LENGTH - step + 1]
        out.append((xxhash.xxh3_64_intdigest(shared, k) - 2**63, max(0, place - k * step - step + 1), min(windows - 1, place - k * step)))
    return out


def refined(crowd: DataFrame, level: int) -> DataFrame:
    """(gram, region, spans) of the repeated windows in the regions (gram, region, n, bytes) of crowded grams, by runs."""
    step = STEPS[level]

    def shared(batches):
        for batch in batches:
            found = [h for data, n in rows(batch, "bytes", "n") for h, _, _ in pieces(data, step)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["h"])

    again = durable(crowd.select("bytes", "n").mapInArrow(shared, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
    bits = crowd.sparkSession.sparkContext.broadcast(bit_filter(again))

    def cut_up(batches):
        for batch in batches:
            out, size = [], 0
            for gram, region, data in rows(batch, "gram", "region", "bytes"):
                found = pieces(data, step)
                for (h, a, b), held in zip(found, holds(np.frombuffer(bits.value, np.uint8), np.array([f[0] for f in found], np.int64)).tolist(), strict=True):
                    if held:
                        own = data[a : b + LENGTH]
                        out.append((gram, region, a, h, xxhash.xxh3_64_intdigest(own) - 2**63, own))
                        size += len(own)
                if size > GATHERED:
                    yield sent(out)
                    out, size = [], 0
            if out:
                yield sent(out)

    def sent(out: list) -> pa.RecordBatch:
        columns = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["_gram", "_region", "_a", "gram", "region", "bytes"])

    cuts = durable(crowd.select("gram", "region", "bytes").mapInArrow(cut_up, "_gram long, _region long, _a int, gram long, region long, bytes binary"))
    solved = settled(cuts.groupBy("gram", "region").agg(F.count(F.lit(1)).alias("n"), F.max("bytes").alias("bytes")), level + 1)
    met = lookup(cuts.select("_gram", "_region", "_a", "gram", "region", (F.octet_length("bytes") - LENGTH).alias("_last")), solved, ["gram", "region"])
    span = F.coalesce("spans", F.array(F.struct(F.lit(0).alias("a"), F.col("_last").alias("b"))))
    spans = F.transform(span, lambda x: F.struct((x["a"] + F.col("_a")).cast("int").alias("a"), (x["b"] + F.col("_a")).cast("int").alias("b")))
    return met.groupBy(F.col("_gram").alias("gram"), F.col("_region").alias("region")).agg(F.flatten(F.collect_list(spans)).alias("spans"))


def settled(distinct: DataFrame, level: int = 0) -> DataFrame:
    """(gram, region, spans) of the distinct regions (gram, region, n, bytes) with repeated windows; null spans: all of them."""
    width = shuffle_width(distinct.sparkSession)
    distinct = durable(distinct)
    whole = distinct.where("n > 1").select("gram", "region", F.lit(None).cast("array<struct<a: int, b: int>>").alias("spans"))
    if level == len(STEPS):  # single windows: those of a gram are equal
        return whole
    crowds = durable(distinct.groupBy("gram").agg(F.count(F.lit(1)).alias("regions")).where(F.col("regions") > CROWD).select("gram"))
    n = crowds.limit(HOT_KEYS + 1).count()
    known = F.broadcast(crowds) if n <= HOT_KEYS else crowds
    small = distinct.join(known, "gram", "left_anti").select("gram", "region", "bytes").repartition(width, "gram").sortWithinPartitions("gram")
    spans = small.mapInArrow(_regions_of_small_grams, "gram long, region long, spans array<struct<a: int, b: int>>").where(F.size("spans") > 0)
    if n:
        spans = spans.unionByName(refined(durable(distinct.join(known, "gram", "left_semi").repartition(width, "gram", "region")), level))
    once = distinct.where("n = 1").select("gram", "region")
    return durable(whole.unionByName(spans.join(once, ["gram", "region"], "left_semi")))


def passages(docs: DataFrame, ref: str) -> DataFrame:
    """(doc_id, ref, start, end) of byte ranges of repeated passages in ``docs`` (doc_id, text binary, ref).

    Ranges of a document may overlap; together they are exactly the bytes in question.
    """
    spark = docs.sparkSession
    id_type = dict(docs.dtypes)["doc_id"]

    def seen(batches):
        for batch in batches:
            grams, regions = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for (text,) in rows(batch, "text"):
                if text and len(text) >= LENGTH:
                    gram, first, last = anchors(np.frombuffer(text, np.uint8))
                    grams.append(gram)
                    regions.append(region_hashes(text, first, last))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (grams, regions)], ["gram", "region"])

    every = docs.select("text").mapInArrow(seen, "gram long, region long")
    grams = every.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("region").alias("lo"), F.max("region").alias("hi"))
    grams = durable(grams.where("n > 1").select("gram", (F.col("lo") != F.col("hi")).alias("mixed")))
    shared = spark.sparkContext.broadcast([bit_filter(x.select(F.col("gram").alias("h"))) for x in (grams, grams.where("mixed"))])
    names = ["doc_id", "ref", "first", "last", "gram", "region", "bytes"]

    def repeats(batches):
        """The anchors whose gram may repeat; with the bytes, where regions may differ, the first time that a task meets them."""
        again, mixed = (np.frombuffer(b, np.uint8) for b in shared.value)
        known: set[int] = set()
        for batch in batches:
            at_row, out, size = [], [[], [], [], [], []], 0

            def sent() -> pa.RecordBatch:
                take = pa.array(np.repeat([r for r, _ in at_row], [n for _, n in at_row]), pa.int64())
                columns = [pa.array(np.concatenate(o), pa.int64()) for o in out[:4]]
                return pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *columns, pa.array(out[4], pa.binary())], names)

            for at, (text,) in enumerate(rows(batch, "text")):
                if not text or len(text) < LENGTH:
                    continue
                gram, first, last = anchors(np.frombuffer(text, np.uint8))
                keep = holds(again, gram)
                if not keep.any():
                    continue
                gram, first, last = gram[keep], first[keep], last[keep]
                region = region_hashes(text, first, last)
                at_row.append((at, len(gram)))
                for o, values in zip(out, (first, last, gram, region), strict=False):
                    o.append(values)
                for a, b, r, w in zip(first.tolist(), last.tolist(), region.tolist(), holds(mixed, gram).tolist(), strict=True):
                    if w and r not in known:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known.add(r)
                        out[4].append(text[a : b + LENGTH])
                        size += b + LENGTH - a
                    else:
                        out[4].append(None)
                size += 40 * len(gram)
                if size > 4 * GATHERED:
                    yield sent()
                    at_row, out, size = [], [[], [], [], [], []], 0
            if at_row:
                yield sent()

    found = durable(docs.select("doc_id", ref, "text").mapInArrow(repeats, f"doc_id {id_type}, ref long, first long, last long, gram long, region long, bytes binary"))
    places = durable(lookup(found.drop("bytes"), grams, ["gram"]))
    distinct = found.groupBy("gram", "region").agg(F.count(F.lit(1)).alias("n"), F.max("bytes").alias("bytes")).where("bytes is not null")
    solved = settled(distinct)

    plain = places.where("not mixed").select("doc_id", "ref", F.col("first").alias("start"), (F.col("last") + LENGTH).alias("end"))
    fitted = lookup(places.where("mixed"), solved, ["gram", "region"])
    fitted = fitted.select("doc_id", "ref", "first", F.explode(F.coalesce("spans", F.array(F.struct(F.lit(0).alias("a"), (F.col("last") - F.col("first")).cast("int").alias("b"))))).alias("span"))
    out = plain.unionByName(fitted.select("doc_id", "ref", (F.col("first") + F.col("span.a")).alias("start"), (F.col("first") + F.col("span.b") + LENGTH).alias("end")))
    out = durable(out.groupBy("doc_id", "ref").agg(F.collect_set(F.struct("start", "end")).alias("ranges")))
    discard(grams, found, places, solved)
    return out


def cut(data: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """The bytes outside the ranges, how many are inside, and in how many maximal runs."""
    kept, at, n_spans, reach = [], 0, 0, -1
    for a, b in sorted(ranges):
        if a > reach:
            n_spans += 1
            kept.append(data[at:a])
        at = reach = max(reach, b)
    kept = b"".join([*kept, data[at:]])
    return kept, len(data) - len(kept), n_spans


def remove_passages(docs: DataFrame) -> DataFrame:
    """``docs`` with kept (binary), n_bytes, n_removed, n_spans instead of text.

    Each byte of a text (UTF-8; null counts as empty) that a string of LENGTH bytes
    covers which also starts elsewhere, in any row or the same one, is removed. Rows are
    documents: two rows with one text count as two, whatever their ids. A null id is an
    id like others. Other columns are passed on; input columns of the new names are
    replaced. Texts of any length are read in slabs; those under LENGTH bytes, empty ones
    included, stay as they are, and an empty table gives an empty result. Documents in
    which nothing is removed are not shuffled. Regions are told apart by 64-bit hashes.
    """
    docs = docs.drop("kept", "n_bytes", "n_removed", "n_spans")
    spark, names, ref, found = docs.sparkSession, [c for c in docs.columns if c != "text"], free_name(docs, "_ref"), free_name(docs, "_ranges")
    named = docs.withColumns({ref: F.xxhash64("doc_id", "text"), "text": F.coalesce(F.col("text"), F.lit("")).cast("binary")})
    ranges = passages(named.select("doc_id", F.col(ref).alias("ref"), "text"), "ref").select("doc_id", F.col("ref").alias(ref), F.col("ranges").alias(found))
    shared = spark.sparkContext.broadcast(bit_filter(ranges.select(F.col(ref).alias("h"))))

    def split(hit: bool):
        def run(batches):
            bits = np.frombuffer(shared.value, np.uint8)
            for batch in batches:
                yield batch.filter(pa.array(holds(bits, batch.column(batch.schema.get_field_index(ref)).to_numpy()) == hit))

        return named.mapInArrow(run, named.schema)

    joined = same(split(True), ranges, ["doc_id", ref], "left").unionByName(split(False).withColumn(found, F.lit(None).cast(ranges.schema[found].dataType)))

    def rewrite(batches):
        for batch in batches:
            kept, counts = [], []
            for text, spans in rows(batch, "text", found):
                rest, n_removed, n_spans = cut(text, [(r["start"], r["end"]) for r in spans or ()])
                kept.append(rest)
                counts.append((len(text), n_removed, n_spans))
            out = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*out, pa.array(kept, pa.binary()), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(3))], [*names, "kept", "n_bytes", "n_removed", "n_spans"])

    more = [T.StructField("kept", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans"))]
    return joined.mapInArrow(rewrite, T.StructType([*(docs.schema[c] for c in names), *more]))
