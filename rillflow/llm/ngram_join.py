"""N-gram Jaccard join: candidates by equal parts of their sets, then prefix trees inside groups of candidates.

1. Documents with equal shingle sets are one class (a 128-bit digest of the set).
2. Sets of Jaccard similarity t or more differ in at most D shingles, D in proportion to
   their sizes. The hash space is cut into parts; of any D + 1 parts one is equal in
   both. Each class posts a hash of what it holds of so many parts, and classes that
   post the same hash are candidates. That needs no counts of the corpus, so nothing is
   broadcast and nothing fills up: the rows posted are in proportion to the input. Only
   pairs go on whose sketches (counts of shingles by CELLS ranges of hashes) let them be
   similar, so that groups of candidates don't grow by chance meetings. Up to PAIRED
   classes with a hash are sent as pairs; more meet around the first of them, with their
   sketches, so that the rows sent are no more than those posted.
3. Each connected group of candidates is joined in a trie of its globally ordered sets
   (frequent shingles first, so that near copies share long paths). A query's overlap
   is counted once for all sets below a node; subtrees are pruned by what sizes and
   remaining lengths allow, and where all sets are known to be in the query's component.
   Groups of more than BLOCK classes are dealt out in pairs of blocks.
4. Components of the links that were found give each document its component.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import HOT_KEYS, bit_filter, components, discard, durable, holds, hot_keys, lookup, release, rows, shuffle_width

#: Ratio of the sizes in a scheme of parts, and how often a set with too many empty parts is cut anew.
RATIO, SEEDS = 1.5, 8
#: One class in so many is looked at to find the hot hashes (which only decides how their rows are dealt).
LOOKED_AT = 32
#: Classes with one hash that are sent as pairs, and cells of a sketch (a byte each).
PAIRED, CELLS = 8, 256
#: Classes of a crowd (more than PAIRED with one hash) that one task compares.
CROWD = 4096
#: Classes of a candidate group that one trie holds.
BLOCK = 1024
#: Digests that a task remembers in order not to send a set twice.
REMEMBERED = 200_000


def shingles(text: str | bytes | None, n: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's n-word shingles (fewer words: of all of them)."""
    if text is None:
        return np.zeros(0, np.uint64)
    found = (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).lower().split()  # bytes: A-Z and the six spaces only
    if not found:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    k = min(n, len(found))
    m = len(found) - k + 1
    with np.errstate(over="ignore"):
        out = np.full(m, np.uint64(k))
        for i in range(k):
            out = (out ^ hashes[i : i + m]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def least_overlap(size: int, percent: int) -> int:
    """The least overlap with any set that is similar enough."""
    return -(-percent * size // 100)


def most_different(size: int, percent: int) -> int:
    """The most shingles in which a set of ``size`` and a similar one that is no smaller can differ."""
    return (size + 100 * size // percent) * (100 - percent) // (100 + percent)


def _posted(size: int, parts: int, spare: int, percent: int) -> float:
    """About how many hashes a set posts: parts, times the attempts until no more than ``spare`` are empty."""
    posted = most_different(size, percent) + 1 + spare
    empty = posted * (1 - 1 / parts) ** size
    if empty > 40:
        enough = 0.5 * math.erfc((empty - spare - 0.5) / math.sqrt(2 * empty))
    else:
        enough = sum(math.exp(-empty) * empty**i / math.factorial(i) for i in range(min(spare, 120) + 1))
    return posted / max(enough, 1 / SEEDS)


@functools.cache
def scheme(number: int, percent: int) -> tuple[int, int, int, int]:
    """(least size, most size, parts, spare parts) of a range of sizes.

    A set and a similar larger one lie in one range or in neighbours. Spare parts make up
    for empty ones, which prove nothing; as many are taken as make the fewest hashes.
    """
    low = scheme(number - 1, percent)[1] + 1 if number else 1
    high = max(low, int(low * max(RATIO, 100 / percent + 0.1)))
    different, best = most_different(high, percent), (math.inf, 0)
    for spare in range(0, different + 9, 1 + different // 200):
        cost = sum(_posted(size, different + 1 + spare, spare, percent) for size in (low, (low + high) // 2, high))
        best = min(best, (cost, spare))
    return low, high, different + 1 + best[1], best[1]


@functools.lru_cache(100_000)
def schemes(size: int, percent: int) -> tuple[int, ...]:
    """The ranges in which a set of this size posts: its own and, if a similar set may be there, the one below."""
    number = 0
    while scheme(number, percent)[1] < size:
        number += 1
    return (number - 1, number) if number and scheme(number - 1, percent)[1] >= least_overlap(size, percent) else (number,)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


def parts_of(found: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of parts of a set, of which any similar set posts one at least.

    If two similar sets share no posted part that holds a shingle, those of the first parts
    that are equal are empty in both, more than are spare: both then cut the hash
    space anew by the next seed, and in the end post their empty parts as well.
    """
    out = []
    for number in schemes(len(found), percent):
        _, high, parts, spare = scheme(number, percent)
        posted = min(parts, most_different(min(len(found), high), percent) + 1 + spare)
        hashes = found
        for seed in range(SEEDS):
            if seed:
                hashes = np.sort(_mixed(found + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)))
            at = ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            starts = np.searchsorted(at, np.arange(posted + 1, dtype=np.uint64))
            full = starts[1:] > starts[:-1]
            with np.errstate(over="ignore"):
                sums = np.zeros(posted, np.uint64)
                if full.any():
                    sums[full] = np.add.reduceat(_mixed(hashes[: starts[-1]]), starts[:-1][full])
                keys = _mixed(_mixed(sums) + np.arange(posted, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(number * SEEDS + seed) * np.uint64(0x9FB21C651E98DF25))
            again = posted - int(np.count_nonzero(full)) > spare
            out.append(keys if again and seed == SEEDS - 1 else keys[full])
            if not again:
                break
    return np.concatenate(out)


def described(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, class, short, text_hash, sketch) of each row; null from class on for an empty set."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            sizes, digests, hashes, sketches = [], [], [], []
            for (text,) in rows(batch, "text"):
                found = shingles(text, n)
                sizes.append(len(found))
                digests.append(digest(found) if len(found) else None)
                hashes.append(_text_hash(text) if len(found) else None)
                sketches.append(sketch(found) if len(found) else None)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array([d and _short(d) for d in digests], pa.int64()), pa.array(hashes, pa.int64()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "class", "short", "text_hash", "sketch"])

    return docs.mapInArrow(run, f"doc_id {kind}, n_shingles long, class binary, short long, text_hash long, sketch binary")


def sketch(found: np.ndarray) -> bytes:
    """How many shingles fall into each cell, 255 at most."""
    return np.minimum(np.bincount((found >> np.uint64(24) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS), 255).astype(np.uint8).tobytes()


def may_be_similar(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets with the sketches a and b (rows) and these sums of sizes can be similar; full cells prove nothing."""
    least = np.minimum(a, b)
    return ((100 + percent) * least.sum(axis=1, dtype=np.int64) >= percent * sizes) | (least == 255).any(axis=1)


def _text_hash(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) - 2**63


def _short(name: bytes) -> int:
    return int.from_bytes(name[:8], "big", signed=True)


def posted(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(key, u) for each hash that a class posts; a task posts a class it remembers once."""

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            keys, names, size = [], [], 0
            for (text,) in rows(batch, "text"):
                found = shingles(text, n)
                if most_different(len(found), percent) == 0 and 100 * (len(found) - 1) < percent * len(found):
                    continue  # similar to equal sets only
                name = digest(found)
                if name not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(name)
                    keys.append(parts_of(found, percent).view(np.int64))
                    names.append(np.full(len(keys[-1]), _short(name)))
                    size += len(keys[-1])
                if size > 1 << 17:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, names)], ["key", "u"])
                    keys, names, size = [], [], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, names)], ["key", "u"])

    return docs.select("text").mapInArrow(run, "key long, u long")


def _meetings(batches):
    """Rows (key, u) in order -> pairs (u, v) of classes that share a key; of more than PAIRED classes, those with the first (star)."""
    last, tail, large = 0, np.zeros(0, np.int64), False

    def out(u: np.ndarray, v: np.ndarray, star: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.full(len(u), star))], ["u", "v", "star"])

    def pairs(u: np.ndarray, ends: np.ndarray):
        """Of each row with all later rows before its end."""
        at, by = np.arange(len(u)), 1
        while len(at := at[at + by < ends[at]]):
            yield out(u[at], u[at + by], False)
            by += 1

    for batch in batches:
        key, u = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        key, u = np.concatenate([np.full(len(tail), last), key]), np.concatenate([tail, u])
        if not len(key):
            continue
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (u[1:] != u[:-1])])
        key, u = key[new], u[new]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        big = sizes > PAIRED
        big[0] |= large
        hubs = np.repeat(u[starts], sizes)
        ends = np.repeat(starts + np.where(big, 0, sizes), sizes)
        crowd = np.repeat(big, sizes) & (hubs != u)
        yield out(hubs[crowd], u[crowd], True)
        last, large = key[-1], bool(big[-1])
        tail = u[starts[-1] : starts[-1] + 1] if large else u[starts[-1] :]
        ends[starts[-1] :] = 0  # not over yet
        yield from pairs(u, ends)
    if not large:
        yield from pairs(tail, np.full(len(tail), len(tail)))


def alike(sizes: np.ndarray, sketches: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets (in order of size) that can be similar by size and sketch."""
    left, out = np.arange(len(sizes)), []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            lo, hi = np.searchsorted(sizes[left], [least_overlap(int(sizes[x]), percent), 100 * int(sizes[x]) // percent + 1])
            some = left[lo:hi]
            found = may_be_similar(sketches[x][None], sketches[some], sizes[x] + sizes[some], percent)
            if found.any():
                todo += some[found].tolist()
                out += [(int(x), y) for y in some[found].tolist()]
                left = np.concatenate([left[:lo], some[~found], left[hi:]])
    return out


def _crowds(percent: int):
    """Rows (hub, lo, hi, node, size, sketch) in order of all but the last two and of size -> pairs (u, v) of nodes."""

    def run(batches):
        key, held = None, []

        def solved() -> pa.RecordBatch:
            nodes = np.array([h[0] for h in held], np.int64)
            found = np.array(alike(np.array([h[1] for h in held], np.int64), np.frombuffer(b"".join(h[2] for h in held), np.uint8).reshape(-1, CELLS), percent), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(nodes[found[:, k]], pa.int64()) for k in (0, 1)], ["u", "v"])

        for batch in batches:
            for hub, lo, hi, *row in rows(batch, "hub", "lo", "hi", "node", "size", "sketch"):
                if (hub, lo, hi) != key:
                    if len(held) > 1:
                        yield solved()
                    key, held = (hub, lo, hi), []
                held.append(row)
        if len(held) > 1:
            yield solved()

    return run


def crowded(stars: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) that connect what can be similar among the classes around each hub: of ``stars`` (u the hub, v).

    Classes that share a hash share its hub, so that each of their pairs is looked at.
    Crowds of more than CROWD classes are dealt out in pairs of blocks.
    """
    member = durable(stars.select(F.col("u").alias("hub"), F.col("v").alias("node")).unionByName(stars.select(F.col("u").alias("hub"), F.col("u").alias("node")).distinct()))
    large = durable(member.groupBy("hub").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > CROWD))
    few = large.limit(HOT_KEYS + 1).count() <= HOT_KEYS
    dealt = member.join(classes.select(F.col("short").alias("node"), "size", "sketch"), "node").join(F.broadcast(large) if few else large, "hub", "left")
    dealt = dealt.withColumn("parts", F.coalesce(F.ceil(F.col("rows") / CROWD), F.lit(1)).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("hub", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "node", "size", "sketch")
    dealt = dealt.repartition(shuffle_width(stars.sparkSession), "hub", "lo", "hi").sortWithinPartitions("hub", "lo", "hi", "size")
    out = durable(dealt.mapInArrow(_crowds(percent), "u long, v long").distinct())
    discard(member, large)
    return out


class Trie:
    """Sets as ascending sequences of ranks in a path-compressed tree; leaves are numbered in order."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets  # sorted lexicographically
        self.sizes = np.array([len(s) for s in sets])
        self.shared = [0, *(self._common(a, b) for a, b in zip(sets[:-1], sets[1:], strict=True))]
        self.root = self._node(0, len(sets), 0)

    @staticmethod
    def _common(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        return int(differ[0]) if len(differ) else n

    def _node(self, lo: int, hi: int, depth: int) -> tuple:
        """(ranks on the way, first and last leaf, least and most size, own leaves, children)"""
        todo: list = []
        top = self._shallow(lo, hi, depth)
        stack = [(lo, hi, top, todo)]
        while stack:
            a, b, node, _ = stack.pop()
            end = node[5]
            at = a
            while at < b and len(self.sets[at]) == end:
                node[3].append(at)
                at += 1
            while at < b:
                to = at + 1
                while to < b and self.shared[to] > end:
                    to += 1
                child = self._shallow(at, to, end)
                node[4].append(child)
                stack.append((at, to, child, todo))
                at = to
        return top

    def _shallow(self, lo: int, hi: int, depth: int) -> tuple:
        end = min([len(self.sets[lo]), *self.shared[lo + 1 : hi]])
        return (self.sets[lo][depth:end], (lo, hi), (int(self.sizes[lo:hi].min()), int(self.sizes[lo:hi].max())), [], [], end)

    def links(self, q: int, ranks: int, percent: int, group: np.ndarray) -> list[int]:
        """One link of set q into each other component (by ``group``) that it is linked with."""
        own, mask = self.sets[q], np.zeros(ranks, bool)
        mask[own] = True
        size, out, done = len(own), [], {int(group[q])}
        stack = [(self.root, 0)]
        while stack:
            (path, (lo, hi), (small, large), leaves, children, end), overlap = stack.pop()
            if 100 * large < percent * size or percent * small > 100 * size or done.issuperset(group[lo:hi].tolist() if hi - lo < 64 else np.unique(group[lo:hi]).tolist()):
                continue
            overlap += int(np.count_nonzero(mask[path]))
            rest = size - (int(np.searchsorted(own, path[-1], "right")) if len(path) else 0)
            most = overlap + min(rest, large - end)
            if (100 + percent) * most < percent * (size + max(small, most)):
                continue
            for y in leaves:
                if int(group[y]) not in done and 100 * overlap >= percent * (size + len(self.sets[y]) - overlap):
                    out.append(y)
                    done.add(int(group[y]))
            stack += [(c, overlap) for c in children]
        return out


def join_sets(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between distinct sets (sorted hashes), as pairs of their numbers."""
    tokens, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, -times))] = np.arange(len(tokens))
    flat, ends = rank[inverse], np.cumsum([len(s) for s in sets])
    ranked = [np.sort(p) for p in np.split(flat, ends[:-1])]
    order = sorted(range(len(sets)), key=lambda i: ranked[i].astype(">i4").tobytes())
    trie = Trie([ranked[i] for i in order])
    group, out = np.arange(len(sets)), []
    for q in range(len(sets)):
        for y in trie.links(q, len(tokens), percent, group):
            out.append((order[q], order[y]))
            group[group == group[y]] = group[q]
    return out


def near_duplicates(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs`` (doc_id, text).

    Documents link when 100 * intersection >= percent * union of their sets of n-word
    shingles; empty sets (null or blank text) link with nothing. Rows without doc_id get
    a null component and link nothing by their id, though their text may bridge others.
    Repeated rows are answered each; rows that share a doc_id with different texts get
    their own text's component. Other columns are not looked at. An empty table gives an
    empty result. Whole texts are read, one at a time. Shingles are compared by 64-bit
    hashes.
    """
    spark, width = docs.sparkSession, shuffle_width(docs.sparkSession)
    raw = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    known = durable(described(raw, n))
    classes = durable(known.where("class is not null").groupBy("class", "short").agg(F.min("doc_id").alias("first"), F.min("text_hash").alias("text_hash"), F.min("n_shingles").alias("size"), F.min("sketch").alias("sketch")))

    every = posted(raw, n, percent)
    some = posted(raw.where(F.pmod(F.xxhash64("text"), F.lit(LOOKED_AT)) == 0), n, percent)
    hot = hot_keys(some.groupBy("key").agg(F.count(F.lit(1)).alias("rows")), ["key"])
    cold = every.join(F.broadcast(spark.createDataFrame(hot, "key long")), "key", "left_anti") if hot else every
    edges = cold.repartition(width, "key").sortWithinPartitions("key", "u").mapInArrow(_meetings, "u long, v long, star boolean")
    if hot:  # HOT_KEYS at most; a key's least class is found by partial aggregation
        warm = durable(every.join(F.broadcast(spark.createDataFrame(hot, "key long")), "key", "left_semi").distinct())
        edges = edges.unionByName(warm.join(F.broadcast(warm.groupBy("key").agg(F.min("u").alias("v"))), "key").select(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(True).alias("star")))
    edges = durable(edges.where("u <> v").distinct())
    release(spark)

    def similar(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, CELLS) for k in (2, 3))
            found = pa.array(may_be_similar(a, b, batch.column(4).to_numpy(), percent))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(found) for k in (0, 1)], ["u", "v"])

    side = lambda name: classes.select(F.col("short").alias(name), F.col("size").alias(f"size_{name}"), F.col("sketch").alias(f"sketch_{name}"))
    sketched = edges.where("not star").select("u", "v").join(side("u"), "u").join(side("v"), "v")
    sketched = sketched.where(F.least("size_u", "size_v") * 100 >= F.greatest("size_u", "size_v") * percent)
    sketched = sketched.select("u", "v", "sketch_u", "sketch_v", F.col("size_u") + F.col("size_v")).mapInArrow(similar, "u long, v long")
    crowds = crowded(edges.where("star").select("u", "v"), classes, percent)
    groups = components(sketched.unionByName(crowds))
    groups = durable(classes.select("class", "short", "text_hash").join(groups, F.col("short") == F.col("node")).select("class", "text_hash", "component"))
    sizes = durable(groups.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > BLOCK))
    few = sizes.limit(HOT_KEYS + 1).count() <= HOT_KEYS
    parts = F.coalesce(F.ceil(F.col("size") / BLOCK), F.lit(1)).cast("int")
    dealt = groups.join(F.broadcast(sizes) if few else sizes, "component", "left").withColumn("parts", parts)

    # A text of each candidate class, found by its hash; a filter keeps other texts from being shuffled.
    shared = spark.sparkContext.broadcast(bit_filter(groups.select(F.col("text_hash").alias("h"))))

    def wanted(batches):
        bits, seen = np.frombuffer(shared.value, np.uint8), set()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                column = part.column(0)
                ends, data = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].tolist(), memoryview(column.buffers()[2] or b"")
                hashes = np.array([xxhash.xxh3_64_intdigest(data[a:b]) - 2**63 for a, b in zip(ends[:-1], ends[1:], strict=True)], np.int64)
                keep = []
                for i in np.flatnonzero(holds(bits, hashes)).tolist():
                    if hashes[i] not in seen:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(hashes[i])
                        keep.append(i)
                yield pa.RecordBatch.from_arrays([pa.array(hashes[keep], pa.int64()), column.take(pa.array(keep, pa.int64()))], ["text_hash", "text"])

    texts = raw.where("text is not null").select("text").mapInArrow(wanted, "text_hash long, text binary")
    dealt = texts.join(dealt, "text_hash").withColumn("own", F.pmod(F.xxhash64("class"), "parts").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("component", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "class", "text")
    dealt = dealt.repartition(width, "component", "lo", "hi").sortWithinPartitions("component", "lo", "hi", "class")

    def join(batches):
        key, names, sets = None, [], []

        def flush() -> pa.RecordBatch:
            links = join_sets(sets, percent) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([names[x[k]] for x in links], pa.binary()) for k in (0, 1)], ["u", "v"])

        for batch in batches:
            for component, lo, hi, name, text in rows(batch, "component", "lo", "hi", "class", "text", step=64):
                if (component, lo, hi) != key:
                    if len(sets) > 1:
                        yield flush()
                    key, names, sets = (component, lo, hi), [], []
                if not names or names[-1] != name:  # tasks may have sent a class each
                    found = shingles(text, n)
                    if digest(found) == name:  # else another text of the same hash
                        names.append(name)
                        sets.append(found)
        yield flush()

    whole = components(dealt.mapInArrow(join, "u binary, v binary"))
    first = durable(classes.join(whole, F.col("class") == F.col("node"), "left").select("class", F.coalesce("component", "class").alias("component"), "first"))
    lowest = durable(first.groupBy("component").agg(F.min("first").alias("component_id")))
    ids = durable(lookup(first.select("class", "component"), lowest, ["component"]).select("class", "component_id"))
    discard(classes, edges, crowds, groups, sizes, first, lowest, whole)
    empty = known.where("class is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = lookup(known.where("class is not null"), ids, ["class"]).select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    return out.unionByName(empty)


def one_of_each(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """The rows of ``docs`` without those whose component has a smaller doc_id; null ids stay."""
    gone = near_duplicates(docs, n, percent).where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
