"""Each operator against a brute-force version on a small, awkward table."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rillflow.llm import bpe, common, embedding_dedup, html_extract, langid, line_dedup, mixing, ngram_join, passages, quality, queries, sharding
from rillflow.llm.common import components, lookup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def texts():
    """Texts with copies, near copies, shared lines and passages, junk, and degenerate ones."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdeéßñ") for _ in range(r.randint(1, 7))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    base, passage, line = prose(150), prose(140), "A line that many documents Share, é."
    out = [None, "", " \n\t ", "one", "Two words", "x\n\ny", base, base, base.upper(), "a " * 3000, "é" * 900, "one two three four five six seven eight nine"]
    for _ in range(12):
        w = base.split()
        w[r.randrange(len(w))] = prose(1)
        out.append(" ".join(w))
    for i in range(25):
        parts = [prose(r.randint(1, 80)) for _ in range(r.randint(1, 5))]
        if i % 3 == 0:
            parts.insert(r.randint(0, len(parts)), passage[r.randint(0, 40) :])
        if i % 2 == 0:
            parts += [line if i % 4 else f"  {line.upper()}\t"] * r.randint(1, 2)
        out.append("\n".join(parts))
    out.append("\n".join([prose(4000)] * 2))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 3 + 1, t, "en", None if i % 7 == 0 else f"s{i % 4}", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def smallest(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def test_components_and_lookup(spark, monkeypatch):
    r = random.Random(1)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(220)] + [(500 + i, 501 + i) for i in range(60)] + [(600, 601 + i) for i in range(900)]
    want = smallest(1600, pairs)
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {n: want[n] for n in nodes}
    monkeypatch.setattr(common, "LOCAL_EDGES", 10)
    again = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert again == got
    left = spark.createDataFrame([(1, i) for i in range(700)] + [(2, 1), (3, 1), (None, 4)], "k long, i long")
    right = spark.createDataFrame([(1, "a"), (2, "b")], "k long, x string")
    assert lookup(left, right, ["k"]).count() == 701
    assert Counter(r["x"] for r in lookup(left, right, ["k"], "left").collect()) == {"a": 700, "b": 1, None: 2}


def test_line_dedup(docs, texts, empty, spark):
    key = lambda line: line.strip(" \t\n\v\f\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    holders = defaultdict(set)
    for i, t in enumerate(texts):
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(i)
    got = by_id(line_dedup.drop_repeated_lines(docs))
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < 3 or max(holders[key(x)]) == i]
        r = got[i * 3 + 1]
        assert (r["n_lines"], r["n_dropped"], r["text"] or "") == (len(lines), len(lines) - len(kept), "\n".join(kept))
        assert r["source"] == (None if i % 7 == 0 else f"s{i % 4}")
    assert sum(r["n_dropped"] for r in got.values()) > 5
    assert line_dedup.drop_repeated_lines(empty).count() == 0
    line = "a line of more than twenty letters"
    odd = spark.createDataFrame([(None, line)] * 2 + [(5, line)] * 2, "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["text"]) for r in line_dedup.drop_repeated_lines(odd).collect()) == [("5", line), ("5", line), ("None", ""), ("None", "")]
    clash = docs.withColumns({"_drop": F.lit(1), "_mark": F.lit("m"), "n_lines": F.lit("old")})
    assert {(r["doc_id"], r["_drop"], r["_mark"], r["n_lines"]) for r in line_dedup.drop_repeated_lines(clash).collect()} == {(k, 1, "m", r["n_lines"]) for k, r in got.items()}
    saturated = line_dedup.drop_repeated_lines(docs, filter_bits=1 << 18)
    assert {k: r["text"] for k, r in by_id(saturated).items()} == {k: r["text"] for k, r in got.items()}


def shingle_sets(texts, n):
    out = []
    for t in texts:
        w = words((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        out.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    return out


@pytest.mark.parametrize(("n", "percent", "block"), [(3, 90, 1024), (5, 80, 1024), (3, 90, 4)])
def test_ngram_join(docs, texts, empty, n, percent, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    sets = shingle_sets(texts, n)
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    root = smallest(len(sets), pairs)
    got = by_id(ngram_join.near_duplicates(docs, n, percent))
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in got.items()} == {i * 3 + 1: (len(s), root[i] * 3 + 1) for i, s in enumerate(sets)}
    assert len(set(root)) < len(root) - 8
    assert {r["doc_id"] for r in ngram_join.one_of_each(docs, n, percent).collect()} == {x * 3 + 1 for x in set(root)}
    assert ngram_join.near_duplicates(empty, n, percent).count() == 0


def test_similar_sets_post_a_common_hash():
    r = np.random.default_rng(1)
    for percent in (50, 80, 90):
        met = 0
        for _ in range(1500):
            base = np.unique(r.integers(0, 2**64, int(r.integers(1, 90)), dtype=np.uint64))
            changed = int(r.integers(0, ngram_join.most_different(len(base), percent) + 1))
            gone = int(r.integers(0, changed + 1))
            other = np.unique(np.concatenate([r.permutation(base)[gone:], r.integers(0, 2**64, changed - gone, dtype=np.uint64)]))
            if len(other) and 100 * len(np.intersect1d(base, other)) >= percent * len(np.union1d(base, other)):
                met += 1
                assert len(np.intersect1d(ngram_join.parts_of(base, percent), ngram_join.parts_of(other, percent)))
        assert met > 500


def test_meetings_pair_every_two_classes(monkeypatch):
    monkeypatch.setattr(ngram_join, "PAIRED", 5)
    r = np.random.default_rng(2)
    rows = sorted({(k, int(u)) for k in range(40) for u in r.integers(0, 100, int(r.integers(1, 12)))})
    rows = sorted(rows + rows[::7])
    for step in (1, 3, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows[i : i + step]], pa.int64()) for k in (0, 1)], ["key", "u"]) for i in range(0, len(rows), step)]
        got = {tuple(x.values()) for b in ngram_join._meetings(batches) for x in b.to_pylist()}
        want = set()
        for key in range(40):
            us = sorted({u for k, u in rows if k == key})
            want |= {(us[0], u, True) for u in us[1:]} if len(us) > 5 else {(a, b, False) for i, a in enumerate(us) for b in us[i + 1 :]}
        assert got == want


def test_sketches_never_rule_out_a_link():
    r = np.random.default_rng(8)
    for size in (3, 50, 3000, 90_000):
        a = np.unique(r.integers(0, 2**64, size, dtype=np.uint64))
        b = np.unique(np.concatenate([a[int(0.09 * len(a)) :], r.integers(0, 2**64, size // 100, dtype=np.uint64)]))
        rows = [np.frombuffer(ngram_join.sketch(x), np.uint8)[None] for x in (a, b)]
        assert ngram_join.may_be_similar(*rows, np.array([len(a) + len(b)]), 90)[0] or 100 * len(np.intersect1d(a, b)) < 90 * len(np.union1d(a, b))
    other = np.unique(r.integers(0, 2**64, 300, dtype=np.uint64))
    assert not ngram_join.may_be_similar(np.frombuffer(ngram_join.sketch(other), np.uint8)[None], np.frombuffer(ngram_join.sketch(a[:300]), np.uint8)[None], np.array([600]), 80)[0]


@pytest.mark.parametrize("paired", [64, 1])
def test_ngram_join_of_odd_tables(spark, paired, monkeypatch):
    monkeypatch.setattr(ngram_join, "PAIRED", paired)
    a, b = " ".join(f"w{i}" for i in range(80)), " ".join(f"w{i}" for i in range(79))
    rows = [(5, a, 1), (5, a, 1), (None, b, 2), (9, b, 3), (3, "x y z w", 4), (None, None, 5)]
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, class int")).collect())
    assert got == {(5, 78, 5): 2, (None, 77, None): 1, (9, 77, 5): 1, (3, 2, 3): 1, (None, 0, None): 1}


def test_alike_connects_all_that_may_be_similar():
    r = np.random.default_rng(3)
    base = [r.integers(0, 2**64, 60, dtype=np.uint64) for _ in range(6)]
    sets = sorted((np.unique(np.concatenate([r.permutation(b)[int(r.integers(0, 7)) :], r.integers(0, 2**64, int(r.integers(0, 6)), dtype=np.uint64)])) for b in base for _ in range(25)), key=len)
    sizes, sketches = np.array([len(s) for s in sets]), np.array([np.frombuffer(ngram_join.sketch(s), np.uint8) for s in sets])
    for percent in (80, 90):
        may = lambda i, j: 100 * min(sizes[i], sizes[j]) >= percent * max(sizes[i], sizes[j]) and ngram_join.may_be_similar(sketches[i][None], sketches[j][None], sizes[i : i + 1] + sizes[j], percent)[0]  # noqa: E731, B023
        found = ngram_join.alike(sizes, sketches, percent)
        assert all(may(i, j) for i, j in found)
        want = smallest(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if may(i, j)])
        assert smallest(len(sets), found) == want and len(found) == len(sets) - len(set(want)) > 20


@pytest.mark.parametrize(("crowd", "hot"), [(4096, 256), (16, 256), (4096, 1)])
def test_a_common_phrase_chains_no_candidates(spark, crowd, hot, monkeypatch):
    """Far more classes than PAIRED post the hash of one shingle; only near copies may reach the trie."""
    monkeypatch.setattr(ngram_join, "CROWD", crowd, raising=False)
    monkeypatch.setattr(ngram_join, "LOOKED_AT", 1 if hot == 1 else ngram_join.LOOKED_AT)
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    texts = ["all of them share this " + " ".join(f"{c}{i}" for c in "abcdefghijklmnop") for i in range(1200)]
    texts += [f"{t} v" for t in texts[::15]]
    posted = Counter(k for t in texts for k in ngram_join.parts_of(ngram_join.shingles(t, 5), 80).tolist())
    assert max(posted.values()) > 100
    groups = []

    def spied(edges, real=ngram_join.components):
        found = real(edges)
        groups.append(Counter(r["component"] for r in found.collect()))
        return found

    monkeypatch.setattr(ngram_join, "components", spied)
    got = by_id(ngram_join.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5, 80))
    assert [got[i]["component_id"] for i in range(len(texts))] == [*range(1200), *range(0, 1200, 15)]
    assert len(groups) == 2 and max(groups[0].values()) == 2


def test_join_sets_finds_all_components():
    r = random.Random(9)
    for percent in (50, 80, 90):
        base = [r.sample(range(1000), 60) for _ in range(4)]
        sets = {tuple(sorted({*r.sample(b, len(b) - r.randint(0, 8)), *r.sample(range(1000, 1100), r.randint(0, 6))})) for b in base for _ in range(30)}
        sets = [np.array(s, np.uint64) for s in sets]
        links = lambda i, j: 100 * len({*sets[i].tolist()} & {*sets[j].tolist()}) >= percent * len({*sets[i].tolist()} | {*sets[j].tolist()})
        want = smallest(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if links(i, j)])
        found = ngram_join.join_sets(sets, percent)
        assert all(links(i, j) for i, j in found)
        assert smallest(len(sets), found) == want


def test_mixing(docs, texts, empty, spark):
    rows = [(i * 3 + 1, len(words(t)), None if i % 7 == 0 else f"s{i % 4}") for i, t in enumerate(texts)]
    total = Counter()
    for _, size, source in rows:
        total[source] += size
    names = sorted((s for s in total if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in total)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free = {}, set(names)
    while True:
        left = sum(total.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * total[s]}
        if not over:
            target |= share
            break
        target |= {s: 3 * total[s] for s in over}
        free -= over
    got = mixing.mixing_plan(docs).collect()
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        assert r["source_size"] == total[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 * sum(total.values())
        assert len(r["positions"]) <= 3 and all(0 <= p <= 1 for p in r["positions"]) and r["positions"] == sorted(r["positions"])
        taken[r["source"]] += len(r["positions"]) * r["size"]
    largest = {s: max(z for _, z, x in rows if x == s) for s in names}
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in names)
    again = mixing.mixing_plan(docs.repartition(1)).collect()
    assert sorted((r["doc_id"], len(r["positions"])) for r in again) == sorted((r["doc_id"], len(r["positions"])) for r in got)
    # a position is where the integral of the source's density, taken in small steps, reaches the words before the copy
    ramps = {s: mixing.RAMPS[i % 3] for i, s in enumerate(names)}
    steps, at = np.linspace(0, 1, 20_001), defaultdict(list)
    for r in got:
        at[r["source"]] += [(p, r["size"]) for p in r["positions"]]
    for s, found in at.items():
        density = target[s] * (1 + ramps[s] * (2 * steps - 1))
        reached = np.concatenate([[0], np.cumsum((density[1:] + density[:-1]) / 2 * np.diff(steps))])
        begin = 0
        for p, size in sorted(found):
            assert abs(np.interp(p, steps, reached) - begin) < 1e-3 * max(1, target[s])
            begin += size
    stream = [r["doc_id"] for r in mixing.mixture(docs).select("doc_id").collect()]
    assert Counter(stream) == Counter({r["doc_id"]: len(r["positions"]) for r in got if r["positions"]})
    assert mixing.mixture(docs).columns == docs.columns
    assert mixing.mixing_plan(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None, "a", 0), (1, None, None, "a", 0)], SCHEMA)
    assert [(r["target"], r["positions"]) for r in mixing.mixing_plan(blank).collect()] == [(0.0, [])] * 2


def test_mixing_query_follows_the_ramps(docs, tmp_path, monkeypatch):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda: {(r["doc_id"], r["first_position"]) for r in queries.op3_mixing(docs.sparkSession, str(tmp_path)).collect()}
    before = run()
    monkeypatch.setattr(mixing, "RAMPS", (0.5, -0.3, 0.1))
    assert before != run()


def test_mixing_of_odd_tables(spark):
    rows = [(1, "a b", "x", 0, "p"), (1, "a b", "x", 0, "p"), (None, "c d e", "x", 0, "q"), (None, "f", None, 0, "r")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, source string, target int, positions string")
    got = mixing.mixing_plan(odd).collect()
    assert len(got) == 4 and sum(r["size"] for r in got) == 8
    assert mixing.mixture(odd).columns == odd.columns


def test_passages(docs, texts, empty, monkeypatch):
    raw = [(t or "").encode() for t in texts]
    counts = Counter(d[i : i + 400] for d in raw for i in range(len(d) - 399))

    def expected(d):
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - 399):
            if counts[d[i : i + 400]] > 1:
                gone[i : i + 400] = True
        return bytes(b for b, g in zip(d, gone, strict=True) if not g), int(gone.sum()), len(passages.runs(gone))

    want = {i * 3 + 1: expected(d) for i, d in enumerate(raw)}
    for crowd in (passages.CROWD, 1):
        monkeypatch.setattr(passages, "CROWD", crowd)
        got = by_id(passages.remove_passages(docs.select("doc_id", "text")))
        assert {k: (bytes(r["kept"]), r["n_removed"], r["n_spans"]) for k, r in got.items()} == want
        assert all(got[i * 3 + 1]["n_bytes"] == len(d) for i, d in enumerate(raw))
    assert sum(w[1] for w in want.values()) > 3000
    assert passages.remove_passages(empty.select("doc_id", "text")).count() == 0


def test_passages_of_odd_tables(spark):
    r = random.Random(3)
    a, b, c = (" ".join(r.choice(["lorem", "ipsum", "dolor", "é"]) for _ in range(n)) for n in (150, 200, 90))
    odd = spark.createDataFrame([(None, a, 1), (None, a, 2), (7, b, 3), (7, b, 4), (8, c, 5), (None, None, 6)], "doc_id long, text string, _ref int").withColumn("n_spans", F.lit("x"))
    got = {r["_ref"]: (r["n_bytes"] - r["n_removed"], r["n_spans"]) for r in passages.remove_passages(odd).collect()}
    assert got == {1: (0, 1), 2: (0, 1), 3: (0, 1), 4: (0, 1), 5: (len(c.encode()), 0), 6: (0, 0)}


def test_slabs_own_every_window_once():
    data = np.random.default_rng(0).integers(97, 99, 3000).astype(np.uint8)
    for slab in (1, 57, 1000, 1 << 18):
        _, first, last = passages.anchors(data, slab=slab)
        assert first[0] == 0 and last[-1] == len(data) - passages.LENGTH and (first[1:] == last[:-1] + 1).all()


def test_longest_previous_factors():
    r = np.random.default_rng(6)
    for _ in range(60):
        codes = np.append(r.integers(0, int(r.integers(1, 5)), int(r.integers(0, 40))), 9)
        match = lambda a, b, c=codes: next(k for k in range(len(c)) if b + k == len(c) or c[a + k] != c[b + k])
        sizes, starts = passages.factors(codes)
        assert sizes.tolist() == [max((match(j, i) for j in range(i)), default=0) for i in range(len(codes))]
        assert all((j == -1) if n == 0 else (j < i and match(j, i) == n) for i, (n, j) in enumerate(zip(sizes.tolist(), starts.tolist(), strict=True)))
    order = np.array([4, 1, 3, 0, 2])
    assert [x.tolist() for x in passages.smaller(order)] == [[-1, -1, 0, 1, -1], [-1, 0, -1, 0, 1]]
    for _ in range(60):
        regions = [bytes(r.integers(97, 99, int(r.integers(5, 30))).tolist()) for _ in range(4)]
        counts = Counter(d[i : i + 5] for d in regions for i in range(len(d) - 4))
        assert [f.tolist() for f in passages.repeated_windows(regions, 5)] == [[counts[d[i : i + 5]] > 1 for i in range(len(d))] for d in regions]


def test_langid(spark, empty):
    r = random.Random(2)
    sounds = {"aa": ["ka", "ru", "to", "mi"], "bb": ["sch", "ung", "er", "pf"], "cc": ["да", "ни", "ко"]}
    say = lambda lang, n: " ".join("".join(r.choice(sounds[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))
    rows = [(i, say(lang, r.randint(20, 90)), lang, "s", 0) for i, lang in enumerate(r.choices(sorted(sounds), k=300))]
    rows += [(900, None, "aa", None, 0), (901, "12 ... !", "bb", None, 0), (902, "", None, None, 0), (None, say("cc", 9), "cc", None, 0)]
    got = langid.identify(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows) and all(0 <= g["score"] <= 1 for g in got)
    real = {i: (lang, zlib.crc32(str(i).encode()) % 4 == 2) for i, _, lang, _, _ in rows}
    for g in got:
        lang, held = real[g["doc_id"]]
        assert g["held_out"] == (held and g["doc_id"] is not None)
        assert g["lang_pred"] == ("und" if g["doc_id"] in (900, 901, 902) else lang)
    model = langid.train(spark.createDataFrame(rows, SCHEMA))
    found = langid.spans(model, say("aa", 30) + " " + say("bb", 30) + " " + say("cc", 30))
    assert [s[0] for s in found] == ["aa", "bb", "cc"] and [s[1] for s in found] == [30, 30, 30]
    assert langid.identify(empty).count() == 0


def test_viterbi_shortcut_is_exact():
    r = np.random.default_rng(3)
    for _ in range(50):
        scores = [r.normal(0, 3, (int(r.integers(1, 30)), 3)) for _ in range(5)]
        for s, path in zip(scores, langid.viterbi(scores, 4.0), strict=True):
            best = np.full(3, 0.0)
            for t, row in enumerate(s):
                best = (np.maximum(best, best.max() - 4.0) if t else 0) + row
            value = s[np.arange(len(s)), path].sum() - 4.0 * np.count_nonzero(np.diff(path))
            assert abs(value - best.max()) < 1e-9


def test_label_equals_full_viterbi():
    r = np.random.default_rng(4)
    model = langid.Model(["a", "b", "c"], np.zeros((langid.BUCKETS, 3)), np.ones((len(langid.SCRIPTS), 3)))
    vocabulary = {"xa": [0, -10, -4], "yb": [-10, 0, -4]}
    for k in range(40):
        vocabulary["".join(chr(97 + x) for x in (k % 20, k // 20, 25))] = r.normal(0, 4, 3) + [0, 0, k % 2 * 6]
    for word, row in vocabulary.items():
        at = langid.scan([word])["bucket"]
        model.logs[at] = 0
        model.logs[at[0]] = row
    assert model.label(["xa xa yb yb"])[0][0].tolist() == [0, 0, 1, 1]
    texts = [" ".join(r.choice(sorted(vocabulary), r.integers(1, 14))) for _ in range(2000)]
    scores = [np.array([model.logs[langid.scan([w])["bucket"]].sum(0) for w in t.split()], float) for t in texts]
    want = langid.viterbi(scores)
    assert [path.tolist() for path, _ in model.label(texts)] == [p.tolist() for p in want]
    assert 100 < sum(len(set(p.tolist())) > 1 for p in want) < 1900


def test_quality(docs, texts, empty):
    got = by_id(quality.verdicts(docs))
    for i, t in enumerate(texts):
        t, w = t or "", words(t)
        windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if words(x)]
        r = got[i * 3 + 1]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (r["kept"] and r["base_failed"])
    kept = quality.good_documents(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {k for k, r in got.items() if r["kept"]}
    assert quality.verdicts(empty).count() == 0 and quality.good_documents(empty).count() == 0


def test_quality_estimate():
    r = random.Random(4)
    patterns = Counter()
    truth = {}
    for i in range(4000):
        junk = r.random() < 0.15
        p = tuple(r.choices((-1, 0, 1), (0.5, 0.2, 0.3) if junk else (0.01, 0.2, 0.79))[0] for _ in range(6))
        patterns[p] += 1
        truth.setdefault(p, Counter())[junk] += 1
    table = quality.estimate(patterns.items(), 6)
    wrong = sum(truth[p][quality.odds(table, p) > 0] for p in patterns)
    assert wrong < 0.05 * 4000
    # the same from all documents one by one
    votes = np.array([p for p in patterns.elements()])
    good = np.where((votes == -1).any(1), 0.1, 0.97)
    for _ in range(quality.ROUNDS):
        total = np.full(len(votes), np.log((good.sum() + 0.9) / ((1 - good).sum() + 0.1)))
        for k in range(6):
            rate = lambda w, hit, v=votes[:, k]: ((w * (v == -1)).sum() + hit) / ((w * (v != 0)).sum() + 1)
            a, b = rate(good, 0.1), rate(1 - good, 0.9)
            total += np.where(votes[:, k] == -1, np.log(a / b), np.where(votes[:, k] == 1, np.log((1 - a) / (1 - b)), 0))
        good = 1 / (1 + np.exp(-total))
    assert [quality.odds(table, p) >= 0 for p in votes.tolist()] == (good >= 0.5).tolist()


def test_quality_verdict_is_the_estimate(spark):
    r = random.Random(6)
    say = lambda n, end="": " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) + end for _ in range(n)) + "."
    rows = [(i, say(60), 1) for i in range(80)] + [(100 + i, say(60, "&&&"), 2) for i in range(12)] + [(None, say(40), 3), (7, None, 4), (7, None, 4), (8, "", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _words int").withColumns({"n_words": F.lit("w"), "kept": F.lit("k"), "_lines": F.lit(1)})
    found = quality.verdicts(docs).collect()
    assert len(found) == len(rows) and Counter(f["kept"] for f in found if not f["base_failed"]) == {True: 81, False: 12}
    good = quality.good_documents(docs)
    assert good.columns == docs.columns and Counter((x["_words"], x["n_words"], x["kept"], x["_lines"]) for x in good.collect()) == {(1, "w", "k", 1): 80, (3, "w", "k", 1): 1}


def test_sharding(docs, texts, empty, spark):
    rows = sharding.shard_plan(docs.unionByName(docs.limit(5))).collect()
    assert len(rows) == len(texts) + 5
    slots, shards = defaultdict(list), {}
    for r in rows:
        t = (texts[(r["doc_id"] - 1) // 3] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(t) + 1, zlib.crc32(t), "key")
        assert r["grown_shard"] in (r["shard"], 8) and shards.setdefault(r["doc_id"], r["shard"]) == r["shard"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))
    many = sharding.place(spark.range(40_000).withColumnRenamed("id", "doc_id")).groupBy("shard").count().collect()
    assert len(many) == 8 and all(abs(r["count"] - 5000) < 350 for r in many)
    moved = sharding.place(spark.range(40_000).withColumnRenamed("id", "doc_id")).where("shard <> grown_shard")
    assert abs(moved.count() - 40_000 / 9) < 350 and {r[0] for r in moved.select("grown_shard").distinct().collect()} == {8}
    heavy = {0: {0: {0: 3.0, 1: 1.0}}, 1: {1: {2: 4.0}}}
    got = {r["shard"]: r["count"] for r in sharding.place(spark.range(40_000).withColumnRenamed("id", "doc_id"), heavy).groupBy("shard").count().collect()}
    assert abs(got[0] - 15_000) < 600 and abs(got[1] - 5000) < 400 and abs(got[2] - 20_000) < 600
    assert sharding.shard_plan(empty).count() == 0
    null = spark.createDataFrame([(None, "a"), (None, "a"), (None, None)], "doc_id long, text string")
    assert sorted(r["slot"] for r in sharding.shard_plan(null).collect()) == [0, 1, 2]


def test_sharding_places_by_plain_draws(spark):
    keys = list(range(0, 3000, 7)) + [None]
    df = spark.createDataFrame([(k,) for k in keys], "doc_id long")
    draws = {(r["doc_id"], r["level"], r["child"]): (r["h"] % 2**64 >> 12) for r in df.crossJoin(spark.range(3).withColumnRenamed("id", "level")).crossJoin(spark.range(10).withColumnRenamed("id", "child")).select("doc_id", "level", "child", F.xxhash64("doc_id", F.col("level").cast("int"), F.col("child").cast("int")).alias("h")).collect()}

    def walk(key, node, level=0):
        if not isinstance(node, dict):
            return node
        weight = lambda n: sum(map(weight, n.values())) if isinstance(n, dict) else n
        draw = lambda c: -math.log((draws[key, level, c] + 0.5) / 2**52) / weight(node[c])
        child = min(node, key=draw) if len(node) > 1 else next(iter(node))
        return child if not isinstance(node[child], dict) else walk(key, node[child], level + 1)

    for tree in (sharding.even_tree(), {0: {0: {0: 3.0, 1: 1.0}}, 1: {1: {2: 4.0}, 2: {3: 1.0, 4: 2.0}}}):
        got = sharding.place(df, tree).collect()
        assert [(r["shard"], r["grown_shard"]) for r in got] == [(walk(r["doc_id"], tree), walk(r["doc_id"], sharding.grown(tree))) for r in got]


@pytest.mark.parametrize("block", [1024, 8])
def test_embeddings(spark, block, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    r = np.random.default_rng(0)
    base = r.normal(size=(12, 16))
    rows = [(i, (base[i % 12] + r.normal(scale=0.11, size=16) * (i % 5) / 4).astype(np.float32).tolist(), int(i % 2)) for i in range(150)]
    rows += [(200 + i, rows[3][1], rows[3][2]) for i in range(4)] + [(210, [2 * x for x in rows[5][1]], rows[5][2])]
    odd = [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan"), *rows[0][1][1:]], 0), (303, [None, *rows[0][1][1:]], 0), (304, rows[0][1], None), (305, [], 0), (306, rows[0][1][:7], 0)]
    got = by_id(embedding_dedup.near_duplicates(spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>, label int")), "vec_id")
    x = np.array([v for _, v, _ in rows], np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.98) & (np.array([c for _, _, c in rows])[:, None] == [c for _, _, c in rows])
    np.fill_diagonal(near, False)
    assert sum(got[i]["n_links"] for i, _, _ in rows) >= 0.97 * near.sum() > 100
    assert all(got[i]["n_links"] <= near[k].sum() for k, (i, _, _) in enumerate(rows))
    root = smallest(len(rows), np.argwhere(near).tolist())
    hits = sum(got[i]["component_id"] == rows[root[k]][0] for k, (i, _, _) in enumerate(rows))
    assert hits >= 0.97 * len(rows)
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i, _, _ in odd)


def test_embeddings_of_odd_tables(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], kind)).count() == 0
    rows = [(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (None, [1.0, 2.0], 0), (2, [2.0, 4.0], 0), (3, [1.0, -2.0], 0)]
    got = Counter(tuple(r) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, kind)).collect())
    assert got == {(1, 2, 1, True): 2, (None, 0, None, False): 1, (2, 2, 1, False): 1, (3, 0, 3, True): 1}


def test_embeddings_recall_at_the_threshold():
    r = np.random.default_rng(7)
    a = embedding_dedup.unit_rows(r.normal(size=(2000, 64)))
    off = r.normal(size=a.shape)
    off = embedding_dedup.unit_rows(off - (off * a).sum(1, keepdims=True) * a)
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * off
    met = (embedding_dedup.signatures(a) == embedding_dedup.signatures(b)).any(axis=1)
    assert met.mean() > 0.99


def test_deep_pages_take_linear_time():
    model = html_extract.train()
    for page in ("<div>x" * 30_000, "<svg>x" * 30_000, "<p><b>x" * 10_000):
        start = time.time()
        html_extract.main_text(page, model)
        assert time.time() - start < 20
    assert [b.text for b in html_extract.blocks("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>")] == ["a", "b", "c", "d"]


def test_html_extract(spark):
    model = html_extract.train()
    wrong = total = 0
    for seed in range(5000, 5150):
        page, main = html_extract.labelled_page(seed)
        found = html_extract.blocks(page)
        want = html_extract.labels(found, main)
        assert sum(want) == len(main)
        wrong += sum(a != b for a, b in zip(want, model.decode(html_extract.features(found)), strict=True))
        total += len(want)
    assert wrong < 0.01 * total
    page = "<html><body><nav><a href='/a'>Menu item</a></nav><article><h1>T&amp;x</h1><p>One  two,\nthree<br>four &lt;b&gt;.<p>Second <b>part</b>s &amp only.<div class=ad>Buy it now</div><p>Third one here.</article><div id=comments><p>I disagree, said a reader.</p></div><footer>&copy; me"
    rows = [(1, "u", page, 7), (2, "v", None, 8), (3, None, "", 9), (4, "w", "<p", 1), (4, "w", "<p", 1)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()
    assert [(r["page_id"], r["url"], r["text"]) for r in got[:1]] == [(1, "u", "T&x\nOne two, three four <b>.\nSecond parts & only.\nThird one here.")]
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert [(r["page_id"], r["text"], r["n_chars"]) for r in got[1:]] == [(2, "", 0), (3, "", 0), (4, "", 0), (4, "", 0)]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_bpe_equals_library(tokenizer):
    vocabulary = bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    encoder, decoder, r = bpe.Encoder(vocabulary), bpe.Decoder(vocabulary), random.Random(8)
    kinds = ["abcdefghijklmnopqrstuvwxyz", "the and ing tion er ", "ABCé ßñÜ'sre've\t\n", "日本語 Σσς ΑΣ İı", "0123 45.,!?-&|<>#", "\x00\x1c\x1d\x85\xa0 ​́ͅ", "<|endoftext|>", "😀👩‍👩‍👧", "aaaaaaaa", "lolol"]
    for _ in range(3000):
        text = "".join(r.choice(r.choice(kinds)) if r.random() < 0.97 else "<|endoftext|>" for _ in range(r.randint(0, 60)))
        ids = np.frombuffer(encoder.encode(text), np.int32)
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, repr(text)
        assert decoder.decode(ids.astype(np.int64)) == tokenizer.decode(want, skip_special_tokens=False)


def test_bpe_query(docs, texts, empty, tokenizer):
    vocabulary = bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    got = by_id(bpe.digests(docs, vocabulary))
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        r = got[i * 3 + 1]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want
    assert bpe.digests(empty, vocabulary).count() == 0


def test_bpe_of_odd_rows(spark, tokenizer):
    vocabulary = bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    long = "x" * 100_000 + " " + "word and " * 20_000
    odd = spark.createDataFrame([(1, long, 0), (None, "a b", 1), (1, long, 2)], "doc_id long, text string, ids int")
    odd = odd.unionByName(spark.sql("select 5L as doc_id, cast(x'61ff62' as string) as text, 3 as ids"))
    ids = tokenizer.encode(long, add_special_tokens=False).ids
    want = [(1, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())] * 2
    got = sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"]) for r in bpe.digests(odd, vocabulary).collect())
    assert got[1:3] == want and got[0][:2] == (0, 2) and got[3][0] == 5
    bad = tokenizer.encode("a\ufffdb", add_special_tokens=False).ids
    assert got[3][1:] == (len(bad), hashlib.sha256(" ".join(map(str, bad)).encode()).hexdigest())
    assert [r["ids"] for r in bpe.encode(odd.where("doc_id = 5"), vocabulary).collect()] == [bad]
    encoder = bpe.Encoder(vocabulary)
    encoder.encode("y" * 200_000)
    assert max(map(len, [*encoder, *encoder.pieces]), default=0) <= bpe.LONG


def test_langid_of_odd_rows(spark):
    rows = [(1, "alpha beta " * 30_000, "aa", 0), (1, "alpha", "aa", 0), (1, "alpha", "aa", 0), (None, "ый " * 20, "cc", 1)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int").withColumn("lang_pred", F.lit("old"))
    assert sorted(r["lang_pred"] for r in langid.identify(odd).collect()) == ["aa", "aa", "aa", "cc"]
    model = langid.train(odd)
    assert [(r["lang_pred"], r["lang"]) for r in langid.predict(odd.where("doc_id is null"), model).collect()] == [("cc", "cc")]


def test_pipeline_stage_by_stage(spark, docs, texts, tokenizer, tmp_path):
    r = random.Random(12)
    say = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n)) + "."
    more = [say(120) for _ in range(30)]
    more += [f"{t} {say(2)}" for t in more[:8]] + [f"{more[20 + i]}\nThe same long line in several documents" for i in range(5)] + [" ".join(w + "&&&" for w in say(60).split()) for _ in range(5)]
    extra = spark.createDataFrame([(1000 + i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(more)] + [(None, None, None, None, None)] * 2, SCHEMA)
    docs.unionByName(extra).write.parquet(f"{tmp_path}/documents.parquet")
    current = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(x) for x in current.select(corpus_pipeline.COLUMNS).collect()]
        current = common.written(stage(spark, current, str(tmp_path)), name)
        seen[name] = before, [tuple(x) for x in current.collect()]
        assert name == "bpe" or current.columns == corpus_pipeline.COLUMNS
    before, after = seen["quality"]
    good = {x["doc_id"] for x in quality.verdicts(spark.createDataFrame(before, SCHEMA)).where("kept").collect()}
    assert sorted(after, key=str) == sorted((x for x in before if x[0] in good), key=str)
    assert not any("&&&" in x[1] for x in after) and {1000 + i for i in range(30)} <= good
    before, after = seen["line_dedup"]
    key = lambda line: line.strip(" \t\n\v\f\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    holders = defaultdict(set)
    for x in before:
        for line in x[1].split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(x[0])
    left = lambda x: "\n".join(line for line in x[1].split("\n") if len(holders[key(line)]) < 3 or max(holders[key(line)]) == x[0])
    assert {x[0]: x[1] for x in after} == {x[0]: left(x) for x in before} and after != before
    before, after = seen["near_copies"]
    before = sorted(before)
    sets = shingle_sets([x[1] for x in before], 5)
    root = smallest(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])])
    assert sorted(after) == [x for i, x in enumerate(before) if root[i] == i] and len(after) < len(before) - 5
    before, after = seen["mixing"]
    plan = mixing.mixing_plan(spark.createDataFrame(before, SCHEMA)).collect()
    assert Counter(x[0] for x in after) == Counter({x["doc_id"]: len(x["positions"]) for x in plan if x["positions"]}) and set(after) <= set(before)
    before, after = seen["bpe"]
    want = Counter((x[0], len(tokenizer.encode(x[1], add_special_tokens=False).ids)) for x in before)
    assert Counter(x[:2] for x in after) == want
    assert Counter(x[:2] for x in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want


def test_sql_equals_the_queries(spark, docs, tmp_path):
    r = np.random.default_rng(7)
    base = r.normal(size=(20, 16))
    vectors = [(i, (base[i % 20] * (1 + i % 3) + r.normal(scale=0.002, size=16)).astype(np.float32).tolist(), i % 2) for i in range(120)]
    vectors += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan"), *vectors[0][1][1:]], 0), (303, [None, *vectors[0][1][1:]], 0), (304, vectors[0][1], None), (305, [], 0), (306, vectors[0][1][:7], 0)]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    for name in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    for name in ("op2_ngram_join", "op3_mixing", "op4_line_dedup", "op5_passages", "op9_embeddings"):
        got = queries.queries()[name](spark, str(tmp_path))
        columns = sorted(got.columns)
        want = db.sql(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
        assert Counter(map(tuple, got.select(columns).collect())) == Counter(want), name
    linked = db.sql(f"SELECT count(*) FILTER (WHERE n_links > 0), count(*) FILTER (WHERE NOT kept) FROM ({queries.oracle_sql()['op9_embeddings']})").fetchall()
    assert linked == [(120, 100)]
