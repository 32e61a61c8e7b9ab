"""Quality rules with weak supervision, in DataFrame expressions only.

A base rule (too few words, or too many in repeated windows) rejects a document outright.
Of those that pass it, each rule looks at counts of one document and votes good (1), junk
(-1) or abstains (0). Nobody has labelled the documents; expectation-maximisation over
all that pass estimates how often each rule votes either way on good and on junk
documents, and a document stays if its posterior probability of being good is at least
one half. The votes form one of at most 3**7 patterns, and the pattern counts are all that
the estimation needs, so the driver receives that bounded table and nothing else.

Null and empty texts fail the base rule; rules abstain where there is nothing to count.
Repeated rows and null ids are judged each on their own, a posterior of exactly one half
stays, and an empty table gives an empty result. Whole texts are counted, in memory in
proportion to the longest text.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import SPACES, durable, words

SYMBOLS = "#*$%&|<>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The counts that features() adds.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_word_lines", "n_upper", "n_lower", "n_marks", "n_stops"]
#: Rounds and pseudo-votes of the estimation; the share of junk that it starts from.
ROUNDS, PSEUDO, JUNK_SHARE = 40, 1.0, 0.1


def _count(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with COUNTS (long) of each whole text; null text counts as empty. Input columns of these names are replaced.

    n_repeat_words counts the words in windows of five words that occur twice or more
    in the text. Windows are compared by 64-bit hashes: sorted as longs whose low bits
    hold the position, equal windows become neighbours.
    """
    kept = docs.drop(*COUNTS).columns
    names = [f"_c{i}" for i in range(len(kept))]  # no column clashes with the ones made here
    docs = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)))
    text = names[kept.index(text)]
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.translate(x, SPACES, "") != "")
    d = docs.withColumns({
        "_words": F.transform(words(F.col(text)), lambda w: F.xxhash64(w)),
        "_lines": lines,
        "word_chars": F.length(F.translate(body, SPACES, "")).cast("long"),
        "n_symbols": _count(body, SYMBOLS),
        "n_upper": _count(body, UPPER),
        "n_lower": _count(body, LOWER),
        "n_marks": _count(body, "!"),
        "n_stops": _count(body, ".?"),
    })
    d = d.withColumns({
        "n_words": F.size("_words").cast("long"),
        "n_word_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_windows": F.expr("transform(if(size(_words) < 5, array(), sequence(0, size(_words) - 5)), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2], _words[i + 3], _words[i + 4]))"),
    }).drop("_words", "_lines")
    d = d.withColumn("_mask", F.expr("if(size(array_distinct(_windows)) = size(_windows), null, shiftleft(1L, int(ceil(log2(size(_windows))))) - 1)"))
    d = d.withColumn("_sorted", F.expr("if(_mask is null, null, array_sort(transform(_windows, (x, i) -> (x & ~_mask) | i)))".replace("array_sort", "sort_array")))
    same = "(_sorted[{a}] & ~_mask) = (_sorted[{b}] & ~_mask) and _windows[int(_sorted[{a}] & _mask)] = _windows[int(_sorted[{b}] & _mask)]"
    twice = f"filter(sequence(0, size(_sorted) - 1), j -> (j > 0 and {same.format(a='j', b='j - 1')}) or (j < size(_sorted) - 1 and {same.format(a='j', b='j + 1')}))"
    d = d.withColumn("_twice", F.expr(f"if(_mask is null, null, sort_array(transform({twice}, j -> int(_sorted[j] & _mask))))"))
    d = d.withColumn("n_repeat_words", F.expr("if(_mask is null, 0L, aggregate(_twice, named_struct('n', 0L, 'last', -5), (a, p) -> named_struct('n', a.n + least(5, p - a.last), 'last', p), a -> a.n))"))
    return d.select(*(F.col(n).alias(c) for c, n in zip(kept, names, strict=True)), *COUNTS)


def _vote(junk: Column, good: Column) -> Column:
    return F.when(junk, -1).when(good, 1).otherwise(0)


def failed() -> Column:
    """The base rule over COUNTS."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Votes over COUNTS. A vote of junk needs a plain excess, one of good a plain absence; without letters or words, none."""
    n, chars, letters = F.col("n_words"), F.col("word_chars"), F.col("n_upper") + F.col("n_lower")
    some = n > 0
    return {
        "symbols": _vote(100 * F.col("n_symbols") > 5 * chars, some & (100 * F.col("n_symbols") <= 2 * chars)),
        "repeats": _vote(100 * F.col("n_repeat_words") > 10 * n, (n >= 50) & (100 * F.col("n_repeat_words") <= 5 * n)),
        "lines": _vote(100 * F.col("n_dup_lines") > 30 * F.col("n_word_lines"), (F.col("n_dup_lines") == 0) & (F.col("n_word_lines") > 1)),
        "capitals": _vote(2 * F.col("n_upper") > letters, (letters > 0) & (5 * F.col("n_upper") <= letters)),
        "marks": _vote(100 * F.col("n_marks") > 15 * n, some & (100 * F.col("n_marks") <= 2 * n)),
        "lengths": _vote((2 * chars < 5 * n) | (chars > 7 * n), some & (chars >= 3 * n) & (chars <= 6 * n)),
        "sentences": _vote((n >= 60) & (200 * F.col("n_stops") < n), some & (40 * F.col("n_stops") >= n)),
    }


def odds(table: list[list[float]], votes: Iterable[int]) -> float:
    """Log odds that a document with these votes is good."""
    return table[0][0] + sum(t[v + 1] for t, v in zip(table[1:], votes, strict=True))


def estimate(patterns: Iterable[tuple[tuple[int, ...], int]], n_rules: int) -> list[list[float]]:
    """Log odds of good over junk: the prior's, then for each rule those of the votes -1, 0 and 1.

    A rule that abstains says nothing (0). The classes start from whether any rule votes
    junk. Nothing keeps a rule from counting against its own word; but should the
    class called good draw more votes of junk than the other in the end, the two have changed
    places and are changed back.
    """
    seen = sorted(patterns)
    good = [0.1 if -1 in p else 0.97 for p, _ in seen]
    table, share = [], []
    for _ in range(ROUNDS):
        total = [sum(c * g for (_, c), g in zip(seen, good, strict=True)), sum(c * (1 - g) for (_, c), g in zip(seen, good, strict=True))]
        table, share = [[math.log((total[0] + PSEUDO * (1 - JUNK_SHARE)) / (total[1] + PSEUDO * JUNK_SHARE))]], []
        for r in range(n_rules):
            votes = {(v, k): PSEUDO * (0.9 if (v == 1) == (k == 0) else 0.1) for v in (-1, 1) for k in (0, 1)}
            for (p, c), g in zip(seen, good, strict=True):
                if p[r]:
                    votes[p[r], 0] += c * g
                    votes[p[r], 1] += c * (1 - g)
            share.append([votes[-1, k] / (votes[-1, k] + votes[1, k]) for k in (0, 1)])
            table.append([math.log(share[r][0] / share[r][1]), 0.0, math.log((1 - share[r][0]) / (1 - share[r][1]))])
        good = [1 / (1 + math.exp(-max(-500.0, min(500.0, odds(table, p))))) for p, _ in seen]
    if sum(s[0] for s in share) > sum(s[1] for s in share):
        table = [[-x for x in t] for t in table]
    return table


def fit(counted: DataFrame) -> list[list[float]]:
    """The table of estimate() from the documents with COUNTS that pass the base rule."""
    votes = rules()
    found = counted.where(~failed()).select(*(v.alias(k) for k, v in votes.items())).groupBy(*votes).count().collect()  # at most 3 ** 7 rows
    return estimate([(tuple(r[:-1]), r[-1]) for r in found], len(votes))


def judged(counted: DataFrame, table: list[list[float]]) -> DataFrame:
    """With base_failed, p_good (double) and kept (boolean) for documents with COUNTS."""
    total = F.lit(table[0][0])
    for vote, (junk, _, good) in zip(rules().values(), table[1:], strict=True):
        total = total + F.when(vote == -1, junk).when(vote == 1, good).otherwise(0.0)
    p_good = 1 / (1 + F.exp(-F.least(F.greatest(total, F.lit(-500.0)), F.lit(500.0))))
    return counted.withColumns({"base_failed": failed(), "p_good": p_good}).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, COUNTS, base_failed, p_good and kept of each row of ``docs``."""
    counted = durable(features(docs.select("doc_id", "text")).drop("text"))
    return judged(counted, fit(counted))


def good_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of ``docs``.

    Texts are counted once: rows and counts are written, estimated from and filtered.
    """
    names = [f"_in{i}" for i in range(len(docs.columns))]
    counted = durable(features(docs.toDF(*names), names[docs.columns.index("text")]))
    return judged(counted, fit(counted)).where("kept").select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))
