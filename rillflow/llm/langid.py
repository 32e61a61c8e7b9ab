"""Language identification: script ranges, per-word scores and Viterbi over words.

Every letter is scored by the hashed trigram around it under each language; a word's
score is the sum over its letters. The script of a word's first letter narrows the
languages that may label it. Viterbi with a penalty for each change of language labels
the words, giving spans of one language each; a document's language is the one that
most of its letters are labelled with.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.llm.common import rows, shuffle_width

#: Buckets of hashed trigrams, rows of it that are summed together, pseudo-count, the
#: penalty in nats for each change of language, and the least share of a language's
#: letters that makes a script one of its own.
BUCKETS, SLICES, PSEUDO, SWITCH, SHARE = 1 << 16, 8, 0.2, 14.0, 0.01
#: First code points of script ranges (the last range before each letter counts).
SCRIPTS = [0x41, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0x980, 0xA00, 0xA80, 0xB00, 0xB80, 0xC00, 0xC80, 0xD00, 0xD80, 0xE00, 0xE80, 0xF00, 0x1000, 0x10A0, 0x1100, 0x1200, 0x13A0, 0x1780, 0x1800, 0x1E00, 0x1F00, 0x2000, 0x2C80, 0x2E80, 0x3040, 0x30A0, 0x3100, 0x3130, 0x3190, 0x31F0, 0x3200, 0x3400, 0xA000, 0xA490, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0xFB50, 0xFF00, 0x10000, 0x20000]
#: Fixed value: ranges that continue an earlier one's script.
CONTINUES = {0x1E00: 0x41, 0x1F00: 0x370, 0x1100: 0xAC00, 0x3130: 0xAC00, 0xD7B0: 0xAC00, 0x2E80: 0x3400, 0xF900: 0x3400, 0x20000: 0x3400, 0x31F0: 0x30A0, 0xFB50: 0x600}


@functools.cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it is a letter, and the number of its script."""
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    number = {s: i for i, s in enumerate(SCRIPTS)}
    own = np.array([0, *(number[CONTINUES.get(s, s)] for s in SCRIPTS)], np.uint8)
    return letter, own[np.searchsorted(SCRIPTS, np.arange(0x110000), "right")]


def scan(texts: list[str]) -> dict[str, np.ndarray]:
    """Trigram bucket of each letter, first letter and script of each word, first word of each text."""
    letter, script = _letters()
    parts = [np.frombuffer((t.lower() + "\n").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    ends = np.cumsum([len(p) for p in parts]) if parts else np.zeros(0, int)
    codes = np.concatenate([np.zeros(1, np.uint32), *parts, np.zeros(1, np.uint32)])
    is_letter = letter[np.minimum(codes, 0x10FFFF)]
    codes = np.where(is_letter, codes, 0).astype(np.uint32)
    at = np.flatnonzero(is_letter)
    with np.errstate(over="ignore"):
        mixed = (codes[at - 1] * np.uint32(0x9E3779B1)) ^ (codes[at] * np.uint32(0x85EBCA6B) + np.uint32(0x27D4EB2F)) ^ (codes[at + 1] * np.uint32(0xC2B2AE35))
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    first = np.flatnonzero(~is_letter[at - 1])
    return {"bucket": (mixed >> np.uint32(16)).astype(np.int64), "word": first, "script": script[codes[at[first]]], "text": np.searchsorted(at[first], np.concatenate([[0], ends]) + 1)}


class Model:
    """languages; logs (BUCKETS, languages); allowed (scripts, languages)."""

    def __init__(self, languages: list[str], counts: np.ndarray, letters: np.ndarray):
        self.languages = languages
        self.logs = np.log((counts + PSEUDO) / (counts.sum(0) + PSEUDO * BUCKETS)).astype(np.float32) if languages else np.zeros((BUCKETS, 0), np.float32)
        self.allowed = letters >= SHARE * np.maximum(letters.sum(0), 1)

    def label(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text the language number of each word, and the words' lengths in letters."""
        s = scan(texts)
        if not len(s["word"]) or not self.languages:
            return [(np.zeros(0, int), np.zeros(0, int))] * len(texts)
        scores = np.add.reduceat(self.logs[s["bucket"]], s["word"], axis=0).astype(np.float64)
        allowed = self.allowed[s["script"]]
        scores -= np.where(~allowed & allowed.any(1, keepdims=True), 1e6, 0)
        lengths = np.diff(np.append(s["word"], len(s["bucket"])))
        spans = list(zip(s["text"][:-1], s["text"][1:], strict=True))
        out: list = [None] * len(texts)
        mixed = []
        for i, (a, b) in enumerate(spans):
            part = scores[a:b]
            best = int(part.sum(0).argmax()) if b > a else 0
            ahead = np.cumsum(part - part[:, best : best + 1], axis=0)
            before = np.vstack([np.zeros((1, ahead.shape[1])), ahead[:-1]])
            # A stay in another language costs a change, but one at the start and one at the end may share it.
            # If neither any stay nor such a pair gains as much as one change costs, every path with changes is worse.
            if b == a or ((ahead - np.minimum.accumulate(before, axis=0)).max() < SWITCH and ahead.max() + (ahead[-1:] - before).max() < SWITCH):
                out[i] = (np.full(b - a, best), lengths[a:b])
            else:
                mixed.append(i)
        for i, path in zip(mixed, viterbi([scores[slice(*spans[i])] for i in mixed]), strict=True):
            out[i] = (path, lengths[slice(*spans[i])])
        return out


def viterbi(scores: list[np.ndarray], switch: float = SWITCH) -> list[np.ndarray]:
    """The best labels of several sequences (n, languages), all of them step by step together."""
    if not scores:
        return []
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    sizes = np.array([len(scores[i]) for i in order])
    longest, n_labels = sizes[0], scores[0].shape[1]
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    flat = np.concatenate([scores[i] for i in order])
    back = np.zeros((len(flat), n_labels), np.int16)
    active = [int(n) for n in np.searchsorted(-sizes, -np.arange(longest), "left")]
    state, stay = flat[starts].copy(), np.arange(n_labels, dtype=np.int16)
    final = np.zeros(len(order), np.int64)
    for t in range(1, longest):
        n = active[t]
        if n < len(state):
            final[n : len(state)] = state[n:].argmax(1)
            state = state[:n]
        top = state.argmax(1)
        best = state[np.arange(n), top][:, None] - switch
        moves = best > state
        at = starts[:n] + t
        back[at] = np.where(moves, top[:, None], stay)
        state = np.where(moves, best, state) + flat[at]
    final[: len(state)] = state.argmax(1)
    paths: list = [None] * len(scores)
    steps = back.tolist() if len(flat) < 200_000 else back
    for k, i in enumerate(order):
        label, path = int(final[k]), [0] * sizes[k]
        for t in range(sizes[k] - 1, -1, -1):
            path[t] = label
            label = int(steps[starts[k] + t][label])
        paths[i] = np.array(path)
    return paths


def train(docs: DataFrame) -> Model:
    """A model from the rows with text and lang: trigram counts of all of them, summed by slice of the table.

    The driver receives 4 * BUCKETS bytes for each language, whatever the number of rows.
    """
    size = BUCKETS // SLICES

    def count(batches):
        found: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for batch in batches:
            by: dict[str, list[str]] = {}
            for text, lang in rows(batch, "text", "lang"):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                for i in range(0, len(texts), 256):
                    s = scan(texts[i : i + 256])
                    found[lang] = found.get(lang, 0) + np.bincount(s["bucket"], minlength=BUCKETS)
                    lengths = np.diff(np.append(s["word"], len(s["bucket"])))
                    scripts[lang] = scripts.get(lang, 0) + np.bincount(s["script"], lengths, minlength=len(SCRIPTS)).astype(np.int64)
        for lang, table in found.items():
            parts = [*table.reshape(SLICES, size), scripts[lang]]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(parts)), pa.array(range(len(parts)), pa.int32()), pa.array([zlib.compress(p.astype(np.int64).tobytes(), 1) for p in parts], pa.binary())], ["lang", "part", "counts"])

    def add(batches):
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for lang, part, counts in rows(batch, "lang", "part", "counts"):
                total[lang, part] = total.get((lang, part), 0) + np.frombuffer(zlib.decompress(counts), np.int64)
        for (lang, part), counts in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([part], pa.int32()), pa.array([counts.tobytes()], pa.binary())], ["lang", "part", "counts"])

    shape = "lang string, part int, counts binary"
    parts = docs.select("text", "lang").dropna().mapInArrow(count, shape).repartition(shuffle_width(docs.sparkSession), "lang", "part").mapInArrow(add, shape)
    held = {(r[0], r[1]): np.frombuffer(r[2], np.int64) for r in parts.collect()}
    languages = sorted({lang for lang, _ in held})
    counts = np.stack([np.concatenate([held[x, i] for i in range(SLICES)]) for x in languages], axis=1) if languages else np.zeros((BUCKETS, 0))
    letters = np.stack([held[x, SLICES] for x in languages], axis=1) if languages else np.zeros((len(SCRIPTS), 0))
    return Model(languages, counts, letters)


def spans(model: Model, text: str) -> list[tuple[str, int]]:
    """(language, number of words) of each span of a text, in order."""
    path = model.label([text])[0][0]
    cuts = np.flatnonzero(np.diff(path)) + 1
    return [(model.languages[p[0]], len(p)) for p in np.split(path, cuts) if len(p)]


def gathered(texts: Iterable[str], characters: int = 1 << 19, most: int = 2048) -> Iterator[list[str]]:
    """Texts to be scored together: up to so many characters, unless one text has more."""
    held, size = [], 0
    for t in texts:
        if held and (size + len(t) > characters or len(held) >= most):
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (share of the letters so labelled) and n_spans.

    Null texts and texts without a letter get `und`, 0.0 and 0; so does everything if
    nothing was learned. Input columns of these names are replaced. Rows are labelled one
    by one, repeated ones alike; where languages tie, the first by name wins. Texts are
    read whole, in memory in proportion to the longest one times the number of languages;
    the model that is broadcast has 4 * BUCKETS bytes a language, 64 MB for 256 of them.
    An empty table gives an empty result.
    """
    docs = docs.drop("lang_pred", "score", "n_spans")
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 * BUCKETS bytes a language

    def run(batches):
        model = shared.value
        for batch in batches:
            langs, scores, n_spans = [], [], []
            for texts in gathered(t or "" for (t,) in rows(batch, text)):
                for path, lengths in model.label(texts):
                    if len(path):
                        by = np.bincount(path, lengths, minlength=len(model.languages))
                        langs.append(model.languages[int(by.argmax())])
                        scores.append(float(by.max() / by.sum()))
                        n_spans.append(int(np.count_nonzero(np.diff(path))) + 1)
                    else:
                        langs.append("und")
                        scores.append(0.0)
                        n_spans.append(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(n_spans, pa.int64())], [*names, "lang_pred", "score", "n_spans"])

    more = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_spans", T.LongType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *more]))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_spans: trained on the rows that are not held out.

    A row is held out if crc32 of its doc_id as text is 2 modulo 4 (a null id: its
    checksum counts as 0). Predictions see the text alone.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = train(docs.where(~held))
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")
