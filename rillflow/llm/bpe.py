"""BPE encoding by backtracking over Aho-Corasick matches, and decoding by an offset table.

An automaton finds the longest token from each position of a word; a table gives the next
shorter one with the same start. The encoder takes the longest token that fits on from
left to right; two neighbours fit if undoing the merges at their border, latest first,
never shows a pair that would have merged earlier (remembered in a table of pairs). A
dead end gives up the last token, and no position is tried twice, so time and memory are
linear in the word. The first way through is the only sequence of tokens whose neighbours
all fit: the one that merging by rank yields.

Rows are independent: repeated rows, null ids and rows of any size give a row each, an
empty table none. Null and empty text has no tokens. Bytes that are no UTF-8 are read as
U+FFFD. A text is read in parts of PART characters that end at a blank, so that a worker
holds little besides the text; words of more than LONG characters are never remembered.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.llm.common import rows

#: Stands for the end-of-word suffix; no byte-level character is a newline.
END = "\n"
#: Encoded chunks, pieces of them and pairs of tokens that a worker remembers before it
#: starts afresh, the longest it remembers, and the characters of a part.
REMEMBERED, LONG, PART = 1 << 18, 48, 1 << 16
BLANK = re.compile("[ \n]")
#: The pre-tokenizer's pattern, and the same for ASCII text in lower case.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t-\ra-z0-9]+")
WHITE = regex.compile(r"\p{White_Space}+")
SEPARATORS = re.compile("[\x1c-\x1f]")  # str.split() takes them for white space, Unicode doesn't


def read(text: str | bytes | None) -> str:
    return text.decode("utf-8", "replace") if isinstance(text, bytes) else text or ""


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def read_vocabulary(path: str) -> dict:
    """What the encoder needs of a tokenizer file: {vocab, merges, special, suffix}."""
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in j["model"]["merges"]]
    return {"vocab": j["model"]["vocab"], "merges": merges, "special": {t["content"]: t["id"] for t in j["added_tokens"]}, "suffix": j["model"]["end_of_word_suffix"]}


def lower(text: str) -> str:
    """Lower case character by character (a final sigma is no special case)."""
    return "".join(c.lower() for c in text) if "Σ" in text else text.lower()


class Encoder(dict):
    """Maps a chunk of text without white space to its ids (int32 bytes), remembering what it met."""

    def __init__(self, vocabulary: dict):
        suffix = vocabulary["suffix"]
        inner = lambda t: t[: -len(suffix)] + END if t.endswith(suffix) else t
        made = [a + b for a, b in vocabulary["merges"]]
        merged = set(made)
        base = [t for t in vocabulary["vocab"] if t not in merged]
        self.n_base = len(base)
        order = {t: i for i, t in enumerate([*base, *dict.fromkeys(made)])}  # single symbols first, then by rank
        self.left, self.right = [-1] * len(order), [-1] * len(order)
        self.pairs: dict[tuple[int, int], int] = {}
        for (a, b), t in zip(vocabulary["merges"], made, strict=True):
            self.pairs.setdefault((order[a], order[b]), order[t])
            if self.left[order[t]] < 0:
                self.left[order[t]], self.right[order[t]] = order[a], order[b]
        self.ids = [vocabulary["vocab"][t] for t in order]
        self.lengths = [len(inner(t)) for t in order]
        self.automaton = ahocorasick.Automaton()
        for t, i in order.items():
            self.automaton.add_word(inner(t), i)
        self.automaton.make_automaton()
        known = {inner(t): i for t, i in order.items()}
        self.shorter = [next((known[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in known), -1) for t in known]
        self.fitting: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.characters = byte_characters()
        self.special = vocabulary["special"]
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def fits(self, a: int, b: int) -> bool:
        """Whether merging by rank leaves ``a`` and ``b`` side by side."""
        limit = len(self.ids)
        while True:
            if self.pairs.get((a, b), limit) < limit:
                return False
            if a > b:
                if a < self.n_base:
                    return True
                limit, a = a, self.right[a]
            else:
                if b < self.n_base:
                    return True
                limit, b = b + 1, self.left[b]

    def piece(self, piece: str) -> list[int]:
        """The ids of one piece of the pre-tokenizer."""
        word = (piece if piece.isascii() and piece.isprintable() else "".join([self.characters[b] for b in piece.encode()])) + END
        lengths, shorter, fitting, n = self.lengths, self.shorter, self.fitting, len(word)
        longest = [-1] * n
        for end, t in self.automaton.iter(word):  # of a start, longer ones come later
            longest[end + 1 - lengths[t]] = t
        taken: list[int] = []
        dead = bytearray(n + 1)
        at, t = 0, longest[0]
        while at < n:
            last = taken[-1] if taken else -1
            while t >= 0:
                if not dead[at + lengths[t]]:
                    if last < 0:
                        break
                    pair = last << 32 | t
                    ok = fitting.get(pair)
                    if ok is None:
                        if len(fitting) >= REMEMBERED:
                            fitting.clear()
                        ok = fitting[pair] = self.fits(last, t)
                    if ok:
                        break
                t = shorter[t]
            if t >= 0:
                taken.append(t)
                at += lengths[t]
                t = longest[at] if at < n else -1
            else:
                dead[at] = 1
                t = taken.pop()
                at -= lengths[t]
                t = shorter[t]
        return [self.ids[t] for t in taken]

    def __missing__(self, chunk: str) -> bytes:
        text = lower(unicodedata.normalize("NFC", chunk))
        known, out = self.pieces, []
        for p in (ASCII_PIECES if text.isascii() else PIECES).findall(text):
            ids = known.get(p)
            if ids is None:
                ids = np.array(self.piece(p), np.int32).tobytes()
                if len(p) <= LONG:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[p] = ids
            out.append(ids)
        out = b"".join(out)
        if len(chunk) <= LONG:
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = out
        return out

    def parts(self, text: str) -> Iterator[bytes]:
        """The ids of a text as int32 bytes, part by part."""
        at = 0
        while at < len(text):
            end = BLANK.search(text, at + PART)  # no token holds a blank
            part, at = (text[at : end.start()], end.end()) if end else (text[at:], len(text))
            out = []
            for i, piece in enumerate(self.special_pattern.split(part) if self.special_pattern and "<" in part else [part]):
                if i % 2:
                    out.append(np.array([self.special[piece]], np.int32).tobytes())
                else:
                    out += [self[c] for c in (WHITE.split(piece) if SEPARATORS.search(piece) else piece.split()) if c]
            yield b"".join(out)

    def encode(self, text: str) -> bytes:
        """The ids of a text as int32 bytes."""
        return b"".join(self.parts(text))


class Strings:
    """Strings in one buffer, each with the blank that follows it; string i starts at offsets[i]."""

    def __init__(self, strings: list[str]):
        parts = [s.encode() + b" " for s in strings]
        self.buffer = np.frombuffer(b"".join(parts), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def joined(self, ids: np.ndarray) -> Iterator[bytes]:
        """The strings of ids, joined by blanks, part by part."""
        for at in range(0, len(ids), PART):
            i = ids[at : at + PART].astype(np.int64)
            starts, lengths = self.offsets[i], self.offsets[i + 1] - self.offsets[i]
            ends = np.cumsum(lengths)
            out = self.buffer[np.arange(ends[-1]) + np.repeat(starts - ends + lengths, lengths)]
            yield (out if at + PART < len(ids) else out[:-1]).tobytes()


def token_strings(vocabulary: dict) -> list[str]:
    """The string of each id."""
    tokens = {i: t for t, i in [*vocabulary["vocab"].items(), *vocabulary["special"].items()]}
    return [tokens.get(i, "") for i in range(max(tokens) + 1)]


class Decoder(Strings):
    """The offset table of all tokens."""

    def __init__(self, vocabulary: dict):
        super().__init__(token_strings(vocabulary))

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(self.joined(ids)).decode()


def _added(df: DataFrame, vocabulary: dict, column: str, source: str, kind: T.DataType, make: Callable) -> DataFrame:
    """``df`` with ``column`` made by an Arrow function of the column ``source``."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)  # as large as the vocabulary file
    df = df.drop(column)
    names = df.columns

    def run(batches):
        f = make(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, f(batch, source)], [*names, column])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(column, kind)]))


def encode(docs: DataFrame, vocabulary: dict, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids (array<int>) of each whole text; null counts as empty.

    Other columns are passed on; an input column of that name is replaced.
    """

    def make(vocabulary):
        encoder = Encoder(vocabulary)

        def f(batch, source):
            found = [encoder.encode(read(t)) for (t,) in rows(batch, source)]
            offsets = np.cumsum([0, *(len(x) // 4 for x in found)]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), np.int32)))

        return f

    raw = docs.withColumn("_raw", F.col(text).cast("binary"))
    return _added(raw, vocabulary, ids, "_raw", T.ArrayType(T.IntegerType()), make).drop("_raw")


def decode(encoded: DataFrame, vocabulary: dict, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids: token strings joined by blanks, special ones kept."""

    def make(vocabulary):
        decoder = Decoder(vocabulary)

        def f(batch, source):
            column = batch.column(batch.schema.get_field_index(source))
            offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
            return pa.array([decoder.decode(values[a:b].astype(np.int64)) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.string())

        return f

    return _added(encoded, vocabulary, text, ids, T.StringType(), make)


def digests(docs: DataFrame, vocabulary: dict) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of ``docs`` (doc_id, text).

    Encodes and decodes in one narrow pass: only the digests leave the worker.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # as large as the vocabulary file
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches):
        encoder, tokens = Encoder(shared.value), Strings(token_strings(shared.value))
        numbers = Strings(list(map(str, range(len(tokens.offsets) - 1))))
        for batch in batches:
            out = ([], [], [])
            for (text,) in rows(batch, "text"):
                ids = np.frombuffer(encoder.encode(read(text)), np.int32)
                out[0].append(len(ids))
                for strings, digests_ in ((numbers, out[1]), (tokens, out[2])):
                    digest = hashlib.sha256()
                    for part in strings.joined(ids):
                        digest.update(part)
                    digests_.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], schema.names)

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)
