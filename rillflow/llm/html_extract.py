"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page becomes the sequence of its leaf blocks (runs of text between block-level
boundaries). Features of a block are its ancestors' tags, the hints in their class, id
and role, the nearest of these, and properties of its text. The field has two labels
(main text or not), is trained by gradient ascent on the conditional likelihood of
labelled pages, and decodes by Viterbi. The labelled pages are drawn by labelled_page()
from a seeded grammar of layouts with invented words; no page of the input is used.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.llm.common import rows

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*+(?:\"[^\"]*\"[^>\"']*+|'[^']*'[^>\"']*+)*+>|[^>]*(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
SKIPPED = {"script", "style", "template", "svg", "math", "iframe", "object", "noscript", "title", "canvas", "audio", "video", "head"}
RAW = {"script", "style", "iframe", "noscript", "title"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
BLOCKS = {"p", "div", "article", "section", "main", "nav", "header", "footer", "aside", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "form", "fieldset", "legend", "figure", "figcaption", "hr", "address", "body", "html", "head", "details", "summary", "select", "option", "textarea", "button", "label", "menu", "dialog"}
#: An opening tag closes an open one of its set, up to the given containers.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Kinds of hint, with the words of class, id and role (and the tags) that give them.
HINTS = {
    "menu": {"nav", "navbar", "menu", "navigation", "breadcrumb", "breadcrumbs", "toc", "pagination", "pager", "tabs"},
    "head": {"header", "masthead", "banner", "topbar", "logo", "branding"},
    "foot": {"footer", "copyright", "legal", "contentinfo", "colophon"},
    "side": {"aside", "sidebar", "side", "related", "widget", "recommended", "complementary", "tags", "popular", "trending"},
    "advert": {"ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promotion", "adsense"},
    "notice": {"notice", "cookie", "cookies", "consent", "gdpr", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "dialog", "warning", "share", "social", "sharing"},
    "form": {"form", "search", "login", "button", "select", "textarea", "fieldset", "label", "input"},
    "reader": {"comment", "comments", "reply", "replies", "respond", "disqus", "discussion", "responses", "feedback"},
    "main": {"article", "main", "content", "post", "entry", "story", "body", "text", "maincontent", "articlebody", "prose"},
}
KIND = {w: k for k, words in HINTS.items() for w in words}
WORD = re.compile(r"[a-z]+")
TAGS = ["p", "li", "td", "h1", "h2", "h3", "blockquote", "pre", "a", "figcaption", "table", "ul", "div", "section", "dt", "dd"]


@dataclass
class Open:
    """An open element with what features need of it and its ancestors, so that a block needs no copy of the path."""

    tag: str
    tags: tuple[str, ...] = ()  # its own and the two around it
    kinds: frozenset[str] = frozenset()
    near: str = "nothing"
    tops: str = "nothing"

    def inside(self, tag: str, hints: tuple[str, ...]) -> Open:
        if not hints:
            return Open(tag, (*self.tags[-2:], tag), self.kinds, self.near, self.tops)
        return Open(tag, (*self.tags[-2:], tag), self.kinds.union(hints), hints[-1], hints[0] if self.tops == "nothing" else self.tops)


ROOT = Open("")


@dataclass
class Block:
    text: str
    path: Open
    linked: int = 0


@functools.lru_cache(20_000)
def _hints(tag: str, attributes: str) -> tuple[str, ...]:
    found = [KIND[tag]] if tag in KIND and tag != "body" else []
    for _, value in ATTRIBUTE.findall(attributes):
        words = WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
        found += [KIND[w] for w in (*words, "".join(words)) if w in KIND]
    return tuple(dict.fromkeys(found))


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order; broken, unclosed and cut-off markup is read as far as it goes.

    Time and memory are linear in the page, however deep it is nested: the places of open
    elements are kept by tag.
    """
    out: list[Block] = []
    stack: list[Open] = []
    places: dict[str, list[int]] = defaultdict(list)
    text: list[str] = []
    path, linked, started = ROOT, 0, False
    endless: set[str] = set()

    def end_block():
        nonlocal linked, started
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                out.append(Block(joined, path, linked))
            text.clear()
        linked, started = 0, False

    def add(raw: str):
        nonlocal linked, path, started
        if raw:
            if "&" in raw:
                raw = html.unescape(raw)
            if not raw.isspace():
                if not started:
                    path, started = stack[-1] if stack else ROOT, True
                if places["a"]:
                    linked += len(raw.strip())
            text.append(raw)

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=-1)

    def close(to: int):
        ends = False
        while len(stack) > to:
            tag = stack.pop().tag
            places[tag].pop()
            ends = ends or tag in BLOCKS
        if ends:
            end_block()

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        add(page[at : m.start()] if m else page[at:])
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if places[tag]:
                close(places[tag][-1])
            elif tag in BLOCKS:
                end_block()
            continue
        if tag in SKIPPED and not m[3].endswith("/>") and tag != "head":
            end = None if tag in endless else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if not end:
                endless.add(tag)
            at = end.end() if end else (n if tag in RAW else at)
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in BLOCKS:
            if places["p"] and tag not in ("button", "label", "select", "option", "textarea"):
                close(places["p"][-1])
            same, within = CLOSES.get(tag, (set(), set()))
            if (found := last(same)) > last(within):
                close(found)
            end_block()
        if tag not in VOID and not m[3].endswith("/>"):
            places[tag].append(len(stack))
            stack.append((stack[-1] if stack else ROOT).inside(tag, _hints(tag, m[3])))
    end_block()
    return out


NAMES = ["bias", "first", "last"] + [f"tag {t}" for t in TAGS] + [f"{w} {k}" for w in ("in", "near", "tops") for k in (*HINTS, "nothing")] + [f"words {i}" for i in range(6)] + [f"links {i}" for i in range(4)] + ["stop", "comma", "rights", "short run"]
INDEX = {n: i for i, n in enumerate(NAMES)}


def features(page: list[Block]) -> list[list[int]]:
    """The indices of the features that hold for each block."""
    out = []
    for i, b in enumerate(page):
        words = b.text.count(" ") + 1
        on = {"bias", f"words {min(5, int(math.log2(words)))}", f"links {min(3, 4 * b.linked // max(1, len(b.text)))}"}
        on |= {f"in {h}" for h in b.path.kinds} or {"in nothing"}
        on |= {f"near {b.path.near}", f"tops {b.path.tops}"}
        on |= {f"tag {t}" for t in b.path.tags if t in TAGS}
        on |= {n for n, holds in (("first", i == 0), ("last", i == len(page) - 1), ("stop", b.text[-1] in ".!?:;\"'”»…"), ("comma", b.text.count(",") * 25 >= words), ("rights", "©" in b.text or "(c)" in b.text[:40].lower()), ("short run", words < 4)) if holds}
        out.append([INDEX[n] for n in on])
    return out


# --- labelled pages ---------------------------------------------------------------------

def _sentence(r: random.Random, least=3, most=18) -> str:
    words = ["".join(r.choice(["ka", "to", "mi", "ren", "sul", "po", "é", "tra", "vin", "os", "el", "##", "da"]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(least, most))]
    return " ".join(words).capitalize() + r.choice([".", ".", ".", "!", "?", ""])


def labelled_page(seed: int) -> tuple[str, list[str]]:
    """A page of a random layout and its main text, block by block."""
    r = random.Random(seed)
    main: list[str] = []
    say = lambda most=18: _sentence(r, 1, most)
    paragraph = lambda: " ".join(say() for _ in range(r.choice([1, 1, 2, 3, 6, 12])))
    links = lambda: "<ul>" + "".join(f'<li><a href="/{i}">{_sentence(r, 1, 3)}</a></li>' for i in range(r.randint(2, 8))) + "</ul>"
    wrap = lambda kind, inside: (lambda w: r.choice([f'<div class="{w}">{inside}</div>', f'<section id="{w}">{inside}</section>', f'<div class="x {w} y">{inside}</div>']))(r.choice(sorted(HINTS[kind])))
    prose = lambda: "".join(f"<p>{say()}</p>" for _ in range(r.randint(1, 3)))

    def boilerplate(kind: str) -> str:
        inside = r.choice([prose, say, links, lambda: say(5)])()
        if kind == "menu":
            return r.choice([f"<nav>{links()}</nav>", wrap(kind, links()), f"<nav>{inside}</nav>"])
        if kind == "head":
            return r.choice([f"<header><h2>{say(4)}</h2>{inside}</header>", f"<header>{inside}</header>", wrap(kind, inside)])
        if kind == "foot":
            return r.choice([f"<footer>&copy; {say(6)}</footer>", f"<footer>{inside}</footer>", wrap(kind, "<p>&copy; " + say() + "</p>")])
        if kind == "side":
            return r.choice([f"<aside>{inside}</aside>", f"<aside><h3>{say(3)}</h3>{links()}</aside>", wrap(kind, f"<h3>{say(3)}</h3>{links()}"), wrap(kind, inside)])
        if kind == "form":
            return r.choice([f"<form><label>{say(3)}</label><input><button>{say(2)}</button></form>", f"<form><p>{say()}</p><textarea>{say()}</textarea></form>", wrap(kind, inside)])
        if kind == "reader":
            each = "".join(r.choice([f'<div class="comment"><b>{say(2)}</b><p>{paragraph()}</p></div>', f"<li><p>{paragraph()}</p></li>", f"<p>{say()}</p>"]) for _ in range(r.randint(1, 5)))
            return wrap(kind, f"<h3>{say(2)}</h3>{each}")
        return wrap(kind, inside)

    def body() -> str:
        out = []
        for i in range(r.randint(1, 14)):
            kind = r.random()
            if i == 0 or kind < 0.12:
                text = say(8)
                main.append(text)
                out.append(f"<h{1 + (i > 0)}>{text}</h{1 + (i > 0)}>")
            elif kind < 0.8:
                text = paragraph()
                main.append(text)
                out.append(r.choice([f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}</b></p>", f"<p>{text}<br>", f"<div>{text}</div>"]))
            elif kind < 0.86:
                items = [say() for _ in range(r.randint(1, 4))]
                main.extend(items)
                out.append("<ul>" + "".join(f"<li>{t}</li>" for t in items) + "</ul>")
            elif kind < 0.92:
                text = paragraph()
                main.append(text)
                out.append(f"<blockquote><p>{text}</p></blockquote>" if kind < 0.9 else f"<table><tr><td>{text}</td></tr></table>")
            else:
                out.append(boilerplate(r.choice(["advert", "side", "notice", "form", "menu"])))
        return "".join(out)

    inside = body()
    if r.random() < 0.3:
        inside += boilerplate("reader")
    layout = r.random()
    core = f"<article>{inside}</article>" if layout < 0.5 else f"<main><div>{inside}</div></main>" if layout < 0.65 else f'<div class="{r.choice(sorted(HINTS["main"] - {"body", "main", "article"}))}">{inside}</div>' if layout < 0.85 else f"<main><article>{inside}</article></main>" if layout < 0.95 else inside
    before = [boilerplate(k) for k in ("head", "menu", "notice", "advert") if r.random() < 0.5]
    after = [boilerplate(k) for k in ("reader", "side", "advert", "form", "foot", "notice") if r.random() < 0.5]
    r.shuffle(before)
    return f"<!DOCTYPE html><html><head><title>{say(5)}</title><script>var a='</p>';</script></head><body>{''.join(before)}{core}{''.join(after)}</body></html>", main


def labels(page: list[Block], main: list[str]) -> list[int]:
    """1 for the blocks that are, in order, the main text."""
    out, at, wanted = [], 0, [" ".join(html.unescape(m).split()) for m in main]
    for b in page:
        hit = at < len(wanted) and b.text == wanted[at]
        out.append(int(hit))
        at += hit
    return out


# --- the field ----------------------------------------------------------------------------

class Field:
    """weights (features, 2) and moves (2, 2): scores of labels and of neighbouring labels."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def decode(self, on: list[list[int]]) -> list[int]:
        """The best labels, by Viterbi."""
        if not on:
            return []
        w, m, back = self.weights.tolist(), self.moves.tolist(), []
        v = [0.0, 0.0]
        for i, f in enumerate(on):
            own = [sum(w[k][y] for k in f) for y in (0, 1)]
            if i:
                came = [int(v[1] + m[1][y] > v[0] + m[0][y]) for y in (0, 1)]
                v = [v[came[y]] + m[came[y]][y] + own[y] for y in (0, 1)]
                back.append(came)
            else:
                v = own
        out = [int(v[1] > v[0])]
        for came in reversed(back):
            out.append(came[out[-1]])
        return out[::-1]


@functools.cache
def train(pages: int = 250, rounds: int = 45, rate: float = 0.5, decay: float = 1e-3) -> Field:
    """Gradient ascent with step sizes by feature; forward-backward over all pages side by side."""
    data = []
    for seed in range(pages):
        page, main = labelled_page(seed)
        found = blocks(page)
        data.append((features(found), labels(found, main)))
    data = [d for d in data if d[0]]
    longest, count = max(len(x) for x, _ in data), len(data)
    x = np.zeros((count, longest, len(NAMES)))
    y, held = np.zeros((count, longest), int), np.zeros((count, longest), bool)
    for i, (on, label) in enumerate(data):
        for t, f in enumerate(on):
            x[i, t, f] = 1
        y[i, : len(on)], held[i, : len(on)] = label, True
    w, m = np.zeros((len(NAMES), 2)), np.zeros((2, 2))
    gw, gm = np.full_like(w, 1e-6), np.full_like(m, 1e-6)
    flat, truth = x[held], np.eye(2)[y]
    both = held[:, 1:]
    pair_truth = np.einsum("ita,itb,it->ab", truth[:, :-1], truth[:, 1:], both)
    for _ in range(rounds):
        own = x @ w
        ahead, behind = np.zeros_like(own), np.zeros_like(own)
        ahead[:, 0] = own[:, 0]
        for t in range(1, longest):
            ahead[:, t] = np.where(held[:, t, None], own[:, t] + np.logaddexp.reduce(ahead[:, t - 1, :, None] + m, axis=1), ahead[:, t - 1])
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        for t in range(longest - 2, -1, -1):
            behind[:, t] = np.where(held[:, t + 1, None], np.logaddexp.reduce(m + (own[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2), 0)
        single = np.exp(ahead + behind - total[:, None, None])
        pair = np.exp(ahead[:, :-1, :, None] + m + (own[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None])
        dw = flat.T @ (truth - single)[held] / count - decay * w
        dm = (pair_truth - np.einsum("itab,it->ab", pair, both)) / count - decay * m
        gw, gm = gw + dw**2, gm + dm**2
        w, m = w + rate * dw / np.sqrt(gw), m + rate * dm / np.sqrt(gm)
    return Field(w, m)


def main_text(page: str | None, field_: Field) -> list[str]:
    """The blocks of a page's main text."""
    found = blocks(page or "")
    return [b.text for b, y in zip(found, field_.decode(features(found)), strict=True) if y]


def extract(pages: DataFrame, field_: Field | None = None, html_column: str = "html") -> DataFrame:
    """``pages`` without the html, with text (the main blocks, joined by newlines), n_chars and n_blocks.

    Null or empty html gives an empty text, bytes that are no UTF-8 are read as U+FFFD.
    One narrow pass: each page is read alone and whole, repeated rows too, in memory in
    proportion to the page. An empty table gives an empty result. Input columns of the new
    names are replaced; others are passed on.
    """
    kept = [c for c in pages.columns if c not in (html_column, "text", "n_chars", "n_blocks")]
    model = field_ or train()

    def run(batches):
        for batch in batches:
            found = [main_text(page and page.decode("utf-8", "replace"), model) for (page,) in rows(batch, html_column)]
            texts = ["\n".join(f) for f in found]
            out = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*out, pa.array([t.encode("utf-8", "replace").decode() for t in texts], pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(map(len, found), pa.int64())], [*kept, "text", "n_chars", "n_blocks"])

    more = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_blocks", T.LongType())]
    return pages.select(*kept, F.col(html_column).cast("binary").alias(html_column)).mapInArrow(run, T.StructType([*(pages.schema[c] for c in kept), *more]))
