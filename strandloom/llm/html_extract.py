"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the page.

A page is read into blocks: runs of text between block-level tags, each with the tags it stands in. Every block gets
sparse features of its ancestors' tags and class names, its own tag, its text and its place; a chain CRF with the
labels main and other is trained on labelled pages (by default a generated set of layouts) and decoded by Viterbi.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of HTML: elements whose content is not text, void elements, and elements that break lines.
HIDDEN = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "head", "title", "select", "textarea", "button", "option", "datalist", "audio", "video"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "br", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
CLOSES_P = BLOCK - {"br", "html", "body"}

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)""", re.S)
ATTR = re.compile(r"""(?:^|\s)(class|id|role|itemprop|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
SPACES = re.compile(r"\s+")
NAMES = re.compile(r"[A-Za-z]+")


class Place:
    """An open element: its tag, the words of its class, id and role, and the element around it.

    The sets of tags and words on the way up are shared with the element around where nothing new is added, and where
    ``known`` is given only what is in it is kept, so the memory of deep nesting doesn't grow with depth squared.
    """

    __slots__ = ("tag", "tags", "names", "named")

    def __init__(self, tag: str = "", names: list[str] = (), around: "Place | None" = None, known: frozenset | None = None):
        self.tag = tag
        self.tags: frozenset = around.tags if around else frozenset()
        self.names: frozenset = around.names if around else frozenset()
        self.named = bool(names) or bool(around and around.named)
        if tag and tag not in self.tags and (known is None or f"in:{tag}" in known):
            self.tags = self.tags | {tag}
        names = [n for n in names if known is None or f"name:{n}" in known]
        if not self.names.issuperset(names):
            self.names = self.names.union(names)


@dataclass
class Block:
    text: str
    place: Place
    linked: int = 0  # characters inside links


def blocks(html: str | None, known: frozenset | None = None) -> list[Block]:
    """The leaf blocks of a page in order: character references decoded, each run of white space one space, trimmed.

    ``known``: names of the features that matter (those of a trained model); all where it is not given.
    """
    out: list[Block] = []
    stack: list[tuple[str, Place, bool]] = []  # tag, place, hidden
    opened: dict[str, list[int]] = {}  # places in the stack of each tag
    barriers: list[int] = []  # places in the stack of block-level tags
    parts: list[tuple[str, bool]] = []
    top = Place()
    hidden = links = 0

    def flush() -> None:
        if parts:
            text = SPACES.sub(" ", "".join(p for p, _ in parts)).strip()
            if text:
                out.append(Block(text, stack[-1][1] if stack else top, sum(len(p.strip()) for p, a in parts if a)))
            parts.clear()

    def close(at: int) -> None:
        nonlocal hidden, links
        while len(stack) > at:
            t, _, h = stack.pop()
            hidden -= h
            links -= t == "a"
            opened[t].pop()
            if t in BLOCK:
                barriers.pop()

    def put(s: str) -> None:
        if s and not hidden:
            parts.append((unescape(s) if "&" in s else s, links > 0))

    html = html or ""
    at = 0
    while at < len(html):
        m = TAG.search(html, at)
        if not m:
            put(html[at:])
            break
        put(html[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if m["cdata"] is not None:
            put(m["cdata"])
        if not name:
            continue
        if m["end"]:
            if name == "br":
                flush()
            k = opened[name][-1] if opened.get(name) else -1
            if name in BLOCK:
                flush()
            if k >= 0 and (name in BLOCK or not barriers or barriers[-1] < k):
                close(k)
            continue
        if name in BLOCK:
            flush()
        if name in VOID:
            continue
        if name in CLOSES_P or name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            # end tags that may be left out: a new one of the kind ends an open one of the same list, row or paragraph
            ends = {"p"} | ({name} if name in ("li", "dt", "dd", "tr", "td", "th") else set())
            if barriers and stack[barriers[-1]][0] in ends:
                close(barriers[-1])
        attrs = m["attrs"] or ""
        names, off = [], name in HIDDEN
        for a in ATTR.finditer(attrs) if attrs.strip(" /") else ():
            key, value = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                off = True
            elif key in ("class", "id", "role", "itemprop"):
                names += NAMES.findall(value)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if attrs.rstrip().endswith("/") and name in ("svg", "path"):
            continue
        opened.setdefault(name, []).append(len(stack))
        if name in BLOCK:
            barriers.append(len(stack))
        stack.append((name, Place(name, names, stack[-1][1] if stack else top, known), off))
        hidden += off
        links += name == "a"
    flush()
    return out


APART, INSIDE = {"nav", "footer", "header", "aside", "form", "menu"}, {"article", "main"}
STARTS = ("©", "copyright", "all rights reserved")


def features(page: list[Block]) -> list[list[str]]:
    """Names of the features that hold for each block."""
    n, found = len(page), []
    for i, b in enumerate(page):
        tags = b.place.tags
        size = len(b.text)
        words = b.text.count(" ") + 1
        f = ["bias"]
        f += [f"in:{t}" for t in tags]
        f += [f"name:{x}" for x in b.place.names]
        f.append(f"own:{b.place.tag}")
        f.append(f"words:{min(5, words.bit_length() - 1)}")
        share = b.linked / size
        f.append("links:" + ("none" if share == 0 else "some" if share < 0.5 else "most"))
        f.append("ends" if b.text[-1] in ".!?。\"”’:" else "open")
        low = b.text[:40].lower()
        if low.startswith(STARTS):
            f.append("rights")
        apart = bool(tags & APART)
        f.append("apart" if apart else "inside" if tags & INSIDE else "loose")
        if not b.place.named and not apart:
            f.append("unnamed" + (" inside" if tags & INSIDE else ""))
        found.append(f)
    return found


@dataclass
class Crf:
    """Labels 0 (other) and 1 (main): weights of features, of label pairs, and of first labels."""

    index: dict[str, int]
    weight: np.ndarray  # features x 2
    pair: np.ndarray
    first: np.ndarray

    @property
    def known(self) -> frozenset:
        """Names of its features, and of the tags that ``features`` asks for by name."""
        if not hasattr(self, "_known"):
            self._known = frozenset(self.index) | {f"in:{t}" for t in APART | INSIDE}
        return self._known

    def scores(self, page: list[Block]) -> np.ndarray:
        rows = [[self.index[x] for x in f if x in self.index] for f in features(page)]
        return np.array([self.weight[r].sum(axis=0) if r else np.zeros(2) for r in rows]).reshape(-1, 2)

    def decode(self, page: list[Block]) -> list[int]:
        """The best label sequence (Viterbi); of equal ones, other before main."""
        if not page:
            return []
        s = self.scores(page).tolist()
        (p00, p01), (p10, p11) = self.pair.tolist()
        a, b = s[0][0] + self.first[0], s[0][1] + self.first[1]
        back = []
        for x, y in s[1:]:
            back.append((int(b + p10 > a + p00), int(b + p11 > a + p01)))
            a, b = max(a + p00, b + p10) + x, max(a + p01, b + p11) + y
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[list[Block], list[int]]], rounds: int = 100, rate: float = 0.5, l2: float = 1e-3) -> Crf:
    """Maximises the conditional likelihood of the labels by gradient steps with per-weight rates (AdaGrad)."""
    seqs = [([], y) if not b else (features(b), y) for b, y in pages]
    index: dict[str, int] = {}
    for f, _ in seqs:
        for row in f:
            for x in row:
                index.setdefault(x, len(index))
    data = [(np.array([index[x] for row in f for x in row]), np.array([len(row) for row in f]), np.array(y)) for f, y in seqs if f]
    size = 2 * len(index)
    w, grads = np.zeros(size + 6), np.full(size + 6, 1e-6)
    for _ in range(rounds):
        g = -l2 * len(data) * w
        weight, pair, first = w[:size].reshape(-1, 2), w[size : size + 4].reshape(2, 2), w[size + 4 :]
        gw, gp, gf = g[:size].reshape(-1, 2), g[size : size + 4].reshape(2, 2), g[size + 4 :]
        for flat, counts, y in data:
            s = np.add.reduceat(weight[flat], np.cumsum(counts) - counts)
            n = len(s)
            fwd, bwd = np.empty((n, 2)), np.zeros((n, 2))
            fwd[0] = s[0] + first
            for t in range(1, n):
                fwd[t] = np.logaddexp(fwd[t - 1][0] + pair[0], fwd[t - 1][1] + pair[1]) + s[t]
            for t in range(n - 2, -1, -1):
                nxt = bwd[t + 1] + s[t + 1]
                bwd[t] = np.logaddexp(pair[:, 0] + nxt[0], pair[:, 1] + nxt[1])
            z = np.logaddexp(*fwd[-1])
            off = np.eye(2)[y] - np.exp(fwd + bwd - z)
            for k in (0, 1):
                gw[:, k] += np.bincount(flat, np.repeat(off[:, k], counts), len(index))
            gf += off[0]
            if n > 1:
                gp -= np.exp(fwd[:-1, :, None] + pair[None] + (s[1:] + bwd[1:])[:, None, :] - z).sum(axis=0)
                np.add.at(gp, (y[:-1], y[1:]), 1)
        grads += g * g
        w += rate * g / np.sqrt(grads)
    return Crf(index, w[:size].reshape(-1, 2).copy(), w[size : size + 4].reshape(2, 2).copy(), w[size + 4 :].copy())


def layouts(n: int = 240, seed: int = 11) -> list[tuple[str, list[int]]]:
    """Generated training pages and the label of each of their blocks, over varied layouts.

    The words are drawn anew for every page, so that the model can only learn tags, names and shapes.
    """
    rng = np.random.default_rng(seed)
    pick = lambda *xs: xs[rng.integers(len(xs))]

    def word() -> str:
        return "".join(chr(97 + rng.integers(26)) for _ in range(rng.integers(2, 9)))

    def words(lo: int, hi: int) -> str:
        return " ".join(word() for _ in range(rng.integers(lo, hi)))

    def sentence(lo: int = 1, hi: int = 30) -> str:
        return words(lo, hi).capitalize() + pick(".", ".", ".", "!", "?", "")

    pages = []
    for _ in range(n):
        y: list[int] = []

        def put(fmt: str, text: str, label: int) -> str:
            y.append(label)  # noqa: B023
            return fmt.format(text)

        def menu(tag: str, attr: str = "") -> str:
            items = "".join(put("<li><a href='/x'>{}</a></li>", words(1, 3), 0) for _ in range(rng.integers(2, 8)))
            return f"<{tag}{attr}><ul>{items}</ul></{tag}>"

        def box(tag: str, attr: str, lo: int = 1, hi: int = 3) -> str:
            return f"<{tag}{attr}>" + "".join(put(pick("<p>{}</p>", "<div>{}</div>", "<p>{}"), sentence(), 0) for _ in range(rng.integers(lo, hi))) + f"</{tag}>"

        def named(*xs: str) -> str:
            return f' {pick("class", "class", "id")}="{pick(*xs)}"'

        def junk() -> str:
            kind = rng.integers(9)
            if kind == 0:
                return put("<div" + named("ad", "ads", "advert", "advertisement", "ad-slot", "sponsored", "promo", "banner") + ">{}</div>", sentence(), 0)
            if kind == 1:
                return box("aside", pick("", named("sidebar", "related", "widget")))
            if kind == 2:
                return box("div", named("sidebar", "side-bar", "related", "related-posts", "widget", "share", "social", "newsletter", "newsletter-signup", "subscribe", "breadcrumb", "breadcrumbs", "pagination", "tags"))
            if kind == 3:
                return box(pick("div", "section"), named("cookie", "cookie-notice", "cookies", "consent", "notice", "gdpr", "popup", "modal", "alert"))
            if kind == 4:
                return "<form>" + put("<label>{}</label>", words(1, 4), 0) + "<input type=text><button>go</button></form>"
            if kind == 5:
                return menu("nav")
            if kind == 6:
                return menu("div", named("menu", "nav", "navbar", "navigation", "topnav", "main-menu"))
            if kind == 7:
                return box("div", pick(' role="navigation"', ' role="banner"', ' role="complementary"', ' role="contentinfo"'))
            return menu("ul", named("menu", "nav", "links")).replace("<ul><li>", "<li>")

        def comments() -> str:
            return f"<{(t := pick('section', 'div', 'ol'))}{named('comments', 'comment-list', 'comment', 'reviews', 'discussion', 'replies', 'respond', 'disqus')}>" + put("<h3>{}</h3>", words(1, 3), 0) + "".join(put(pick('<div class="comment">{}</div>', "<p>{}</p>", "<li>{}</li>"), sentence(), 0) for _ in range(rng.integers(1, 5))) + f"</{t}>"

        def main() -> str:
            inside = [put(pick("<h1>{}</h1>", "<h1>{}</h1>", "<h2>{}</h2>"), sentence(1, 14), 1)] if rng.random() < 0.9 else []
            for _ in range(rng.integers(1, pick(3, 12, 12))):
                kind = rng.integers(12)
                text = sentence(1, 90) if kind < 9 else sentence(1, 12)
                inside.append(put(("<p>{}</p>", "<p>{}</p>", "<p>{}", "<p>{}</p>", "<p><b>{}<br>", "<p>{}</p>", "<p>{}</p>", "<div>{}</div>", "<p>{} </p>", "<h2>{}</h2>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>")[kind], text, 1))
                if rng.random() < 0.1:
                    inside.append(junk())
            if rng.random() < 0.1:
                inside.append(comments())
            frame = pick(("article", ""), ("article", ""), ("main", ""), ("div", named("content", "post", "entry", "article", "article-body", "story", "text", "main", "post-content", "entry-content", "body")), ("section", named("content", "article")), ("div", ""))
            return f"<{frame[0]}{frame[1]}>" + "".join(inside) + f"</{frame[0]}>"

        top = []
        bare = rng.random() < 0.15  # nothing but the article
        if not bare and rng.random() < 0.4:
            name = pick("header", "header", "div")
            top.append(f"<{name}{named('header', 'site-header', 'masthead', 'top') if name == 'div' else ''}>" + put(pick("<a href='/'>{}</a>", "<div>{}</div>", "<h1>{}</h1>", "<p>{}</p>"), words(1, 5), 0) + f"</{name}>")
        if not bare and rng.random() < 0.8:
            top.append(menu("nav"))
        top += [junk() for _ in range(0 if bare else rng.integers(0, 4))]
        body = main()
        end = [junk() for _ in range(0 if bare else rng.integers(0, 3))]
        if not bare and rng.random() < 0.3:
            end.append(comments())
        if not bare and rng.random() < 0.85:
            name = pick("footer", "footer", "footer", "div")
            end.append(f"<{name}{named('footer', 'site-footer', 'copyright', 'bottom') if name == 'div' else ''}>" + put(pick("{}", "<p>{}</p>"), pick("&copy; ", "", "Copyright ") + sentence(), 0) + f"</{name}>")
        pages.append(("<html><head><title>t</title></head><body>" + "".join(top) + body + "".join(end) + pick("</body></html>", ""), y))
    return pages


@lru_cache(maxsize=1)
def default_model() -> Crf:
    """Trained on the generated layouts; the order of labels is that of the blocks in the page."""
    return train([(b, y) for html, y in layouts() if len(b := blocks(html)) == len(y)])


def main_text(html: str | None, model: Crf) -> str:
    page = blocks(html, model.known)
    return "\n".join(b.text for b, keep in zip(page, model.decode(page)) if keep)


def extract(pages: DataFrame, model: Crf | None = None) -> DataFrame:
    """page_id, url, text, n_chars (code points) of each row of ``pages`` (page_id, url, html).

    Whole pages; a null or empty page, and one without a main block, gives the empty text. Text outside any tag is a
    block like any other. Rows that repeat an id each give a row; other columns are ignored.
    """
    model = model or default_model()

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": [main_text(h, model) for h in b["html"]]})

    kind = pages.schema["page_id"].dataType.simpleString()
    found = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).mapInPandas(each, f"page_id {kind}, url string, text string")
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def query(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return extract(pages)
