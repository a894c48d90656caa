"""Main text of web pages by a conditional random field over their leaf blocks.

Each block is described by its ancestors' tags and names and by its text; the labels are main text or
not. The field is trained on labelled pages: :func:`labelled_pages` writes pages of many layouts, from
a seed, in which every block's label is known. Viterbi decoding labels a page's blocks together.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .crf import Crf, train
from .common import materialize, narrow_batches
from .dom import Block, leaf_blocks

#: How many labelled pages the field is trained on.
TRAIN_PAGES = 700

#: Names that elements of a kind commonly bear.
BOILER_NAMES = {
    "nav": ["nav", "menu", "navbar", "main menu", "breadcrumb", "top links", "pagination", "tabs"],
    "header": ["header", "site header", "masthead", "topbar", "branding"],
    "footer": ["footer", "site footer", "colophon", "copyright", "legal", "bottom"],
    "side": ["sidebar", "aside", "widget", "related", "rail", "popular", "recommended", "tags", "toc"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner", "adsense"],
    "notice": ["notice", "cookie", "consent", "alert", "gdpr", "popup", "modal", "newsletter", "subscribe"],
    "social": ["share", "social", "follow", "byline", "meta"],
    "comment": ["comments", "comment", "commentlist", "respond", "replies", "discussion", "disqus"],
    "form": ["form", "search", "login", "signup", "contact"],
}
MAIN_NAMES = ["article", "content", "post", "entry", "story", "main", "body", "text", "page", "entry content", "article body", "post content"]
_KNOWN = {w for names in BOILER_NAMES.values() for n in names for w in n.split()} | {w for n in MAIN_NAMES for w in n.split()}


NAMES = frozenset(_KNOWN | {"hidden"})
#: Elements whose presence above a block says what it is.
ROLES = (
    "nav", "header", "footer", "aside", "form", "article", "main", "section", "figure", "table", "li", "blockquote", "address",
    "button", "dialog", "details", "fieldset", "p", "pre", "dl",
)


def describe(blocks: list[Block]) -> list[list[str]]:
    """Binary features of each block of a page."""
    out = []
    seen_head = False
    for k, b in enumerate(blocks):
        tags, n = b.tags, len(b.text)
        names = b.names & NAMES
        size = 0 if n < 15 else 1 if n < 40 else 2 if n < 100 else 3 if n < 250 else 4
        links = b.link_chars / max(n, 1)
        link = 0 if links == 0 else 1 if links < 0.5 else 2
        stop = "stop" if b.text[-1] in ".!?…:\"”»)" else "open"
        inner = b.inner
        roles = [t for t in ROLES if t in tags]
        found = ["all", f"size{size}", f"link{link}", stop, f"in:{inner}", f"size{size}+link{link}"]
        found += [f"tag:{t}" for t in roles] + [f"name:{w}" for w in names]
        if "article" in tags or "main" in tags:
            found += [f"article+name:{w}" for w in names] + [f"article+tag:{t}" for t in roles]
        first = b.text[0]
        if first in "©®":
            found.append("sign:copy")
        if first in "|•·»›":
            found.append("sign:dot")
        head = inner[:1] == "h" and inner[1:].isdigit()
        if head and not seen_head:
            found.append("head:first")
            seen_head = True
        if k == 0:
            found.append("place:first")
        if k == len(blocks) - 1:
            found.append("place:last")
        if not roles and not names:
            found.append("bare")
            found.append(f"bare+size{size}+link{link}")
        out.append(found)
    return out


class _Writer:
    """Writes one labelled page; labels stand beside the blocks in their order."""

    def __init__(self, rng: random.Random):
        self.r = rng
        self.html: list[str] = []
        self.labels: list[int] = []
        letters = "abcdefghijklmnopqrstuvwxyzéèüöñç"
        self.words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(300)]

    def text(self, low: int, high: int, stop: bool = True) -> str:
        words = [self.r.choice(self.words) for _ in range(self.r.randint(low, high))]
        if self.r.random() < 0.15:
            words = [w + self.r.choice(["###", "***", "$$$", "!!", " |", "&amp;&amp;"]) for w in words]
        body = " ".join(words).capitalize()
        return body + (self.r.choice([".", ".", ".", "!", "?"]) if stop and self.r.random() < 0.9 else "")

    def put(self, inner: str, label: int, tag: str) -> None:
        if label and self.r.random() < 0.2 and " " in inner:
            at = inner.index(" ")
            mark = self.r.choice(["b", "em", "i", "strong", "a href='/x'", "span"])
            inner = f"<{mark}>{inner[:at]}</{mark.split()[0]}>{inner[at:]}"
        if label and tag == "p" and self.r.random() < 0.1:
            self.html.append(f"<p><b>{inner}<br>")  # left open, as careless pages do
        else:
            end = "" if tag == "p" and self.r.random() < 0.1 else f"</{tag.split()[0]}>"
            self.html.append(f"<{tag}>{inner}{end}")
        self.labels.append(label)

    def box(self, kind: str, tags: list[str]) -> tuple[str, str]:
        tag = self.r.choice(tags)
        if self.r.random() < (0.35 if tag in ("nav", "header", "footer", "aside", "form") else 0.97):
            where = self.r.choice(["class", "id", "class"])
            return f'<{tag} {where}="{self.r.choice(BOILER_NAMES[kind]).replace(" ", self.r.choice([" ", "-", "_"]))}">', f"</{tag}>"
        return (f"<{tag}>", f"</{tag}>") if tag != "div" else ('<div class="' + BOILER_NAMES[kind][0] + '">', "</div>")

    def links(self, low: int, high: int) -> None:
        shape = self.r.random()
        n = self.r.randint(low, high)
        if shape < 0.7:
            self.html.append("<ul>")
            for _ in range(n):
                self.put(f'<a href="/{self.r.choice(self.words)}">{self.text(1, 3, False)}</a>', 0, "li")
            self.html.append("</ul>")
        else:
            inner = self.r.choice([" ", " | ", " &middot; "]).join(f'<a href="#">{self.text(1, 2, False)}</a>' for _ in range(n))
            self.put(inner, 0, "div")

    def boiler(self, kind: str) -> None:
        tags = {
            "nav": ["nav", "nav", "div"], "header": ["header", "div"], "footer": ["footer", "footer", "div"], "side": ["aside", "div", "section"],
            "ad": ["div", "div", "aside", "section"], "notice": ["div", "section", "aside"], "social": ["div", "p", "ul"],
            "comment": ["section", "div", "ol"], "form": ["form", "form", "div"],
        }[kind]
        start, end = self.box(kind, tags)
        bare_text = kind in ("ad", "notice", "footer", "social") and self.r.random() < 0.5
        if bare_text or start.startswith(("<p", "<ul")):
            lead = self.r.choice(["&copy; ", "© 2020 ", "", ""]) if kind == "footer" else ""
            tail = self.r.choice(["", "", "\n", " &middot; "])
            inner = lead + self.text(2, 30) + tail + (self.text(1, 8) if tail else "")
            self.html.append(start + inner + end)
            self.labels.append(0)
            return
        self.html.append(start)
        if kind in ("nav", "header"):
            if kind == "header" and self.r.random() < 0.6:
                self.put(self.text(1, 4, False), 0, self.r.choice(["div", "h2", "p"]))
            self.links(3, 8)
        elif kind == "side":
            for _ in range(self.r.randint(1, 2)):
                self.put(self.text(1, 4, False), 0, self.r.choice(["h2", "h3", "h4"]))
                self.links(2, 6) if self.r.random() < 0.6 else self.put(self.text(5, 40), 0, "p")
        elif kind == "comment":
            self.put(self.text(1, 3, False), 0, "h3")
            for _ in range(self.r.randint(1, 5)):
                self.html.append(self.r.choice(['<div class="comment">', '<li class="comment">', '<article class="comment">']))
                shape = self.html[-1][1:].split()[0]
                self.put(self.text(1, 2, False), 0, self.r.choice(["cite", "h4", "div"]).replace("cite", "div"))
                for _ in range(self.r.randint(1, 2)):
                    self.put(self.text(4, 50), 0, "p")
                self.html.append(f"</{shape}>")
        elif kind == "form":
            self.html.append(f"<label>{self.text(1, 4, False)}</label> <input name=q> <button>{self.text(1, 2, False)}</button>")
            self.labels += [0, 0]
        else:
            for _ in range(self.r.randint(1, 3)):
                self.put(self.text(3, 40), 0, self.r.choice(["p", "p", "div", "h4"]))
        self.html.append(end)

    def article(self) -> None:
        r = self.r
        if r.random() < 0.75:
            self.put(self.text(2, 10, r.random() < 0.3), 1, "h1")
        for k in range(r.choice([1, 2, 3, 5, 8, 12, 20])):
            pick = r.random()
            if pick < 0.78:
                self.put(self.text(1, 6) if r.random() < 0.2 else self.text(6, 90), 1, "p")
            elif pick < 0.84:
                self.put(self.text(1, 6, False), 1, r.choice(["h2", "h3"]))
            elif pick < 0.90:
                self.html.append("<ul>")
                for _ in range(r.randint(2, 5)):
                    self.put(self.text(2, 20), 1, "li")
                self.html.append("</ul>")
            elif pick < 0.94:
                self.put(self.text(5, 40), 1, r.choice(["blockquote", "pre"]))
            elif k and pick < 0.97:
                self.boiler(r.choice(["ad", "social", "notice", "side", "form"]))
            else:
                self.html.append("<script>var a='<p>';</script><!-- x -->")

    def page(self) -> tuple[str, list[int]]:
        r = self.r
        self.html.append("<!DOCTYPE html><html><head><title>" + self.text(2, 6) + "</title><style>p{}</style></head><body>")
        for kind in ("notice", "header", "nav", "ad"):
            if r.random() < {"notice": 0.25, "header": 0.4, "nav": 0.85, "ad": 0.5}[kind]:
                self.boiler(kind)
        shell = r.random()
        outer = "main" if r.random() < 0.3 else ""
        name = f' class="{r.choice(MAIN_NAMES)}"' if r.random() < 0.6 else ""
        tag = "article" if shell < 0.6 else r.choice(["div", "section", "main"])
        if tag in ("div", "section") and not name and not outer:
            name = f' id="{r.choice(MAIN_NAMES)}"' if r.random() < 0.8 else ""
        self.html.append((f"<{outer}>" if outer else "") + f"<{tag}{name}>")
        self.article()
        if r.random() < 0.15:
            self.boiler("comment")
        self.html.append(f"</{tag}>")
        if r.random() < 0.3:
            self.boiler("comment")
        self.html.append(f"</{outer}>" if outer else "")
        for kind in ("side", "ad", "form", "footer"):
            if r.random() < {"side": 0.35, "ad": 0.25, "form": 0.25, "footer": 0.9}[kind]:
                self.boiler(kind)
        self.html.append("</body></html>")
        return "".join(self.html), self.labels


def labelled_pages(count: int, seed: int = 5) -> Iterator[tuple[str, list[int]]]:
    """Pages with the label of each of their blocks, 1 for main text."""
    for k in range(count):
        html, labels = _Writer(random.Random(f"{seed}/{k}")).page()
        if len(leaf_blocks(html)) == len(labels):
            yield html, labels


@cache
def trained_field(count: int = TRAIN_PAGES) -> Crf:
    """The field, trained once in a process."""
    return train([(describe(leaf_blocks(html)), labels) for html, labels in labelled_pages(count)])


def extract(html: str, field: Crf) -> str:
    """Main text of one page: its main blocks joined by blank lines."""
    blocks = leaf_blocks(html, frozenset(ROLES), NAMES)
    labels = field.viterbi(describe(blocks))
    return "\n\n".join(b.text for b, label in zip(blocks, labels, strict=True) if label)


def _pages(batches: Iterator[pa.RecordBatch], field: Crf) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(html, field) for html in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            ["id", "url", "text", "n_chars"],
        )


def extract_pages(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", field: Crf | None = None
) -> DataFrame:
    """Per page: id, url, text, n_chars (code points).

    Character references are decoded, white space inside a block becomes one space, blocks are
    trimmed and joined by two line ends. A null or empty page, or one without main text, gives an
    empty text. Pages of any length are read whole. Repeated rows give repeated results, an empty
    table none; only the three named columns are read.
    """
    field = field or trained_field()
    shared = pages.sparkSession.sparkContext.broadcast(field)
    kinds = dict(pages.dtypes)
    slim = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    out = slim.mapInArrow(
        lambda it: _pages(it, shared.value), f"id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long"
    )
    with narrow_batches(pages.sparkSession):
        return materialize(out.withColumnsRenamed({"id": id_col, "url": url_col}), "pages")
