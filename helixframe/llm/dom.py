"""Leaf blocks of an HTML page: the stretches of text between block-level tags, with their ancestors."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html import unescape

_TAG = re.compile(
    r"<!--(?:.*?-->|>|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_BLANKS = re.compile(r"\s+")

#: HTML's elements by how they stand in the text.
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "select", "annotation", "annotation-xml"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
    "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
    "time", "tt", "u", "var", "object",
    # formulas
    "math", "semantics", "mi", "mn", "mo", "ms", "mtext", "mspace", "mrow", "mfrac", "msqrt", "mroot", "mstyle", "merror",
    "mpadded", "mphantom", "mfenced", "menclose", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mmultiscripts",
    "mprescripts", "none", "mtable", "mtr", "mtd", "maction",
}
#: Elements whose start closes an open element of the second set.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"},
}
#: What ends the search for an element to close.
WALLS = {"ul", "ol", "dl", "table", "div", "article", "section", "main", "body", "aside", "nav", "form"}


#: Elements that the start of another one may close.
CLOSABLE = {"p"}.union(*CLOSES.values())


@dataclass(slots=True)
class Block:
    """A stretch of text with the distinct tags and names of its ancestors and its innermost tag."""

    text: str
    tags: frozenset[str]
    names: frozenset[str]
    inner: str
    link_chars: int


@dataclass(slots=True)
class _Open:
    """An open element, with what it and its ancestors hold; sets are shared where nothing is new."""

    name: str
    own: tuple[str, ...]
    tags: frozenset[str]
    names: frozenset[str]
    inner: str
    linked: bool
    closable: frozenset[str]


_TOP = _Open("", (), frozenset(), frozenset(), "none", False, frozenset())
#: Elements that only format and are passed over for a block's innermost tag.
_FORMATS = ("a", "b", "i", "em", "strong", "span")


def _inside(above: _Open, name: str, own: tuple[str, ...], kept_tags: frozenset[str] | None, kept_names: frozenset[str] | None) -> _Open:
    named = [w for w in own if w not in above.names and (kept_names is None or w in kept_names)]
    known = name in above.tags or (kept_tags is not None and name not in kept_tags)
    open_ends = frozenset() if name in WALLS else above.closable
    return _Open(
        name, own, above.tags if known else above.tags | {name}, above.names.union(named) if named else above.names,
        above.inner if name in _FORMATS else name, above.linked or name == "a",
        open_ends | {name} if name in CLOSABLE and name not in open_ends else open_ends,
    )


class _Formatting:
    """Formatting elements that are open inside the innermost block, where any one may end by itself.

    What they hold is counted, so that an end tag costs the same however many elements are open.
    """

    def __init__(self) -> None:
        self._open: dict[str, list[tuple[int, tuple[str, ...]]]] = {}
        self._inner: list[tuple[int, str]] = []
        self._ended: set[int] = set()
        self._words: Counter[str] = Counter()
        self._opened = 0

    def start(self, name: str, own: tuple[str, ...]) -> None:
        self._opened += 1
        self._open.setdefault(name, []).append((self._opened, own))
        self._words.update(own)
        if name not in _FORMATS:
            self._inner.append((self._opened, name))

    def end(self, name: str) -> None:
        """The last open element of this name ends; those opened after it stay open."""
        if name in self._open:
            number, own = self._open[name].pop()
            if not self._open[name]:
                del self._open[name]
            self._ended.add(number)
            self._words.subtract(own)
            for word in own:
                if self._words[word] <= 0:
                    del self._words[word]

    def linked(self) -> bool:
        return "a" in self._open

    def over(self, block: _Open, kept_tags: frozenset[str] | None) -> tuple[frozenset[str], frozenset[str], str]:
        """Tags, names and innermost tag of text in these elements inside ``block``."""
        while self._inner and self._inner[-1][0] in self._ended:
            self._inner.pop()
        tags = self._open.keys() if kept_tags is None else self._open.keys() & kept_tags
        return (
            block.tags if block.tags.issuperset(tags) else block.tags | tags,
            block.names if block.names.issuperset(self._words) else block.names | self._words.keys(),
            self._inner[-1][1] if self._inner else block.inner,
        )


def _names(attributes: str) -> tuple[str, ...]:
    """Words of the attributes that say what an element is for."""
    if not attributes or attributes.isspace():
        return ()
    out: list[str] = []
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values)
        if name.lower() in ("hidden", "aria-hidden"):
            if value.lower() != "false":
                out.append("hidden")
        else:
            out += _WORD.findall(value.lower())
    return tuple(out)


def leaf_blocks(html: str, kept_tags: frozenset[str] | None = None, kept_names: frozenset[str] | None = None) -> list[Block]:
    """The page's blocks in order. Elements that hold no running text (scripts, styles, title and the
    like) and comments are left out, and so is text drawn in an svg or given in a noscript, which a
    reader with scripts does not see as running text; what is open at the end counts as closed there.

    With ``kept_tags`` and ``kept_names`` blocks tell of those ancestors only, so that their size does
    not grow with the depth of the page; the time then grows with the page's length alone, also where
    elements are misnested.
    """
    blocks: list[Block] = []
    stack: list[_Open] = [_TOP]
    formatting = _Formatting()
    count: Counter[str] = Counter()
    held: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = _BLANKS.sub(" ", unescape("".join(held))).strip()
            if text:
                blocks.append(Block(text, *formatting.over(stack[-1], kept_tags), linked))
            held.clear()
        linked = 0

    def push(name: str, own: tuple[str, ...]) -> None:
        stack.append(_inside(stack[-1], name, own, kept_tags, kept_names))
        count[name] += 1

    def cut(k: int) -> None:
        nonlocal formatting
        formatting = _Formatting()  # formatting left open does not reach the next block
        for gone in stack[k:]:
            count[gone.name] -= 1
        del stack[k:]

    at, end = 0, len(html)
    while at < end:
        found = _TAG.search(html, at)
        text = html[at : found.start() if found else end]
        if text:
            held.append(text)
            if stack[-1].linked or formatting.linked():
                linked += len(text)
        if not found:
            break
        at = found.end()
        closing, name = found.group(1), (found.group(2) or "").lower()
        if not name:
            continue
        if name in RAW:
            if not closing and not found.group(3).rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\s*(?:>|\Z)", re.I).search(html, at)
                at = close.end() if close else end
                if name not in ("svg", "annotation", "annotation-xml"):
                    held.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name == "br":
                held.append(" ")
            continue
        if name in INLINE:
            if not closing:
                own = _names(found.group(3))
                formatting.start(name, own if kept_names is None else tuple(w for w in own if w in kept_names))
            else:
                formatting.end(name)
            continue
        flush()
        if closing:
            if count[name]:
                k = len(stack) - 1
                while stack[k].name != name:
                    k -= 1
                cut(k)
            continue
        cut(len(stack))
        ends = CLOSES.get(name, set()) | {"p"}
        while not ends.isdisjoint(stack[-1].closable):
            k = len(stack) - 1
            while stack[k].name not in ends:
                k -= 1
            cut(k)
        push(name, _names(found.group(3)))
    flush()
    return blocks
