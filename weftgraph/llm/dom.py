"""A tolerant reading of HTML into leaf blocks, and their features.

A leaf block is the text between two block-level tags, with the elements open around it. Missing, crossed and extra end tags
are borne: a start tag closes what HTML says it closes, an end tag without a start is ignored, what is open at the end ends
there. Comments, scripts, styles and the like have no text, nor do menus of forms (select), which end with the next
block-level tag at the latest. Formulas and fallback contents (math, object) are text of their block. Every tag costs about
the same however deeply it is nested.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# HTML element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math object q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
MUTE = frozenset("select template annotation annotation-xml desc".split())
IN_SELECT = frozenset("option optgroup hr select".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
P_FENCE = frozenset({"table", "td", "th", "button", "caption"})
#: Case is folded in ASCII only, in the page itself: lower() of a page can be longer than the page.
RAW_END = {tag: re.compile("</" + tag, re.I | re.A) for tag in RAW}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    text: str
    inner: str  # the innermost open element that is not inline
    around: frozenset[str]  # the open elements among AROUND
    names: frozenset[str]  # lower-case parts of the classes, ids and roles of open elements
    link_chars: int = 0
    hidden: bool = False


@dataclass
class _Open:
    tag: str
    names: frozenset[str] = frozenset()
    hidden: bool = False
    gone: bool = False  # an inline element that has ended below others


def _less(counts: dict, key) -> None:
    counts[key] -= 1
    if not counts[key]:
        del counts[key]


@dataclass
class _Reader:
    known: frozenset[str] | None
    stack: list[_Open] = field(default_factory=list)
    at: dict[str, list[int]] = field(default_factory=dict)  # the places of each open tag in the stack
    solid: list[int] = field(default_factory=list)  # the places of the elements that are not inline
    around: dict[str, int] = field(default_factory=dict)
    names: dict[str, int] = field(default_factory=dict)
    hidden: int = 0
    mute: int = 0  # open elements without text
    flow: int = 0  # open formulas, in which all is inline
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    links: int = 0  # open links
    blocks: list[Block] = field(default_factory=list)

    def text(self, raw: str) -> None:
        if self.mute:
            return
        t = html.unescape(raw) if "&" in raw else raw
        self.parts.append(t)
        if self.links:
            self.linked += len(t)

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                inner = self.stack[self.solid[-1]].tag if self.solid else ""
                self.blocks.append(Block(text, inner, frozenset(self.around), frozenset(self.names), self.linked, self.hidden > 0))
        self.parts, self.linked = [], 0

    def _left(self, x: _Open) -> None:
        if x.gone:
            return
        x.gone = True
        self.at[x.tag].pop()
        self.links -= x.tag == "a"
        self.mute -= x.tag in MUTE
        self.flow -= x.tag == "math"
        self.hidden -= x.hidden
        if x.tag in AROUND:
            _less(self.around, x.tag)
        for name in x.names:
            _less(self.names, name)

    def pop_to(self, i: int) -> None:
        while len(self.stack) > i:
            self._left(self.stack.pop())
            if self.solid and self.solid[-1] == len(self.stack):
                self.solid.pop()

    def last(self, tags) -> int:
        """The place of the innermost open element of some tags; -1 if there is none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def inline(self, tag: str) -> bool:
        return tag in INLINE or (self.flow > 0 and tag not in AROUND)

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.text(" ")
            return
        if self.at.get("select") and tag not in IN_SELECT:
            self.pop_to(self.last(("select",)))
        inline = self.inline(tag) or (tag in VOID and tag != "hr")
        if not inline and tag not in MUTE:
            self.flush()
            self._imply(tag)
        if tag in VOID or (attributes.endswith("/") and (self.flow or self.at.get("svg") or tag in ("svg", "math"))):
            return
        names, hidden = frozenset(), False
        if attributes and "=" in attributes or "hidden" in attributes:
            found = []
            for key, a, b, c in ATTRIBUTE.findall(attributes):
                key, value = key.lower(), a or b or c
                if key in ("class", "id", "role", "itemprop"):
                    found += [x.lower() for x in NAME_PART.findall(value)]
                elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
                    hidden = True
            names = frozenset(found if self.known is None else (x for x in found if x in self.known))
        self.at.setdefault(tag, []).append(len(self.stack))
        if not inline:
            self.solid.append(len(self.stack))
        self.stack.append(_Open(tag, names, hidden))
        self.links += tag == "a"
        self.mute += tag in MUTE
        self.flow += tag == "math"
        self.hidden += hidden
        if tag in AROUND:
            self.around[tag] = self.around.get(tag, 0) + 1
        for name in names:
            self.names[name] = self.names.get(name, 0) + 1

    def _imply(self, tag: str) -> None:
        shut, fence = CLOSES.get(tag, ({"p"}, P_FENCE))
        if tag in ("svg", "option", "optgroup"):
            return
        if tag not in CLOSES or tag in ("li", "dt", "dd"):
            self._shut({"p"}, P_FENCE | {"li", "dd"} if tag in CLOSES else fence)
        if tag in CLOSES:
            self._shut(shut, fence)
        if tag == "body":
            self._shut({"head"}, set())

    def _shut(self, tags: set[str], fence: set[str]) -> None:
        while (i := self.last(tags)) > self.last(fence):
            self.pop_to(i)
            if len(tags) == 1:
                return

    def end(self, tag: str) -> None:
        inline = self.inline(tag)
        if not inline and tag not in MUTE:
            self.flush()
        i = self.last((tag,))
        if i < 0:
            return
        if inline:
            if not self.solid or self.solid[-1] < i:
                self._left(self.stack[i])
        else:
            self.pop_to(i)


def blocks(page: str | None, known: frozenset[str] | None = None) -> list[Block]:
    """The leaf blocks of a page in order; none for a null or empty page. known: the names that are looked for (None: all)."""
    if not page:
        return []
    r, at, n = _Reader(known), 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            r.text(page[at:])
            break
        if m.start() > at:
            r.text(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br":
                r.text(" ")
            else:
                r.end(tag)
            continue
        if tag in RAW and not (m[3].endswith("/") and r.at.get("svg")):
            r.flush()
            close = RAW_END[tag].search(page, at)
            end = page.find(">", close.end()) if close else -1
            if tag == "xmp":  # its text is shown as it stands
                r.parts.append("" if r.mute else page[at : close.start() if close else n])
                r.flush()
            at = n if end < 0 else end + 1
            continue
        r.start(tag, m[3])
    r.flush()
    return r.blocks


# The elements that are features where they are open around a block.
AROUND = frozenset("article main section aside nav header footer form ul ol li table td th figure figcaption blockquote pre button label dl dd dt h1 h2 h3 h4 h5 h6 details noscript address fieldset div p body".split())
SIZES = (1, 3, 6, 12, 25, 50)


def features(page: list[Block]) -> list[list[str]]:
    """The names of each block's binary features: elements around it, words in their names, and its text's shape."""
    has = {t for t in ("article", "main") if any(t in b.around for b in page)}
    whole = [f"page:{t}" for t in ("article", "main") if t in has]
    out = []
    for b in page:
        f = ["bias", f"in:{b.inner}", *(f"around:{t}" for t in b.around), *(f"name:{x}" for x in b.names)]
        f += [f"{w}&{'in' if w[5:] in b.around else 'out'}" for w in whole]
        n = b.text.count(" ") + 1
        f.append(f"words:{sum(n >= s for s in SIZES)}")
        share = b.link_chars / len(b.text)
        f.append("links:" + ("none" if share == 0 else "some" if share < 0.3 else "many" if share < 0.9 else "all"))
        f.append("ends:" + ("stop" if b.text[-1] in ".!?:;…\"'”»)" else "open"))
        if b.text[0] == "©" or "©" in b.text[:40]:
            f.append("copyright")
        if b.hidden:
            f.append("hidden")
        out.append(f)
    return out
