"""Pages as sequences of leaf blocks: the text between block-level tags, with the path of elements it stands in."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

# Fixed values of HTML: elements inside a line of text, elements without content, elements whose content is not markup, and which open elements a start tag ends.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark meter nobr progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas noembed noframes xmp".split())
LISTED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements beyond which a start tag ends nothing.
SCOPE = frozenset("ul ol dl table div article section main aside nav header footer body select form td th blockquote".split())

#: Elements around a block that its path names.
DEPTH = 24

TEXT_END = re.compile(r"<(?=[a-zA-Z/!?])")
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
QUOTED = re.compile(r"""[^>"']*+(?:"[^"]*"[^>"']*+|'[^']*'[^>"']*+)*+>""")
MARKS = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
PIECE = re.compile(r"[^\W\d_]+")


class Leaf(NamedTuple):
    """A block's text, the nearest DEPTH elements around it from the outermost (each its name and marks), and how many characters are links."""

    text: str
    path: tuple[tuple[str, ...], ...]
    linked: int


def marks(attributes: str) -> tuple[str, ...]:
    """Lower-cased words of class, id and role, and whether the element is hidden."""
    out = []
    for kind, value in MARKS.findall(attributes):
        kind = kind.lower()
        if kind in ("hidden", "aria-hidden"):
            out += ["hidden"] * (value.strip("\"'").lower() != "false")
        elif kind == "style":
            out += ["hidden"] * bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        else:
            out += PIECE.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower().replace("_", " "))
    return tuple(out)


def tokens(page: str) -> Iterator[tuple[str, str]]:
    """(kind, value): text, start (name and attributes, parted by a blank) and end tags; comments, declarations and raw content are left out."""
    at, n, quotes = 0, len(page), True
    while at < n:
        m = TEXT_END.search(page, at)
        stop = m.start() if m else n
        if stop > at:
            yield "text", page[at:stop]
        if not m:
            return
        if page.startswith("<!--", stop):
            end = page.find("-->", stop + 4)
            at = n if end < 0 else end + 3
            continue
        name = NAME.match(page, stop)
        if not name:  # a declaration, or an end tag without a name
            end = page.find(">", stop)
            at = n if end < 0 else end + 1
            continue
        end = QUOTED.match(page, name.end()) if quotes else None
        if end is None:
            quotes = False  # a quote is open to the end: from here on tags end at their first >
            close = page.find(">", name.end())
            if close < 0:
                return
            at = close + 1
        else:
            at = end.end()
        tag = name[2].lower()
        if name[1]:
            yield "end", tag
            continue
        yield "start", f"{tag} {page[name.end() : at - 1]}"
        if tag in RAW and page[at - 2] != "/":
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            if close is None:
                return
            at = close.start()


def leaves(page: str) -> list[Leaf]:
    """The blocks of a page in its order, blank ones left out; character references decoded, white space made one blank."""
    out: list[Leaf] = []
    stack: list[tuple[str, ...]] = []
    held: list[str] = []
    held_linked = 0
    path: tuple = ()

    def close() -> None:
        nonlocal held, held_linked
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            out.append(Leaf(text, path, min(held_linked, len(text))))
        held, held_linked = [], 0

    for kind, value in tokens(page):
        if kind == "text":
            if not held:
                path = tuple([e for e in islice(reversed(stack), 4 * DEPTH) if e[0] not in INLINE][DEPTH - 1 :: -1])
            held.append(value)
            if any(e[0] == "a" for e in stack[-4:]):
                held_linked += len(value.strip())
            continue
        tag, _, attributes = value.partition(" ")
        if tag == "br":
            held.append(" ")
            continue
        if tag not in INLINE:
            close()
        if kind == "end":
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
                if tag in INLINE and stack[i][0] not in INLINE:
                    break
            continue
        if tag in VOID:
            continue
        ends = LISTED.get(tag, set()) | (set() if tag in INLINE else {"p"})
        cut = len(stack)
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in ends:
                cut = i
            elif stack[i][0] in SCOPE:
                break
        del stack[cut:]
        if not attributes.endswith("/") or tag not in RAW:
            stack.append((tag, *(marks(attributes) if "=" in attributes or "hidden" in attributes else ())))
    close()
    return out
