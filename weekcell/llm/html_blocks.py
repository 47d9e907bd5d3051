"""HTML pages as sequences of text blocks with their tag paths.

A block is the text between two block-level tags; inline tags and line breaks within it count as text flow. Comments, scripts, styles and what
stands in the head make no block. Unclosed and stray tags are taken as browsers roughly do; an unclosed svg, math, object or template
ends with its open parent.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

from weekcell.llm.memo import Memo

#: Tags that open or close a block.
BLOCK_TAGS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select
summary table tbody td textarea tfoot th thead tr ul""".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag that closes an open element of the same group, unless one of the fences stands between.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
           "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
#: Elements whose content holds no tags: what stands in them ends at their end tag only.
_RAW = {t: re.compile(rf"</{t}\s*>|(?=<body\b)|\Z", re.IGNORECASE) for t in ("script", "style", "noscript", "iframe", "title")}
#: Elements with tags in them that make no block.
_HIDDEN = frozenset("template svg math object head".split())
_FOREIGN = frozenset(("svg", "math"))
#: What may stand in a head.
_IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
#: Start tags that end an open svg or math, unless one of the points is open in it.
_BREAKS = frozenset("""b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p
pre ruby s small span strong strike sub sup table tt u ul var""".split())
_POINTS = ("foreignobject", "desc", "annotation-xml", "mi", "mo", "mn", "ms", "mtext")
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>|<[a-z][^>]*>", re.IGNORECASE | re.DOTALL)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|itemprop|aria-label|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_PIECE = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{2,}")


@dataclass
class Block:
    text: str
    path: tuple[tuple[str, ...], ...]  # of each open element: its tag, then the words of its class, id and role
    linked: int  # characters inside links


def _signs(element: tuple[str, str]) -> tuple[str, ...]:
    tag, rest = element
    words = []
    if rest:
        for name, value in _ATTRIBUTE.findall(rest):
            words += [name.lower()] if name.lower() == "hidden" else [w.lower() for w in _PIECE.findall(value)]
    return (tag, *dict.fromkeys(words))


_SIGNS = Memo(_signs, limit=8 << 20)


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    links, linked, at = 0, 0, 0
    hidden: list[tuple[str, Counter]] = []  # open hidden elements, and what is open in each
    inline = Counter()  # open elements that are neither blocks nor hidden

    def close() -> None:
        nonlocal linked
        text = "".join(held)
        held.clear()
        if "&" in text:
            text = html.unescape(text)
        text = " ".join(text.split())
        if text:
            out.append(Block(text, tuple(s for _, s in stack), linked))
        linked = 0

    def pop_to(tags, fences=()) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in tags:
                del stack[k:]
                return
            if stack[k][0] in fences:
                return

    def foreign() -> bool:
        return bool(hidden) and hidden[-1][0] in _FOREIGN and not any(hidden[-1][1][t] for t in _POINTS)

    def still_hidden(tag: str, end: bool, empty: bool) -> bool:
        """Whether a tag stands in hidden elements, after those that it ends are closed."""
        if end:
            for k in range(len(hidden) - 1, -1, -1):
                name, inner = hidden[k]
                if inner[tag]:
                    inner[tag] -= 1
                    del hidden[k + 1:]
                    return True
                if name == tag:
                    del hidden[k:]
                    return True
            if inline[tag] or any(t == tag for t, _ in stack):
                hidden.clear()  # an open parent ends
            elif hidden[0][0] == "head" and tag in ("body", "html"):
                hidden.clear()
            return bool(hidden)
        if tag == "body":
            hidden.clear()
        elif tag in _BREAKS:
            while foreign():
                hidden.pop()
        if hidden and hidden[-1][0] == "head" and tag not in _IN_HEAD:
            hidden.pop()
        if hidden and tag not in _HIDDEN and tag not in VOID_TAGS and not (empty and foreign()):
            hidden[-1][1][tag] += 1
        return bool(hidden)

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            piece = page[at:m.start()]
            if hidden and hidden[-1][0] == "head" and not piece.isspace():
                hidden.pop()
            if not hidden:
                held.append(piece)
                if links:
                    linked += len(piece)
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        empty = m["rest"].endswith("/")
        if tag in _RAW and not (empty and foreign()):
            if not m["end"]:
                if hidden and hidden[-1][0] == "head" and tag not in _IN_HEAD:
                    hidden.pop()
                at = _RAW[tag].search(page, at).end()
            continue
        if hidden and still_hidden(tag, bool(m["end"]), empty):
            if tag in _HIDDEN and not m["end"] and not (empty and (tag in _FOREIGN or foreign())) and tag != "head":
                hidden.append((tag, Counter()))
            continue
        if tag in _HIDDEN:
            if not m["end"] and not (empty and tag in _FOREIGN):
                hidden.append((tag, Counter()))
            continue
        if tag not in BLOCK_TAGS and tag not in VOID_TAGS:
            inline[tag] = max(0, inline[tag] + (-1 if m["end"] else 1))
        if tag == "br":
            held.append(" ")
        elif tag == "a":
            links = 0 if m["end"] else 1
        elif tag in BLOCK_TAGS:
            close()
            links = 0
            if m["end"]:
                pop_to((tag,))
            else:
                if tag in _CLOSES:
                    pop_to(*_CLOSES[tag])
                elif stack and stack[-1][0] == "p":
                    stack.pop()
                if tag not in VOID_TAGS:
                    stack.append((tag, _SIGNS[(tag, m["rest"])]))
    if at < len(page) and (not hidden or hidden == [("head", Counter())]):
        held.append(page[at:])
    close()
    return out
