"""Leaf blocks of an HTML page: the pieces of text between the borders of block elements.

A block knows the chain of its block ancestors with their class, id and role words, and how much of its text is
in links.  Comments, scripts, styles and other elements whose content isn't shown are no text.  The reader
follows what browsers do where it matters for text: ``p``, list items and cells end where the next one begins,
stray end tags are ignored, character references are decoded.  It reads each character a fixed number of times.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

# --- Fixed values: elements of HTML by how their content is shown ------------------------

#: Content is not text of the page.
UNSHOWN = "script style title textarea noscript template iframe noembed noframes xmp svg math select button object canvas".split()
BLOCK = set(
    "html body address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table caption tbody thead tfoot tr td th ul".split()
)
#: Elements that end an open element of the second list, up to one of the third.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
}

# -----------------------------------------------------------------------------------------

# a quoted value may hold < or > up to a length, so that a quote left open costs little
_INSIDE = r"""(?:[^<>"']|"[^"<]*"|'[^'<]*'|"[^"]{0,500}"|'[^']{0,500}')*+"""
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<({'|'.join(UNSHOWN)})(?=[\s/>]){_INSIDE}(?:/>|>.*?(?:</\1(?=[\s/>])[^>]*(?:>|\Z)|\Z))"
    rf"|<(/?)([a-z][^\s/<>]*)({_INSIDE}|[^<>]*)>",
    re.DOTALL | re.IGNORECASE,
)
_NAMED = re.compile(r"""(?<![^\s"'/])(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""(?<![^\s"'/])hidden(?=[\s=/]|$)|display\s*:\s*none""", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+|[0-9]+")


@dataclass(frozen=True)
class Block:
    text: str
    #: Tag and words of class, id and role of every block ancestor, outermost first.
    path: tuple[tuple[str, tuple[str, ...]], ...]
    linked: int


def _names(attributes: str) -> tuple[str, ...]:
    found = []
    for _, *values in _NAMED.findall(attributes):
        # camelCase and dashes separate words
        found += _WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", "".join(values)).lower())
    if _HIDDEN.search(attributes):
        found.append("hidden")
    return tuple(dict.fromkeys(found))


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    path: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[str] = []
    links, linked = 0, 0

    def end_block() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split()) if pieces else ""
        if text:
            out.append(Block(text, tuple(path), min(linked, len(text))))
        pieces.clear()
        linked = 0

    def close(tags: set[str], borders: set[str]) -> None:
        """End the innermost open element of ``tags``, and all in it."""
        for i in range(len(path) - 1, -1, -1):
            if path[i][0] in tags:
                del path[i:]
                return
            if path[i][0] in borders:
                return

    at = 0

    def add(text: str) -> None:
        nonlocal linked
        text = html.unescape(text) if "&" in text else text
        pieces.append(text)
        if links:
            linked += len(text.strip())

    for token in _TOKEN.finditer(page):
        if token.start() > at:
            add(page[at : token.start()])
        at = token.end()
        ending, tag = token[2], token[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "a":
            links = 0 if ending else 1
        elif tag == "br":
            pieces.append(" ")
        elif tag in BLOCK:
            end_block()
            links = 0
            if ending:
                close({tag}, {"td", "th", "table"} - {tag} if tag not in ("table", "tr", "tbody", "body", "html") else set())
                continue
            close({"p"}, {"td", "th", "table", "li", "div", "section", "article", "blockquote"})
            if tag in ENDS:
                while (before := len(path)) and (close(*ENDS[tag]) or len(path) < before):
                    pass
            if tag != "hr":
                path.append((tag, _names(token[4]) if token[4] else ()))
        elif tag == "body":
            end_block()
    if at < len(page):
        add(page[at:])
    end_block()
    return out
