"""Pages as sequences of leaf blocks: the text between two block boundaries, with the path of open elements above it."""

from __future__ import annotations

import re
from html import unescape

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html "
    "label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a new one of the same family closes when their end tag was left out.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_FENCES = frozenset("body article aside section main div td th ul ol dl table form header footer nav".split())
#: Elements whose content is not markup: it runs to their own end tag, or to the end of the page.
_RAW = "script|style|title|textarea|iframe|xmp|noembed|noframes"
#: Elements with markup that is not page text; without an end tag of their own they hide nothing.
_HIDDEN = frozenset("noscript template svg object".split())
_ANY_HIDDEN = re.compile(rf"<(?:{'|'.join(sorted(_HIDDEN))})(?=[\s/>])", re.I)
#: What stands between a tag's name and its end: a quote opens a value only behind "=", and only if it is closed
#: somewhere; elsewhere it is part of a name or of an unquoted value, which end at white space or at the tag's end.
_ATTRIBUTES = r"""(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?>"[^"]*"|'[^']*'|[^\s>]*+))?+)*+"""
_PIECE = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<({_RAW})(?=[\s/>]){_ATTRIBUTES}(?:(?<=/)>|>.*?(?:</\1(?=[\s/>]){_ATTRIBUTES}>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})>|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z)|</?[a-zA-Z][^>]*\Z",
    re.S | re.I,
)
_NAMES = re.compile(r"""(?<![^\s/"'])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPACE = re.compile(r"\s+")

Path = tuple[str, ...]


def _hidden(page: str) -> dict[int, int]:
    """Where each hidden element starts and ends: an end tag belongs to the last open element of the same name."""
    ends: dict[int, int] = {}
    if _ANY_HIDDEN.search(page):
        opened: dict[str, list[int]] = {name: [] for name in _HIDDEN}
        for m in _PIECE.finditer(page):
            if m[3] and (tag := m[3].lower()) in _HIDDEN:
                if not m[2] and not m[4].endswith("/"):
                    opened[tag].append(m.start())
                elif m[2] and opened[tag]:
                    ends[opened[tag].pop()] = m.end()
    return ends


def blocks(page: str) -> list[tuple[str, Path, float]]:
    """(text, path, share of characters in links) of each block with text, in page order. A path holds tag names, and class, id and role names behind a dot."""
    out: list[tuple[str, Path, float]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    linked = 0
    in_link = 0
    path: Path | None = ()

    def close() -> None:
        nonlocal linked
        if held:
            text = _SPACE.sub(" ", "".join(held)).strip()
            if text:
                out.append((text, tuple(n for _, names in stack for n in names), min(1.0, linked / max(1, sum(map(len, held))))))
            held.clear()
        linked = 0

    def hold(text: str) -> None:
        nonlocal linked
        # Each text is decoded by itself: a reference never goes on behind a tag.
        held.append(text := unescape(text) if "&" in text else text)
        linked += len(text) * (in_link > 0)

    last = 0
    hidden = _hidden(page)
    for m in _PIECE.finditer(page):
        if m.start() < last:
            continue
        if m.start() > last:
            hold(page[last : m.start()])
        last = hidden.get(m.start(), m.end())
        tag = m[3]
        if not tag or m.start() in hidden:
            continue
        tag = tag.lower()
        if tag == "br":
            held.append(" ")
            continue
        if tag in BLOCK_TAGS:
            close()
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if stack[k][0] in _FENCES and tag not in BLOCK_TAGS:
                    break
            in_link = sum(t == "a" for t, _ in stack)
            continue
        if tag in BLOCK_TAGS:
            ends = _CLOSES.get(tag, frozenset()) | {"p"}
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends:
                    del stack[k:]
                    break
                if stack[k][0] in _FENCES:
                    break
            in_link = sum(t == "a" for t, _ in stack)
        if tag not in VOID_TAGS and not m[4].endswith("/"):
            names = [tag]
            if m[4]:
                for found in _NAMES.findall(m[4]):
                    names += ["." + n for n in "".join(found).lower().split()]
            stack.append((tag, tuple(names)))
            in_link += tag == "a"
    if last < len(page):
        hold(page[last:])
    close()
    return out
