"""A small tolerant reader of HTML: block elements as nodes, runs of inline text as segments."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)>",
    re.S,
)
NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
LABEL = re.compile(r"data-label=([01])")
WORD = re.compile(r"[a-z]+")
RAW = {t: re.compile(rf"</{t}\b[^>]*>|\Z", re.I) for t in ("script", "style", "title", "textarea", "iframe", "noscript", "noembed", "xmp", "template", "svg")}
SHOWN_RAW = frozenset(["title", "textarea", "xmp"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
# a start tag of the key ends an open element of the values, unless one of the bounds stands between
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
BOUNDS = frozenset("ul ol dl table select html body article section div".split())


@dataclass
class Page:
    """Nodes in page order; node 0 is the page. Segments are (node, text, length of its links)."""

    tags: list[str] = field(default_factory=lambda: ["#page"])
    parents: list[int] = field(default_factory=lambda: [-1])
    names: list[list[str]] = field(default_factory=lambda: [[]])
    labels: list[int | None] = field(default_factory=lambda: [None])
    inline: list[int] = field(default_factory=lambda: [0])
    segments: list[tuple[int, str, int]] = field(default_factory=list)


def _names(rest: str) -> list[str]:
    if "=" not in rest:
        return []
    spaced = re.sub(r"([a-z])([A-Z])", r"\1 \2", " ".join(a or b or c for a, b, c in NAMES.findall(rest)))
    return WORD.findall(spaced.lower())


def read(source: str) -> Page:
    """Parse a page; unknown, unclosed and misplaced tags never fail."""
    page, stack, links = Page(), [0], 0
    parts: list[str] = []
    linked: list[str] = []

    def text(piece: str) -> None:
        parts.append(piece)
        if links:
            linked.append(piece)

    def close_segment() -> None:
        if parts:
            words = " ".join(html.unescape("".join(parts)).split())
            if words:
                page.segments.append((stack[-1], words, min(len(words), len(" ".join(html.unescape("".join(linked)).split())))))
            parts.clear()
            linked.clear()

    def pop_to(depth: int) -> None:
        nonlocal links
        close_segment()
        del stack[depth:]
        links = 0

    at = 0
    while True:
        found = TOKEN.search(source, at)
        if found is None:
            text(source[at:])
            break
        if found.start() > at:
            text(source[at : found.start()])
        at = found.end()
        tag = (found["tag"] or found["tag2"] or "").lower()
        if not tag:
            continue
        if found["end"] or found["end2"]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag not in INLINE:
                depth = next((d for d in range(len(stack) - 1, 0, -1) if page.tags[stack[d]] == tag), 0)
                if depth:
                    pop_to(depth)
                else:
                    close_segment()
            continue
        rest = found["rest"] or found["rest2"] or ""
        if tag in INLINE:
            page.inline[stack[-1]] += 1
            if tag == "a":
                links += 1
            elif tag == "br":
                text(" ")
            continue
        if tag in ENDS_P and page.tags[stack[-1]] == "p":
            pop_to(len(stack) - 1)
        for closed in CLOSES.get(tag, ()):
            for d in range(len(stack) - 1, 0, -1):
                if page.tags[stack[d]] == closed:
                    pop_to(d)
                    break
                if page.tags[stack[d]] in BOUNDS:
                    break
        close_segment()
        if tag in VOID:
            continue
        page.tags.append(tag)
        page.parents.append(stack[-1])
        page.names.append(_names(rest))
        page.inline.append(0)
        label = LABEL.search(rest)
        page.labels.append(int(label[1]) if label else None)
        if rest.endswith("/") and tag not in RAW:
            continue
        stack.append(len(page.tags) - 1)
        if tag in RAW:
            end = RAW[tag].search(source, at)
            if tag in SHOWN_RAW:
                text(source[at : end.start()])
            at = end.end()
            pop_to(len(stack) - 1)
    close_segment()
    return page
