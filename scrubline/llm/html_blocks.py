"""Leaf blocks of an HTML page, with the tags and hints they stand under."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html import unescape

# fixed values: element groups of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template iframe noembed noframes xmp svg math select button object".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section"
    " summary table tbody td tfoot th thead tr ul".split()
)
# an opening tag that ends open elements of these kinds, up to the nearest of the others
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
    "body": (("head",), ()),
}
# fixed values: words of class, id and role attributes that tell what a part is for
HINTS = {
    "ad": "ad ads advert advertisement adverts adsense banner promo promotion sponsor sponsored dfp".split(),
    "comment": "comment comments commentlist reply replies respond disqus discussion reviews".split(),
    "content": "content article post entry story body text main maincontent articlebody".split(),
    "footer": "footer foot copyright colophon bottom contentinfo".split(),
    "form": "form login signup subscribe newsletter search contact".split(),
    "header": "header masthead head branding logo topbar top".split(),
    "menu": "nav navigation menu navbar breadcrumb breadcrumbs toc pagination pager tabs links".split(),
    "notice": "cookie cookies consent notice gdpr alert privacy popup modal overlay disclaimer".split(),
    "sidebar": "sidebar side aside widget widgets rail complementary".split(),
    "social": "share sharing social related recommended trending popular tags meta byline author".split(),
}
HINT_OF = {w: hint for hint, listed in HINTS.items() for w in listed}

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.DOTALL,
)
# what needs no > to its end
OPEN = re.compile(r"<!--.*|<[!?][^>]*", re.DOTALL)
HINT = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in RAW}


@dataclass
class Block:
    text: str
    tag: str
    ancestors: tuple[str, ...]
    hints: tuple[str, ...]
    link_chars: int


def hints_of(attributes: str) -> set[str]:
    found = set()
    for m in HINT.finditer(attributes):
        for word in PIECE.findall(m[1] or m[2] or m[3] or ""):
            if hint := HINT_OF.get(word.lower()):
                found.add(hint)
    return found


def blocks(html: str) -> list[Block]:
    """The runs of text between block-level tags, in page order, without empty ones.

    Character references are decoded and white space inside a block is one space. Scripts, styles,
    comments and form controls are skipped. Missing end tags are implied as in browsers.
    """
    stack: list[tuple[str, set[str]]] = []
    tags: Counter = Counter()
    hints: Counter = Counter()
    out: list[Block] = []
    pieces: list[str] = []
    links = 0

    def pop() -> None:
        tag, own = stack.pop()
        tags[tag] -= 1
        for h in own:
            hints[h] -= 1

    def flush() -> None:
        nonlocal links
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            block = next((t for t, _ in reversed(stack) if t in BLOCK), "")
            out.append(Block(text, block, tuple(t for t, n in tags.items() if n > 0), tuple(h for h, n in hints.items() if n > 0), links))
        links = 0

    def close(tag: str) -> None:
        while stack[-1][0] != tag:
            pop()
        pop()

    at, end = 0, len(html)
    # no tag ends beyond the last >, so none is looked for there; a page of tags that never end is read once
    last = html.rfind(">") + 1
    while at < end:
        m = TOKEN.search(html, at, last) if at < last else None
        m = m or OPEN.search(html, max(at, last - 1))
        piece = html[at : m.start()] if m else html[at:]
        if piece:
            piece = unescape(piece)
            pieces.append(piece)
            if tags["a"] > 0:
                links += len(piece)
        if not m:
            break
        at = m.end()
        if m.re is OPEN or m[0].startswith("<!--") and not m[0].endswith("-->"):
            # a comment that never ends hides the rest
            at = end if m[0].startswith("<!--") else at
            continue
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag in BLOCK:
                flush()
            if tags[tag] > 0:
                close(tag)
            continue
        attributes = m[3] if m[2] else m[6]
        if tag in RAW:
            if not attributes.endswith("/") or tag not in ("svg", "math"):
                stop = RAW_END[tag].search(html, at)
                at = html.find(">", stop.end()) + 1 or end if stop else end
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if tags["p"] > 0 and tag not in ("option", "optgroup"):
                close("p")
            if tag in IMPLIED:
                ended, until = IMPLIED[tag]
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in until:
                        break
                    if stack[i][0] in ended:
                        while len(stack) > i:
                            pop()
        if tag in VOID:
            continue
        own = hints_of(attributes) if attributes else set()
        stack.append((tag, own))
        tags[tag] += 1
        for h in own:
            hints[h] += 1
    flush()
    return out
