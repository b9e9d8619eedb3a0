"""Reading HTML: tags, an element tree with implied ends, text with its block breaks."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import xxhash

#: Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol "
    "optgroup option p pre section select summary table tbody tfoot thead tr ul".split())
CELLS = frozenset(("td", "th"))
BOXES = frozenset("html body div section main article center table tbody tr td".split())
CLOSES_P = BLOCK - frozenset("body caption dd dt html li optgroup option tbody tfoot thead tr".split())

#: What an element of these names holds is never main text.
OUTSIDE = frozenset(
    "head nav footer aside form button select option input textarea label fieldset dialog menu "
    "script style noscript template iframe svg math object embed canvas audio video title".split())
#: Words in a class or id, and values of role, that mean the same.
OUTSIDE_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promotion "
    "banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup login sidebar aside menu nav navbar navigation breadcrumb "
    "breadcrumbs footer masthead topbar toolbar comment comments reply replies disqus share sharing "
    "social related recommended widget pagination pager skip hidden".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog "
                          "alertdialog alert menu menubar toolbar".split())
COMMENT_WORDS = frozenset("comment comments reply replies disqus".split())
#: Elements and roles that hold the main text where a page has them.
LANDMARKS = frozenset(("article", "main"))

TEXT, BREAK, SPACE = 0, 1, 2

_TAG = re.compile(
    r"<(?:!--(?:.*?-->|.*\Z)|[!?][^>]*+(?:>|\Z)|(/?)([A-Za-z][^\s/>]*+)"
    r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z))", re.DOTALL)
_ATTRIBUTE = re.compile(
    r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?",
    re.IGNORECASE)
_NAMED = re.compile(r"class|id|role|hidden|style", re.IGNORECASE)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_STATE = re.compile(r"(?:^|[-_])(?:has|with|no|without|is)[-_]|[-_](?:open|opened|closed|enabled|disabled)$")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.IGNORECASE) for name in RAW}
# What a start tag ends if it is open, and the elements beyond which it does not look.
_IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")), "option": (("option",), ("select",)),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead"), ("table",)),
    "body": (("head",), ("html",)),
}


@dataclass
class Page:
    """Elements in page order and what stands in them.

    Of each element: hash of its path, number of its parent, whether it is outside the main
    text, a landmark, in a link, a box that holds other elements. ``items`` are ``(kind, element, text)`` in page order.
    """
    path: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    outside: list[bool] = field(default_factory=list)
    landmark: list[bool] = field(default_factory=list)
    link: list[bool] = field(default_factory=list)
    box: list[bool] = field(default_factory=list)
    items: list[tuple[int, int, str]] = field(default_factory=list)


class Reader:
    """Reads pages within a task; paths of elements are hashed once while there is room."""

    def __init__(self):
        self._paths: dict[tuple[int, str], int] = {}
        self._kinds: dict[tuple[str, str], tuple[str, bool, bool, bool]] = {}

    def _kind(self, tag: str, attributes: str) -> tuple[str, bool, bool, bool]:
        """Name in paths; outside the main text; landmark; a header (outside but in a landmark)."""
        key = (tag, attributes) if _NAMED.search(attributes) else (tag, "")
        found = self._kinds.get(key)
        if found is None:
            found = self._judge(*key)
            if len(self._kinds) > 50_000:
                self._kinds.clear()
            if len(attributes) < 500:
                self._kinds[key] = found
        return found

    @staticmethod
    def _judge(tag: str, attributes: str) -> tuple[str, bool, bool, bool]:
        outside, landmark, header, names = tag in OUTSIDE, tag in LANDMARKS, tag == "header", []
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
            if name in ("class", "id"):
                for token in value.split():
                    names.append(("#" if name == "id" else ".") + re.sub(r"\d{3,}", "0", token))
                    if _STATE.search(token.lower()):
                        continue
                    words = {w.lower() for w in _WORDS.findall(token)}
                    if tag in ("html", "body", "main"):
                        continue
                    outside |= bool(words & (COMMENT_WORDS if tag == "article" else OUTSIDE_WORDS))
                    header |= "header" in words
            elif name == "role":
                outside |= value.lower() in OUTSIDE_ROLES
                landmark |= value.lower() in LANDMARKS
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                outside |= tag not in ("html", "body")
            elif name == "style":
                outside |= bool(_INVISIBLE.search(value))
        return "".join([tag, *sorted(set(names))]), outside, landmark and not outside, header

    def _path(self, above: int, name: str) -> int:
        found = self._paths.get((above, name))
        if found is None:
            found = xxhash.xxh64_intdigest(f"{above}/{name}".encode("utf-8", "surrogatepass")) >> 1
            if len(self._paths) > 200_000:
                self._paths.clear()
            self._paths[above, name] = found
        return found

    def read(self, source: str) -> Page:
        page, items = Page([0], [-1], [False], [False], [False], [True]), []
        page.items = items
        stack: list[tuple[str, int]] = [("", 0)]
        opened: Counter = Counter()
        within = [False]  # in a landmark
        at, n = 0, len(source)

        def pop():
            tag, _ = stack.pop()
            opened[tag] -= 1
            within.pop()
            if tag in BLOCK:
                items.append((BREAK, stack[-1][1], ""))
            elif tag in CELLS:
                items.append((SPACE, stack[-1][1], ""))

        def close(names, barrier=()):
            """Close the nearest open element of ``names`` and what is open in it."""
            if not any(opened[name] > 0 for name in names):
                return
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in names:
                    while len(stack) > i:
                        pop()
                    return
                if stack[i][0] in barrier:
                    return

        def push(tag, attributes, pushed=True):
            name, outside, landmark, header = self._kind(tag, attributes)
            above = stack[-1][1]
            number = len(page.path)
            page.path.append(self._path(page.path[above], name))
            page.parent.append(above)
            page.outside.append(page.outside[above] or outside or header and not within[-1])
            page.landmark.append(landmark)
            page.link.append(page.link[above] or tag == "a")
            page.box.append(tag in BOXES)
            if tag in BLOCK:
                items.append((BREAK, above, ""))
            elif tag in CELLS or tag == "br":
                items.append((SPACE, above, ""))
            if pushed:
                stack.append((tag, number))
                opened[tag] += 1
                within.append(within[-1] or landmark)
            return number

        while at < n:
            m = _TAG.search(source, at)
            if m is None:
                items.append((TEXT, stack[-1][1], source[at:]))
                break
            if m.start() > at:
                items.append((TEXT, stack[-1][1], source[at:m.start()]))
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag in BLOCK or tag in CELLS:
                    close((tag,), () if tag == "table" else ("table",))
                else:
                    close((tag,), BLOCK | CELLS)
                continue
            if tag in ("html", "body") and opened[tag]:
                continue
            if tag in CLOSES_P:
                close(("p",), ("table", "td", "th", "button", "caption"))
            if tag in _IMPLIED:
                close(*_IMPLIED[tag])
            if tag in VOID:
                push(tag, m[3], pushed=False)
            elif tag in RAW:
                number = push(tag, m[3], pushed=False)
                end = _ENDS[tag].search(source, at)
                stop = end.start() if end else n
                items.append((TEXT, number, source[at:stop]))
                at = stop if end is None else source.find(">", stop) + 1 or n
            else:
                push(tag, m[3])
        return page


def plain(text: str) -> str:
    return html.unescape(text) if "&" in text else text


def blocks(items) -> str:
    """Blocks of ``(kind, text)`` joined by line ends, white space in them made one space."""
    out, part = [], []
    for kind, text in items:
        if kind == TEXT:
            part.append(plain(text))
        elif kind == SPACE:
            part.append(" ")
        elif part:
            out.append(" ".join("".join(part).split()))
            part = []
    if part:
        out.append(" ".join("".join(part).split()))
    return "\n".join(b for b in out if b)
