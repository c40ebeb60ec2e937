"""A small tree of the block elements of a web page, for wrapper induction.

Time is linear in the page, also on broken markup: a tag that is never closed is text, and so is what its search for an end
went over. Elements nested deeper than MAX_DEPTH are kept as runs of text of their innermost element, in page order.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# Element names of HTML by their role.
RAW = frozenset("script style textarea title xmp iframe noembed noframes template".split())
BLOCK = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption"
    " nav header footer aside form fieldset address details summary dialog hr center noscript menu head search".split()
)
BOILER = frozenset("nav header footer aside form head noscript dialog menu search fieldset".split())
DROPPED = frozenset("button select option optgroup input label svg object audio video canvas map".split())
CLOSES_P = BLOCK - {"html", "body", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = frozenset("ul ol dl table html body".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
MARKS = frozenset(
    "nav navbar navigation menu header masthead footer foot sidebar aside ad ads adv advert advertisement adverts banner cookie cookies consent gdpr"
    " notice notices alert promo promotion sponsor sponsored comment comments reply replies respond disqus share sharing social related recommended"
    " breadcrumb breadcrumbs newsletter subscribe subscription signup login popup modal overlay pagination pager search widget toolbar copyright".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Class words after these say what an element has, not what it is.
HAVING = frozenset("has have with no not without is".split())
#: An element marked by its class words only is no boilerplate if it holds more than this share of the page's text.
OVERRULED = 0.5
#: Depth of the tree; deeper elements become runs of text.
MAX_DEPTH = 200
REACH = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+", re.S)


@dataclass(slots=True)
class Element:
    """`items`: texts (text, whether it is in a link) and children, in page order. `label`: tag and its class words.

    `boiler`: to be left out; `marked`: only because of its class words or id.
    """

    tag: str
    label: str
    boiler: bool
    marked: bool = False
    items: list = field(default_factory=list)


def _words(value: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", value)]


def _element(tag: str, attributes: str, inside_article: bool) -> Element:
    classes: list[str] = []
    marked = False
    boiler = tag in BOILER and not (tag == "header" and inside_article)
    if attributes:
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id"):
                words = _words(value)
                marked = marked or (tag not in ("html", "body", "main", "article") and any(_marks(w, inside_article) for w in value.split()))
                classes += words if name == "class" else []
            elif name == "role":
                boiler = boiler or value.lower() in ROLES
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
                boiler = True
    return Element(tag, ".".join([tag, *sorted(set(classes))]), boiler or marked, marked and not boiler)


def _marks(name: str, inside_article: bool) -> bool:
    """Whether a class or id has a word of MARKS that says what the element is. The header of an article holds its headline."""
    words = _words(name)
    return any(w in MARKS and not (inside_article and w == "header") and (k == 0 or words[k - 1] not in HAVING) for k, w in enumerate(words))


def _overrule(root: Element) -> None:
    """Marked elements with most of the page's text are content."""
    order = [root]
    for e in order:
        order += [i for i in e.items if isinstance(i, Element)]
    mass: dict[int, int] = {}
    for e in reversed(order):
        mass[id(e)] = sum(mass[id(i)] if isinstance(i, Element) else len(i[0]) * (not i[1]) for i in e.items)
    for e in order:
        if e.marked and mass[id(e)] > OVERRULED * mass[id(root)]:
            e.boiler = e.marked = False


class _Open:
    """The open elements, innermost last. Below MAX_DEPTH, texts become elements of the deepest one kept."""

    def __init__(self, root: Element):
        self.stack, self.count = [root], Counter([root.tag])
        self.low_boiler = self.low_firm = 0

    def push(self, made: Element) -> None:
        if len(self.stack) < MAX_DEPTH:
            self.stack[-1].items.append(made)
        else:
            self.low_boiler += made.boiler
            self.low_firm += made.boiler and not made.marked
        self.stack.append(made)
        self.count[made.tag] += 1

    def pop(self) -> str:
        gone = self.stack.pop()
        self.count[gone.tag] -= 1
        if len(self.stack) >= MAX_DEPTH:
            self.low_boiler -= gone.boiler
            self.low_firm -= gone.boiler and not gone.marked
        return gone.tag

    def take(self, item: tuple[str, bool]) -> None:
        if len(self.stack) <= MAX_DEPTH:
            self.stack[-1].items.append(item)
        else:
            low = self.stack[-1]
            self.stack[MAX_DEPTH - 1].items.append(Element(low.tag, low.label, self.low_boiler > 0, self.low_boiler > 0 and not self.low_firm, [item]))

    def end(self, tag: str) -> None:
        if self.count[tag]:
            while self.pop() != tag:
                pass

    def close(self, tags: set[str] | frozenset[str]) -> None:
        """Ends the innermost open element of `tags`, unless a list, table or boiler element is opened inside it."""
        if not any(self.count[t] for t in tags):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            e = self.stack[k]
            if e.tag in tags:
                while len(self.stack) > k:
                    self.pop()
                return
            if e.tag in SCOPES or e.tag in ("div", "section", "article", "main", "blockquote") or e.boiler:
                return


def parse(page: str | None) -> Element:
    """The tree of block elements. Inline elements are part of the text around them; scripts and the like are left out."""
    root = Element("#page", "#page", False)
    opened, text, links, dropped, at = _Open(root), [], 0, 0, 0
    page = page or ""

    def flush() -> None:
        if text:
            raw = "".join(t for t, _ in text)
            if "&" in raw:  # &amp; apart, as it is frequent
                raw = "&".join(map(html.unescape, raw.split("&amp;")))
            if clean := " ".join(raw.split()):
                linked = sum(len(t) for t, link in text if link)
                item = (clean, 2 * linked > sum(len(t) for t, _ in text))
                opened.take(item)
            text.clear()

    while at < len(page):
        start, m = at, None
        while m is None and (start := page.find("<", start)) >= 0:
            m = TAG.match(page, start)
            if m is None:  # no end of a tag from here; a start before the place the search came to finds none either
                start = max(start + 1, REACH.match(page, start + 1).end() if page[start + 1 : start + 2].isalpha() or page[start + 1 : start + 2] == "/" else 0)
        if m is None:
            break
        if m.start() > at and not dropped:
            text.append((page[at : m.start()], links > 0))
        at = m.end()
        tag = m[2] and m[2].lower()
        if not tag:
            continue
        if not m[1]:
            if tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at) if page.find(">", at) >= 0 else None
                at = end.end() if end else len(page)
            elif tag in DROPPED:
                dropped += tag not in ("input",)
            elif tag == "a":
                links += 1
            elif tag in ("br", "wbr", "img"):
                text.append((" ", links > 0))
            elif tag in BLOCK:
                flush()
                links = dropped = 0
                if tag in CLOSES_P:
                    opened.close({"p"})
                if tag in HEADINGS:
                    opened.close(HEADINGS)
                if tag in ENDS:
                    opened.close(ENDS[tag])
                if tag != "hr":
                    opened.push(_element(tag, m[3], opened.count["article"] + opened.count["main"] > 0))
        elif tag in DROPPED:
            dropped = max(0, dropped - 1)
        elif tag == "a":
            links = max(0, links - 1)
        elif tag in BLOCK:
            flush()
            links = dropped = 0
            opened.end(tag)
    if at < len(page) and not dropped:
        text.append((page[at:], links > 0))
    flush()
    _overrule(root)
    return root
