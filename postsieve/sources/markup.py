"""An HTML page as intervals: every element covers a range of the page's texts and of its elements.

One pass with a stack numbers the elements in document order. The descendants of an element are then the numbers behind
it up to its last one, its text is a slice of the page's texts, and its card is handed down from its parent, so that
questions about what stands near a link need no walk over the page.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from html.parser import HTMLParser

# Rules of HTML.
CARDS = frozenset(("article", "li", "div", "tr"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not part of the text around them.
SILENT = frozenset(("script", "style", "template", "rt", "rp"))
#: Open elements that a start tag ends, as long as they are the innermost ones.
ENDED_BY = {
    "a": ("a",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "option": ("option",),
    "optgroup": ("option", "optgroup"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "tr": ("td", "th", "tr", "p"),
    **{part: ("td", "th", "tr", "thead", "tbody", "tfoot", "p") for part in ("thead", "tbody", "tfoot")},
    **{block: ("p",) for block in ("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main "
                                   "nav ol p pre section table ul").split()},
}
#: An end tag does not reach past an open element of a higher number; all others have 0.
WIDTH = {"div": 1, "td": 2, "th": 2, "tr": 3, "thead": 4, "tbody": 4, "tfoot": 4, "table": 5, "body": 6, "html": 7}


@dataclass(frozen=True)
class Compound:
    """What one element must be: ``tag#id.class[attribute=value]`` in any part."""

    tag: str
    ids: tuple[str, ...]
    classes: tuple[str, ...]
    attributes: tuple[tuple[str, str | None], ...]

    def fits(self, name: str, attributes: dict[str, str]) -> bool:
        if self.tag not in ("", "*", name) or any(attributes.get("id") != i for i in self.ids):
            return False
        if self.classes and not set(self.classes) <= set(attributes.get("class", "").split()):
            return False
        return all(k in attributes and v in (None, attributes[k]) for k, v in self.attributes)


_COMPOUND = re.compile(r"(\*|[A-Za-z][\w-]*)?((?:#[\w-]+|\.[\w-]+|\[\s*[\w-]+\s*(?:=\s*(?:\"[^\"]*\"|'[^']*'|[\w-]+)\s*)?\])*)")
_PART = re.compile(r"#([\w-]+)|\.([\w-]+)|\[\s*([\w-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([\w-]+))\s*)?\]")


def selector(text: str) -> list[list[tuple[str, Compound]]]:
    """Alternatives (split by commas) of compounds, the last one first, each with what ties it to the one before it:
    a space for any ancestor, ``>`` for the parent. Other selectors are refused."""
    found = []
    for alternative in re.split(r",(?![^\[]*\])", text):
        parts, at, tie = [], 0, ""
        alternative = alternative.strip()
        while at < len(alternative):
            m = _COMPOUND.match(alternative, at)
            if m.end() == at:
                raise ValueError(f"selector {text!r} is not of a known kind")
            ids, classes, attributes = [], [], []
            for i, c, k, *values in _PART.findall(m[2]):
                if k:
                    attributes.append((k.lower(), next((v for v in values if v), None)))
                else:
                    (ids if i else classes).append(i or c)
            parts.append((tie, Compound((m[1] or "").lower(), tuple(ids), tuple(classes), tuple(attributes))))
            gap = re.compile(r"\s*(>)\s*|\s+").match(alternative, m.end())
            at, tie = (gap.end(), gap[1] or " ") if gap else (m.end(), "")
            if not gap and at < len(alternative) or gap and at == len(alternative):
                raise ValueError(f"selector {text!r} is not of a known kind")
        if not parts:
            raise ValueError(f"selector {text!r} is empty")
        found.append(parts[::-1])
    return found


class Page(HTMLParser):
    """Element 0 stands for the page itself. ``last`` is an element's last descendant (itself without any); its texts
    are those from ``first`` up to ``end``."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.names, self.attributes, self.parents, self.cards = ["body"], [{}], [0], [-1]
        self.first, self.end, self.last = [0], [0], [0]
        self.texts: list[str] = []
        self._open, self._count, self._silent, self._held = [0], {}, 0, []
        self.feed(html)
        self.close()
        self._flush()
        while self._open:
            self._pop()

    def _flush(self) -> None:
        if self._held:
            if not self._silent and (text := "".join(self._held).strip()):
                self.texts.append(text)
            self._held = []

    def _pop(self) -> None:
        self._flush()
        e = self._open.pop()
        name = self.names[e]
        self._count[name] = self._count.get(name, 0) - 1
        self._silent -= name in SILENT
        self.end[e], self.last[e] = len(self.texts), len(self.names) - 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._flush()
        ended = ENDED_BY.get(tag, ())
        while self.names[self._open[-1]] in ended:
            self._pop()
        parent, e = self._open[-1], len(self.names)
        self.names.append(tag)
        own: dict[str, str] = {}
        for name, value in attrs:
            own.setdefault(name, value or "")
        self.attributes.append(own)
        self.parents.append(parent)
        # the nearest card around an element's content; an element's own card is that of its parent
        self.cards.append(e if tag in CARDS else self.cards[parent])
        self.first.append(len(self.texts))
        self.end.append(len(self.texts))
        self.last.append(e)
        if tag not in VOID:
            self._open.append(e)
            self._count[tag] = self._count.get(tag, 0) + 1
            self._silent += tag in SILENT

    def handle_endtag(self, tag: str) -> None:
        if self._count.get(tag, 0) < 1:
            return
        width = WIDTH.get(tag, 0)
        for depth in range(len(self._open) - 1, 0, -1):
            name = self.names[self._open[depth]]
            if name == tag:
                while len(self._open) > depth:
                    self._pop()
                return
            if WIDTH.get(name, 0) > width:
                return

    def handle_data(self, data: str) -> None:
        self._held.append(data)

    def handle_comment(self, data: str) -> None:
        self._flush()

    def text(self, e: int, most: int | None = None) -> str:
        """An element's text, or so many characters of it without reading the rest."""
        if most is None:
            return " ".join(self.texts[self.first[e]:self.end[e]])
        used, end = 0, self.first[e]
        while end < self.end[e] and used <= most:
            used, end = used + len(self.texts[end]) + 1, end + 1
        return " ".join(self.texts[self.first[e]:end])[:most]

    def fitting(self, chosen: list[list[tuple[str, Compound]]]) -> list[int]:
        """The elements that a selector takes, in document order."""
        return [e for e in range(1, len(self.names)) if any(self._fits(e, parts, 0) for parts in chosen)]

    def _fits(self, e: int, parts: list[tuple[str, Compound]], at: int) -> bool:
        tie, compound = parts[at]
        if not compound.fits(self.names[e], self.attributes[e]):
            return False
        if not tie:
            return True
        above = self.parents[e]
        while above:
            if self._fits(above, parts, at + 1):
                return True
            if tie == ">":
                return False
            above = self.parents[above]
        return False

    def within(self, e: int, found: list[int]) -> int | None:
        """The first of some elements, in order, that is a descendant."""
        at = bisect_right(found, e)
        return found[at] if at < len(found) and found[at] <= self.last[e] else None


class Hits:
    """Where a pattern is found in a page's text, asked for any element without reading its text again."""

    def __init__(self, page: Page, pattern: re.Pattern[str]):
        self._page, self._pattern = page, pattern
        starts, at = [], 0
        for text in page.texts:
            starts.append(at)
            at += len(text) + 1
        self._starts = [*starts, at]
        self._line = " ".join(page.texts)
        spans = [m.span() for m in pattern.finditer(self._line)]
        self._from, self._to = [s for s, _ in spans], [e for _, e in spans]

    def inside(self, e: int) -> bool:
        """Whether the element's text holds a match. Any match in it begins in one of the whole line's matches; where
        such a match stands over the element's border, the element's text is searched itself."""
        first, end = self._page.first[e], self._page.end[e]
        if first == end:
            return False
        low, high = self._starts[first], self._starts[end] - 1
        at = bisect_right(self._to, low)
        beyond = bisect_left(self._from, high)
        if at >= beyond:
            return False
        if any(self._from[k] >= low and self._to[k] <= high for k in {at, at + 1, beyond - 1} if at <= k < beyond):
            return True
        return self._pattern.search(self._line[low:high]) is not None
