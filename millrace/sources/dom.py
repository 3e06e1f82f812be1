"""A parsed page as flat arrays in document order.

Every element and every string is one item; an element's items end where ``end`` says. Sums over
the items before each one make counts, lengths and texts of a subtree differences of two entries,
so nothing walks a subtree for them and nothing recurses, however deep the tags are nested.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("p div section article li tr h1 h2 h3 h4 h5 h6 blockquote pre ul ol table main body".split())
#: Strings below these are no text when lengths are compared.
QUIET = ("script", "style", "template")
#: Elements open at once, as in browsers; deeper ones hold nothing, and their text belongs to the one above.
DEEPEST = 512
#: Elements of a tag open at once where a page gives the text of each one, so that what it gives stays within so many times its size.
DEEPEST_OF = dict.fromkeys("p h1 h2 h3 h4 h5 h6 li ul ol blockquote pre a".split(), 32) | dict.fromkeys("table tr td th".split(), 4)


class Node:
    """An element of a page."""

    __slots__ = ("at", "page")

    def __init__(self, page: Page, at: int):
        self.page, self.at = page, at

    def __eq__(self, other) -> bool:
        return isinstance(other, Node) and self.at == other.at and self.page is other.page

    def __hash__(self) -> int:
        return hash(self.at)

    @property
    def tag(self) -> str:
        return self.page.tags[self.at]

    @property
    def attrs(self) -> dict[str, str]:
        return self.page.held[self.at]

    @property
    def end(self) -> int:
        return self.page.end[self.at]

    @property
    def parent(self) -> Node | None:
        return Node(self.page, self.page.parent[self.at]) if self.at else None

    @property
    def children(self) -> list[Node | str]:
        out, j, page = [], self.at + 1, self.page
        while j < self.end:
            out.append(page.held[j] if page.tags[j] is None else Node(page, j))
            j = page.end[j]
        return out

    def walk(self) -> Iterator[Node]:
        """Elements below, in document order."""
        tags = self.page.tags
        return (Node(self.page, j) for j in range(self.at + 1, self.end) if tags[j] is not None)

    def all(self, *tags: str) -> list[Node]:
        """Elements below with one of some tags, in document order."""
        page, found = self.page, []
        for t in tags:
            own = page.by_tag.get(t, ())
            found += own[bisect_left(own, self.at + 1) : bisect_left(own, self.end)]
        return [Node(page, j) for j in (sorted(found) if len(tags) > 1 else found)]

    def first(self, *tags: str) -> Node | None:
        page, best = self.page, self.end
        for t in tags:
            own = page.by_tag.get(t, ())
            k = bisect_left(own, self.at + 1)
            if k < len(own):
                best = min(best, own[k])
        return Node(page, best) if best < self.end else None

    def count(self, tag: str) -> int:
        own = self.page.by_tag.get(tag, ())
        return bisect_left(own, self.end) - bisect_left(own, self.at + 1)

    def span(self) -> tuple[int, int]:
        """The page's pieces of text that stand below."""
        return self.page.pieces_before[self.at], self.page.pieces_before[self.end]

    def text(self, skip: frozenset = frozenset(), stop: Node | None = None) -> str:
        """Text below, a space between pieces; nothing of skipped tags, and nothing from a stop node on."""
        page = self.page
        if not skip and stop is None:
            lo, hi = self.span()
            return page.whole[page.starts[lo] : page.stops[hi - 1]] if hi > lo else ""
        tags, end, pieces, out = page.tags, page.end, page.pieces, []
        before, j, last = page.pieces_before, self.at + 1, stop.at if stop is not None else -1
        while j < self.end:
            if tags[j] is None:
                out += pieces[before[j] : before[j + 1]]
            elif j == last:
                break
            elif tags[j] in skip:
                j = end[j]
                continue
            j += 1
        return " ".join(out)

    def text_length(self) -> int:
        """Characters of text(), without building it."""
        lo, hi = self.span()
        return self.page.stops[hi - 1] - self.page.starts[lo] if hi > lo else 0

    def raw(self) -> str:
        """All strings below as they stand."""
        page = self.page
        return "".join([page.held[j] for j in range(self.at + 1, self.end) if page.tags[j] is None])

    def length(self) -> int:
        """Characters of the strings below as they stand, a space between them, without those at the ends; scripts and styles have none."""
        page = self.page
        lo, hi = page.loud_before[self.at], page.loud_before[self.end]
        return page.loud_stops[hi - 1] - page.loud_starts[lo] if hi > lo else 0

    def link_length(self) -> int:
        """length() of all links below."""
        sums, own = self.page.link_sums, self.page.by_tag.get("a", ())
        return sums[bisect_left(own, self.end)] - sums[bisect_left(own, self.at + 1)]

    def has_block(self) -> bool:
        return self.page.blocks_before[self.end] > self.page.blocks_before[self.at + 1]


class Page:
    """Items of a page: ``tags`` (None for a string), ``held`` (attributes, or the string), ``parent`` and ``end`` of each."""

    def __init__(self, html: str):
        self.tags: list[str | None] = ["#root"]
        self.held: list[dict[str, str] | str] = [{}]
        self.parent, self.end = [-1], [0]
        reader = _Reader(self)
        reader.feed(html)
        reader.close()
        for j in reader.open:
            self.end[j] = len(self.tags)
        self._sum()

    def add(self, tag: str | None, held, parent: int) -> int:
        at = len(self.tags)
        self.tags.append(tag)
        self.held.append(held)
        self.parent.append(parent)
        self.end.append(at + 1)
        return at

    def _sum(self) -> None:
        tags, held, end = self.tags, self.held, self.end
        self.by_tag: dict[str, list[int]] = {}
        self.pieces: list[str] = []
        self.starts, self.stops, self.loud_starts, self.loud_stops = [], [], [], []
        self.pieces_before, self.loud_before, self.blocks_before = [], [], []
        place = loud = blocks = quiet = 0
        for j, tag in enumerate(tags):
            self.pieces_before.append(len(self.pieces))
            self.loud_before.append(len(self.loud_starts))
            self.blocks_before.append(blocks)
            if tag is not None:
                self.by_tag.setdefault(tag, []).append(j)
                blocks += tag in BLOCKS
                if tag in QUIET:
                    quiet = max(quiet, end[j])
                continue
            words = held[j].split()
            if words:
                piece = " ".join(words)
                self.pieces.append(piece)
                self.starts.append(place)
                place += len(piece)
                self.stops.append(place)
                place += 1
            if j >= quiet:
                s = held[j]
                if words:
                    self.loud_starts.append(loud + len(s) - len(s.lstrip()))
                    self.loud_stops.append(loud + len(s.rstrip()))
                loud += len(s) + 1
        self.pieces_before.append(len(self.pieces))
        self.loud_before.append(len(self.loud_starts))
        self.blocks_before.append(blocks)
        self.whole = " ".join(self.pieces)
        self.link_sums = [0]
        for j in self.by_tag.get("a", ()):
            self.link_sums.append(self.link_sums[-1] + Node(self, j).length())


class _Reader(HTMLParser):
    def __init__(self, page: Page):
        super().__init__(convert_charrefs=True)
        self.page, self.open, self.names, self.over = page, [0], Counter(), Counter()

    def handle_starttag(self, tag, attrs):
        at = self.page.add(tag, {k: v or "" for k, v in attrs}, self.open[-1])
        if tag in VOID:
            return
        if len(self.open) >= DEEPEST or self.names[tag] >= DEEPEST_OF.get(tag, DEEPEST):
            self.over[tag] += 1
        else:
            self.open.append(at)
            self.names[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.page.add(tag, {k: v or "" for k, v in attrs}, self.open[-1])

    def handle_endtag(self, tag):
        if self.over[tag]:
            self.over[tag] -= 1
        elif self.names[tag]:
            page, n = self.page, len(self.page.tags)
            while True:
                j = self.open.pop()
                page.end[j] = n
                self.names[page.tags[j]] -= 1
                if page.tags[j] == tag:
                    return

    def handle_data(self, data):
        if data:
            self.page.add(None, data, self.open[-1])


def parse(html: str | None) -> Node:
    """The root of a page."""
    return Node(Page(html or ""), 0)
