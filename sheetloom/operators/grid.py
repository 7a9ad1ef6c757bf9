"""HTML tables as full grids."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

_WS = re.compile(r"\s+")
#: Elements without content, and those a following sibling closes.
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_CLOSED_BY = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
_SCOPES = {"table", "ul", "ol", "div", "section", "article"}


@dataclass
class Node:
    """An element; text nodes are plain strings among the children."""

    name: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)
    parent: Node | None = None

    @property
    def classes(self) -> set[str]:
        return set(self.attrs.get("class", "").split())

    def walk(self):
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def all(self, *names: str):
        return (n for n in self.walk() if n.name in names)

    def ancestors(self):
        n = self.parent
        while n is not None:
            yield n
            n = n.parent

    def own(self, *names: str) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node) and c.name in names]

    def text(self, skip: tuple[str, ...] = ()) -> str:
        return "".join(c if isinstance(c, str) else "" if c.name in skip else c.text() for c in self.children)

    def flat(self) -> str:
        """Text without gaps between inline pieces, white space collapsed."""
        return _WS.sub(" ", self.text()).strip()


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("document")
        self.at = self.root

    def handle_starttag(self, tag, attrs) -> None:
        closes = _CLOSED_BY.get(tag, set())
        n = self.at
        while closes and n.parent is not None and n.name not in _SCOPES:
            if n.name in closes and not (tag in ("td", "th") and n.name == "tr"):
                self.at = n.parent
                break
            n = n.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, parent=self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag) -> None:
        n = self.at
        while n.parent is not None and n.name != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data) -> None:
        if self.at.name not in ("script", "style"):
            self.at.children.append(data)


def parse_html(text: str) -> Node:
    builder = _Builder()
    builder.feed(text)
    builder.close()
    return builder.root


def _span(cell: Node, name: str) -> int:
    try:
        return max(1, int(cell.attrs.get(name, 1)))
    except ValueError:
        return 1


def expand(rows: list[list[tuple[str, int, int]]]) -> list[list[str]]:
    """Rows of (text, rowspan, colspan) as a grid: every cell fills all places
    it spans. A place that is taken from above moves later cells to the right;
    short rows still use up the spans above them; all rows end equally wide."""
    taken: dict[tuple[int, int], str] = {}
    for i, row in enumerate(rows):
        j = 0
        for text, down, across in row:
            while (i, j) in taken:
                j += 1
            for k in range(across):
                for r in range(min(down, len(rows) - i)):
                    # a span from above keeps its own row; below, the later cell takes the place
                    if r > 0 or (i, j + k) not in taken:
                        taken[i + r, j + k] = text
            j += across
    width = max((j + 1 for _, j in taken), default=0)
    return [[taken.get((i, j), "") for j in range(width)] for i in range(len(rows))]


def _cells(rows: list[Node]) -> list[list[tuple[str, int, int]]]:
    return [[(c.flat(), _span(c, "rowspan"), _span(c, "colspan")) for c in r.own("td", "th")] for r in rows]


def table_block(table: Node) -> dict:
    """headers, grid and cited markers of a table element. Header rows are
    joined per column without repeating what directly precedes; blank rows are
    dropped; markers count only in superscripts."""
    head = next(table.all("thead"), None)
    head_rows = expand(_cells(head.own("tr"))) if head else []
    headers = []
    for column in zip(*head_rows, strict=True):
        parts = [p for p in column if p]
        headers.append(" ".join(p for i, p in enumerate(parts) if i == 0 or p != parts[i - 1]))
    body = next(table.all("tbody"), table)
    grid = [r for r in expand(_cells(body.own("tr"))) if any(c.strip() for c in r)]
    cited = {m[1] for s in table.all("sup") if (m := re.fullmatch(r"\s*(\(\d+\))\s*", s.text()))}
    return {"headers": headers, "grid": grid, "cited_markers": sorted(cited)}


def html_table(text: str) -> dict:
    table = next(parse_html(text).all("table"), None)
    if table is None:
        raise ValueError("there is no table")
    return table_block(table)
