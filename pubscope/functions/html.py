"""A small tree of an HTML page with the selections that the extraction needs, from the standard library's parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INVISIBLE = dict.fromkeys([0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0xFEFF])


class Node:
    """An element with its attributes and its children, texts among them."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order."""
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def classes(self) -> set[str]:
        return set(self.attrs.get("class", "").split())

    def fits(self, simple: str) -> bool:
        """tag, .class, tag.class, tag[attribute]"""
        m = re.fullmatch(r"([a-z0-9]*)((?:\.[\w-]+)*)(?:\[([\w-]+)\])?", simple)
        if not m:
            raise ValueError(f"no such selector: {simple}")
        tag, classes, attr = m.groups()
        return (not tag or self.tag == tag) and set(filter(None, classes.split("."))) <= self.classes() and (not attr or attr in self.attrs)

    def select(self, selector: str) -> list[Node]:
        """The elements below that fit one of the comma-separated descendant selectors."""
        chains = [s.split() for s in selector.split(",")]

        def under(node: Node, chain: list[str]) -> bool:
            if not node.fits(chain[-1]):
                return False
            rest, up = chain[:-1], node.parent
            while rest and up is not None:
                if up.fits(rest[-1]):
                    rest = rest[:-1]
                up = up.parent
            return not rest

        return [n for n in self.walk() if any(under(n, c) for c in chains)]

    def first(self, selector: str) -> Node | None:
        found = self.select(selector)
        return found[0] if found else None

    def text(self) -> str:
        """All texts below on one clean line, blanks between elements."""
        parts: list[str] = []

        def gather(node: Node) -> None:
            for c in node.children:
                if isinstance(c, str):
                    parts.append(c)
                elif c.tag not in ("script", "style"):
                    gather(c)

        gather(self)
        return " ".join(" ".join(p.strip() for p in parts if p.strip()).translate(_INVISIBLE).replace("\xa0", " ").split())

    def lines(self) -> list[str]:
        """The block's lines, separated by <br>."""
        groups: list[list[str]] = [[]]

        def gather(node: Node) -> None:
            for c in node.children:
                if isinstance(c, str):
                    groups[-1].append(c)
                elif c.tag == "br":
                    groups.append([])
                else:
                    gather(c)

        gather(self)
        cleaned = (" ".join(" ".join(p.strip() for p in g if p.strip()).translate(_INVISIBLE).replace("\xa0", " ").split()) for g in groups)
        return [line for line in cleaned if line]


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        up: Node | None = self.at
        while up is not None and up.tag != tag:
            up = up.parent
        if up is not None and up.parent is not None:
            self.at = up.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def between_markers(html: str, begin: str, end: str) -> str:
    """The part between two comments, or the whole page where they don't enclose one."""
    a, b = html.find(begin), html.find(end)
    return html[a:b] if 0 <= a < b else html


def tree(html: str) -> Node:
    """The page's tree; unclosed and stray tags are tolerated."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root
