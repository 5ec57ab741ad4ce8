"""A small HTML tree: enough structure for page facts, built in one pass with implied ends of elements."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Elements whose start ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HEAD_TAGS = frozenset("base link meta noscript script style template title head html".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Node:
    __slots__ = ("name", "attrs", "children", "parent", "start")

    def __init__(self, name: str, attrs: dict[str, str], parent: Node | None, start: int) -> None:
        self.name, self.attrs, self.parent, self.start = name, attrs, parent, start
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def find(self, *names: str) -> list[Node]:
        return [n for n in self.walk() if n.name in names]

    def first(self, *names: str) -> Node | None:
        return next((n for n in self.walk() if n.name in names), None)

    def above(self, *names: str) -> Node | None:
        node = self.parent
        while node is not None and node.name not in names:
            node = node.parent
        return node

    def text(self, skip: frozenset[str] = frozenset(), breaks: frozenset[str] = frozenset()) -> str:
        out: list[str] = []
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                out.append(item)
            elif item.name == "br":
                out.append(" " if breaks else "")
            elif item.name not in skip:
                if item.name in breaks:
                    stack.append(" ")
                stack.extend(reversed(item.children))
        return "".join(out)

    def get(self, name: str) -> str | None:
        return self.attrs.get(name)


def parse(html: str) -> Node:
    """The tree below a root node; elements of the head that stand in the body stay there."""
    root = Node("#root", {}, None, 0)
    here, at = root, 0
    opened: dict[str, int] = {}

    def close(name: str) -> None:
        nonlocal here
        while here.parent is not None:
            gone = here
            opened[gone.name] -= 1
            here = gone.parent
            if gone.name == name:
                return

    while m := _TOKEN.search(html, at):
        if m.start() > at:
            here.children.append(unescape(html[at : m.start()]))
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if opened.get(name):
                close(name)
            continue
        if name in ("html", "head", "body") and opened.get(name):
            continue
        if opened.get("head") and name not in HEAD_TAGS:
            close("head")
        if name in ENDS_P and opened.get("p"):
            close("p")
        for other in SIBLINGS.get(name, ()):
            if here.name == other:
                close(other)
        attrs = {}
        for a in _ATTRIBUTE.finditer(m[3] or ""):
            attrs.setdefault(a[1].lower(), unescape(a[2] or a[3] or a[4] or ""))
        node = Node(name, attrs, here, m.start())
        here.children.append(node)
        if name in VOID or (m[3] or "").rstrip().endswith("/") and name not in RAW and opened.get("svg"):
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(html, at)
            body = html[at : end.start() if end else len(html)]
            at = end.end() if end else len(html)
            if body:
                node.children.append(unescape(body) if name in ("title", "textarea") else body)
            continue
        here = node
        opened[name] = opened.get(name, 0) + 1
    if at < len(html):
        here.children.append(unescape(html[at:]))
    return root


def collapse(text: str) -> str:
    return " ".join(text.split())
