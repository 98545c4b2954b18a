"""HTML to text and metadata with the standard library's tokeniser and a small tree."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

#: Elements whose text is never content, elements set off by blank lines, elements without an end.
DROPPED = set("script style head noscript template svg nav form button select iframe".split())
BLOCKS = set("p div section article h1 h2 h3 h4 h5 h6 li ul ol blockquote pre tr table br hr header footer figcaption dd dt".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
#: What the head of a page may hold, and elements whose insides are not HTML.
HEAD_ONLY = set("base basefont bgsound link meta title noscript noframes style script template head html".split())
FOREIGN = {"svg", "math"}
#: The metadata keys of each field.
META = {
    "title": ("og:title", "twitter:title"),
    "author": ("author", "article:author", "og:article:author"),
    "url": ("og:url",),
    "date": ("article:published_time", "og:article:published_time", "date", "pubdate", "publish_date"),
}
_FIELD = {key: name for name, keys in META.items() for key in keys}


@dataclass(eq=False)
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)  # nodes and strings

    def walk(self):
        """This element and those below it in document order, without recursion."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def first(self, tag: str) -> Node | None:
        return next((n for n in self.walk() if n.tag == tag), None)

    def own_text(self) -> str:
        return "".join(c for c in self.children if isinstance(c, str)).strip()


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]
        self.depth: Counter = Counter()  # open elements by tag, so that no event walks up the tree in vain

    def _add(self, tag, attrs) -> Node:
        named: dict[str, str] = {}
        for name, value in attrs:
            named.setdefault(name, value or "")
        if tag not in HEAD_ONLY and self._inside("head") and not self._inside("noscript", "template"):
            self.handle_endtag("head")  # anything else ends a head that was left open
        node = Node(tag, named)
        self.open[-1].children.append(node)
        return node

    def _inside(self, *tags: str) -> bool:
        return any(self.depth[t] for t in tags)

    def handle_starttag(self, tag, attrs):
        node = self._add(tag, attrs)
        if tag not in VOID:
            self.open.append(node)
            self.depth[tag] += 1

    def handle_startendtag(self, tag, attrs):
        """A slash at the end closes foreign elements; on others it means nothing."""
        if tag in FOREIGN or self._inside(*FOREIGN):
            self._add(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if not self.depth[tag]:
            if tag in ("p", "br"):
                self.open[-1].children.append(Node(tag))
            return
        while True:
            closed = self.open.pop().tag
            self.depth[closed] -= 1
            if closed == tag:
                return

    def handle_data(self, data):
        if self.open[-1].tag == "head" and data.strip():
            self.handle_endtag("head")
        self.open[-1].children.append(data)


def parse(markup: str) -> Node:
    builder = _Builder()
    builder.feed(markup)
    builder.close()
    return builder.root


def content(root: Node) -> Node:
    """The first article, else main, else body, else all."""
    return next((n for tag in ("article", "main", "body") if (n := root.first(tag)) is not None), root)


def raw_text(node: Node, leave_out: tuple = (), shape=lambda s: s) -> str:
    """Text of the tree with blank lines around blocks; ``leave_out`` elements, dropped ones and page titles are silent."""
    out: list[str] = []
    stack: list = [node]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            out.append(item if item == "\n\n" else shape(item))
        elif item.tag not in DROPPED and item.tag != "title" and not any(item is x for x in leave_out):
            edge = ["\n\n"] if item.tag in BLOCKS else []
            stack.extend([*edge, *reversed(item.children), *edge])
    return "".join(out)


def unwrap(text: str) -> str:
    """Soft line wraps as spaces; white space with two line feeds or more as a paragraph break."""
    return re.sub(r"[ \t\n\r\v\f]+", lambda m: "\n\n" if m.group().count("\n") > 1 else " ", text)


def _stated(node: Node) -> Iterator[tuple[str, str]]:
    """What an element states of its page, as (field, value)."""
    attrs = node.attrs
    if node.tag == "title":
        yield "page_title", node.own_text()
    elif node.tag == "meta":
        yield _FIELD.get((attrs.get("property") or attrs.get("name") or "").lower(), ""), attrs.get("content", "")
    elif node.tag == "link" and attrs.get("rel", "").lower() == "canonical":
        yield "url", attrs.get("href", "")
    elif node.tag == "time":
        yield "date", attrs.get("datetime", "")


def metadata(root: Node) -> dict:
    """Title, author and url of a page, each as first stated, and all its dates in order (the first that can be read counts)."""
    stated: dict[str, list[str]] = {}
    for node in root.walk():
        for name, value in _stated(node):
            if value:
                stated.setdefault(name, []).append(value)
    first = lambda *names: next((v for n in names for v in stated.get(n, [])), "")
    return {"title": first("title", "page_title").strip(), "author": first("author").strip(), "url": first("url"), "dates": stated.get("date", [])}


def site_page(markup: str, is_date) -> dict:
    """Title, date line and text of a hand-built page; its second heading is left out if ``is_date`` of it."""
    body = content(parse(markup))
    h1, h2 = body.first("h1"), body.first("h2")
    title = h1.own_text() if h1 is not None else ""
    line = h2.own_text() if h2 is not None and is_date(h2.own_text()) else ""
    leave = tuple(n for n in (h1, h2 if line else None) if n is not None)
    return {"title": "" if title.lower() == "title" else title, "date_line": line, "text": raw_text(body, leave, unwrap)}
