"""A small HTML reader for one page at a time, run inside Spark tasks.

Lenient in the usual way: void elements close at once, an end tag closes everything up
to its latest matching start tag, stray end tags are ignored.
"""

from __future__ import annotations

from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset(("script", "style", "template"))


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict):
        self.tag = tag
        self.attrs = attrs
        self.children: list = []

    def descendants(self):
        """Elements below this one, in document order."""
        pending = [iter(self.children)]
        while pending:
            child = next(pending[-1], None)
            if child is None:
                pending.pop()
            elif isinstance(child, Node):
                yield child
                pending.append(iter(child.children))

    def text(self) -> str:
        parts: list[str] = []
        pending = [iter(self.children)]
        while pending:
            child = next(pending[-1], None)
            if child is None:
                pending.pop()
            elif isinstance(child, str):
                parts.append(child)
            elif child.tag not in SILENT:
                pending.append(iter(child.children))
        return "".join(parts).strip()

    def has(self, attr: str, values) -> bool:
        found = self.attrs.get(attr)
        if found is None:
            return False
        if attr in ("class", "rel"):
            words = found.split()
            return any(v in words or v == " ".join(words) for v in values)
        return found in values


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def read_html(html: str | None) -> Node:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    return reader.root


def _matches(node: Node, step) -> bool:
    tags, attr, values = step
    return (not tags or node.tag in tags) and (attr is None or node.has(attr, values))


def _first(node: Node, step) -> Node | None:
    return next((n for n in node.descendants() if _matches(n, step)), None)


def first_text(root: Node, paths) -> str:
    """Text under the first path whose first step is found; "" if its later steps miss."""
    for path in paths:
        node = _first(root, path[0])
        if node is None:
            continue
        for step in path[1:]:
            node = _first(node, step) if node is not None else None
        return node.text() if node is not None else ""
    return ""


def body_blocks(root: Node, rules: dict) -> list[str]:
    """Stripped texts of the paragraph-like blocks of the body container(s)."""
    bodies = [n for n in root.descendants() if _matches(n, rules["body"])]
    if not rules["every_body"]:
        bodies = bodies[:1]
    found = []
    for body in bodies:
        below = body.children if rules["children_only"] else body.descendants()
        found += [n.text() for n in below if isinstance(n, Node) and n.tag in rules["blocks"]]
    return found


def links_to(root: Node, hrefs) -> bool:
    """Whether the page holds a link to exactly one of these addresses."""
    return any(n.tag == "a" and n.attrs.get("href") in hrefs for n in root.descendants())
