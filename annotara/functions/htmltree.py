"""A small tree over the standard library's HTML parser.

Elements nest as they are opened: an unclosed paragraph holds the next one.  A closing tag closes the
nearest open element of its name and all within; without one it is dropped.  Writing the tree back keeps
text as it was; attributes are written with double quotes.
"""

from __future__ import annotations

from html import escape, parser, unescape
from html.parser import HTMLParser
from itertools import chain

#: References in attribute values, as the parser at hand resolves them.
_value = getattr(parser, "_unescape_attrvalue", unescape)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Node:
    """An element, or with tag None a piece of source text."""

    __slots__ = ("tag", "attrs", "children", "text", "parent")

    def __init__(self, tag: str | None, attrs: list[tuple[str, str | None]] | None = None, text: str = ""):
        self.tag, self.attrs, self.text = tag, attrs or [], text
        self.children: list[Node] = []
        self.parent: Node | None = None

    def add(self, child: Node) -> Node:
        child.parent = self
        self.children.append(child)
        return child

    def get(self, name: str) -> str | None:
        return next((v if v is not None else "" for k, v in reversed(self.attrs) if k == name), None)

    def elements(self):
        """Elements below, in document order."""
        for c in list(self.children):
            if c.tag is not None:
                yield c
                yield from c.elements()

    def all_text(self) -> str:
        if self.tag is None:
            return "" if self.text.startswith(("<!", "<?")) else unescape(self.text)
        return "".join(c.all_text() for c in self.children)

    def unwrap(self) -> None:
        p = self.parent
        i = p.children.index(self)
        for c in self.children:
            c.parent = p
        p.children[i : i + 1] = self.children
        self.children = []

    def wrap(self, outer: Node) -> None:
        p = self.parent
        i = p.children.index(self)
        p.children[i] = outer
        outer.parent = p
        outer.add(self)

    def inner(self) -> str:
        return "".join(c.html() for c in self.children)

    def html(self) -> str:
        if self.tag is None:
            return self.text
        attrs = "".join(f" {k}" if v is None else f' {k}="{escape(v, quote=False).replace(chr(34), "&quot;")}"' for k, v in self.attrs)
        return f"<{self.tag}{attrs}/>" if self.tag in VOID else f"<{self.tag}{attrs}>{self.inner()}</{self.tag}>"


class _Builder(HTMLParser):
    """mark stands for "&" while the source is read: the parser would report references with and without a
    semicolon alike, and stop at some that it can't read."""

    def __init__(self, mark: str) -> None:
        super().__init__(convert_charrefs=False)
        self.root = self.at = Node("#root")
        self.mark = mark

    def source(self, text: str) -> str:
        return text.replace(self.mark, "&")

    def _node(self, tag, attrs) -> Node:
        return self.at.add(Node(self.source(tag), [(self.source(k), v if v is None else _value(self.source(v))) for k, v in attrs]))

    def handle_starttag(self, tag, attrs):
        node = self._node(tag, attrs)
        if node.tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self._node(tag, attrs)

    def handle_endtag(self, tag):
        node, tag = self.at, self.source(tag)
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def _raw(self, text: str) -> None:
        self.at.add(Node(None, text=self.source(text)))

    def handle_data(self, data):
        self._raw(data)

    def handle_comment(self, data):
        self._raw(f"<!--{data}-->")

    def handle_decl(self, decl):
        self._raw(f"<!{decl}>")

    def handle_pi(self, data):
        self._raw(f"<?{data}>")

    def unknown_decl(self, data):
        self._raw(f"<![{data}]>")


def parse(html: str) -> Node:
    mark = next(c for c in map(chr, chain(range(0xE000, 0xF900), range(0xF0000, 0xFFFFE))) if c not in html)  # a private character
    b = _Builder(mark)
    b.feed(html.replace("&", mark))
    b.close()
    return b.root


def write(root: Node) -> str:
    return root.inner()


BLOCKS = ("p", "li", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6")
NESTED = ("p", "li", "blockquote", "pre")


def leaf_blocks(html: str) -> list[str]:
    """Source of the block elements that hold no other paragraph, item, quotation or preformatted text."""
    return [e.html() for e in parse(html).elements() if e.tag in BLOCKS and not any(c.tag in NESTED for c in e.elements())]
