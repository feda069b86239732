"""The element tree of a page as an array column, and tests and texts of elements as expressions over it.

A page is parsed once, into its elements and pieces of text in page order. Each
entry knows its place and the place of its last descendant, so what lies within
an element is a slice of the array, and its ancestors are the earlier entries
that reach as far. Everything after the parse is built-in expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Elements that hold no visible text, that end a line, that are empty, and that a sibling of their kind closes.
SKIPPED = frozenset("title script style noscript nav footer button iframe svg".split())
BLOCKS = frozenset("p div li ul ol h1 h2 h3 h4 h5 h6 tr section article header main table".split())
EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())
ALONE = frozenset("p li option dt dd tr td th".split())

TEXT, END = "#text", "#end"
NODE = "struct<pos:int,last:int,cover:int,tag:string,id:string,classes:array<string>,attrs:map<string,string>,text:string>"
#: A test takes an element and all entries of its page.
Test = Callable[[Column, Column], Column]


class Tree(HTMLParser):
    """Entries [pos, last, cover, tag, id, classes, attrs, text] of a page; cover is the innermost element around that shows no text, or -1."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.nodes: list[list] = []
        self.open: list[tuple[str, int, int]] = []
        self.feed(page)
        self.close()
        while self.open:
            self._end()

    def _add(self, tag: str, attrs: dict | None = None, text: str | None = None) -> int:
        attrs = attrs or {}
        self.nodes.append([at := len(self.nodes), at, self.open[-1][2] if self.open else -1, tag, attrs.get("id"), attrs.get("class", "").split(), attrs, text])
        return at

    def _end(self) -> str:
        tag, at, _ = self.open[-1]
        if tag in BLOCKS:
            self._add(END, text="\n")
        self.nodes[at][1] = len(self.nodes) - 1
        self.open.pop()
        return tag

    def handle_starttag(self, tag, attrs):
        if self.open and tag == self.open[-1][0] and tag in ALONE or tag in BLOCKS and self.open and self.open[-1][0] == "p":
            self._end()
        at = self._add(tag, {k: v or "" for k, v in reversed(attrs)}, "\n" if tag == "br" else None)
        if tag not in EMPTY:
            self.open.append((tag, at, at if tag in SKIPPED else self.open[-1][2] if self.open else -1))

    def handle_endtag(self, tag):
        if any(x[0] == tag for x in self.open):
            while self._end() != tag:
                pass

    def handle_data(self, data):
        self._add(TEXT, text=data)

    def text(self) -> str:
        """The visible text of the whole page, blocks ending lines."""
        return "".join(n[7] for n in self.nodes if n[7] is not None and n[2] < 0)


ENTRIES = pa.list_(pa.struct([*((k, pa.int32()) for k in ("pos", "last", "cover")), ("tag", pa.string()), ("id", pa.string()), ("classes", pa.list_(pa.string())), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string())]))
#: Pages that stand as Python objects at once; the rest of a batch is held in Arrow, which takes a small part of the room.
AT_ONCE = 32


def _trees(pages: pa.Array) -> pa.Array:
    def entries(page: str | None) -> list[tuple]:
        return [(*n[:6], list(n[6].items()), n[7]) for n in Tree(page or "").nodes]

    parts = [pa.array(map(entries, pages.slice(i, AT_ONCE).to_pylist()), ENTRIES) for i in range(0, len(pages), AT_ONCE)]
    return pa.concat_arrays(parts) if parts else pa.array([], ENTRIES)


def elements(page: Column) -> Column:
    """The entries of each page in page order. A null page has none."""
    return F.arrow_udf(_trees, f"array<{NODE}>")(page)


def mark(tag: str | None = None, cls: str | None = None, id: str | None = None, attr: str | None = None, value: str | None = None, part: str | None = None) -> Test:  # noqa: A002
    """Elements by tag, class, id, and an attribute that is there, has a value or contains a part."""

    def test(node: Column, nodes: Column) -> Column:
        held = ~F.startswith(node["tag"], F.lit("#"))
        if tag:
            held &= node["tag"] == tag
        if cls:
            held &= F.array_contains(node["classes"], cls)
        if id:
            held &= F.coalesce(node["id"] == id, F.lit(False))
        if attr:
            held &= F.map_contains_key(node["attrs"], attr)
            if value is not None:
                held &= node["attrs"][attr] == value
            if part is not None:
                held &= F.contains(node["attrs"][attr], F.lit(part))
        return held

    return test


def any_of(*tests: Test) -> Test:
    def test(node: Column, nodes: Column) -> Column:
        out = tests[0](node, nodes)
        for t in tests[1:]:
            out |= t(node, nodes)
        return out

    return test


def inside(outer: Test, inner: Test) -> Test:
    """Elements that pass ``inner`` within one that passes ``outer``."""
    return lambda node, nodes: inner(node, nodes) & F.exists(ancestors(nodes, node), lambda a: outer(a, nodes))


def ancestors(nodes: Column, node: Column) -> Column:
    """The elements around ``node``, outermost first."""
    return F.filter(F.slice(nodes, F.lit(1), node["pos"]), lambda a: a["last"] >= node["pos"])


def under(nodes: Column, node: Column) -> Column:
    """All entries within ``node``; none where it is null."""
    return F.coalesce(let(node, lambda x: F.slice(nodes, x["pos"] + 2, x["last"] - x["pos"])), F.array().cast(f"array<{NODE}>"))


def find(nodes: Column, test: Test, within: Column | None = None) -> Column:
    """The elements that pass a test, of the page or within an element, in page order."""
    return F.filter(nodes if within is None else under(nodes, within), lambda n: test(n, nodes))


def first(nodes: Column, test: Test, within: Column | None = None) -> Column:
    """The first element that passes a test, or null."""
    return F.get(find(nodes, test, within), F.lit(0))


def closest(nodes: Column, node: Column, test: Test) -> Column:
    """The innermost of ``node`` and the elements around it that passes a test, or null."""
    around = let(node, lambda x: F.filter(F.slice(nodes, F.lit(1), x["pos"] + 1), lambda a: (a["last"] >= x["pos"]) & test(a, nodes)))
    return F.try_element_at(around, F.lit(-1))


def following(nodes: Column, node: Column) -> Column:
    """The next element beside ``node``, or null."""

    def after(x: Column) -> Column:
        end = F.coalesce(F.try_element_at(ancestors(nodes, x), F.lit(-1))["last"], F.size(nodes) - 1)
        return F.get(F.filter(F.slice(nodes, x["last"] + 2, end - x["last"]), lambda n: ~F.startswith(n["tag"], F.lit("#"))), F.lit(0))

    return let(node, after)


def apart(node: Column, others: Column) -> Column:
    """Whether an entry lies in none of some elements."""
    return ~F.exists(others, lambda g: node["pos"].between(g["pos"], g["last"]))


def _joined(pieces: Column) -> Column:
    return F.array_join(F.transform(pieces, lambda n: n["text"]), "")


def raw_text(nodes: Column, node: Column, without: Test | None = None) -> Column:
    """All text within ``node`` as it stands, less what lies in elements that pass ``without``; empty where it is null."""
    if without is None:
        return _joined(F.filter(under(nodes, node), lambda n: n["tag"] == TEXT))

    def rest(inner: Column) -> Column:
        gone = F.filter(inner, lambda n: without(n, nodes))
        return let(gone, lambda g: _joined(F.filter(inner, lambda n: (n["tag"] == TEXT) & apart(n, g))))

    return let(under(nodes, node), rest)


def shown_text(nodes: Column, node: Column) -> Column:
    """Visible text within ``node``, blocks ending lines; empty where it is null. Scripts, styles, menus, footers, buttons and frames within it are left out."""
    return F.coalesce(let(node, lambda x: _joined(F.filter(under(nodes, x), lambda n: n["text"].isNotNull() & (n["cover"] <= x["pos"])))), F.lit(""))


def let_nodes(nodes: Column, body: Callable[[Column], Column]) -> Column:
    """``body(nodes)`` with the page parsed once a row."""
    return let(nodes, body)
