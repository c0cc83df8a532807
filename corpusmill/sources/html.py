"""HTML pages to text and metadata, with the standard library's parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.shared import bounded, importable

_DROPPED = ("script", "style", "nav", "footer", "header")
_HEADINGS = ("h1", "h2", "h3")


class Page(HTMLParser):
    """text: text nodes, stripped, joined by blank lines, without scripts, styles and page furniture."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[str] = []
        self.meta: dict[str, str] = {}
        self.headers: list[str] = []
        self._dropped: list[str] = []
        self._title: str | None = None
        self._open: str | None = None
        self._first_h1: str | None = None
        self._heading = ""
        self._buffer: list[str] = []
        self.feed(html)
        self.close()
        self._flush()

    @property
    def text(self) -> str:
        return "\n\n".join(self.nodes)

    @property
    def title(self) -> str | None:
        return self._title.strip() if self._title and self._title.strip() else self._first_h1

    def _flush(self) -> None:
        node = "".join(self._buffer).strip()
        self._buffer = []
        if node and not self._dropped:
            self.nodes.append(node)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._flush()
        if tag in _DROPPED:
            self._dropped.append(tag)
        elif tag == "meta":
            values = dict(attrs)
            name, content = values.get("name") or values.get("property"), values.get("content")
            if name and content:
                self.meta[name] = content
        elif tag == "title" and self._title is None:
            self._open, self._title = "title", ""
        elif tag in _HEADINGS:
            self._open, self._heading = tag, ""

    def handle_endtag(self, tag: str) -> None:
        self._flush()
        if tag in _DROPPED and tag in self._dropped:
            while self._dropped.pop() != tag:
                pass
        if tag == self._open:
            if tag != "title":
                self.headers.append(self._heading.strip())
                if tag == "h1" and self._first_h1 is None:
                    self._first_h1 = self._heading.strip()
            self._open = None

    def handle_data(self, data: str) -> None:
        self._buffer.append(data)
        if self._open == "title":
            self._title = (self._title or "") + data
        elif self._open:
            self._heading += data


#: Elements that have no end tag.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SIMPLE = re.compile(r"(?P<tag>[\w-]+|\*)|#(?P<id>[\w-]+)|\.(?P<class>[\w-]+)|\[(?P<name>[\w-]+)(?:=[\"']?(?P<value>[^\"'\]]*)[\"']?)?\]")


def _compound(text: str) -> list[dict[str, str]]:
    parts = [m.groupdict() for m in _SIMPLE.finditer(text)]
    if "".join(m[0] for m in _SIMPLE.finditer(text)) != text or not text:
        raise ValueError(f"selector not understood: {text!r}")
    return parts


def parse_selector(selector: str) -> list[list[tuple[bool, list[dict[str, str]]]]]:
    """Alternatives, by commas, of chains of (is a child of the one before, tests on one element).

    Understood are tag, ``*``, ``#id``, ``.class``, ``[name]``, ``[name=value]``, and chains
    of these by white space or ``>``.
    """
    out = []
    for alternative in selector.split(","):
        chain, child = [], False
        for word in alternative.replace(">", " > ").split():
            if word == ">":
                child = True
            else:
                chain.append((child, _compound(word)))
                child = False
        if not chain or child:
            raise ValueError(f"selector not understood: {selector!r}")
        out.append(chain)
    return out


def _is(element: tuple[str, dict[str, str]], tests: list[dict[str, str]]) -> bool:
    tag, attributes = element
    for t in tests:
        if t["tag"] and t["tag"] not in ("*", tag):
            return False
        if t["id"] and attributes.get("id") != t["id"]:
            return False
        if t["class"] and t["class"] not in attributes.get("class", "").split():
            return False
        if t["name"] and (t["name"] not in attributes or t["value"] is not None and attributes[t["name"]] != t["value"]):
            return False
    return True


def _selected(path: list[tuple[str, dict[str, str]]], chain: list[tuple[bool, list[dict[str, str]]]]) -> bool:
    """Whether the last element of the path ends the chain."""
    if not path or not _is(path[-1], chain[-1][1]):
        return False
    if len(chain) == 1:
        return True
    above = range(len(path) - 1, len(path) - 2, -1) if chain[-1][0] else range(len(path) - 1, 0, -1)
    return any(_selected(path[:i], chain[:-1]) for i in above)


class Selection(HTMLParser):
    """The stripped text nodes of each element that a selector names, in document order, without page furniture."""

    def __init__(self, html: str, selector: str) -> None:
        super().__init__(convert_charrefs=True)
        self.chains = parse_selector(selector)
        self.found: list[list[str]] = []
        self._path: list[tuple[str, dict[str, str]]] = []
        self._open: list[tuple[int, list[str]]] = []  # depth of an open element that is selected, and its nodes
        self._buffer: list[str] = []
        self.feed(html)
        self.close()
        self._flush()

    def _flush(self) -> None:
        node = "".join(self._buffer).strip()
        self._buffer = []
        if node and not any(tag in _DROPPED for tag, _ in self._path):
            for _, nodes in self._open:
                nodes.append(node)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._flush()
        self._path.append((tag, {k: v or "" for k, v in attrs}))
        if not any(t in _DROPPED for t, _ in self._path) and any(_selected(self._path, c) for c in self.chains):
            nodes: list[str] = []
            self.found.append(nodes)
            self._open.append((len(self._path), nodes))
        if tag in _VOID:
            self._leave(len(self._path) - 1)

    def handle_endtag(self, tag: str) -> None:
        self._flush()
        depth = next((i for i in range(len(self._path) - 1, -1, -1) if self._path[i][0] == tag), None)
        if depth is not None:
            self._leave(depth)

    def _leave(self, depth: int) -> None:
        del self._path[depth:]
        while self._open and self._open[-1][0] > depth:
            self._open.pop()

    def handle_data(self, data: str) -> None:
        self._buffer.append(data)


def selected_text(html: str, selector: str) -> str:
    """The text of the elements that a selector names, an element's nodes run together, elements apart by a blank line."""
    return "\n\n".join("".join(nodes) for nodes in Selection(html, selector).found)


def main_text(html: str) -> str:
    """The nodes, a line each, of the first main element, else article, else body, else of the whole page."""
    for name in ("main", "article", "body"):
        if found := Selection(html, name).found:
            return "\n".join(found[0])
    return "\n".join(Page(html).nodes)


def pages_to_text(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key``, title, author, description, headers (array), text: one Arrow pass; a null page is an empty one."""
    importable(pages.sparkSession)
    source = pages.select(key, F.col(html).alias("html"))

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        for batch in bounded(batches):
            read = [Page(h or "") for h in batch.column(1).to_pylist()]
            columns = [[p.title for p in read], [p.meta.get("author") for p in read], [p.meta.get("description") for p in read]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns), pa.array([p.headers for p in read], pa.list_(pa.string())), pa.array([p.text for p in read], pa.string())], names=[key, "title", "author", "description", "headers", "text"])

    return source.mapInArrow(run, f"{key} {source.schema[key].dataType.simpleString()}, title string, author string, description string, headers array<string>, text string")
