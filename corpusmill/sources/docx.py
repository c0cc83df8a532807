"""What a DOCX file holds, in reading order, from the archive's own XML."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.etree.ElementTree import Element

from corpusmill.sources import dispatch

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_FALLBACK = "{http://schemas.openxmlformats.org/markup-compatibility/2006}Fallback"
_HEADING = re.compile(r"heading (\d)$", re.I)
#: Columns or rows that a cell may run over; files that claim more are not believed.
MOST_SPAN = 100


def _value(node: Element | None, path: str) -> str | None:
    """The w:val of what ``path`` leads to, "" where it has none, None where it is not there."""
    found = node.find("/".join(_W + p for p in path.split("/"))) if node is not None else None
    return None if found is None else found.get(f"{_W}val", "")


def said(node: Element) -> str:
    """The text of a paragraph's runs; what is there twice for older readers counts once."""
    out: list[str] = []
    stack = [node]
    while stack:
        at = stack.pop()
        if at.tag == f"{_W}t":
            out.append(at.text or "")
        elif at.tag == f"{_W}tab" and not at.attrib:  # one with attributes is a tab stop of the style
            out.append("\t")
        elif at.tag in (f"{_W}br", f"{_W}cr"):
            out.append("\n")
        if at.tag != _FALLBACK:
            stack.extend(reversed(at))
    return "".join(out)


def _children(node: Element, *tags: str) -> Iterator[Element]:
    """Children of these tags, also those inside content controls."""
    for child in node:
        if child.tag in tags:
            yield child
        elif child.tag == f"{_W}sdt":
            inside = child.find(f"{_W}sdtContent")
            if inside is not None:
                yield from _children(inside, *tags)


def table_rows(table: Element) -> list[list[str]]:
    """Cells by rows; a cell that runs over columns or rows stands in each of its places."""
    rows: list[list[str]] = []
    for row in _children(table, f"{_W}tr"):
        cells: list[str] = []
        for cell in _children(row, f"{_W}tc"):
            properties = cell.find(f"{_W}tcPr")
            span = _value(properties, "gridSpan") or "1"
            width = max(1, min(int(span) if span.isdigit() else 1, MOST_SPAN))
            merge = _value(properties, "vMerge")
            if merge is not None and merge != "restart" and rows and len(cells) < len(rows[-1]):
                text = rows[-1][len(cells)]
            else:
                text = "\n".join(said(p) for p in cell.iter(f"{_W}p")).strip()
            cells += [text] * width
        rows.append(cells)
    return rows


class Docx:
    """A file's body and properties; ``level`` and ``numbering`` tell headings and list items from paragraphs."""

    def __init__(self, data: bytes) -> None:
        self.archive = zipfile.ZipFile(io.BytesIO(data))
        root = self._part("word/document.xml")
        body = root.find(f"{_W}body") if root is not None else None
        if body is None:
            raise ValueError("no document in the archive")
        self.body = body
        core = self._part("docProps/core.xml")
        self.core = {} if core is None else {node.tag.rpartition("}")[2]: node.text or "" for node in core}
        styles = self._part("word/styles.xml")
        self._styles = {} if styles is None else {s.get(f"{_W}styleId", ""): s for s in styles.findall(f"{_W}style")}
        self._formats = self._list_formats(self._part("word/numbering.xml"))

    def _part(self, name: str) -> Element | None:
        if name not in self.archive.namelist():
            return None
        if self.archive.getinfo(name).file_size > dispatch.MAX_FILE_BYTES:
            raise ValueError(f"{name} is too large")
        return ElementTree.fromstring(self.archive.read(name))

    @staticmethod
    def _list_formats(root: Element | None) -> dict[tuple[str, str], str]:
        """How the items of (list, level) are numbered; "bullet" for those without numbers."""
        if root is None:
            return {}
        shapes = {a.get(f"{_W}abstractNumId", ""): {n.get(f"{_W}ilvl", "0"): _value(n, "numFmt") or "bullet" for n in a.findall(f"{_W}lvl")} for a in root.findall(f"{_W}abstractNum")}
        return {(n.get(f"{_W}numId", ""), level): kind for n in root.findall(f"{_W}num") for level, kind in shapes.get(_value(n, "abstractNumId") or "", {}).items()}

    def blocks(self) -> Iterator[Element]:
        """Paragraphs and tables in reading order."""
        return _children(self.body, f"{_W}p", f"{_W}tbl")

    def _chain(self, paragraph: Element) -> Iterator[Element]:
        """A paragraph and the styles that it builds on."""
        yield paragraph
        style, seen = _value(paragraph, "pPr/pStyle"), set()
        while style in self._styles and style not in seen:
            seen.add(style)
            yield self._styles[style]
            style = _value(self._styles[style], "basedOn")

    def level(self, paragraph: Element) -> int:
        """1 to 6 for a heading, else 0."""
        for node in self._chain(paragraph):
            name = _value(node, "name") or ""
            if name.lower() == "title":
                return 1
            outline = _value(node, "pPr/outlineLvl")
            if outline is not None and outline.isdigit():
                return min(int(outline) + 1, 6) if int(outline) < 9 else 0
            if m := _HEADING.match(name):
                return max(1, min(int(m[1]), 6))
        # Files without a table of styles name the style alone.
        m = re.match(r"heading\s?(\d)$", _value(paragraph, "pPr/pStyle") or "", re.I)
        return max(1, min(int(m[1]), 6)) if m and not self._styles else 0

    def numbering(self, paragraph: Element) -> tuple[str, int, bool] | None:
        """(list, level from 1, whether its items have numbers) of a list's item."""
        for node in self._chain(paragraph):
            number = _value(node, "pPr/numPr/numId")
            if number is not None:
                if number == "0":
                    return None  # numbering taken away
                level = _value(node, "pPr/numPr/ilvl") or "0"
                return number, int(level) + 1 if level.isdigit() else 1, self._formats.get((number, level), "bullet") not in ("bullet", "none")
        return None
