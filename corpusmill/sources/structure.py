"""Structure-preserving reading: headings, paragraphs, list items, tables and code in reading order.

HTML and DOCX files become a table of blocks, or Markdown whose headings, lists and tables
the header chunker and the table serializer understand.  Sequential reading is one Arrow
pass; what follows from the blocks is native.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from itertools import islice
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions import chunking
from corpusmill.operators.chunks import row_sentence
from corpusmill.operators.shared import PASS_BYTES, bounded, importable
from corpusmill.sources.docx import MOST_SPAN, Docx, said, table_rows
from corpusmill.sources.html import _DROPPED

_UNREAD = (*_DROPPED, "title", "template")
#: Elements that begin and end a block of text.
_BLOCKS = frozenset("address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure form h1 h2 h3 h4 h5 h6 hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
_SPACE = re.compile(r"[ \t\n\r\f]+")


#: Blocks that leave a task together.
BATCH = 1_000
#: Lists deeper than this are set in no further.
MOST_INDENT = 20


@dataclass
class Block:
    """kind: heading, paragraph, item, quote, code or table; level: of a heading, or depth in lists; number: an item's, where it has one."""

    kind: str
    text: str = ""
    level: int = 0
    number: int | None = None
    rows: list[list[str]] | None = None
    headers: list[str] = field(default_factory=list)


def _under(blocks: list[Block]) -> list[Block]:
    """Each block with the headings it stands under, outermost first."""
    path: list[tuple[int, str]] = []
    for b in blocks:
        if b.kind == "heading":
            path = [p for p in path if p[0] < b.level]
        b.headers = [text for _, text in path]
        if b.kind == "heading":
            path.append((b.level, b.text))
    return blocks


def _times(value: str | None, most: int = MOST_SPAN) -> int:
    return max(1, min(int(value), most)) if value and value.isascii() and value.isdigit() else 1


def _grid(raw: list[list[tuple[str, int, int]]]) -> list[list[str]]:
    """Rows of cells (text, columns, rows); a cell that runs over columns or rows stands in each of its places; rows without text of their own go."""
    out: list[list[str]] = []
    below: dict[int, tuple[int, str]] = {}  # column: rows that a cell above still fills, and with what
    for cells in raw:
        line: list[str] = []
        ahead: dict[int, tuple[int, str]] = {}

        def take(line=line, ahead=ahead, below=below) -> None:
            while len(line) in below:
                left, text = below[len(line)]
                if left > 1:
                    ahead[len(line)] = (left - 1, text)
                line.append(text)

        for text, columns, rows in cells:
            take()
            for _ in range(columns):
                if rows > 1:
                    ahead[len(line)] = (rows - 1, text)
                line.append(text)
        take()
        below = ahead
        if any(text for text, _, _ in cells):
            out.append(line)
    return out


class _Reader(HTMLParser):
    """The blocks of a page, without scripts, styles and page furniture."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self._text: list[str] = []
        self._unread: list[str] = []
        self._lists: list[list[Any]] = []  # of each open list: whether it has numbers, the next one
        self._item: int | None | bool = False  # the number of an item whose text is to come
        self._heading = self._quotes = self._pre = self._tables = 0
        self._raw: list[list[tuple[str, int, int]]] = []
        self._cell: tuple[int, int] | None = None
        self.feed(html)
        self.close()
        self._flush()
        self._end_table()

    def _said(self) -> str:
        text = "".join(self._text)
        self._text = []
        if self._pre:
            return text.strip("\n") if text.strip() else ""
        lines = [_SPACE.sub(" ", x).strip(" ") for x in text.split("\0")]
        return "\n".join(lines).strip("\n")

    def _flush(self) -> None:
        """What was said since the last border is a block, but for a cell's, which goes on."""
        if self._cell is not None:
            self._text.append(" ")
            return
        text = self._said()
        if not text:
            return
        if self._pre:
            self.blocks.append(Block("code", text))
        elif self._heading:
            self.blocks.append(Block("heading", text.replace("\n", " "), self._heading))
        elif self._item is not False:
            self.blocks.append(Block("item", text, max(1, len(self._lists)), self._item))
            self._item = False
        else:
            self.blocks.append(Block("quote" if self._quotes else "paragraph", text, len(self._lists)))

    def _end_cell(self) -> None:
        if self._cell is not None:
            pre, self._pre = self._pre, 0
            text = self._said().replace("\n", " ")
            self._pre = pre
            self._raw[-1].append((_SPACE.sub(" ", text), *self._cell))
            self._cell = None

    def _end_table(self) -> None:
        self._end_cell()
        rows = _grid(self._raw)
        if rows:
            self.blocks.append(Block("table", rows=rows))
        self._raw, self._tables = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _UNREAD:
            self._flush()
            self._unread.append(tag)
        if self._unread:
            return
        if tag == "br":
            self._text.append("\n" if self._pre else "\0")
        if tag not in _BLOCKS:
            return
        self._flush()
        if tag == "table":
            self._tables += 1
        elif self._tables == 1 and tag == "tr":
            self._end_cell()
            self._raw.append([])
        elif self._tables == 1 and tag in ("td", "th"):
            self._end_cell()
            if not self._raw:
                self._raw.append([])
            spans = dict(attrs)
            self._text = []
            self._cell = (_times(spans.get("colspan")), _times(spans.get("rowspan")))
        elif self._cell is not None:
            return
        elif tag in ("ul", "ol"):
            start = dict(attrs).get("start")
            self._lists.append([tag == "ol", int(start) if start and re.fullmatch(r"-?[0-9]{1,9}", start) else 1])
        elif tag == "li":
            self._item = None
            if self._lists and self._lists[-1][0]:
                self._item = self._lists[-1][1]
                self._lists[-1][1] += 1
        elif tag == "blockquote":
            self._quotes += 1
        elif tag == "pre":
            self._pre += 1
        self._heading = int(tag[1]) if re.fullmatch("h[1-6]", tag) else 0

    def handle_endtag(self, tag: str) -> None:
        if self._unread:
            if tag in self._unread:
                while self._unread.pop() != tag:
                    pass
            return
        if tag not in _BLOCKS:
            return
        self._flush()
        if self._tables and tag == "table":
            self._tables -= 1
            if not self._tables:
                self._end_table()
        elif self._tables == 1 and tag in ("td", "th", "tr"):
            self._end_cell()
        elif self._cell is not None:
            return
        elif tag in ("ul", "ol") and self._lists:
            self._lists.pop()
            self._item = False
        elif tag == "li":
            self._item = False
        elif tag == "blockquote":
            self._quotes = max(0, self._quotes - 1)
        elif tag == "pre":
            self._pre = max(0, self._pre - 1)
        self._heading = 0

    def handle_data(self, data: str) -> None:
        if not self._unread:
            self._text.append(data)


def html_blocks(text: str) -> list[Block]:
    """Text between borders of block elements, its white space collapsed; br is a line break.  Tables inside cells are the cell's text."""
    return _under(_Reader(text.replace("\0", "")).blocks)


def docx_blocks(data: bytes) -> list[Block]:
    """Headings and lists by style, outline and numbering; rows of tables as they stand."""
    document = Docx(data)
    out: list[Block] = []
    counts: dict[str, list[int]] = {}
    for node in document.blocks():
        if node.tag.endswith("}tbl"):
            rows = [[_SPACE.sub(" ", c) for c in row] for row in table_rows(node)]
            if rows := [row for row in rows if any(row)]:
                out.append(Block("table", rows=rows))
            continue
        text = said(node).strip()
        if not text:
            continue
        level, item = document.level(node), document.numbering(node)
        if level:
            out.append(Block("heading", _SPACE.sub(" ", text), level))
        elif item:
            name, depth, numbered = item
            seen = counts.setdefault(name, [])
            seen[:] = (seen + [0] * depth)[:depth]
            seen[-1] += 1
            out.append(Block("item", text, depth, seen[-1] if numbered else None))
        else:
            out.append(Block("paragraph", text))
    return _under(out)


READERS: dict[str, Any] = {"html": html_blocks, "docx": docx_blocks}


def _plain(text: str) -> str:
    """Lines that Markdown would read as headings are marked as text."""
    return re.sub(r"(?m)^(#{1,6}\s)", r"\\\1", text)


def _written(b: Block) -> str:
    if b.kind == "heading":
        return f"{'#' * b.level} {b.text}"
    if b.kind == "table":
        names = [x.replace("|", "\\|") for x in b.rows[0]]
        return chunking.grid(names + [""] * (max(map(len, b.rows)) - len(names)), b.rows[1:])
    if b.kind == "code":
        return re.sub(r"(?m)^", "    ", b.text)
    if b.kind == "quote":
        return re.sub(r"(?m)^", "> ", b.text)
    indent = "  " * min(b.level - 1 if b.kind == "item" else b.level, MOST_INDENT)
    mark = "" if b.kind == "paragraph" else "- " if b.number is None else f"{b.number}. "
    return indent + mark + _plain(b.text).replace("\n", "\n" + indent + " " * len(mark))


def markdown(blocks: list[Block]) -> str:
    """Blocks apart by an empty line, items of a list each on the next line."""
    parts: list[str] = []
    for before, b in zip([None, *blocks], blocks, strict=False):
        if before is not None:
            parts.append("\n" if before.kind == b.kind == "item" else "\n\n")
        parts.append(_written(b))
    return "".join(parts)


def decoded_text(data: bytes) -> str:
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _some(rows: Iterator[tuple]) -> list[tuple]:
    """The next rows, up to a number and to an amount of text."""
    out: list[tuple] = []
    size = 0
    for row in islice(rows, BATCH):
        out.append(row)
        size += len(row[5] or "") + sum(len(cell) for cells in row[6] or () for cell in cells)
        if size > PASS_BYTES:
            break
    return out


def blocks(files: DataFrame, kind: str) -> DataFrame:
    """file_path, i, kind, level, number, text, rows, headers of HTML or DOCX files (file_path, content as bytes).

    A table's first row holds its column names.  A file that cannot be read is one row of kind
    ``error`` whose text tells why; one without text has no row, nor has one whose content is null.
    """
    importable(files.sparkSession)
    fields = T.StructType.fromDDL("file_path string, i int, kind string, level int, number int, text string, rows array<array<string>>, headers array<string>")

    def told(path: str, data: Any) -> Iterator[tuple]:
        try:
            found = READERS[kind](data if kind == "docx" else decoded_text(data))
        except Exception as failure:  # noqa: BLE001 - reported in the row
            found = [Block("error", f"{type(failure).__name__}: {failure}")]
        for i, b in enumerate(found):
            yield path, i, b.kind, b.level, b.number, b.text, b.rows, b.headers

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(fields)
        # Null contents are left out here: a filter in the plan would work the contents out twice.
        made = (row for batch in bounded(batches) for path, data in zip(*batch.columns, strict=True) if data.is_valid for row in told(path.as_py(), data.as_py()))
        while some := _some(made):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)

    return files.select("file_path", F.col("content").cast("binary").alias("content")).mapInArrow(run, fields)


def table_sentences(found: DataFrame) -> DataFrame:
    """file_path, i, row, headers, sentence: a sentence for each row of each table of ``blocks`` that has a filled cell; rows count from 1."""
    tables = found.where("kind = 'table'")
    rows = tables.select("file_path", "i", "headers", F.col("rows")[0].alias("names"), F.posexplode("rows").alias("row", "cells")).where("row > 0")
    return rows.select("file_path", "i", "row", "headers", row_sentence(F.col("names"), F.col("cells")).alias("sentence")).where("sentence IS NOT NULL")
