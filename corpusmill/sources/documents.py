"""Loaders: what a file's content and metadata become.

Text, Markdown, code, CSV and JSON are native column expressions over a table of
files; formats that need a parser (HTML, notebooks, DOCX, PDF) are one Arrow pass each.
A file that cannot be read has an ``error`` and no content; nothing else fails with it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.text import is_blank, strip
from corpusmill.operators.shared import PASS_BYTES, bounded, cut, importable
from corpusmill.sources import dispatch

FILE = "file_path string, file_name string, source_type string, title string, author string, language string, section_headers array<string>, custom_tags map<string,string>, content string, error string"


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def decoded(data: Column) -> Column:
    """UTF-8, or Latin-1 where the bytes are not valid UTF-8; a leading mark is not content."""
    return F.coalesce(F.try_validate_utf8(data.cast("string")), F.decode(data, "ISO-8859-1"))


def _tags(**tags: Column) -> Column:
    return F.create_map(*[x for k, v in tags.items() for x in (F.lit(k), v.cast("string"))])


def text_meta(content: Column) -> dict[str, Column]:
    """lines and characters of a text; lines are line breaks and one more."""
    return {"lines": F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1, "characters": F.length(content)}


def markdown_headers(content: Column) -> Column:
    """Every line that begins with # when stripped, without its # marks; empty ones go."""
    marked = F.filter(F.transform(F.split(content, "\n"), strip), lambda x: x.startswith("#"))
    return F.filter(F.transform(marked, lambda x: strip(F.regexp_replace(x, "^#+", ""))), lambda x: x != "")


def code_definitions(content: Column, word: str) -> Column:
    """Names after ``word`` ("def" or "class") at the beginning of stripped lines."""
    found = F.filter(F.transform(F.split(content, "\n"), strip), lambda x: x.startswith(f"{word} "))
    return F.transform(found, lambda x: strip(F.regexp_extract(x, rf"^{word} ([^(:]*)", 1)))


# Rows of tables


def csv_row_text(number: Column, names: list[str], values: list[Column], text_column: str | None = None) -> Column:
    """"[Row i]" and "name: value" lines of cells that are not blank, or the text column alone on the first line."""
    if text_column is not None:
        return F.concat(F.lit("[Row "), number.cast("string"), F.lit("] "), F.coalesce(values[names.index(text_column)].cast("string"), F.lit("")))
    cells = F.array_compact(F.array(*[F.when(~is_blank(F.coalesce(v.cast("string"), F.lit(""))), F.concat(F.lit(f"{n}: "), strip(v.cast("string")))) for n, v in zip(names, values, strict=True)]))
    return F.concat(F.lit("[Row "), number.cast("string"), F.lit("]"), F.when(F.size(cells) > 0, F.concat(F.lit("\n"), F.array_join(cells, "\n"))).otherwise(""))


def csv_rows(rows: DataFrame, order: str, columns: list[str], text_column: str | None = None, group: str | None = None) -> DataFrame:
    """``order``, i, row_text for every row of a table; i counts from 1 by ``order`` within ``group`` (a file).

    Without a group the whole table is one file, and is ranked by ranges, not in one task.
    """
    if group is None:
        from corpusmill.operators.preferences import ranked_globally

        ranked = ranked_globally(rows, [F.col(order)]).withColumnRenamed("rank", "i")
    else:
        ranked = rows.withColumn("i", F.row_number().over(Window.partitionBy(group).orderBy(order)))
    keys = [order] if group is None else [group, order]
    return ranked.select(*keys, "i", csv_row_text(F.col("i"), columns, [F.col(c) for c in columns], text_column).alias("row_text"))


# Parsers


def _pretty(value: Any) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False)


def parse_json(text: str, name: str) -> tuple[str, dict]:
    """Entries of an array or of JSON lines, numbered; an object as it is, indented."""
    if name.lower().endswith(".jsonl"):
        entries, out = [], []
        for i, line in enumerate((x for x in text.splitlines() if x.strip()), 1):
            try:
                entries.append(json.loads(line))
                out.append(f"[Entry {i}]\n{_pretty(entries[-1])}")
            except ValueError:
                out.append(f"[Line {i}] {line.strip()}")
        first = next((e for e in entries if isinstance(e, dict)), {})
        return "\n\n".join(out), {"custom_tags": {"format": "jsonl", "entries": str(len(out)), "sample_keys": ",".join(list(first)[:10])}}
    value = json.loads(text)
    if isinstance(value, list):
        first = value[0] if value and isinstance(value[0], dict) else {}
        return "\n\n".join(f"[Entry {i}]\n{_pretty(v)}" for i, v in enumerate(value, 1)), {"custom_tags": {"format": "json", "entries": str(len(value)), "sample_keys": ",".join(list(first)[:10])}}
    keys = list(value)[:10] if isinstance(value, dict) else []
    return _pretty(value), {"custom_tags": {"format": "json", "entries": "1", "sample_keys": ",".join(keys)}}


def parse_notebook(text: str, name: str) -> tuple[str, dict]:
    book = json.loads(text)
    joined = lambda x: "".join(x) if isinstance(x, list) else x or ""
    parts, counts, title = [], {"code": 0, "markdown": 0}, None
    language = book.get("metadata", {}).get("language_info", {}).get("name", "python")
    for i, cell in enumerate(book.get("cells", []), 1):
        kind, source = cell.get("cell_type"), joined(cell.get("source", ""))
        if kind in counts:
            counts[kind] += 1
        if not source.strip():
            continue
        if kind == "markdown":
            parts.append(f"[Markdown Cell {i}]\n{source}")
            if title is None and counts["markdown"] == 1:
                title = next((x.lstrip("#").strip() for x in source.split("\n") if x.startswith("#")), None)
        elif kind == "code":
            parts.append(f"[Code Cell {i}]\n```python\n{source}\n```")  # the fence says python whatever the kernel is
            for output in cell.get("outputs", []):
                shown = joined(output.get("text") if output.get("output_type") == "stream" else output.get("data", {}).get("text/plain") if output.get("output_type") == "execute_result" else "")
                if shown.strip():
                    parts.append(f"[Output]\n{shown}")
    meta = book.get("metadata", {})
    tags = {"format": "jupyter", "kernel": meta.get("kernelspec", {}).get("display_name", "Python"), "language_version": meta.get("language_info", {}).get("version", ""), "total_cells": str(len(book.get("cells", []))), "code_cells": str(counts["code"]), "markdown_cells": str(counts["markdown"])}
    return "\n\n".join(parts), {"title": title, "language": language, "custom_tags": tags}


def parse_html(text: str, name: str) -> tuple[str, dict]:
    from corpusmill.sources.html import Page

    page = Page(text)
    return page.text, {"title": page.title, "author": page.meta.get("author"), "section_headers": page.headers, "custom_tags": {"format": "html", "description": page.meta.get("description", ""), "keywords": page.meta.get("keywords", "")}}


def parse_docx(data: bytes, name: str) -> tuple[str, dict]:
    """Paragraphs, then rows of the tables, their filled cells joined by " | "; blank ones go."""
    from corpusmill.sources.docx import Docx, said, table_rows

    document = Docx(data)
    nodes = list(document.blocks())
    paragraphs = [said(n).strip() for n in nodes if n.tag.endswith("}p")]
    tables = [n for n in nodes if n.tag.endswith("}tbl")]
    rows = [" | ".join(filter(None, row)) for table in tables for row in table_rows(table)]
    core = document.core
    tags = {"format": "docx", "subject": core.get("subject", ""), "keywords": core.get("keywords", ""), "created": core.get("created", ""), "modified": core.get("modified", ""), "paragraphs": str(len(paragraphs)), "tables": str(len(tables))}
    return "\n\n".join(filter(None, [*paragraphs, *rows])), {"title": core.get("title") or None, "author": core.get("creator") or None, "custom_tags": tags}


def parse_pdf(data: bytes, name: str) -> tuple[str, dict]:
    """The texts of the pages that have any, with an empty line between."""
    from corpusmill.sources.pdf import read_pdf

    pages, info = read_pdf(data)
    tags = {"format": "pdf", "pages": str(len(pages)), "creator": info.get("Creator", ""), "producer": info.get("Producer", "")}
    return "\n\n".join(filter(None, pages)), {"title": info.get("Title"), "author": info.get("Author"), "custom_tags": tags}


PARSERS: dict[str, Callable[..., tuple[str, dict]]] = {"json": parse_json, "jupyter": parse_notebook, "html": parse_html, "docx": parse_docx, "pdf": parse_pdf}
_BINARY = ("docx", "pdf")
#: Bytes of such files that are read at once.
PACKED_BYTES = 500_000
#: Kinds that can be read with their structure.
STRUCTURED = ("docx", "html")


def parse_structured(data: Any, name: str, kind: str) -> tuple[str, dict]:
    """The plain parse with Markdown of headings, lists and tables in reading order as its content; the plain content where that finds none."""
    from corpusmill.sources import structure

    content, more = PARSERS[kind](data, name)
    try:
        found = structure.READERS[kind](data)
    except Exception:  # noqa: BLE001 - what the plain loader can read is read plainly
        found = []
    if found:
        content = structure.markdown(found)
        more = more | {"section_headers": [b.text for b in found if b.kind == "heading"]}
    return content, more | {"custom_tags": more["custom_tags"] | {"parser": "structured" if found else "fallback"}}


def _parsed(files: DataFrame, kind: str, structured: bool = False) -> DataFrame:
    """One Arrow pass over (file_path, file_name, data); a file's failure is its own row's error."""
    importable(files.sparkSession)
    ddl = "file_path string, file_name string, content string, title string, author string, language string, section_headers array<string>, custom_tags map<string,string>, error string"

    fields = T.StructType.fromDDL(ddl)

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, parse = to_arrow_schema(fields), PARSERS[kind]
        # Packed files unfold to many times their bytes.
        for batch in bounded(batches, most=PACKED_BYTES if kind in _BINARY else PASS_BYTES):
            rows = []
            for path, name, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row: dict[str, Any] = {"file_path": path, "file_name": name}
                try:
                    if kind not in _BINARY:
                        try:
                            data = data.decode()
                        except UnicodeDecodeError:
                            data = data.decode("latin-1")
                    row["content"], more = parse_structured(data, name, kind) if structured else parse(data, name)
                    row |= {k: list(v.items()) if k == "custom_tags" else v for k, v in more.items()}
                except Exception as failure:  # noqa: BLE001 - reported in the row
                    row["error"] = f"{type(failure).__name__}: {failure}"
                rows.append({n: row.get(n) for n in schema.names})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("file_path", "file_name", "content").mapInArrow(run, fields)


def _shape(rows: DataFrame, source_type: str, **columns: Column) -> DataFrame:
    """The file schema, with nulls for what a loader has not got."""
    have = set(rows.columns) | set(columns)
    rows = rows.withColumns(columns) if columns else rows
    kinds = {"title": "string", "author": "string", "language": "string", "section_headers": "array<string>", "custom_tags": "map<string,string>", "error": "string", "content": "string"}
    missing = {n: F.lit(None).cast(k) for n, k in kinds.items() if n not in have}
    full = rows.withColumns(missing) if missing else rows
    return full.select("file_path", "file_name", F.lit(source_type).alias("source_type"), F.coalesce(F.nullif("title", F.lit("")), stem(F.col("file_name"))).alias("title"), "author", "language", "section_headers", "custom_tags", "content", "error")


def load(files: DataFrame, kind: str, structured: bool = False) -> DataFrame:
    """Files (file_path, file_name, content as bytes) of one kind, loaded; ``structured`` gives HTML and DOCX as Markdown."""
    if structured and kind in STRUCTURED:
        return _shape(_parsed(files, kind, structured=True), "markdown")
    if kind in PARSERS:
        return _shape(_parsed(files, kind), {"jupyter": "code", "pdf": "pdf"}.get(kind, "text"))
    text = files.select("file_path", "file_name", decoded(F.col("content")).alias("content"))
    content = F.col("content")
    if kind == "markdown":
        headers = markdown_headers(content)
        return _shape(text, "markdown", section_headers=headers, title=F.get(headers, F.lit(0)), custom_tags=_tags(format=F.lit("markdown")))
    if kind == "code":
        names = lambda w: F.array_join(code_definitions(content, w), ",")
        return _shape(text, "code", language=dispatch.language(F.col("file_path")), custom_tags=_tags(format=F.lit("code"), language=dispatch.language(F.col("file_path")), functions=names("def"), classes=names("class"), lines=text_meta(content)["lines"]))
    if kind == "csv":
        return _shape(_csv_files(text), "text")
    meta = text_meta(content)
    return _shape(text, "text", custom_tags=_tags(format=F.lit("text"), extension=dispatch.extension(F.col("file_path")), lines=meta["lines"], characters=meta["characters"]))


def _csv_files(text: DataFrame, delimiter: str = ",") -> DataFrame:
    """Whole CSV files to row texts; a file is one value here, so its rows are parsed in its own row."""

    @F.pandas_udf("content string, columns string, rows int, error string")
    def parse(contents):
        import csv
        import io

        import pandas as pd

        out = []
        for content in contents:
            reader = csv.DictReader(io.StringIO(content), delimiter=delimiter)
            if not reader.fieldnames:
                out.append((None, None, None, "no header"))
                continue
            rows = []
            for i, row in enumerate(reader, 1):
                cells = [f"{k}: {v.strip()}" for k, v in row.items() if k and isinstance(v, str) and v.strip()]
                rows.append("\n".join([f"[Row {i}]", *cells]))
            out.append(("\n\n".join(rows), ",".join(reader.fieldnames), len(rows), None))
        return pd.DataFrame(out, columns=["content", "columns", "rows", "error"])

    read = text.select("file_path", "file_name", parse("content").alias("p"))
    return read.select("file_path", "file_name", "p.content", "p.error", _tags(format=F.lit("csv"), columns=F.col("p.columns"), column_count=F.size(F.split("p.columns", ",")), row_count=F.col("p.rows"), delimiter=F.lit(delimiter)).alias("custom_tags"))


def module_paths(files: DataFrame) -> DataFrame:
    """``files`` with module_path: the names of the folders above a file that have an ``__init__.py``, and the file's own, by dots.

    Folders are known by the files in the table; whether each is a package is looked up once a folder.
    """
    parent = F.regexp_replace("file_path", "/?[^/]*$", "")
    placed = files.withColumn("_folder", parent)
    packages = placed.where("file_name = '__init__.py'").select(F.col("_folder").alias("above")).distinct()
    parts = F.split("_folder", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    each = placed.select("_folder").distinct().select("_folder", F.posexplode(above).alias("depth", "above"))
    names = F.array_sort(F.collect_list(F.struct("depth", F.substring_index("above", "/", -1).alias("name"))))
    inside = each.join(packages, "above").groupBy("_folder").agg(F.transform(names, lambda x: x["name"]).alias("_names"))
    own = F.array(stem(F.col("file_name")))
    return placed.join(inside, "_folder", "left").withColumn("module_path", F.array_join(F.concat(F.coalesce("_names", F.array().cast("array<string>")), own), ".")).drop("_folder", "_names")


#: Bytes of a file of unknown kind that are looked at to tell whether it is text.
SNIFFED = 8192


def looks_like_text(head: bytes) -> bool:
    """Whether the first bytes of a file are UTF-8 without null bytes; a character may be cut off at their end."""
    import codecs

    try:
        codecs.getincrementaldecoder("utf-8")().decode(head)
    except UnicodeDecodeError:
        return False
    return b"\0" not in head


def list_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """uri, file_path, file_name, length of every file below a folder, those that Spark's readers pass over - empty ones, names that begin with _ - included.

    Folders are listed by tasks, a level at a time; names that begin with a dot, ignored
    folders and job markers are left out.
    """
    importable(spark)
    root = path if "://" in path or path.startswith("file:") else f"file://{path}"
    ddl = "uri string, file_path string, file_name string, length bigint, folder boolean"

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                files, place = fs.FileSystem.from_uri(uri)
                found = [x for x in files.get_file_info(fs.FileSelector(place)) if not x.base_name.startswith(".") and x.base_name not in (*dispatch.IGNORED, "_SUCCESS")]
                columns = [f"{uri.rstrip('/')}/{x.base_name}" for x in found], [x.path for x in found], [x.base_name for x in found], [x.size for x in found], [x.type == fs.FileType.Directory for x in found]
                kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["uri", "file_path", "file_name", "length", "folder"])

    level, levels = spark.createDataFrame([(root,)], "uri string"), []
    while True:
        levels.append(cut(level.mapInArrow(run, ddl), "listing"))
        level = levels[-1].where("folder").select("uri").repartition("uri")
        if not recursive or level.isEmpty():
            return reduce(DataFrame.unionByName, levels).where("not folder").drop("folder")


def _opened(files: DataFrame, most: int = dispatch.MAX_FILE_BYTES) -> DataFrame:
    """Files (uri, file_path, file_name, length, kind) with their content; one of unknown kind is text where its first bytes are, else an error, and no more of it is read."""
    importable(files.sparkSession)

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            for uri, path, name, length, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                content = error = None
                try:
                    files, place = fs.FileSystem.from_uri(uri)
                    with files.open_input_stream(place, compression=None) as stream:
                        head = stream.read(SNIFFED)
                        if kind == "unknown" and not looks_like_text(head):
                            error = "unsupported format"
                        elif length > most:
                            error = "file too large"
                        else:
                            content = head + stream.read()
                except Exception as failure:  # noqa: BLE001 - reported in the row
                    error = f"{type(failure).__name__}: {failure}"
                columns = ([path], [name], ["text" if kind == "unknown" else kind], [content], [error])
                kinds = (pa.string(), pa.string(), pa.string(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file_path", "file_name", "kind", "content", "error"])

    return files.select("uri", "file_path", "file_name", "length", "kind").mapInArrow(run, "file_path string, file_name string, kind string, content binary, error string")


def read_folder(spark: SparkSession, path: str, recursive: bool = True, kinds: tuple[str, ...] = tuple(dispatch.LOADERS), sniff: bool = False, modules: bool = False, structured: bool = False, max_bytes: int = dispatch.MAX_FILE_BYTES) -> DataFrame:
    """All supported files below a folder, loaded each by its kind.

    Files over ``max_bytes``, and kinds whose parser is missing, become error rows.  With
    ``sniff`` so do files of unknown kinds, but for those whose first bytes are text, which
    are loaded as such, and files that Spark's readers pass over (empty ones, names that begin
    with _): then every file has a row.  ``modules`` adds module_path, null but for code.
    ``structured`` reads HTML and DOCX as Markdown of their headings, lists and tables.
    """
    root = path.rstrip("/") + "/"

    def found(kind: str) -> DataFrame:
        """Files of one kind, by a glob on their names, so that each file is read by its own loader only."""
        names = ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in dispatch.LOADERS[kind])
        files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", f"*.{{{names}}}").load(path)
        base = F.regexp_replace("path", "^file:/+", "/")
        # Only components below the folder are held against the ignore list.
        below = F.when(base.startswith(root), F.substring(base, F.lit(len(root) + 1), F.length(base))).otherwise(base)
        return files.select(base.alias("file_path"), F.substring_index("path", "/", -1).alias("file_name"), "length", "content", below.alias("below")).where(~dispatch.ignored(F.col("below")))

    fits = F.col("length") <= max_bytes
    parts = []
    for kind in kinds:
        files = found(kind)
        parts += [load(files.where(fits), kind, structured), _shape(files.where(~fits).select("file_path", "file_name"), "text", error=F.lit("file too large"))]
    every = list_files(spark, path, recursive).withColumn("kind", dispatch.loader(F.col("file_path"))) if sniff or modules else None
    if sniff:
        # Only files of unknown kinds, and those that the readers above pass over, are opened here.
        passed = F.col("kind").isin("unknown", *kinds) & ((F.col("kind") == "unknown") | F.col("file_name").startswith("_") | (F.col("length") == 0))
        told = cut(_opened(every.where(passed), max_bytes), "opened")
        parts += [load(told.where((F.col("kind") == kind) & F.col("error").isNull()), kind, structured) for kind in kinds]
        parts.append(_shape(told.where("error is not null").select("file_path", "file_name", "error"), "text"))
    loaded = reduce(DataFrame.unionByName, parts)
    if not modules:
        return loaded
    named = module_paths(every.where("kind = 'code'").select("file_path", "file_name"))
    return loaded.join(named.select("file_path", "module_path"), "file_path", "left")
