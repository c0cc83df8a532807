"""Chunkers and enrichment: tables of files to tables of chunks.

Spans come from one Arrow pass per document (splitting is sequential); everything after
that - ids, exploding, prefixes - is native.  A file table has file_path, content,
source_type, title, section_headers and language; any of the last three may be absent.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions import chunking
from corpusmill.functions.text import chunk_id, collapse_space, strip
from corpusmill.operators.shared import bounded, importable
from corpusmill.schema import ChunkConfig

PIECES = "array<struct<content:string,headers:array<string>,tags:map<string,string>,parent:string,is_parent:boolean>>"


def _plain(pieces: list[chunking.Piece]) -> list[tuple]:
    return [(p.content, p.headers, list(p.tags.items()), None, None) for p in pieces]


def definition_names(files: DataFrame) -> DataFrame:
    """``files`` with name: what the definition that a file begins with is called, in its language."""
    importable(files.sparkSession)

    @F.pandas_udf("string")
    def name(content, language):
        return content.combine(language, lambda c, k: chunking.definition_name(c or "", k or ""))

    return files.withColumn("name", name("content", "language"))


def route(source_type: str, language: str, mode: str) -> str:
    """The chunker that the setting names, or else the one for the source."""
    if mode != "auto":
        return mode
    return {"markdown": "markdown", "code": "code"}.get(source_type, "recursive")


class Splitter:
    """Splits texts by the settings; the embedder is any object with ``embed(list[str])``."""

    def __init__(self, config: ChunkConfig, embedder: Any = None) -> None:
        self.config, self.embedder = config, embedder

    def split(self, text: str, source_type: str, language: str) -> list[tuple]:
        c, kind = self.config, route(source_type, language, self.config.mode)
        if not text.strip():
            return []
        if kind in ("markdown", "late"):
            return _plain(chunking.by_headers(text, c.size, c.overlap))
        if kind == "code":
            return _plain(chunking.by_definitions(text, c.size, c.overlap, language))
        if kind == "semantic":
            if self.embedder is None:
                from corpusmill.operators.vectors import HashEmbedder

                self.embedder = HashEmbedder()
            return _plain(chunking.semantic(text, c.size, c.overlap, c.breakpoint, c.threshold, self.embedder.embed))
        if kind == "parent_child":
            out: list[tuple] = []
            for parent, children in chunking.parent_child(text, c.size, c.overlap, c.child_size, c.child_overlap):
                alone = len(children) <= 1
                out += [(p.content, parent.headers, [], parent.content, alone) for p in ([parent] if alone else children)]
            return out
        return _plain(chunking.by_size(text, c.size, c.overlap))


def chunk(files: DataFrame, config: ChunkConfig | None = None, embedder: Any = None) -> DataFrame:
    """file_path, i, chunk_id, content, section_headers, tags, parent_id, is_parent; blank files have no chunks.

    Values that the metadata of a document would share between its chunks are each
    chunk's own here.
    """
    config = config or ChunkConfig()
    importable(files.sparkSession)
    have = set(files.columns)
    optional = lambda name, kind: (F.col(name) if name in have else F.lit(None)).cast(kind).alias(name)
    source = files.select("file_path", F.coalesce("content", F.lit("")).alias("content"), F.coalesce(optional("source_type", "string"), F.lit("text")).alias("source_type"), F.coalesce(optional("language", "string"), F.lit("")).alias("language"), optional("title", "string"), optional("section_headers", "array<string>"))
    fields = T.StructType([*source.schema.fields, *T.StructType.fromDDL(f"pieces {PIECES}").fields])

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, splitter = to_arrow_schema(fields), Splitter(config, embedder)
        names = ("content", "headers", "tags", "parent", "is_parent")
        for batch in bounded(batches):
            texts, types, languages = (batch.column(i).to_pylist() for i in (1, 2, 3))
            pieces = [[dict(zip(names, p, strict=True)) for p in splitter.split(*args)] for args in zip(texts, types, languages, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces, schema.field("pieces").type)], names=schema.names)

    split = source.mapInArrow(run, fields)
    # A document's prefix is made once, before its chunks part; they carry the prefix and not the text.
    prefix = late_prefix(F.col("content"), F.col("title"), config.lead_chars) if config.mode == "late" else F.lit(None).cast("string")
    whole = split.select("file_path", "title", prefix.alias("prefix"), F.coalesce("section_headers", F.array().cast("array<string>")).alias("file_headers"), "pieces")
    each = whole.select("file_path", "title", "prefix", "file_headers", F.posexplode("pieces").alias("i", "p"))
    content = F.col("p.content")
    headers = F.concat("file_headers", "p.headers")
    if config.mode == "late":
        content = F.when(content.startswith("[Context:"), content).otherwise(F.concat("prefix", F.lit("\n\n"), content))
    parent = F.when(F.col("p.parent").isNotNull(), chunk_id(F.col("file_path"), F.lit(None).cast("int"), F.col("p.parent")))
    return each.select("file_path", "i", chunk_id(F.col("file_path"), F.lit(None).cast("int"), content).alias("chunk_id"), content.alias("content"), headers.alias("section_headers"), F.col("p.tags").alias("tags"), parent.alias("parent_id"), F.col("p.parent").alias("parent_text"), F.col("p.is_parent").alias("is_parent"), "title")


def header_path(text: Column, most: int = 4) -> Column:
    """The first headers' texts joined by " > "."""
    found = F.regexp_extract_all(text, F.lit(r"(?Udm)^(#{1,6})\s+(.+)$"), F.lit(2))
    return F.array_join(F.slice(F.transform(found, strip), 1, most), " > ")


def late_prefix(text: Column, title: Column, lead_chars: int = 300) -> Column:
    """[Context: header path or title | the text's first characters]."""
    path = F.coalesce(F.nullif(header_path(text), F.lit("")), title, F.lit(""))
    return F.concat(F.lit("[Context: "), path, F.lit(" | "), F.substring(collapse_space(text), 1, lead_chars), F.lit("]"))


def contextual_prefix(chunks: DataFrame, lead_chars: int = 300) -> DataFrame:
    """Content prefixed by its own header path (or title) and lead; a new id; already prefixed ones stay."""
    heading = F.coalesce(F.nullif(F.array_join("section_headers", " > "), F.lit("")), F.col("title"), F.lit(""))
    lead = F.substring(collapse_space(F.col("content")), 1, lead_chars)
    needed = ~F.col("content").startswith("[Context:") & ((heading != "") | (lead != ""))
    content = F.when(needed, F.concat(F.lit("[Context: "), heading, F.lit(" | "), lead, F.lit("]\n\n"), F.col("content"))).otherwise(F.col("content"))
    return _changed(chunks, content)


def _changed(chunks: DataFrame, content: Column) -> DataFrame:
    """New content, with a new id where it differs."""
    new = chunks.withColumn("_new", content)
    return new.withColumns({"chunk_id": F.when(F.col("_new") != F.col("content"), chunk_id(F.col("file_path"), F.lit(None).cast("int"), F.col("_new"))).otherwise(F.col("chunk_id")), "content": F.col("_new")}).drop("_new")


def may_have_table(content: Column) -> Column:
    """The cheap test ahead of the scan for tables."""
    return F.contains(content, F.lit("|")) & F.contains(content, F.lit("---"))


def serialize_tables(chunks: DataFrame, mode: str = "both") -> DataFrame:
    """Pipe tables in contents written out as sentences; only chunks that pass the cheap test reach Python."""
    if mode == "markdown":
        return chunks

    @F.pandas_udf("string")
    def serialized(contents):
        return contents.map(lambda t: chunking.serialize_tables(t, mode))

    importable(chunks.sparkSession)
    has = may_have_table(F.col("content"))
    done = _changed(chunks.where(has), serialized(F.col("content")))
    return done.unionByName(chunks.where(~F.coalesce(has, F.lit(False))))


def row_sentence(headers: Column, cells: Column) -> Column:
    """One sentence for a row: "header: cell; ..." over cells that are not blank; null if none is."""
    parts = F.filter(F.zip_with(F.slice(headers, 1, F.least(F.size(headers), F.size(cells))), F.slice(cells, 1, F.least(F.size(headers), F.size(cells))), lambda h, c: F.when(strip(F.coalesce(c, F.lit(""))) != "", F.concat(strip(h), F.lit(": "), strip(c)))), lambda p: p.isNotNull())
    return F.when(F.size(parts) > 0, F.concat(F.array_join(parts, "; "), F.lit(".")))


def grid_row(cells: Column, width: Column) -> Column:
    """A grid line of ``width`` cells: short rows filled up, long ones cut, pipes escaped."""
    clean = F.transform(cells, lambda c: F.replace(strip(F.coalesce(c, F.lit(""))), F.lit("|"), F.lit("\\|")))
    filled = F.slice(F.concat(clean, F.array_repeat(F.lit(""), F.greatest(F.lit(0), width - F.size(cells)))), 1, width)
    return F.concat(F.lit("| "), F.array_join(filled, " | "), F.lit(" |"))


def redact_chunks(chunks: DataFrame, options: Any = None) -> DataFrame:
    """Contents redacted, ids kept; the copy of a parent's text is redacted as well."""
    from corpusmill.functions.pii import scan

    once = scan(chunks, "content", options)
    once = once.withColumn("content", F.col("redacted_text")).withColumnRenamed("findings", "pii_findings").drop("redacted_text")
    if "parent_text" in chunks.columns:
        once = scan(once, "parent_text", options).withColumn("parent_text", F.col("redacted_text")).drop("findings", "redacted_text")
    return once
