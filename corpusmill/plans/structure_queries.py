"""Queries on structure: blocks of pages and of DOCX files, their Markdown, tables and sections; size guard; embedded chunks."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import chunks as C
from corpusmill.operators import vectors as V
from corpusmill.operators.shared import scratch
from corpusmill.plans import adapters as A
from corpusmill.plans.registry import query
from corpusmill.plans.text_queries import _ID, _STRIP, _TEXT_MARKS, _plain, _windows
from corpusmill.schema import ChunkConfig
from corpusmill.sources import structure
from corpusmill.sources.documents import load, read_folder

# Pages whose navigation is content: a heading and a list, or a table with a cell that runs over all rows.


def _pages(spark: SparkSession, d: str, html) -> DataFrame:
    return A.table(spark, d, "pages").select(F.col("page_id").cast("string").alias("file_path"), F.lit("p.html").alias("file_name"), html.cast("binary").alias("content"))


def _with_list(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d, F.replace(F.replace("html", F.lit("<nav>"), F.lit("<section><h2>Links</h2>")), F.lit("</nav>"), F.lit("</section>")))


_UNREAD = "replace(replace(html, '<nav>', '<section><h2>Links</h2>'), '</nav>', '</section>')"
for _pattern in ("<!--.*?-->", *(rf"<{t}\b.*?</{t}\s*>" for t in ("title", "script", "style", "footer", "header"))):
    _UNREAD = f"regexp_replace({_UNREAD}, '(?s){_pattern}', '', 'g')"
_BORDERS = "p|div|article|section|h1|h2|ul|li|body|html"
_MARKED = f"regexp_replace(regexp_replace({_UNREAD}, '</({_BORDERS})\\s*>', chr(1) || chr(2), 'g'), '<({_BORDERS})\\b[^>]*>', chr(1) || '\\1' || chr(2), 'g')"
_SAID = _plain("regexp_replace(regexp_replace(split_part(x, chr(2), 2), '<br\\s*/?>', chr(3), 'g'), '<[^>]*>', '', 'g')")
_LINES = f"trim(regexp_replace(regexp_replace(regexp_replace({_SAID}, '[ \\t\\n\\r\\f]+', ' ', 'g'), ' ?\\x03 ?', chr(10), 'g'), '^\\n+|\\n+$', '', 'g'))"
#: blocks(page_id, i, kind, level, text, headers)
_BLOCKS = f"""split AS (SELECT page_id, string_split({_MARKED}, chr(1)) AS xs FROM pages), piece AS (SELECT page_id, generate_subscripts(xs, 1) AS pos, unnest(xs) AS x FROM split),
said AS (SELECT page_id, pos, split_part(x, chr(2), 1) AS tag, {_LINES} AS text FROM piece),
plain AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS i, CASE WHEN tag IN ('h1', 'h2') THEN 'heading' WHEN tag = 'li' THEN 'item' ELSE 'paragraph' END AS kind,
  CASE tag WHEN 'h1' THEN 1 WHEN 'h2' THEN 2 WHEN 'li' THEN 1 ELSE 0 END AS level, text FROM said WHERE text <> ''),
placed AS (SELECT *, max(CASE WHEN kind = 'heading' AND level = 1 THEN i END) OVER w AS one, max(CASE WHEN kind = 'heading' AND level = 2 THEN i END) OVER w AS two FROM plain
  WINDOW w AS (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
blocks AS (SELECT b.page_id, b.i, b.kind, b.level, b.text, concat_ws('|', o.text, CASE WHEN (b.one IS NULL OR b.two > b.one) AND NOT (b.kind = 'heading' AND b.level <= 2) THEN t.text END) AS headers
  FROM placed b LEFT JOIN plain o ON o.page_id = b.page_id AND o.i = b.one AND NOT (b.kind = 'heading' AND b.level = 1) LEFT JOIN plain t ON t.page_id = b.page_id AND t.i = b.two)"""


@query(f"WITH {_BLOCKS} SELECT page_id, i::INT AS i, kind, level::INT AS level, text, headers FROM blocks")
def html_blocks(spark, d):
    """Headings, paragraphs and list items of pages in reading order, with the headings above each."""
    found = structure.blocks(_with_list(spark, d), "html")
    return found.select(F.col("file_path").cast("bigint").alias("page_id"), "i", "kind", "level", "text", F.array_join("headers", "|").alias("headers"))


_ESCAPED = "regexp_replace(text, '(^|\\n)(#{1,6}\\s)', '\\1\\\\\\2', 'g')"
#: written(page_id, i, kind, gap, md): a block's Markdown and what stands before it
_WRITTEN = f"""{_BLOCKS}, written AS (SELECT page_id, i, kind, text, CASE WHEN kind = 'item' AND lag(kind) OVER (PARTITION BY page_id ORDER BY i) = 'item' THEN chr(10) ELSE chr(10) || chr(10) END AS gap,
  CASE kind WHEN 'heading' THEN repeat('#', level) || ' ' || text WHEN 'item' THEN '- ' || replace({_ESCAPED}, chr(10), chr(10) || '  ') ELSE {_ESCAPED} END AS md FROM blocks)"""


@query(f"""WITH {_WRITTEN} SELECT page_id, substr(string_agg(gap || md, '' ORDER BY i), 3) AS content, 'structured' AS parser FROM written GROUP BY page_id""")
def html_markdown(spark, d):
    """Pages as Markdown of their headings, lists and paragraphs."""
    files = load(_with_list(spark, d), "html", structured=True)
    return files.select(F.col("file_path").cast("bigint").alias("page_id"), "content", F.element_at("custom_tags", "parser").alias("parser"))


@query(f"""WITH {_WRITTEN}, section AS (SELECT *, sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS s FROM written),
chunk AS (SELECT page_id, s, {_STRIP.format("string_agg(CASE WHEN kind = 'heading' THEN '' ELSE gap || md END, '' ORDER BY i)")} AS content, coalesce(max(CASE WHEN kind = 'heading' THEN text END), '') AS header FROM section GROUP BY page_id, s)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY s) - 1 AS INT) AS i, header, content FROM chunk WHERE content <> ''""")
def chunk_structured(spark, d):
    """Sections of structured pages: the header chunker on their Markdown."""
    made = C.chunk(load(_with_list(spark, d), "html", structured=True).drop("section_headers"), ChunkConfig(size=1_000_000, overlap=0))
    return made.select(F.col("file_path").cast("bigint").alias("page_id"), "i", F.coalesce(F.try_element_at("section_headers", F.lit(-1)), F.lit("")).alias("header"), "content")


_LINK = '<li><a href="([^"]*)">([^<]*)</a></li>'


@query(f"""WITH l AS (SELECT page_id, regexp_extract_all(html, '{_LINK}', 1) AS target, regexp_extract_all(html, '{_LINK}', 2) AS name FROM pages),
e AS (SELECT page_id, generate_subscripts(target, 1) AS row, unnest(target) AS target, unnest(name) AS name FROM l)
SELECT page_id, row::INT AS row, 'Links' AS headers, 'page: ' || page_id || CASE WHEN trim(target) = '' THEN '' ELSE '; target: ' || {_plain('trim(target)')} END || CASE WHEN trim(name) = '' THEN '' ELSE '; name: ' || {_plain('trim(name)')} END || '.' AS sentence FROM e""")
def html_table_sentences(spark, d):
    """Links of pages as a table whose first cell runs over all rows; a sentence a row."""
    first = F.concat(F.lit('<h2>Links</h2><table><thead><tr><th>page<th>target<th>name</tr></thead><tr><td rowspan="100">'), "page_id")
    rows = F.regexp_replace("html", _LINK, "<td>$1</td><td>$2</td><tr>")
    return structure.table_sentences(structure.blocks(_pages(spark, d, F.replace(F.replace(rows, F.lit("<nav><ul>"), first), F.lit("</ul></nav>"), F.lit("</table>"))), "html")).select(
        F.col("file_path").cast("bigint").alias("page_id"), "row", F.array_join("headers", "|").alias("headers"), "sentence"
    )


# DOCX files

_NAMES = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_STYLES = f'<w:styles {_NAMES}><w:style w:styleId="H"><w:name w:val="heading 2"/></w:style><w:style w:styleId="Own"><w:name w:val="own"/><w:basedOn w:val="H"/></w:style></w:styles>'
_LISTS = f'<w:numbering {_NAMES}><w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num></w:numbering>'
_ITEM = '<w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr>'


def as_docx(heading: str, lines: list[str], rows: list[list[str]]) -> bytes:
    """A DOCX file: a heading, lines as paragraphs, every third of them an item, a table; the heading is its title."""
    run = lambda t: f'<w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r>'
    paragraphs = [f'<w:p><w:pPr><w:pStyle w:val="Own"/></w:pPr>{run(heading)}</w:p>', *(f"<w:p><w:pPr>{_ITEM if i % 3 == 2 else ''}</w:pPr>{run(x)}</w:p>" for i, x in enumerate(lines))]
    table = "".join(f"<w:tr>{''.join(f'<w:tc><w:p>{run(c)}</w:p></w:tc>' for c in row)}</w:tr>" for row in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml", f"<w:document {_NAMES}><w:body>{''.join(paragraphs)}<w:tbl>{table}</w:tbl></w:body></w:document>")
        archive.writestr("word/styles.xml", _STYLES)
        archive.writestr("word/numbering.xml", _LISTS)
        archive.writestr("docProps/core.xml", f"<c><title>{escape(heading)}</title></c>")
    return out.getvalue()


def _docx_files(spark: SparkSession, d: str) -> DataFrame:
    rows = A.table(spark, d, "documents").select(F.col("doc_id").cast("string"), "source", "lang", "text")
    return A.written(rows, "x.docx", lambda i, s, k, t: as_docx(s, t.split("\n"), [["id", "", "language"], [i, "", k]]))


_DOC_LINES = f"SELECT doc_id, source, lang, list_transform(string_split(text, chr(10)), lambda x: {_STRIP.format('x')}) AS xs FROM documents"


@query(f"""WITH l AS ({_DOC_LINES}) SELECT doc_id, array_to_string(list_concat([source], list_filter(xs, lambda x: x <> ''), ['id | language', doc_id || ' | ' || lang]), chr(10) || chr(10)) AS content,
  source AS title, CAST(len(xs) + 1 AS VARCHAR) AS paragraphs, '1' AS tables FROM l""")
def load_docx(spark, d):
    """Each document written as a DOCX file and loaded: paragraphs, then rows of the table."""
    tag = lambda name: F.element_at("custom_tags", name).alias(name)
    return load(_docx_files(spark, d), "docx").select(F.col("file_path").cast("bigint").alias("doc_id"), "content", "title", tag("paragraphs"), tag("tables"))


@query(f"""WITH l AS ({_DOC_LINES}), e AS (SELECT doc_id, generate_subscripts(xs, 1) AS pos, unnest(xs) AS text FROM l), k AS (SELECT * FROM e WHERE text <> ''),
b AS (SELECT doc_id, pos, CASE WHEN pos % 3 = 0 THEN 'item' ELSE 'paragraph' END AS kind, CASE WHEN pos % 3 = 0 THEN 1 ELSE 0 END AS level,
  CASE WHEN pos % 3 = 0 THEN sum(CASE WHEN pos % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) END AS number, text, NULL AS cells FROM k
UNION ALL SELECT doc_id, 0, 'heading', 2, NULL, source, NULL FROM documents
UNION ALL SELECT doc_id, 1000000000, 'table', 0, NULL, '', 'id,,language;' || doc_id || ',,' || lang FROM documents)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INT) AS i, kind, level::INT AS level, number::INT AS number, text, cells FROM b""")
def docx_blocks(spark, d):
    """The same files as blocks: a heading by its style's parent, numbered items, a table."""
    cells = F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), ";")
    return structure.blocks(_docx_files(spark, d), "docx").select(F.col("file_path").cast("bigint").alias("doc_id"), "i", "kind", "level", "number", "text", cells.alias("cells"))


# Size guard


@query("""WITH f AS (SELECT c_nationkey, sum(length(c_name) + 1) AS bytes FROM customer GROUP BY c_nationkey), m AS (SELECT floor(avg(bytes)) AS most FROM f)
SELECT c_nationkey::INT AS c_nationkey, CASE WHEN bytes <= most THEN length(string_agg(c_name || chr(10), ''))::INT END AS characters, CASE WHEN bytes > most THEN 'file too large' END AS error
FROM f JOIN customer USING (c_nationkey), m GROUP BY c_nationkey, bytes, most""")
def size_guard(spark, d):
    """Customers written as a file for each nation; files longer than the mean are error rows and are not read."""
    at = scratch(spark, "folder")
    rows = A.table(spark, d, "customer").select("c_nationkey", "c_name")
    most = rows.groupBy("c_nationkey").agg(F.sum(F.length("c_name") + 1).alias("b")).agg(F.floor(F.avg("b"))).first()[0]
    rows.repartition("c_nationkey").write.partitionBy("c_nationkey").text(at)
    key = F.regexp_extract("file_path", r"c_nationkey=(\d+)", 1).cast("int")
    return read_folder(spark, at, max_bytes=most).select(key.alias("c_nationkey"), F.length("content").alias("characters"), "error")


# Embedded chunks


@query(f"""WITH RECURSIVE {A.FILES}, {_windows('files', 'doc_id, file_path', 1000, 200, _TEXT_MARKS)},
pieces AS (SELECT doc_id, file_path, a, {_STRIP.format('substr(content, a + 1, b - a)')} AS piece FROM spans)
SELECT {_ID} AS chunk_id, greatest(1, length(piece) // 4)::INT AS tokens, 'hash' AS embedder, 256 AS width, length(piece) > 0 AS filled FROM pieces WHERE piece <> ''""")
def chunk_embeddings(spark, d):
    """Chunks with the vectors of the embedder that no model's name gives."""
    made = C.chunk(A.files(spark, d), ChunkConfig(mode="recursive"))
    found = V.embed(made, "chunk_id", "content", V.get_embedder(""))
    return found.select("chunk_id", "tokens", "embedder", F.size("embedding").alias("width"), F.exists("embedding", lambda x: x > 0).alias("filled"))
