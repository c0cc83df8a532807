"""Structured reading: HTML and DOCX to blocks and Markdown."""

import io
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import chunking
from corpusmill.operators import chunks as C
from corpusmill.plans.structure_queries import as_docx
from corpusmill.schema import ChunkConfig, IngestConfig
from corpusmill.sources import structure
from corpusmill.sources.documents import load, parse_docx, read_folder
from corpusmill.sources.docx import Docx, table_rows

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"'


def said(html):
    return [(b.kind, b.level, b.number, b.text or b.rows) for b in structure.html_blocks(html)]


def docx(body, **parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        for name, xml in parts.items():
            archive.writestr(f"word/{name}.xml", xml)
    return out.getvalue()


def test_lists_nest_and_count():
    got = said("<ul><li>a<ul><li>b</ul><li>c<p>more</ul><ol start=9><li>d<li><li>e</ol>")
    assert got == [("item", 1, None, "a"), ("item", 2, None, "b"), ("item", 1, None, "c"), ("paragraph", 1, None, "more"), ("item", 1, 9, "d"), ("item", 1, 11, "e")]


def test_text_between_borders():
    assert said("a <b>b</b>\n c<br> d<p>e &amp; f</p>g<script>no</script><nav><p>no</nav>") == [("paragraph", 0, None, "a b c\nd"), ("paragraph", 0, None, "e & f"), ("paragraph", 0, None, "g")]
    assert said("<pre>  x\n\n <b>y</b></pre><blockquote>q</blockquote>") == [("code", 0, None, "  x\n\n y"), ("quote", 0, None, "q")]
    for empty in ("", "   ", "<p></p>", "<table></table>", "<ul><li></ul>", "<title>t</title>", "<table><tr><td> </table>"):
        assert said(empty) == []


def test_spans_fill_their_places():
    rows = said('<table><tr><th rowspan=2>a<th colspan=2>b<tr><td>c<td>d<tr><td>e<td rowspan=0>f<td colspan=x>g</table>')[0][3]
    assert rows == [["a", "b", "b"], ["a", "c", "d"], ["e", "f", "g"]]
    assert said("<table><tr><td>x<table><tr><td>in<td>ner</table>y<td>z</table>") == [("table", 0, None, [["x in ner y", "z"]])]
    assert len(said("<table><tr><td colspan=99999>a</table>")[0][3][0]) == 100
    assert said("<table><caption>c</caption><td>a") == [("paragraph", 0, None, "c"), ("table", 0, None, [["a"]])]


def test_headings_above():
    found = structure.html_blocks("<p>0<h1>a</h1><h3>b</h3><p>1<h2>c</h2><p>2<h1>d</h1>")
    assert [(b.text, b.headers) for b in found] == [("0", []), ("a", []), ("b", ["a"]), ("1", ["a", "b"]), ("c", ["a"]), ("2", ["a", "c"]), ("d", [])]


def test_markdown_goes_through_chunker_and_serializer():
    html = "<h1>One</h1><p># text</p><pre># code</pre><h2>Two</h2><table><tr><td>k<td>v<tr><td>a<td>b</table><ul><li>x<li>y</ul>"
    text = structure.markdown(structure.html_blocks(html))
    assert text == "# One\n\n\\# text\n\n    # code\n\n## Two\n\n| k | v |\n| --- | --- |\n| a | b |\n\n- x\n- y"
    assert [p.headers for p in chunking.by_headers(text, 1000, 0)] == [["One"], ["Two"]]
    assert "k: a; v: b." in chunking.serialize_tables(text)


def test_deep_and_hostile_pages_take_linear_time():
    for made in (lambda n: "<ul><li>x" * n, lambda n: "<table><tr><td>" * n, lambda n: "<div><p>a<b>" * n, lambda n: '<table><tr><td colspan=100 rowspan=100>a' + "<tr><td>b" * n, lambda n: "<h1>" * n):
        spent = []
        for n in (4_000, 16_000):
            began = time.process_time()
            structure.markdown(structure.html_blocks(made(n)))
            spent.append(time.process_time() - began)
        assert spent[1] < 10 * spent[0] + 0.5


def test_docx_styles_lists_and_merged_cells():
    run = "<w:p><w:pPr>{}</w:pPr><w:r><w:t>{}</w:t></w:r></w:p>".format
    item = '<w:numPr><w:ilvl w:val="{}"/><w:numId w:val="1"/></w:numPr>'.format
    cell = "<w:tc><w:tcPr>{}</w:tcPr><w:p><w:r><w:t>{}</w:t></w:r></w:p></w:tc>".format
    table = f"<w:tbl><w:tr>{cell('<w:vMerge w:val=\"restart\"/>', 'a')}{cell('<w:gridSpan w:val=\"2\"/>', 'b')}</w:tr><w:tr>{cell('<w:vMerge/>', '')}{cell('', 'c')}{cell('', 'd')}</w:tr></w:tbl>"
    body = run('<w:pStyle w:val="T"/>', "title") + run(item(0), "i") + run(item(1), "ii") + run(item(1), "ij") + run(item(0), "j") + run(item(1), "jj") + run("", " ") + run('<w:outlineLvl w:val="1"/>', "out")
    body += f"<w:sdt><w:sdtContent>{table}</w:sdtContent></w:sdt>" + "<w:p><w:r><w:t>x</w:t><w:tab/><w:t>y</w:t><w:br/></w:r><mc:AlternateContent><mc:Fallback><w:r><w:t>no</w:t></w:r></mc:Fallback></mc:AlternateContent><w:del><w:r><w:delText>no</w:delText></w:r></w:del></w:p>"
    styles = f'<w:styles {NS}><w:style w:styleId="T"><w:name w:val="Title"/></w:style></w:styles>'
    lists = f'<w:numbering {NS}><w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="lowerRoman"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num></w:numbering>'
    data = docx(body, styles=styles, numbering=lists)
    got = [(b.kind, b.level, b.number, b.text or b.rows) for b in structure.docx_blocks(data)]
    assert got == [
        ("heading", 1, None, "title"), ("item", 1, 1, "i"), ("item", 2, 1, "ii"), ("item", 2, 2, "ij"), ("item", 1, 2, "j"), ("item", 2, 1, "jj"),
        ("heading", 2, None, "out"), ("table", 0, None, [["a", "b", "b"], ["a", "c", "d"]]), ("paragraph", 0, None, "x\ty"),
    ]
    content, meta = parse_docx(data, "x.docx")
    assert content == "title\n\ni\n\nii\n\nij\n\nj\n\njj\n\nout\n\nx\ty\n\na | b | b\n\na | c | d"
    assert meta["custom_tags"]["paragraphs"] == "9" and meta["custom_tags"]["tables"] == "1"


def test_broken_archives():
    for data in (b"", b"PK", docx("")[:60]):
        with pytest.raises((ValueError, zipfile.BadZipFile)):
            Docx(data)
    out = io.BytesIO()
    zipfile.ZipFile(out, "w").close()
    with pytest.raises(ValueError, match="no document"):
        Docx(out.getvalue())
    assert structure.docx_blocks(docx("")) == [] and table_rows(Docx(docx("<w:tbl/>")).body[0]) == []


def test_tables_of_files(spark):
    good, bad = "<h1>h</h1><table><tr><td>a<td>b<tr><td>1<td> <tr><td> <td> </table>".encode(), b"PK broken"
    html = spark.createDataFrame([("g", "g.html", good), ("e", "e.html", b""), ("n", "n.html", None), ("l", "l.html", "<p>é".encode("latin-1"))], "file_path string, file_name string, content binary")
    got = {(r["file_path"], r["i"]): (r["kind"], r["text"], r["headers"]) for r in structure.blocks(html, "html").collect()}
    assert got == {("g", 0): ("heading", "h", []), ("g", 1): ("table", "", ["h"]), ("l", 0): ("paragraph", "é", [])}
    assert [tuple(r) for r in structure.table_sentences(structure.blocks(html, "html")).collect()] == [("g", 1, 1, ["h"], "a: 1.")]
    docs = spark.createDataFrame([("b", "b.docx", bad), ("d", "d.docx", as_docx("t", ["x"], [["k"], ["v"]]))], "file_path string, file_name string, content binary")
    kinds = [(r["file_path"], r["kind"]) for r in structure.blocks(docs, "docx").orderBy("file_path", "i").collect()]
    assert kinds == [("b", "error"), ("d", "heading"), ("d", "paragraph"), ("d", "table")]
    rows = {r["file_path"]: r for r in load(docs, "docx", structured=True).collect()}
    assert rows["b"]["error"].startswith("BadZipFile") and rows["b"]["content"] is None
    assert rows["d"]["content"] == "## t\n\nx\n\n| k |\n| --- |\n| v |" and rows["d"]["source_type"] == "markdown" and rows["d"]["section_headers"] == ["t"]


def test_folder_read_with_structure(spark, tmp_path):
    (tmp_path / "p.html").write_text("<title>T</title><h1>One</h1><p>a</p><h2>Two</h2><p>b</p>")
    (tmp_path / "none.html").write_text("<nav>x</nav>")
    (tmp_path / "t.txt").write_text("plain")
    rows = {r["file_name"]: r for r in read_folder(spark, str(tmp_path), structured=True).collect()}
    assert rows["p.html"]["content"] == "# One\n\na\n\n## Two\n\nb" and rows["p.html"]["title"] == "T" and rows["p.html"]["custom_tags"]["parser"] == "structured"
    assert rows["none.html"]["content"] == "" and rows["none.html"]["custom_tags"]["parser"] == "fallback"
    assert rows["t.txt"]["content"] == "plain" and rows["t.txt"]["source_type"] == "text"
    files = read_folder(spark, str(tmp_path), structured=True).where(F.col("file_name") == "p.html").drop("section_headers")
    assert [(r["content"], r["section_headers"]) for r in C.chunk(files, ChunkConfig()).orderBy("i").collect()] == [("a", ["One"]), ("b", ["Two"])]


def test_ingest_with_structure(spark, tmp_path):
    from corpusmill.plans import jobs

    (tmp_path / "p.html").write_text("<h1>One</h1><table><tr><td>k<td>v<tr><td>a<td>b</table>")
    made, failed = jobs.ingest(spark, str(tmp_path), IngestConfig(structured=True))
    assert "k: a; v: b." in made.first()["content"] and failed.count() == 0
