"""Office and PDF files read without a converter."""

import io
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftwell.errors import ParseError
from siftwell.plans import files
from siftwell.sources import blobs, detect, office, parsers, pdf

LINES = ["Titel", "a <b> & c", "", "  drei | vier  ", "fünf 東京 🎉", "sechs", "sieben", "acht", "neun"]


def test_texts_have_headings_lists_tables_and_pages():
    w = files._W
    body = """<w:p><w:pPr><w:pStyle w:val="H2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>item</w:t><w:tab/><w:t>x</w:t></w:r><w:del><w:r><w:t>gone</w:t></w:r></w:del></w:p>
      <w:tbl><w:tr><w:tc><w:p><w:r><w:t>a|b</w:t></w:r></w:p><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>in</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:tc></w:tr></w:tbl>
      <w:p><w:r><w:t>end</w:t><w:br w:type="page"/><w:t>next</w:t><w:br/><w:t>line</w:t></w:r></w:p><w:p><w:pPr><w:outlineLvl w:val="2"/></w:pPr><w:r><w:t>Third</w:t></w:r></w:p>"""
    styles = f'<w:styles {w}><w:style w:styleId="H2"><w:name w:val="Heading 2"/></w:style></w:styles>'
    made = files._archive({"word/document.xml": f"<w:document {w}><w:body>{body}</w:body></w:document>", "word/styles.xml": styles})
    assert list(office.office_pages(made, "docx")) == ["## Head\n\n- item\tx\n\n| a\\|b c |  |\n| --- | --- |\n| 1 in |  |\n\nend", "next line\n\n### Third"]


def test_sheets_have_their_columns():
    sheet = '<row r="1"><c r="A1" t="inlineStr"><is><t>h</t></is></c><c r="C1" t="b"><v>1</v></c></row><row r="2"/><row r="3"><c r="AA3"><v>2.5</v></c></row>'
    made = files._archive({"xl/workbook.xml": f'<workbook {files._S} {files._R}><sheets><sheet name="N" r:id="r0"/><sheet name="leer" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": files._relations(["worksheets/a.xml", "worksheets/b.xml"]), "xl/worksheets/a.xml": f"<worksheet {files._S}>{sheet}</worksheet>"})
    first, second = office.office_pages(made, "xlsx")
    rows = first.split("\n")
    assert rows[0] == "## N" and rows[2].startswith("| h |  | TRUE |") and rows[4].endswith("| 2.5 |") and rows[4].count("|") == 28 and second == ""


@pytest.mark.parametrize("fmt", ["docx", "pptx", "xlsx"])
def test_made_office_files_come_back(spark, fmt):
    made = getattr(files, fmt)(LINES)
    source = blobs.with_doc_id(blobs.bytes_source(spark, [(f"x.{fmt}", made), (f"leer.{fmt}", getattr(files, fmt)([""]))], lang="de"))
    assert {r.format for r in detect.detect_format(source.drop("format")).collect()} == {fmt}
    docs = {r.source_uri: r for r in parsers.AutoParser().parse(source.drop("format")).collect()}
    doc, kept = docs[f"x.{fmt}"], [x.strip() for x in LINES if x.strip()]
    assert doc.metadata == {"lang": "de"}
    if fmt == "docx":
        assert doc.markdown == "\n\n".join(["# Titel", *kept[1:]]) and doc.page_count == 2 and [p.page_number for p in doc.page_spans] == [1, 2]
    elif fmt == "pptx":
        assert doc.markdown == "\n\n".join("# " + x if x in ("Titel", "sechs") else x for x in kept) and doc.page_count == 2
    else:
        assert doc.markdown.startswith("## S\n\n| 1 | Titel |\n| --- | --- |\n| 2 | a <b> & c |\n| 3 |  |\n| 4 | drei \\| vier |") and doc.page_count == 1
    assert docs[f"leer.{fmt}"].page_count == (1 if fmt == "xlsx" else 0)


def test_broken_office_files_are_errors(spark):
    bomb = files._archive({"word/document.xml": '<!DOCTYPE x [<!ENTITY a "aaaa">]><w:document xmlns:w="w"><w:t>&a;</w:t></w:document>'})
    cut = files.docx(LINES)[:-40]
    for content in (bomb, cut, files._archive({"word/document.xml": "<w:document"})):
        source = spark.createDataFrame([("d", "x.docx", bytearray(content), "docx")], "doc_id string, uri string, content binary, format string")
        with pytest.raises(Exception, match="no office file") as told:
            parsers.OfficeParser().parse(source).collect()
        assert ParseError.__name__ in str(told.value)
    with zipfile.ZipFile(io.BytesIO(files.docx([]))) as z:
        assert "word/document.xml" in z.namelist()


@pytest.mark.parametrize("modern", [False, True])
@pytest.mark.parametrize("damage", [None, b"startxref", b"xref\n0"])
def test_made_pdf_files_come_back(modern, damage):
    for pages in ([LINES, ["(x) \\ y", "z"], ["scan"]], [["only ascii", "é"], ["b"], ["c"]]):
        made = files.pdf(pages, modern, {3})
        made = made.replace(damage, b"?" * len(damage)) if damage else made
        assert list(pdf.page_texts(made)) == [(sum(map(len, p)), "\n".join(p)) for p in pages[:2]] + [(0, "")]
        assert pdf.probe(made)[2] == 0 and pdf.convert(made, 2, 3) == ["\n".join(pages[1]), ""]


def test_pdf_of_several_updates():
    made = files.pdf([["old", "text"]], False)
    at = len(made)
    body = b"BT /F 9 Tf 0 5 Td (ne) Tj <77> Tj 0 -9 TD (a\\\n\\050b\\)) ' T* [(c) -900 (d)] TJ ET"
    change = b"6 0 obj\n<</Length 7 0 R>>\nstream\n%s\nendstream\nendobj\n" % body
    second = at + len(change)
    change += b"7 0 obj\n%d\nendobj\n" % len(body)
    start = at + len(change)
    old = int(made.rsplit(b"startxref\n", 1)[1].split()[0])
    change += b"xref\n6 2\n%010d 00000 n \n%010d 00000 n \ntrailer\n<</Size 8/Root 1 0 R/Prev %d>>\nstartxref\n%d\n%%%%EOF\n" % (at, second, old, start)
    assert list(pdf.page_texts(made + change)) == [(9, "new\na(b)\nc d")]
    assert list(pdf.page_texts(made)) == [(7, "old\ntext")]


def test_pdf_files_that_cannot_be_read(spark):
    locked = files.pdf([["a"]], False).replace(b"/Root 1 0 R", b"/Root 1 0 R/Encrypt 1 0 R")
    for content, said in ((b"%PDF-1.4 nothing", "no PDF"), (locked, "encrypted")):
        with pytest.raises(ParseError, match=said):
            pdf.probe(content)
    assert pdf.text_layer(spark.createDataFrame([(1, None)], "doc_id long, content binary")).collect() == []


def test_pdf_pages_go_by_text_layer_or_engine(spark):
    made = files.pdf([["x" * 40], ["y" * 40], ["z" * 40]], True, {2})
    source = blobs.with_doc_id(blobs.bytes_source(spark, [("a.pdf", made)]))
    assert parsers.AutoParser().parse(source).first().markdown == "x" * 40 + "\n\n" + "z" * 40
    from siftwell.sources import ocr

    read = parsers.PagedParser(render=lambda data, n: (b"%d" % n, "image/png"), engine=ocr.CallableOcr(lambda image, mime: f"[{image.decode()}]")).parse(source).first()
    assert read.markdown == "x" * 40 + "\n\n[2]\n\n" + "z" * 40 and (read.page_count, read.ocr_pages) == (3, 1)
    assert pdf.text_layer(source.withColumn("more", F.lit(1))).select("page", "chars").collect() == [(1, 40), (2, 0), (3, 40)]


def test_pdf_files_are_made_and_read_once(spark, tmp_path):
    from siftwell.sources import ocr

    log = str(tmp_path / "log")
    pages = [["x" * 40], ["y" * 40], ["z" * 40]]

    def note(what):
        with open(log, "a") as f:
            f.write(what + "\n")

    @F.arrow_udf("binary")
    def made(ids: pa.Array) -> pa.Array:
        for i in ids.to_pylist():
            note(f"made {i}")
        return pa.array([files.pdf(pages, i % 2 == 1, {2}) for i in ids.to_pylist()], pa.binary())

    def seen(image, mime):
        note("seen")
        return f"[{image.decode()}]"

    docs = spark.range(6).select(F.col("id").alias("doc_id"), F.concat(F.lit("f-"), "id").alias("uri"))
    source = detect.detect_format(docs.withColumn("content", made.asNondeterministic()("doc_id")))
    read = parsers.AutoParser(render=lambda data, n: (b"%d" % n, "image/png"), engine=ocr.CallableOcr(seen)).parse(source)
    rows = read.select("doc_id", "markdown", "page_count", "ocr_pages").collect()
    assert sorted(r.doc_id for r in rows) == list(range(6))
    assert {(r.markdown, r.page_count, r.ocr_pages) for r in rows} == {("x" * 40 + "\n\n[2]\n\n" + "z" * 40, 3, 1)}
    with open(log) as f:
        lines = f.read().splitlines()
    assert all(lines.count(f"made {i}") == 2 for i in range(6))  # for the formats there are, and for the documents
    assert lines.count("seen") == 6
    assert "Join" not in read._jdf.queryExecution().toString()


def test_pdf_scans_reach_the_engine_in_batches_over_files(spark):
    from siftwell.sources import ocr

    class Batches(ocr.OcrEngine):
        name = "batches"

        def recognize_batch(self, images):
            return [f"{image.decode()} of {len(images)}" if image != b"3" else " " for image, _ in images]

    made = files.pdf([["x" * 40], ["y"], ["z" * 40]], False, {1, 3})
    source = spark.createDataFrame([(None, "a", made, {"k": "v"}), (1, "b", made, None), (1, "c", files.pdf([["w" * 40]], True), {})], "doc_id long, uri string, content binary, metadata map<string,string>").coalesce(1)
    parser = lambda **kw: parsers.PagedParser(render=lambda data, n: (b"%d" % n, "image/png"), engine=Batches(), page_batch_size=4, **kw).parse(source)
    got = [(r.doc_id, r.source_uri, r.markdown, r.metadata, r.page_count, r.ocr_pages, [(s.page_number, s.start, s.end) for s in r.page_spans]) for r in parser().collect()]
    assert sorted(got, key=lambda r: r[1]) == [
        (None, "a", "1 of 4\n\n2 of 4", {"k": "v"}, 2, 2, [(1, 0, 6), (2, 8, 14)]), (1, "b", "1 of 4\n\n2 of 2", None, 2, 2, [(1, 0, 6), (2, 8, 14)]), (1, "c", "w" * 40, {}, 1, 0, [(1, 0, 40)]),
    ]
    odd = source.withColumn("doc_id", F.struct(F.lit(1).alias("a b"))).withColumn("metadata", F.create_map(F.lit("a"), F.lit("b")))
    assert {(r.doc_id["a b"], r.metadata["a"]) for r in parsers.PagedParser().parse(odd).collect()} == {(1, "b")}
    assert [r.ocr_pages for r in parser(policy=ocr.OcrPolicy.FORCE).orderBy("source_uri").collect()] == [2, 2, 1]
    assert [(r.markdown, r.page_count, r.ocr_pages) for r in parser(policy=ocr.OcrPolicy.NEVER).orderBy("source_uri").collect()] == [("y", 1, 0), ("y", 1, 0), ("w" * 40, 1, 0)]


def test_codes_of_pdf_strings():
    assert pdf.value(b"<00 01 0>", 0) == (b"\0\1\0", 9) and pdf.value(b"<0 001>", 0) == (b"\0\1", 7) and pdf.value(b"<>", 0) == (b"", 2)
    assert pdf.value(b"(a b) (c(d)\\))", 0) == (b"a b", 5) and pdf.value(b"(c(d)\\))", 0) == (b"c(d))", 8)
    assert pdf.value(b"/A#42 1", 0) == ("AB", 5) and pdf.value(b"null ", 0) == (None, 4)
    font = pdf.Font(pdf.Pdf(files.pdf([["a"]], False)), {"Subtype": "Type0"})
    font.map.update({1: "a", 2: "ffi"})
    assert font.shown(b"\0\1\0\2\0\3\2") == "affi\ufffdffi" and font.shown(b"") == "" and set(font.map) == {1, 2}
