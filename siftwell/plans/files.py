"""Office and PDF files made of lines of text, for queries and tests of their readers."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.sources.folders import text_batches

DOCX_PAGE, SLIDE, PDF_PAGE = 7, 5, 12
_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
_S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def _archive(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def _relations(targets: list[str]) -> str:
    return "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="{t}"/>' for i, t in enumerate(targets)) + "</Relationships>"


def docx(lines: list[str]) -> bytes:
    """The first line is a heading; a page break stands before every DOCX_PAGE lines."""
    body = []
    for i, line in enumerate(lines):
        if i and i % DOCX_PAGE == 0:
            body.append('<w:p><w:r><w:br w:type="page"/></w:r></w:p>')
        style = '<w:pPr><w:pStyle w:val="berschrift1"/></w:pPr>' if i == 0 else ""
        half = len(line) // 2
        body.append(f'<w:p>{style}<w:r><w:t xml:space="preserve">{escape(line[:half])}</w:t></w:r><w:r><w:t xml:space="preserve">{escape(line[half:])}</w:t></w:r></w:p>')
    styles = f'<w:styles {_W}><w:style w:type="paragraph" w:styleId="berschrift1"><w:name w:val="heading 1"/></w:style></w:styles>'
    return _archive({"word/styles.xml": styles, "word/document.xml": f"<w:document {_W}><w:body>{''.join(body)}</w:body></w:document>"})


def pptx(lines: list[str]) -> bytes:
    """SLIDE lines a slide, of which the first is the title; the slides' members are named in another order."""
    slides, n = {}, -(-len(lines) // SLIDE)
    for k in range(n):
        title, *rest = lines[SLIDE * k : SLIDE * (k + 1)]
        text = lambda lines: "".join(f"<a:p><a:r><a:t>{escape(x)}</a:t></a:r></a:p>" for x in lines)
        shapes = f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr><p:txBody>{text([title])}</p:txBody></p:sp><p:sp><p:txBody>{text(rest)}</p:txBody></p:sp>'
        slides[f"ppt/slides/slide{n - k}.xml"] = f"<p:sld {_P}><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:sld>"
    listed = "".join(f'<p:sldId id="{256 + k}" r:id="r{k}"/>' for k in range(n))
    return _archive(slides | {"ppt/presentation.xml": f"<p:presentation {_P} {_R}><p:sldIdLst>{listed}</p:sldIdLst></p:presentation>", "ppt/_rels/presentation.xml.rels": _relations([f"slides/slide{n - k}.xml" for k in range(n)])})


def xlsx(lines: list[str]) -> bytes:
    """A sheet of numbers and lines, every other one a shared string."""
    shared, rows = [], []
    for i, line in enumerate(lines, 1):
        if i % 2:
            cell = f'<c r="B{i}" t="s"><v>{len(shared)}</v></c>'
            shared.append(f"<si><r><t>{escape(line[:3])}</t></r><r><t>{escape(line[3:])}</t></r></si>")
        else:
            cell = f'<c r="B{i}" t="inlineStr"><is><t>{escape(line)}</t></is></c>'
        rows.append(f'<row r="{i}"><c r="A{i}"><v>{i}</v></c>{cell}</row>')
    return _archive({
        "xl/workbook.xml": f'<workbook {_S} {_R}><sheets><sheet name="S" sheetId="1" r:id="r0"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": _relations(["/xl/worksheets/sheet1.xml"]),
        "xl/sharedStrings.xml": f"<sst {_S}>{''.join(shared)}</sst>", "xl/worksheets/sheet1.xml": f"<worksheet {_S}><sheetData>{''.join(rows)}</sheetData></worksheet>",
    })


def pdf(pages: list[list[str]], modern: bool, scanned=frozenset()) -> bytes:
    """Pages of lines, those of scanned without their text.

    modern: object and cross-reference streams and a composite font; otherwise a
    table and, where it has all characters, Windows' Latin alphabet.
    """
    text = "".join(x for p in pages for x in p)
    latin = not modern and text == text.encode("cp1252", "ignore").decode("cp1252")
    if latin:
        font, maps = b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding>>", b""
        line = lambda x: b"(" + re.sub(rb"([()\\])", rb"\\\1", x.encode("cp1252")) + b")"
    else:
        codes = {c: k for k, c in enumerate(sorted(set(text)), 1)}
        pairs = "\n".join(f"<{k:04x}> <{c.encode('utf-16-be').hex()}>" for c, k in codes.items())
        maps = f"1 begincodespacerange <0000> <ffff> endcodespacerange\n{len(codes)} beginbfchar\n{pairs}\nendbfchar".encode()
        font = b"<</Type/Font/Subtype/Type0/BaseFont/F/Encoding/Identity-H/ToUnicode 4 0 R>>"
        digits = {c: f"{k:04x}" for c, k in codes.items()}
        line = lambda x: b"<" + "".join(map(digits.__getitem__, x)).encode() + b">"
    plain, streams = {1: b"<</Type/Catalog/Pages 2 0 R>>", 3: font}, {4: (b"", maps)}
    kids = []
    for n, lines in enumerate(pages, 1):
        at = 3 + 2 * n
        body = b"q 9 0 0 9 0 0 cm /I Do Q" if n in scanned else b"BT /F 9 Tf 12 TL " + b" T* ".join(b"[" + line(x[: len(x) // 2]) + b" -20 " + line(x[len(x) // 2 :]) + b"] TJ" for x in lines) + b" ET"
        plain[at] = b"<</Type/Page/Parent 2 0 R/Contents %d 0 R>>" % (at + 1)
        streams[at + 1] = (b"", body)
        kids.append(b"%d 0 R" % at)
    plain[2] = b"<</Type/Pages/Count %d/Resources<</Font<</F 3 0 R>>>>/Kids[%s]>>" % (len(pages), b" ".join(kids))
    size = max(plain | streams) + 1
    if modern:
        head, inner, at = b"", b"", {}
        for k, (number, held) in enumerate(sorted(plain.items())):
            at[number], head, inner = k, head + b"%d %d " % (number, len(inner)), inner + held + b" "
        streams[size] = (b"/Type/ObjStm/N %d/First %d" % (len(plain), len(head)), head + inner)
    out, places = bytearray(b"%PDF-1.5\n"), {}
    for number, held in () if modern else sorted(plain.items()):
        places[number] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (number, held)
    for number, (head, body) in sorted(streams.items()):
        places[number], packed = len(out), zlib.compress(body)
        out += b"%d 0 obj\n<</Filter/FlateDecode/Length %d%s>>\nstream\n%s\nendstream\nendobj\n" % (number, len(packed), head, packed)
    start = len(out)
    if not modern:
        out += b"xref\n0 %d\n0000000000 65535 f \n" % size + b"".join(b"%010d 00000 n \n" % places[n] for n in range(1, size))
        out += b"trailer\n<</Size %d/Root 1 0 R>>\n" % size
    else:
        entries = b"".join(b"\x02" + size.to_bytes(4, "big") + at[n].to_bytes(2, "big") if n in at else b"\x01" + places[n].to_bytes(4, "big") + b"\0\0" for n in range(1, size + 1))
        rows = b"".join(b"\x02" + bytes((b - a) & 255 for a, b in zip(before, row, strict=True)) for before, row in zip([bytes(7), *(entries[i : i + 7] for i in range(0, len(entries) - 7, 7))], [entries[i : i + 7] for i in range(0, len(entries), 7)], strict=True))
        packed = zlib.compress(rows)
        out += b"%d 0 obj\n<</Type/XRef/Size %d/Root 1 0 R/Index[1 %d]/W[1 4 2]/Filter/FlateDecode/DecodeParms<</Predictor 12/Columns 7>>/Length %d>>\nstream\n%s\nendstream\nendobj\n" % (size + 1, size + 2, size, len(packed), packed)
    return bytes(out + b"startxref\n%d\n%%%%EOF\n" % start)


def office_files(docs: DataFrame) -> DataFrame:
    """(doc_id, uri, content): docs (doc_id, text) as texts, slides and workbooks in turn."""
    makers = (("docx", docx), ("pptx", pptx), ("xlsx", xlsx))

    @F.arrow_udf("binary")
    def made(ids: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array([makers[i % 3][1]((t or "").split("\n")) for i, t in zip(ids.to_pylist(), texts.to_pylist(), strict=True)], pa.binary())

    names = F.element_at(F.array(*[F.lit(n) for n, _ in makers]), (F.col("doc_id") % 3 + 1).cast("int"))
    return docs.select("doc_id", F.concat(F.lit("f-"), "doc_id", F.lit("."), names).alias("uri"), made(F.col("doc_id"), F.col("text")).alias("content"))


def pdf_files(docs: DataFrame) -> DataFrame:
    """(doc_id, uri, content): docs (doc_id, text) in pages of PDF_PAGE lines; each page whose number and doc_id make a multiple of 5 is a scan."""

    def one(doc: int, text: str) -> bytes:
        lines = text.split("\n")
        pages = [lines[i : i + PDF_PAGE] for i in range(0, len(lines), PDF_PAGE)]
        return pdf(pages, doc % 2 == 1, {n for n in range(1, len(pages) + 1) if (n + doc) % 5 == 0})

    @F.arrow_udf("binary")
    def made(ids: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array([one(i, t or "") for i, t in zip(ids.to_pylist(), texts.to_pylist(), strict=True)], pa.binary())

    text_batches(docs.sparkSession)
    once = made.asNondeterministic()  # a condition on the content stays above it: pushed below, it would have files made once more
    return docs.select("doc_id", F.concat(F.lit("f-"), "doc_id", F.lit(".pdf")).alias("uri"), once(F.col("doc_id"), F.col("text")).alias("content"))
