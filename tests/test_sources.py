import io
import zipfile

import pytest
from pyspark.sql import functions as F

from siftwell.errors import ConfigError, OcrError, StorageError, UnsupportedFormat
from siftwell.sources import blobs, detect, html, ocr, pages, parsers


def office(member):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(member, "x")
    return out.getvalue()


CASES = [
    ("a.txt", b"%PDF-1.7", "pdf"), ("a.txt", b"\x89PNG\r\n\x1a\n", "image"), ("a", b"\xff\xd8\xff\xe0", "image"), ("a", b"GIF89a", "image"), ("a", b"II*\x00", "image"), ("a", b"MM\x00*", "image"),
    ("a", b"RIFF\x00\x00\x00\x00WEBP", "image"), ("a", office("word/document.xml"), "docx"), ("a", office("ppt/x"), "pptx"), ("a", office("xl/x"), "xlsx"), ("a.docx", office("other"), "docx"), ("a.zip", office("other"), "unknown"),
    ("a.pptx", b"PK\x03\x04broken", "pptx"), ("a.bin", b"\n <!DOCTYPE HTML><p>", "html"), ("a", b"<html>", "html"), ("A.MD", b"text", "md"), ("a.htm", b"text", "html"), ("a", b"plain", "txt"), ("a", b"nul\x00", "unknown"),
    ("a", b"\xfe\xfe abcdef", "unknown"), ("a", b"cut " + "é".encode()[:1], "txt"), ("a", b"", "txt"), ("a.png", b"x", "image"), (None, b"x", "txt"),
]


def test_detection(spark):
    rows = [(n, u, bytearray(c)) for n, (u, c, _) in enumerate(CASES)]
    got = {r.n: r.format for r in detect.detect_format(spark.createDataFrame(rows, "n int, uri string, content binary")).collect()}
    assert [got[n] for n in range(len(CASES))] == [f for _, _, f in CASES]
    hinted = spark.createDataFrame([("a", bytearray(b"%PDF"), "md")], "uri string, content binary, format_hint string")
    assert detect.detect_format(hinted).first().format == "md"


def test_extension_of_the_detected_format(spark):
    df = spark.createDataFrame([("pdf", "x.txt"), ("image", "A.PNG"), ("unknown", "noext")], "f string, u string")
    assert [r[0] for r in df.select(detect.canonical_extension(F.col("f"), F.col("u"))).collect()] == [".pdf", ".png", ""]


@pytest.mark.parametrize(("text", "size", "lengths"), [("x" * 250, 100, [100, 100, 50]), ("line one\nline two\nline three\n", 12, [9, 9, 11]), ("  \n ", 100, []), ("", 5, []), ("ab\n" + " " * 20, 10, [3, 10, 10]), ("é" * 10, 10, [10])])
def test_paging(spark, text, size, lengths):
    df = spark.createDataFrame([("d", text)], "doc_id string, text string")
    rows = pages.plain_text_pages(df, size).orderBy("number").collect()
    assert [len(r.markdown) for r in rows] == lengths and [r.number for r in rows] == list(range(1, len(lengths) + 1))
    assert "".join(r.markdown for r in rows) == text[: sum(lengths)]


def test_assembly_and_page_ranges(spark):
    rows = [("d", 2, "B" * 100, True), ("d", 1, "A" * 100, False)]
    doc = pages.assemble(spark.createDataFrame(rows, "doc_id string, number int, markdown string, ocr_applied boolean")).first()
    assert doc.markdown == "A" * 100 + "\n\n" + "B" * 100 and [(p.start, p.end) for p in doc.page_spans] == [(0, 100), (102, 202)] and (doc.page_count, doc.ocr_pages) == (2, 1)
    df = spark.createDataFrame([(doc.page_spans, 90, 110), (doc.page_spans, 100, 102)], "s array<struct<page_number:int,start:int,end:int,ocr_applied:boolean>>, a int, b int")
    assert [tuple(r) for r in df.select(*pages.page_range(F.col("s"), F.col("a"), F.col("b"))).collect()] == [(1, 2), (None, None)]


def test_parsers(spark):
    rows = [("a.txt", b"hello\n"), ("b.html", b"<html><h1>T</h1><p>a <b>b</b></p><script>x</script>"), ("c.md", b"# H\n\xff")]
    sources = blobs.with_doc_id(blobs.bytes_source(spark, rows, lang="en"))
    out = {r.source_uri: r for r in parsers.AutoParser().parse(sources).collect()}
    assert out["a.txt"].markdown == "hello\n" and out["b.html"].markdown == "# T\n\na b" and out["c.md"].markdown == "# H\n�" and out["a.txt"].metadata == {"lang": "en"}
    with pytest.raises(UnsupportedFormat):
        parsers.AutoParser().parse(blobs.with_doc_id(blobs.bytes_source(spark, [("x", b"\x00")])))
    made = parsers.AutoParser(convert=lambda data, fmt: [f"{fmt} {len(data)}", " "]).parse(blobs.with_doc_id(blobs.bytes_source(spark, [("x.pdf", b"%PDF")]))).first()
    assert (made.markdown, made.page_count) == ("pdf 4", 1)


def test_paged_documents_by_text_layer_and_ocr(spark):
    content = b"a" * 50 + b"|" + b"b" * 3 + b"|" + b"c" * 40 + b"| |" + b"d" * 60
    pages_of = lambda data: data.decode().split("|")
    parts = {"probe": lambda data: [len(p) for p in pages_of(data)], "convert": lambda data, a, b: pages_of(data)[a - 1 : b], "render": lambda data, page: (pages_of(data)[page - 1].encode(), "image/png")}
    source = blobs.with_doc_id(blobs.bytes_source(spark, [("x.pdf", content)]))
    engine = ocr.CallableOcr(lambda image, mime: f"[{image.decode()}]")
    doc = parsers.PagedParser(**parts, engine=engine, page_batch_size=2).parse(source).first()
    assert doc.markdown == "\n\n".join(["a" * 50, "[bbb]", "c" * 40, "[ ]", "d" * 60]) and (doc.page_count, doc.ocr_pages) == (5, 2)
    plain = parsers.PagedParser(**parts).parse(source).first()
    assert (plain.page_count, plain.ocr_pages) == (4, 0)
    forced = parsers.PagedParser(**parts, engine=engine, policy=ocr.OcrPolicy.FORCE).parse(source).first()
    assert forced.ocr_pages == 5
    with pytest.raises(ConfigError):
        parsers.PagedParser(**parts, policy=ocr.OcrPolicy.FORCE)
    # the automatic parser sends pdf pages and images the same way, where it is given the means
    auto = parsers.AutoParser(probe=parts["probe"], pages=parts["convert"], render=parts.get("render"), engine=ocr.CallableOcr(lambda image, mime: f"{mime} {len(image)}"))
    image = blobs.with_doc_id(blobs.bytes_source(spark, [("x.png", bytes.fromhex("89504E470D0A1A0A") + b"pixels"), ("empty.txt", b" \n "), ("d.pdf", b"%PDF-1 a")])).drop("format")
    docs = {r.source_uri: r for r in auto.parse(image).collect()}
    assert auto.routes["pdf"] == "paged" and auto.routes["image"] == "image" and docs["x.png"].page_count == docs["x.png"].ocr_pages == 1
    assert docs["empty.txt"].markdown == "" and docs["empty.txt"].page_count == 0 and set(docs) == {"x.png", "empty.txt", "d.pdf"}
    blank = parsers.ConverterParser(lambda data, fmt: [" ", ""]).parse(blobs.with_doc_id(blobs.bytes_source(spark, [("b.pdf", b"%PDF b")])).withColumn("format", F.lit("pdf"))).collect()
    assert [(r.markdown, r.page_count, r.page_spans) for r in blank] == [("", 0, [])]


def test_converters_without_pages_tell_what_they_span(spark):
    source = blobs.with_doc_id(blobs.bytes_source(spark, [("x.pdf", b"a"), ("y.pdf", b"abc")], lang="en"))
    parser = parsers.PagedParser(probe=lambda data: [99] * 5 if data == b"a" else [99], convert=lambda data, first, last: f"{data.decode()}{first}-{last}" if data == b"a" else ["one"], page_batch_size=2)
    docs = {r.source_uri: r for r in parser.parse(source).collect()}
    assert docs["x.pdf"].markdown == "a1-2\n\na3-4\n\na5-5" and docs["x.pdf"].metadata == {"lang": "en", "page_span": "1-2,3-4"} and docs["y.pdf"].metadata == {"lang": "en"}
    assert [(r.number, r.markdown) for r in pages.disassemble(parser.parse(source).where("source_uri = 'x.pdf'")).orderBy("number").collect()] == [(1, "a1-2"), (3, "a3-4"), (5, "a5-5")]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hi there")
    row = blobs.with_doc_id(blobs.read_sources(spark, str(tmp_path), team="x")).first()
    assert row.uri.endswith("a.txt") and row.metadata == {"team": "x"} and len(row.doc_id) == 64
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        blobs.read_sources(spark, str(tmp_path / "none")).collect()


def test_markdown_of_html():
    assert html.to_markdown("<title>no</title><h2>A&amp;B</h2><ul><li>x<li>y</ul>z<br>w<nav>menu</nav>") == "## A&B\n\n- x\n\n- y\n\nz w"


def test_ocr_plan_and_windows(spark):
    counts = spark.createDataFrame([("d", n + 1, c) for n, c in enumerate([500, 400, 0, 5, 999])], "doc_id string, page int, chars int")
    plan = lambda **kw: sorted((r.start, r.end, r.kind) for r in ocr.segment_plan(counts, **kw).collect())
    assert plan() == [(1, 2, "text"), (3, 4, "ocr"), (5, 5, "text")]
    assert plan(policy=ocr.OcrPolicy.FORCE) == [(1, 5, "ocr")] and plan(policy=ocr.OcrPolicy.NEVER) == plan(engine=False) == [(1, 5, "text")]
    w = spark.range(1).select(ocr.page_windows(F.lit(10), 4).alias("w"), ocr.page_windows(F.lit(0)).alias("none")).first()
    assert [(x.start, x.end) for x in w.w] == [(1, 4), (5, 8), (9, 10)] and w.none == []


def test_ocr_engine(spark):
    images = spark.createDataFrame([(1, bytearray(b"\x89PNG"))], "page int, image binary").withColumn("mime", detect.image_mime(F.col("image")))
    row = ocr.CallableOcr(lambda data, mime: f"{mime}:{len(data)}").apply(images).first()
    assert row.markdown == "image/png:4" and row.ocr_applied
    with pytest.raises(Exception, match="recognition failed"):
        ocr.CallableOcr(lambda data, mime: 1 / 0).apply(images).collect()
    assert issubclass(OcrError, Exception)


def test_blob_stores(spark, tmp_path):
    for store in (blobs.LocalBlobStore(str(tmp_path / "a")), blobs.HadoopBlobStore(spark, f"file://{tmp_path}/b")):
        store.put("x/y.bin", b"1")
        store.put("x/y.bin", b"22")
        assert store.get("x/y.bin") == b"22" and store.exists("x/y.bin") and not store.exists("x/none") and not store.exists("../z") and store.url("x/y.bin")
        for key in ("", "../z", "none"):
            with pytest.raises(StorageError):
                store.get(key)


def test_catalogue(spark):
    entries = blobs.Catalogue(spark)
    source = lambda name: detect.detect_format(blobs.with_doc_id(blobs.bytes_source(spark, [(name, b"same")])))
    entries.record(source("first.txt"))
    entries.record(source("second.txt"))
    assert [(r.source_uri, r.ext) for r in entries.documents().collect()] == [("first.txt", ".txt")]
    entries.record(source("third.txt"), overwrite=True)
    assert [r.source_uri for r in entries.documents().collect()] == ["third.txt"]
    doc_id = entries.documents().first().doc_id
    assert entries.source_uri(doc_id) == "third.txt" and entries.source_uri("none") is None
    assert entries.download_url(doc_id, blobs.LocalBlobStore("/tmp/x")).endswith(f"raw/{doc_id}/original.txt")
    with pytest.raises(ConfigError):
        entries.download_url(doc_id, None)


def test_parse_cache_computes_what_it_lacks(spark, tmp_path):
    calls = []

    def compute(rows):
        calls.append(rows.count())
        return rows.select("k", F.upper("v").alias("out"))

    df = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, v string")
    first = blobs.through_cache(df.limit(1), spark, str(tmp_path / "c"), ["k"], compute).count()
    out = blobs.through_cache(df, spark, str(tmp_path / "c"), ["k"], compute).orderBy("k").collect()
    assert first == 1 and calls == [1, 1] and [r.out for r in out] == ["X", "Y"]
