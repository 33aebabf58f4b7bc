"""Parsers: sources (doc_id, uri, content, format) to documents (doc_id, markdown, page_spans, ...)."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.errors import ConfigError, ParseError, UnsupportedFormat
from siftwell.functions.text import is_blank
from siftwell.plans.component import Component, registry
from siftwell.sources import pdf
from siftwell.sources.detect import detect_format, image_mime
from siftwell.sources.html import html_markdown
from siftwell.sources.office import BROKEN, office_pages
from siftwell.sources.ocr import BATCH, MIN_CHARS, OcrEngine, OcrPolicy, page_windows, segment_plan
from siftwell.sources.folders import text_batches
from siftwell.sources.pages import PAGE_CHARS, assemble, assembled, decode_text, drop_blank, joined

#: windows of pages that one copy of a file is sent for
WINDOWS = 32
_COLUMNS = ("doc_id", "markdown", "page_spans", "page_count", "ocr_pages", "source_uri", "metadata")


class Parser(Component):
    kind = "parser"
    formats: tuple[str, ...] = ()

    def supports(self, fmt: str) -> bool:
        return fmt in self.formats

    def parse(self, sources: DataFrame) -> DataFrame:
        raise NotImplementedError

    @classmethod
    def _assembled(cls, sources: DataFrame, rows: DataFrame) -> DataFrame:
        """Documents of page rows; one whose pages are all blank, or that has none, is empty and stays."""
        kept = drop_blank(rows)
        found = sources.drop("content").join(assemble(kept), "doc_id", "left")
        if "span" in rows.columns:
            spans = kept.where("span is not null").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "span"))), lambda s: s["span"]), ",").alias("__spans"))
            own = F.col("metadata") if "metadata" in sources.columns else F.create_map().cast("map<string,string>")
            told = F.map_concat(F.map_filter(own, lambda name, _: name != "page_span"), F.create_map(F.lit("page_span"), F.col("__spans")))
            found = found.join(spans, "doc_id", "left").withColumn("metadata", F.when(F.col("__spans").isNull(), own).otherwise(F.coalesce(told, F.create_map(F.lit("page_span"), F.col("__spans"))))).drop("__spans")
        spans = "array<struct<page_number:int,start:int,end:int,ocr_applied:boolean>>"
        found = found.withColumn("markdown", F.coalesce("markdown", F.lit(""))).withColumn("page_spans", F.coalesce("page_spans", F.array().cast(spans)))
        return cls._documents(found.withColumn("page_count", F.coalesce("page_count", F.lit(0))).withColumn("ocr_pages", F.coalesce("ocr_pages", F.lit(0))))

    @staticmethod
    def _documents(df: DataFrame) -> DataFrame:
        if "metadata" not in df.columns:
            df = df.withColumn("metadata", F.create_map().cast("map<string,string>"))
        return df.withColumn("source_uri", F.col("uri")).select(*_COLUMNS)


@registry.register
class PlainTextParser(Parser):
    """Text and markdown, in pages of about page_chars characters cut at line ends."""

    name, formats = "plaintext", ("txt", "md")

    @dataclass
    class Config:
        encoding: str = "utf-8"
        page_chars: int = PAGE_CHARS

    def parse(self, sources):
        text = sources.withColumn("__text", decode_text(F.col("content"), self.config.encoding)).drop("content")
        return self._documents(assembled(text, self.config.page_chars, text="__text"))


@registry.register
class HtmlParser(Parser):
    """Web pages as markdown with ATX headings, one page each."""

    name, formats = "html", ("html",)

    def parse(self, sources):
        text = sources.withColumn("__text", html_markdown(decode_text(F.col("content")))).drop("content")
        return self._documents(assembled(text, 1 << 30, text="__text"))


@registry.register
class ConverterParser(Parser):
    """An injected converter, a function of (bytes, format), that gives the markdown of each page; blank pages go."""

    name, formats = "converter", ("pdf", "docx", "pptx", "xlsx", "html", "image")

    @dataclass
    class Config:
        page_batch_size: int = 8
        min_chars_digital: int = 32
        render_dpi: int = 200

    def __init__(self, convert: Callable[[bytes, str], list[str]] | None = None, config=None, **fields):
        super().__init__(config, **fields)
        if convert is None:
            raise ConfigError("the converter parser needs convert=")
        self.convert = convert

    def parse(self, sources):
        convert = self.convert

        @F.arrow_udf("array<struct<number:int,markdown:string>>")
        def pages(content: pa.Array, fmt: pa.Array) -> pa.Array:
            out = []
            for c, f in zip(content.to_pylist(), fmt.to_pylist(), strict=True):
                try:
                    out.append([{"number": n, "markdown": t} for n, t in enumerate(convert(c, f), 1)])
                except Exception as error:
                    raise ParseError(f"conversion failed: {error}") from error
            return pa.array(out, pa.list_(pa.struct([("number", pa.int32()), ("markdown", pa.string())])))

        rows = sources.select("doc_id", F.explode(pages(F.col("content"), F.col("format"))).alias("p")).select("doc_id", "p.*", F.lit(False).alias("ocr_applied"))
        return self._assembled(sources, rows)


@registry.register
class OfficeParser(Parser):
    """Texts, slides and workbooks, without a converter; blank pages go.

    A page is read when the one before it has been sent on, so a task holds an
    archive and one page's text.
    """

    name, formats = "office", ("docx", "pptx", "xlsx")

    def parse(self, sources: DataFrame) -> DataFrame:
        def rows(batches):
            for batch in batches:
                ids, type_ = batch["doc_id"], batch.schema.field("doc_id").type
                for i in range(batch.num_rows):
                    doc, held, size = ids[i].as_py(), [], 0
                    try:
                        for number, page in enumerate(office_pages(batch["content"][i].as_py() or b"", batch["format"][i].as_py()), 1):
                            held.append((doc, number, page))
                            size += len(page)
                            if size > 1 << 20:
                                yield _batch(held, type_)
                                held, size = [], 0
                    except BROKEN as error:
                        raise ParseError(f"{doc} is no office file that can be read: {error}") from error
                    if held:
                        yield _batch(held, type_)

        kind = sources.schema["doc_id"].dataType.simpleString()
        pages = sources.select("doc_id", "content", "format").mapInArrow(rows, f"doc_id {kind}, number int, markdown string")
        return self._assembled(sources, pages.withColumn("ocr_applied", F.lit(False)))


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    ids, numbers, texts = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(numbers, pa.int32()), pa.array(texts, pa.string())], names=["doc_id", "number", "markdown"])


@registry.register
class PagedParser(Parser):
    """Paged documents, whose pages go by their text layer or by OCR.

    probe gives the characters of each page's text layer, convert the markdown
    of the pages from one number to another, by default those of the PDF reader
    here; render gives one page's image and mime type.  Runs of pages that go the
    same way are cut into windows, which are converted in parallel; blank pages
    go.  A converter that knows no pages may give one text for a window: it
    becomes the window's first page, and the document's metadata tell what it
    spans (page_span: first-last, several by commas).

    With the reader here, which finds characters and text at once, a file is
    opened once and its document is put together where it was read.
    """

    name, formats = "paged", ("pdf",)

    @dataclass
    class Config:
        policy: OcrPolicy = OcrPolicy.AUTO
        page_batch_size: int = BATCH
        min_chars_digital: int = MIN_CHARS

    def __init__(self, probe=None, convert=None, render=None, engine: OcrEngine | None = None, config=None, **fields):
        super().__init__(config, **fields)
        if (probe is None) != (convert is None):
            raise ConfigError("the paged parser needs both of probe= and convert=, or neither")
        if engine is not None and render is None:
            raise ConfigError("OCR needs render=")
        if self.config.policy is OcrPolicy.FORCE and engine is None:
            raise ConfigError("forced OCR needs an engine")
        self.probe, self.convert, self.render, self.engine = probe or pdf.probe, convert or pdf.convert, render, engine

    def describe(self):
        return super().describe() | {"engine": self.engine.describe() if self.engine else None}

    def _read_once(self, sources: DataFrame) -> DataFrame:
        """Documents of sources in one pass; a task holds a file, about 1 MB of pages and the images of a batch."""
        render, engine, c = self.render, self.engine, self.config
        kinds = pa.list_(pa.struct([("number", pa.int32()), ("markdown", pa.string()), ("ocr_applied", pa.bool_())]))
        kept = [name for name in ("doc_id", "uri", "metadata") if name in sources.columns]

        def scanned(chars: int) -> bool:
            return c.policy is OcrPolicy.FORCE or (c.policy is OcrPolicy.AUTO and engine is not None and chars < c.min_chars_digital)

        def recognized(waiting: list[tuple]) -> None:
            texts = engine.recognize_batch([(image, mime) for _, image, mime in waiting]) if waiting else []
            for (page, _, _), text in zip(waiting, texts, strict=True):
                page["markdown"] = text
            waiting.clear()

        def rows(batches):
            for batch in batches:
                at, held, size, waiting = 0, [], 0, []
                for i in range(batch.num_rows):
                    content, pages = batch["content"][i].as_py(), []
                    for number, (chars, text) in enumerate(pdf.page_texts(content), 1):
                        scan = scanned(chars)
                        pages.append({"number": number, "markdown": None if scan else text, "ocr_applied": scan})
                        size += len(text)
                        if scan:
                            waiting.append((pages[-1], *render(content, number)))
                            if len(waiting) >= c.page_batch_size:
                                recognized(waiting)
                    held.append(pages)
                    if size > 1 << 20 or i + 1 == batch.num_rows:
                        recognized(waiting)
                        yield pa.RecordBatch.from_arrays([*(batch[name].slice(at, len(held)) for name in kept), pa.array(held, kinds)], names=[*kept, "p"])
                        at, held, size = i + 1, [], 0

        text_batches(sources.sparkSession)
        page = T.StructType().add("number", "integer").add("markdown", "string").add("ocr_applied", "boolean")
        schema = T.StructType([T.StructField(name, sources.schema[name].dataType) for name in kept]).add("p", T.ArrayType(page))
        read = sources.select(*kept, "content").mapInArrow(rows, schema)
        return self._documents(joined(read.withColumn("p", F.filter("p", lambda p: ~is_blank(p["markdown"]))), "p"))

    def parse(self, sources):
        probe, convert, render, c = self.probe, self.convert, self.render, self.config
        if probe is pdf.probe and convert is pdf.convert and (self.engine is None or type(self.engine).apply is OcrEngine.apply):
            return self._read_once(sources)

        @F.arrow_udf("array<int>")
        def counts(content: pa.Array) -> pa.Array:
            return pa.array([probe(x) for x in content.to_pylist()], pa.list_(pa.int32()))

        pages = sources.select("doc_id", F.posexplode(counts(F.col("content"))).alias("p", "chars")).select("doc_id", (F.col("p") + 1).alias("page"), "chars")
        plan = segment_plan(pages, c.min_chars_digital, c.policy, self.engine is not None)
        size = F.col("end") - F.col("start") + 1
        spans = plan.select("doc_id", "kind", "start", F.explode(page_windows(size, c.page_batch_size)).alias("w")).select("doc_id", "kind", (F.col("start") + F.col("w.start") - 1).alias("first"), (F.col("start") + F.col("w.end") - 1).alias("last"))
        # a file goes once with so many windows: it is not copied for each, and a long one is still several tasks
        together = spans.groupBy("doc_id", "kind", F.floor(F.col("first") / (c.page_batch_size * WINDOWS)).alias("share")).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("windows"))
        work = together.join(sources.select("doc_id", "content"), "doc_id")

        def paged(data: bytes, w: dict) -> list[dict]:
            made = convert(data, w["first"], w["last"])
            if isinstance(made, str):
                return [{"number": w["first"], "markdown": made, "last": w["last"]}]
            return [{"number": w["first"] + k, "markdown": page, "last": w["first"] + k} for k, page in enumerate(made)]

        @F.arrow_udf("array<struct<number:int,markdown:string,last:int>>")
        def digital(content: pa.Array, windows: pa.Array) -> pa.Array:
            out = [[p for w in ws for p in paged(data, w)] for data, ws in zip(content.to_pylist(), windows.to_pylist(), strict=True)]
            return pa.array(out, pa.list_(pa.struct([("number", pa.int32()), ("markdown", pa.string()), ("last", pa.int32())])))

        text = work.where("kind = 'text'").select("doc_id", F.explode(digital(F.col("content"), F.col("windows"))).alias("p"))
        rows = text.select("doc_id", "p.number", "p.markdown", F.lit(False).alias("ocr_applied"), F.when(F.col("p.last") > F.col("p.number"), F.concat("p.number", F.lit("-"), "p.last")).alias("span"))
        if self.engine is not None:

            @F.arrow_udf("array<struct<number:int,image:binary,mime:string>>")
            def image(content: pa.Array, windows: pa.Array) -> pa.Array:
                pages = lambda ws: (n for w in ws for n in range(w["first"], w["last"] + 1))
                out = [[dict(zip(("number", "image", "mime"), (n, *render(data, n)), strict=True)) for n in pages(ws)] for data, ws in zip(content.to_pylist(), windows.to_pylist(), strict=True)]
                return pa.array(out, pa.list_(pa.struct([("number", pa.int32()), ("image", pa.binary()), ("mime", pa.string())])))

            each = work.where("kind = 'ocr'").select("doc_id", "content", F.explode("windows").alias("w")).select("doc_id", "content", F.array("w").alias("windows"))
            images = each.select("doc_id", F.explode(image(F.col("content"), F.col("windows"))).alias("i")).select("doc_id", "i.*")
            rows = rows.unionByName(self.engine.apply(images).select("doc_id", "number", "markdown", "ocr_applied"), allowMissingColumns=True)
        return self._assembled(sources, rows)


#: the parser of each format
ROUTES = {"txt": "plaintext", "md": "plaintext", "html": "html", "pdf": "converter", "docx": "converter", "pptx": "converter", "xlsx": "converter", "image": "converter"}


@registry.register
class ImageParser(Parser):
    """Images as documents of one page, read by an OCR engine."""

    name, formats = "image", ("image",)

    def __init__(self, engine: OcrEngine | None = None, config=None, **fields):
        super().__init__(config, **fields)
        if engine is None:
            raise ConfigError("the image parser needs engine=")
        self.engine = engine

    def describe(self):
        return super().describe() | {"engine": self.engine.describe()}

    def parse(self, sources):
        images = sources.select("doc_id", F.lit(1).alias("number"), F.col("content").alias("image"), image_mime(F.col("content")).alias("mime"))
        return self._assembled(sources, self.engine.apply(images).select("doc_id", "number", "markdown", "ocr_applied"))


@registry.register
class AutoParser(Parser):
    """Each source by the parser of its detected format; a format without one is an error.

    PDF pages go by their text layer or by OCR (engine, render), with probe and
    pages in place of the reader here; images go to an engine.  With convert,
    office files, and what of PDF and images has no such way, go to it.
    """

    name, formats = "auto", tuple(ROUTES)

    @dataclass
    class Config:
        routes: Mapping[str, str] = field(default_factory=lambda: dict(ROUTES))
        parsers: Mapping[str, dict] = field(default_factory=dict)

    def __init__(self, convert=None, probe=None, pages=None, render=None, engine: OcrEngine | None = None, config=None, **fields):
        super().__init__(config, **fields)
        self.given = {"converter": {"convert": convert}, "paged": {"probe": probe, "convert": pages, "render": render, "engine": engine if render is not None else None}, "image": {"engine": engine}}
        own = {"pdf": "paged"} if convert is None or (probe is not None and pages is not None) else {}
        own |= {f: "office" for f in OfficeParser.formats} if convert is None else {}
        own |= {"image": "image"} if engine is not None else {}
        self.routes = dict(self.config.routes) | {f: p for f, p in own.items() if self.config.routes.get(f) == "converter"}
        self._made: dict[str, Parser] = {}

    def _parser(self, name: str) -> Parser:
        if name not in self._made:
            params = dict(self.config.parsers.get(name, {})) | self.given.get(name, {})
            self._made[name] = registry.create("parser", name, **params)
        return self._made[name]

    def parse(self, sources):
        rows = sources if "format" in sources.columns else detect_format(sources)
        found = [r.format for r in rows.select("format").distinct().collect()]
        if lost := sorted(set(found) - set(self.routes)):
            raise UnsupportedFormat(f"no parser for {', '.join(lost)}")
        out = None
        for name in sorted({self.routes[f] for f in found}):
            formats = [f for f in found if self.routes[f] == name]
            part = self._parser(name).parse(rows.where(F.col("format").isin(formats)))
            out = part if out is None else out.unionByName(part)
        if out is None:
            return self._parser("plaintext").parse(rows)
        return out
