"""Plain-text paging, page assembly, and the way back from characters to pages."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.text import is_blank
from siftwell.sources.folders import text_batches

PAGE_CHARS = 8000
JOINER = "\n\n"


def page_ends(text: str, size: int) -> list[int]:
    """Ends of the pages of a text: after the last line break among the next size characters, or all of them."""
    ends, at, n = [], 0, len(text)
    while n - at >= size:
        at = text.rfind("\n", at, at + size) + 1 or at + size
        ends.append(at)
    if text[at:].strip():
        ends.append(n)
    return ends


def pages_udf(size: int):
    @F.arrow_udf("array<struct<number:int,markdown:string>>")
    def pages(text: pa.Array) -> pa.Array:
        out = []
        for value in text:
            t, at, found = value.as_py() or "", 0, []
            for number, end in enumerate(page_ends(t, size), 1):
                found.append({"number": number, "markdown": t[at:end]})
                at = end
            out.append(found)
        return pa.array(out, pa.list_(pa.struct([("number", pa.int32()), ("markdown", pa.string())])))

    return pages


def decode_text(content: Column, encoding: str = "UTF-8") -> Column:
    """Bytes as text; what cannot be decoded becomes U+FFFD."""
    return F.decode(content, encoding) if encoding.upper().replace("-", "") != "UTF8" else F.make_valid_utf8(content.cast("string"))


def plain_text_pages(documents: DataFrame, page_chars: int = PAGE_CHARS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, number, markdown, ocr_applied): a row for each page."""
    text_batches(documents.sparkSession)
    pages = documents.select(key, F.explode(pages_udf(page_chars)(F.col(text))).alias("p"))
    return pages.select(key, "p.number", "p.markdown", F.lit(False).alias("ocr_applied"))


def assemble(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, markdown, page_spans, page_count, ocr_pages): pages joined by an empty line, with their places."""
    ordered = F.array_sort(F.collect_list(F.struct("number", "markdown", "ocr_applied")))
    return joined(pages.groupBy(key).agg(ordered.alias("p")), "p")


def joined(documents: DataFrame, pages: str) -> DataFrame:
    """documents with their pages, an array (number, markdown, ocr_applied) in order, joined by an empty line, and their places."""
    none = F.array().cast("array<struct<page_number:int,start:int,end:int,ocr_applied:boolean>>")

    def place(spans: Column, p: Column) -> Column:
        begin = F.when(F.size(spans) == 0, F.lit(0)).otherwise(F.element_at(spans, -1)["end"] + len(JOINER))
        return F.concat(spans, F.array(F.struct(p["number"].cast("int").alias("page_number"), begin.cast("int").alias("start"), (begin + F.length(p["markdown"])).cast("int").alias("end"), p["ocr_applied"].alias("ocr_applied"))))

    return documents.select(
        *[c for c in documents.columns if c != pages],
        F.array_join(F.transform(pages, lambda p: p["markdown"]), JOINER).alias("markdown"),
        F.aggregate(pages, none, place).alias("page_spans"),
        F.size(pages).alias("page_count"),
        F.size(F.filter(pages, lambda p: p["ocr_applied"])).alias("ocr_pages"),
    )


def assembled(documents: DataFrame, page_chars: int = PAGE_CHARS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The same of plain texts, row by row and so without a shuffle."""
    text_batches(documents.sparkSession)
    paged = documents.withColumn("p", pages_udf(page_chars)(F.col(text)))
    none = F.array().cast("array<struct<page_number:int,start:int,end:int,ocr_applied:boolean>>")

    def place(spans: Column, p: Column) -> Column:
        begin = F.when(F.size(spans) == 0, F.lit(0)).otherwise(F.element_at(spans, -1)["end"] + len(JOINER))
        return F.concat(spans, F.array(F.struct(p["number"].alias("page_number"), begin.cast("int").alias("start"), (begin + F.length(p["markdown"])).cast("int").alias("end"), F.lit(False).alias("ocr_applied"))))

    out = paged.withColumn("markdown", F.array_join(F.transform("p", lambda p: p["markdown"]), JOINER)).withColumn("page_spans", F.aggregate("p", none, place)).withColumn("page_count", F.size("p"))
    return out.withColumn("ocr_pages", F.lit(0)).drop("p", *([text] if text != "markdown" else []))


def disassemble(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, number, markdown, ocr_applied) of every page, from assembled texts and their spans: the way back from assemble."""
    pages = documents.select(key, "markdown", F.explode("page_spans").alias("p"))
    return pages.select(key, F.col("p.page_number").alias("number"), F.substring("markdown", F.col("p.start") + 1, F.col("p.end") - F.col("p.start")).alias("markdown"), F.col("p.ocr_applied").alias("ocr_applied"))


def page_range(spans: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """First and last page that [start, end) overlaps; null where it lies between pages."""
    hit = F.filter(spans, lambda p: (p["start"] < end) & (p["end"] > start))
    return F.array_min(F.transform(hit, lambda p: p["page_number"])), F.array_max(F.transform(hit, lambda p: p["page_number"]))


def drop_blank(pages: DataFrame) -> DataFrame:
    return pages.where(~is_blank(F.col("markdown")))
