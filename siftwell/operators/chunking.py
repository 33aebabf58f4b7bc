"""Chunkers: documents (doc_id, markdown, page_spans) to chunks."""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.errors import ConfigError
from siftwell.functions.text import is_blank, let
from siftwell.plans.component import Component, registry
from siftwell.sources.folders import text_batches
from siftwell.sources.pages import page_range

_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
#: a line that begins like this opens a section
HEADING = re.compile(r" {0,3}#{1,6}\s")
_LINE_END = re.compile(r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]")


class Breaks:
    """Where a text may be cut: after empty lines, else after lines; found once, looked up by bisection."""

    def __init__(self, text: str):
        self.lines = [m.start() for m in re.finditer("\n", text)]
        at = set(self.lines)
        self.empty = [i for i in self.lines if i + 1 in at]

    @staticmethod
    def _last(places: list[int], low: int, high: int) -> int | None:
        k = bisect_left(places, high) - 1
        return places[k] if k >= 0 and places[k] >= low else None

    def cut(self, start: int, size: int, limit: int) -> int:
        """End of the window at start: a break in its back half, else size characters, at most limit."""
        stop = start + size
        if stop >= limit:
            return limit
        half = start + size // 2
        if (i := self._last(self.empty, half, stop - 1)) is not None:
            return i + 2
        if (i := self._last(self.lines, half, stop)) is not None:
            return i + 1
        return stop

    def windows(self, start: int, limit: int, size: int, overlap: int):
        while start < limit:
            end = self.cut(start, size, limit)
            yield start, end
            if end >= limit:
                return
            start = end - overlap if end - overlap > start else end


def sections(text: str) -> list[tuple[int, int]]:
    """Spans between headings; what precedes the first is a span, and a text without headings is one."""
    if not text:
        return []
    starts = [0]
    begin = 0
    for m in _LINE_END.finditer(text):
        begin = m.end()
        if begin < len(text) and HEADING.match(text, begin):
            starts.append(begin)
    return list(zip(starts, [*starts[1:], len(text)], strict=True))


def _spans_udf(spans):
    @F.arrow_udf("array<struct<start:int,end:int>>")
    def udf(text: pa.Array) -> pa.Array:
        return pa.array([[{"start": a, "end": b} for a, b in spans(t.as_py() or "")] for t in text], _SPANS)

    return udf


class Chunker(Component):
    """Cuts each document into spans; a blank span is skipped and takes no index."""

    kind = "chunker"

    def spans(self, text: str):
        raise NotImplementedError

    def chunk(self, documents: DataFrame) -> DataFrame:
        """Chunks of documents; narrow but for nothing: each document's chunks stay in its row until they are exploded."""
        text_batches(documents.sparkSession)
        spans = _spans_udf(self.spans)(F.col("markdown"))
        # let: what makes the markdown would else move into the lambda and join a document's pages anew for each of its pieces
        pieces = let(F.col("markdown"), lambda m: F.transform("spans", lambda s: F.struct(s["start"].alias("s"), s["end"].alias("e"), F.substring(m, s["start"] + 1, s["end"] - s["start"]).alias("text"))))
        kept = documents.withColumn("spans", spans).withColumn("piece", F.filter(pieces, lambda p: ~is_blank(p["text"])))
        metadata = F.col("metadata") if "metadata" in documents.columns else F.lit(None).cast("map<string,string>")
        page_spans = F.col("page_spans") if "page_spans" in documents.columns else F.lit(None).cast("array<struct<page_number:int,start:int,end:int,ocr_applied:boolean>>")
        # an inner explode would let a filter on the number of pieces move below, and all that makes them be computed twice
        rows = kept.select(F.col("doc_id").cast("string").alias("doc_id"), metadata.alias("metadata"), page_spans.alias("ps"), F.posexplode_outer("piece").alias("index", "p")).where("p is not null")
        first, last = page_range(F.col("ps"), F.col("p.s"), F.col("p.e"))
        return rows.select(
            F.concat_ws(":", "doc_id", "index").alias("id"), "doc_id", F.col("p.text").alias("text"), F.col("index").cast("int").alias("index"), F.col("p.s").alias("char_start"), F.col("p.e").alias("char_end"), first.alias("page_start"), last.alias("page_end"), "metadata"
        )


@registry.register
class FixedChunker(Chunker):
    """Windows of a fixed size with overlap, cut at breaks in their back half."""

    name = "fixed"

    @dataclass
    class Config:
        chunk_chars: int = 1600
        overlap_chars: int = 200

    def __init__(self, config=None, **fields):
        super().__init__(config, **fields)
        if self.config.chunk_chars <= 0 or self.config.overlap_chars < 0:
            raise ConfigError("chunk_chars must be positive and overlap_chars not negative")

    def spans(self, text):
        return Breaks(text).windows(0, len(text), self.config.chunk_chars, self.config.overlap_chars)


@registry.register
class MarkdownChunker(Chunker):
    """One chunk for each heading's section."""

    name = "markdown-aware"

    def spans(self, text):
        return sections(text)


@registry.register
class MarkdownFixedChunker(Chunker):
    """Sections, and windows inside those that are too long."""

    name = "markdown-fixed"

    @dataclass
    class Config:
        max_chars: int = 1600
        overlap_chars: int = 200

    def spans(self, text):
        breaks = Breaks(text)
        for a, b in sections(text):
            if b - a <= self.config.max_chars:
                yield a, b
            else:
                yield from breaks.windows(a, b, self.config.max_chars, self.config.overlap_chars)
