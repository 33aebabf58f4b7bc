"""Routing of pages between their text layer and an OCR engine."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from enum import Enum

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.errors import ConfigError, OcrError
from siftwell.plans.component import Component, registry

MIN_CHARS = 32
BATCH = 8


class OcrPolicy(Enum):
    AUTO = "auto"
    FORCE = "force"
    NEVER = "never"


def page_windows(pages: Column, size: int = BATCH) -> Column:
    """Array of (start, end), inclusive, that covers 1..pages; windows are converted in parallel after an explode."""
    starts = F.when(pages > 0, F.sequence(F.lit(1), pages.cast("int"), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + size - 1, pages.cast("int")).alias("end")))


def segment_plan(counts: DataFrame, min_chars: int = MIN_CHARS, policy: OcrPolicy = OcrPolicy.AUTO, engine: bool = True, key: str = "doc_id") -> DataFrame:
    """(key, kind, start, end) of runs of pages (key, page, chars) that go the same way: gaps and islands."""
    scanned = F.col("chars") < min_chars
    by_policy = {OcrPolicy.AUTO: scanned if engine else F.lit(False), OcrPolicy.FORCE: F.lit(True), OcrPolicy.NEVER: F.lit(False)}[policy]
    if policy is OcrPolicy.FORCE and not engine:
        raise ConfigError("forced OCR needs an engine")
    kind = counts.withColumn("kind", F.when(by_policy, "ocr").otherwise("text"))
    by_page, by_kind = Window.partitionBy(key).orderBy("page"), Window.partitionBy(key, "kind").orderBy("page")
    island = kind.withColumn("island", F.row_number().over(by_page) - F.row_number().over(by_kind))
    return island.groupBy(key, "kind", "island").agg(F.min("page").alias("start"), F.max("page").alias("end")).drop("island")


class OcrEngine(Component):
    """Pages' images to markdown, in Arrow batches; one engine a worker."""

    kind = "ocr"

    def recognize(self, image: bytes, mime: str) -> str:
        raise NotImplementedError

    def recognize_batch(self, images: list[tuple[bytes, str]]) -> list[str]:
        return [self.recognize(i, m) for i, m in images]

    def apply(self, pages: DataFrame) -> DataFrame:
        """pages (image, mime, ...) with markdown and ocr_applied."""
        engine = self

        @F.arrow_udf("string")
        def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for images, mimes in batches:
                yield pa.array(engine.recognize_batch(list(zip(images.to_pylist(), mimes.to_pylist(), strict=True))), pa.string())

        return pages.withColumn("markdown", run(F.col("image"), F.col("mime"))).withColumn("ocr_applied", F.lit(True))


@registry.register
class CallableOcr(OcrEngine):
    """An injected service: a function of (bytes, mime type)."""

    name = "callable"

    def __init__(self, call: Callable[[bytes, str], str] | None = None):
        super().__init__()
        if call is None:
            raise ConfigError("the OCR engine needs call=")
        self.call = call

    def recognize(self, image, mime):
        try:
            return self.call(image, mime)
        except Exception as error:
            raise OcrError(f"recognition failed: {error}") from error
