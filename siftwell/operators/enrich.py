"""Enrichers: chunks and their documents to chunks with more searchable text."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.errors import EnrichmentError
from siftwell.functions.text import lstrip
from siftwell.plans.component import Component, registry

_HEADING = re.compile(r"^ {0,3}#{1,6}\s.*$", re.M)


class Enricher(Component):
    kind = "enricher"

    def enrich(self, chunks: DataFrame, documents: DataFrame) -> DataFrame:
        raise NotImplementedError


def enrich(chunks: DataFrame, documents: DataFrame, chain: list[Enricher]) -> DataFrame:
    """The chain in order; the empty chain changes nothing."""
    return reduce(lambda df, e: e.enrich(df, documents), chain, chunks)


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("off", T.IntegerType()), T.StructField("heading", T.StringType())])))
def headings(markdown: pa.Array) -> pa.Array:
    out = [[{"off": m.start(), "heading": m[0]} for m in _HEADING.finditer(t.as_py() or "")] for t in markdown]
    return pa.array(out, pa.list_(pa.struct([("off", pa.int32()), ("heading", pa.string())])))


@registry.register
class HeadingEnricher(Enricher):
    """Puts the last heading at or before a chunk's start in front of its text."""

    name = "heading"

    def enrich(self, chunks, documents):
        # a backward as-of join: the headings of a document are one short row
        found = documents.select(F.col("doc_id").cast("string").alias("doc_id"), headings(F.col("markdown")).alias("heads"))
        last = F.element_at(F.filter("heads", lambda h: h["off"] <= F.col("char_start")), -1)["heading"]
        above = F.when(F.size(F.filter("heads", lambda h: h["off"] <= F.col("char_start"))) > 0, last)
        rows = chunks.join(found, "doc_id", "left").withColumn("above", above)
        text = F.when(F.col("above").isNull() | F.startswith(lstrip(F.col("text")), F.col("above")), F.col("text")).otherwise(F.concat("above", F.lit("\n\n"), "text"))
        return rows.withColumn("text", text).select(*chunks.columns)


def completed(rows: DataFrame, column: str, prompt: str, complete: Callable[[str], str], error: type[Exception]) -> DataFrame:
    """rows with column, what complete says to each row's prompt; one call a row, in Arrow batches."""

    @F.arrow_udf("string")
    def call(prompts: pa.Array) -> pa.Array:
        out = []
        for p in prompts:
            try:
                out.append(complete(p.as_py()))
            except Exception as e:
                raise error(f"completion failed: {e}") from e
        return pa.array(out, pa.string())

    return rows.withColumn(column, call(F.col(prompt)))


@registry.register
class ContextualEnricher(Enricher):
    """Puts a sentence by a language model, which places the chunk in its document, in front of its text."""

    name = "contextual"

    @dataclass
    class Config:
        model: str = ""
        max_tokens: int = 128
        max_document_chars: int = 16000

    def __init__(self, complete: Callable[[str], str] | None = None, config=None, **fields):
        super().__init__(config, **fields)
        self.complete = complete

    def enrich(self, chunks, documents):
        if self.complete is None:
            raise EnrichmentError("the contextual enricher needs complete=, a function of a prompt")
        docs = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.substring("markdown", 1, self.config.max_document_chars).alias("__doc"))
        prompt = F.concat(F.lit("<document>\n"), "__doc", F.lit("\n</document>\n<chunk>\n"), "text", F.lit("\n</chunk>\nSay in one sentence what this chunk is about within the document."))
        rows = completed(chunks.join(docs, "doc_id").withColumn("__prompt", prompt), "__context", "__prompt", self.complete, EnrichmentError)
        return rows.withColumn("text", F.concat(F.trim("__context"), F.lit("\n\n"), "text")).select(*chunks.columns)


def synthetic(chunks: DataFrame, texts: DataFrame) -> DataFrame:
    """chunks with added ones (id of the parent, text): id parent#augN, marked synthetic, at the parent's place."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("id").orderBy("aug")) - 1
    added = chunks.join(texts.select("id", F.col("text").alias("aug")), "id").withColumn("n", n)
    mark = F.map_concat(F.coalesce("metadata", F.create_map().cast("map<string,string>")), F.create_map(F.lit("synthetic"), F.lit("true")))
    added = added.withColumn("metadata", mark).withColumn("text", F.col("aug")).withColumn("id", F.concat("id", F.lit("#aug"), "n"))
    return chunks.unionByName(added.select(*chunks.columns))
