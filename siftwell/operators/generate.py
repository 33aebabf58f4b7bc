"""Generation: pack the best passages, answer, and cite."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.errors import ConfigError, GenerationError
from siftwell.plans.component import Component, registry

NO_CONTEXT = "I don't have enough context to answer that."


def pack(rows: DataFrame, max_chars: int) -> DataFrame:
    """candidates (qid, pos, text, ...) with marker and block, those whose blocks fit max_chars; the first always does.

    Blocks are joined by an empty line, which counts two characters.
    """
    w = Window.partitionBy("qid").orderBy("pos")
    numbered = rows.withColumn("marker", F.row_number().over(w).cast("int"))
    block = numbered.withColumn("block", F.concat(F.lit("["), F.col("marker").cast("string"), F.lit("] "), "text"))
    cost = F.length("block") + F.when(F.col("marker") > 1, 2).otherwise(0)
    used = block.withColumn("used", F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return used.where((F.col("marker") == 1) | (F.col("used") <= max_chars)).drop("used")


def contexts(packed: DataFrame) -> DataFrame:
    """(qid, prompt_block, citations) of packed rows; a query has as many rows as its budget holds."""
    entry = F.struct("marker", "block", "chunk_id", "doc_id", "page_start", "page_end")
    rows = packed.groupBy("qid").agg(F.array_sort(F.collect_list(entry)).alias("b"))
    cite = lambda b: F.struct(b["marker"].alias("marker"), b["chunk_id"].alias("chunk_id"), b["doc_id"].alias("doc_id"), b["page_start"].alias("page_start"), b["page_end"].alias("page_end"))
    return rows.select("qid", F.array_join(F.transform("b", lambda b: b["block"]), "\n\n").alias("prompt_block"), F.transform("b", cite).alias("citations"))


def resolve_citations(answers: DataFrame) -> DataFrame:
    """answers (text, citations) with the citations whose markers stand in the text; all, if none does."""
    marks = F.transform(F.regexp_extract_all("text", F.lit(r"\[(\d+)\]"), F.lit(1)), lambda m: m.try_cast("int"))
    return answers.withColumn("__used", F.filter("citations", lambda c: F.array_contains(marks, c["marker"]))).withColumn("citations", F.when(F.size("__used") > 0, F.col("__used")).otherwise(F.col("citations"))).drop("__used")


class Generator(Component):
    kind = "generator"

    @dataclass
    class Config:
        max_context_chars: int = 8000

    def complete(self, rows: DataFrame) -> DataFrame:
        """(qid, question, prompt_block, citations, first) with text and usage."""
        raise NotImplementedError

    def generate(self, queries: DataFrame, rows: DataFrame) -> DataFrame:
        """(qid, text, citations, usage) of every query, those without a passage too."""
        packed = pack(rows, self.config.max_context_chars)
        first = packed.where("marker = 1").select("qid", F.col("text").alias("first"))
        none = F.array().cast("array<struct<marker:int,chunk_id:string,doc_id:string,page_start:int,page_end:int>>")
        asked = queries.select("qid", F.col("text").alias("question")).join(contexts(packed), "qid", "left").join(first, "qid", "left")
        return resolve_citations(self.complete(asked.withColumn("citations", F.coalesce("citations", none)).withColumn("prompt_block", F.coalesce("prompt_block", F.lit(""))))).select("qid", "text", "citations", "usage")


@registry.register
class ExtractiveGenerator(Generator):
    """The best passage itself, with its marker."""

    name = "extractive"

    @dataclass
    class Config:
        max_context_chars: int = 4000

    def complete(self, rows):
        return rows.withColumn("text", F.coalesce(F.concat("first", F.lit(" [1]")), F.lit(NO_CONTEXT))).withColumn("usage", F.create_map().cast("map<string,double>"))


@registry.register
class ModelGenerator(Generator):
    """An injected language model: a function of a prompt that gives a text, or a text and what it used ({name: number}, such as tokens)."""

    name = "model"

    @dataclass
    class Config:
        model: str = ""
        max_tokens: int = 1024
        max_context_chars: int = 8000
        instruction: str = "Answer from the numbered passages alone and cite them as [n]. If they do not hold the answer, say so."

    def __init__(self, complete: Callable[[str], str] | None = None, config=None, **fields):
        super().__init__(config, **fields)
        if complete is None:
            raise ConfigError("the model generator needs complete=, a function of a prompt")
        self.call = complete

    def complete(self, rows):
        prompt = F.concat(F.lit(self.config.instruction + "\n\nPassages:\n"), "prompt_block", F.lit("\n\nQuestion: "), "question")
        call = self.call

        @F.arrow_udf("struct<text:string,usage:map<string,double>>")
        def said(prompts: pa.Array) -> pa.Array:
            out = []
            for p in prompts:
                try:
                    found = call(p.as_py())
                except Exception as error:
                    raise GenerationError(f"completion failed: {error}") from error
                text, used = found if isinstance(found, tuple) else (found, {})
                usage = {"input_chars": len(p.as_py()), "output_chars": len(text)} | dict(used)
                out.append({"text": text, "usage": [(k, float(v)) for k, v in sorted(usage.items())]})
            return pa.array(out, pa.struct([("text", pa.string()), ("usage", pa.map_(pa.string(), pa.float64()))]))

        return rows.withColumn("__said", said(prompt)).withColumn("text", F.col("__said.text")).withColumn("usage", F.col("__said.usage")).drop("__said")
