"""Refiners: rankings with their chunks' columns to better rankings.

A refiner takes and returns candidates: (qid, pos, score, retriever_name) and
the chunk's columns.  pos, from 1, is the order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.errors import ConfigError
from siftwell.functions.text import jaccard, tokens
from siftwell.operators.search import TIE
from siftwell.operators.store import small, stored
from siftwell.plans.component import Component, registry


def candidates(rankings: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rankings with what their chunks are.

    The rankings are written and counted; as long as they are few they go to the
    chunks, which stay where they are, so no text is shuffled.
    """
    chunk = chunks.withColumnRenamed("id", "chunk_id")
    return small(stored(rankings.withColumn("pos", F.col("rank").cast("int")))).join(chunk, "chunk_id")


def renumbered(rows: DataFrame, *order) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(*order)
    return rows.withColumn("pos", F.row_number().over(w).cast("int"))


class Refiner(Component):
    kind = "refiner"

    def refine(self, rows: DataFrame, queries: DataFrame, chunks: DataFrame, k: int | None = None) -> DataFrame:
        raise NotImplementedError


def refine(rows: DataFrame, queries: DataFrame, chunks: DataFrame, chain: list[Refiner], k: int) -> DataFrame:
    """The chain in order, then the first k of each query."""
    out = reduce(lambda df, r: r.refine(df, queries, chunks, k), chain, rows)
    return out.where(F.col("pos") <= k)


@registry.register
class KeywordRefiner(Refiner):
    """Orders by the Jaccard similarity of query and chunk words."""

    name = "keyword"

    def refine(self, rows, queries, chunks, k=None):
        asked = queries.select("qid", F.array_distinct(tokens(F.col("text"))).alias("__q"))
        scored = rows.join(asked, "qid").withColumn("score", jaccard(F.array_distinct(tokens(F.col("text"))), F.col("__q")))
        return renumbered(scored, F.round("score", TIE).desc(), F.col("chunk_id").cast("string").desc()).select(*rows.columns)


@registry.register
class ScoreThreshold(Refiner):
    """Keeps scores of at least min_score, in their order."""

    name = "score-threshold"

    @dataclass
    class Config:
        min_score: float = 0.0

    def refine(self, rows, queries, chunks, k=None):
        return renumbered(rows.where(F.col("score") >= self.config.min_score), "pos").select(*rows.columns)


@registry.register
class NeighborExpander(Refiner):
    """Stitches the chunks before and after each candidate to its text."""

    name = "neighbor-expander"

    @dataclass
    class Config:
        window: int = 1

    def refine(self, rows, queries, chunks, k=None):
        window = self.config.window
        if window <= 0:
            return rows
        real = chunks.where(~F.coalesce(F.try_element_at("metadata", F.lit("synthetic")) == "true", F.lit(False))) if "metadata" in chunks.columns else chunks
        near = real.select(F.col("doc_id").alias("n_doc"), F.col("index").alias("n_index"), F.struct("char_start", "char_end", F.col("text").alias("text"), "page_start", "page_end", F.col("id").alias("id")).alias("n"))
        # the places that are asked for go to the chunks; of those, only what lies there moves on
        asked = rows.select("doc_id", F.explode(F.sequence(F.col("index") - window, F.col("index") + window)).alias("n_index")).distinct()
        near = near.join(small(stored(asked)).withColumnRenamed("doc_id", "n_doc"), ["n_doc", "n_index"], "left_semi")
        own = F.struct("char_start", "char_end", "text", "page_start", "page_end", F.col("chunk_id").alias("id"))
        anchors = rows.withColumn("__own", own).withColumn("__at", F.explode(F.sequence(F.col("index") - window, F.col("index") + window)))
        # an equality on document and index in place of a range: each candidate asks for 2 * window + 1 indices
        joined = anchors.join(near, (F.col("doc_id") == F.col("n_doc")) & (F.col("__at") == F.col("n_index")), "left")
        joined = joined.withColumn("n", F.when((F.col("__at") == F.col("index")), F.coalesce("n", "__own")).otherwise(F.col("n")))
        grouped = joined.groupBy("qid", "chunk_id", "pos").agg(F.array_sort(F.collect_list("n")).alias("ns"))
        usable = F.filter("ns", lambda x: x["char_start"].isNotNull() & x["char_end"].isNotNull())
        zero = F.struct(F.lit("").alias("text"), F.lit(None).cast("int").alias("at"))

        def stitch(acc, x):
            gap = F.when(x["char_start"] > acc["at"], F.lit(" ")).otherwise(F.lit(""))
            tail = F.substring(x["text"], acc["at"] - x["char_start"] + 1, F.length(x["text"]))
            added = F.when(acc["at"].isNull(), x["text"]).when(x["char_start"] >= acc["at"], F.concat(gap, x["text"])).when(x["char_end"] > acc["at"], tail).otherwise(F.lit(""))
            return F.struct(F.concat(acc["text"], added).alias("text"), F.greatest(acc["at"], x["char_end"]).cast("int").alias("at"))

        merged = grouped.select(
            "qid", "chunk_id", "pos", F.size("ns").alias("__n"), F.aggregate(usable, zero, stitch).alias("__m"),
            F.array_min(F.transform(usable, lambda x: x["char_start"])).alias("__start"), F.array_min(F.transform("ns", lambda x: x["page_start"])).alias("__ps"), F.array_max(F.transform("ns", lambda x: x["page_end"])).alias("__pe"),
        )
        out = rows.join(merged, ["qid", "chunk_id", "pos"], "left")
        grown = (F.col("__n") > 1) & F.col("__m.at").isNotNull()
        values = {"text": F.col("__m.text"), "char_start": F.col("__start"), "char_end": F.col("__m.at"), "page_start": F.coalesce("__ps", "page_start"), "page_end": F.coalesce("__pe", "page_end")}
        if "metadata" in rows.columns:
            kept = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda key, _: key != "expanded")
            values["metadata"] = F.map_concat(kept, F.create_map(F.lit("expanded"), F.lit("true")))
        for name, value in values.items():
            out = out.withColumn(f"__new_{name}", F.when(grown, value).otherwise(F.col(name)))
        return out.select(*[F.col(f"__new_{c}").alias(c) if c in values else F.col(c) for c in rows.columns])


@registry.register
class CrossEncoderReranker(Refiner):
    """Orders by an injected model's scores of (query, text) pairs."""

    name = "cross-encoder"

    @dataclass
    class Config:
        model: str = ""
        batch_size: int = 32

    def __init__(self, predict: Callable[[list[tuple[str, str]]], list[float]] | None = None, config=None, **fields):
        super().__init__(config, **fields)
        if predict is None:
            raise ConfigError("the cross-encoder needs predict=, a function of pairs")
        self.predict = predict

    def refine(self, rows, queries, chunks, k=None):
        predict, size = self.predict, self.config.batch_size

        @F.arrow_udf("double")
        def score(q: pa.Array, t: pa.Array) -> pa.Array:
            pairs = list(zip(q.to_pylist(), t.to_pylist(), strict=True))
            return pa.array([float(s) for i in range(0, len(pairs), size) for s in predict(pairs[i : i + size])], pa.float64())

        asked = queries.select("qid", F.col("text").alias("__q"))
        scored = rows.join(asked, "qid").withColumn("score", score(F.col("__q"), F.col("text")))
        return renumbered(scored, F.round("score", TIE).desc(), F.col("chunk_id").cast("string").desc()).select(*rows.columns)
