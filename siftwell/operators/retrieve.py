"""Retrievers: queries (qid, text) to rankings."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.errors import ConfigError
from siftwell.operators import search
from siftwell.operators.index import Corpus
from siftwell.plans.component import Component, registry
from siftwell.sources.folders import shared_folder

K = 20


class Retriever(Component):
    kind = "retriever"

    def retrieve(self, queries: DataFrame, k: int = K, filters: Mapping[str, Any] | None = None) -> DataFrame:
        raise NotImplementedError


def stamped(rankings: DataFrame, name: str) -> DataFrame:
    return rankings.withColumn("retriever_name", F.lit(name))


@registry.register
class IndexRetriever(Retriever):
    """One space of a corpus; its only one by default."""

    name = "index"

    @dataclass
    class Config:
        representation: str | None = None

    def __init__(self, corpus: Corpus | None = None, config=None, **fields):
        super().__init__(config, **fields)
        if corpus is None:
            raise ConfigError("the index retriever needs corpus=")
        space = self.config.representation
        if space is None and len(corpus.spaces) > 1:
            raise ConfigError(f"which of the spaces {', '.join(corpus.spaces)}?")
        self.corpus, self.space = corpus, space or next(iter(corpus.spaces))
        corpus.representation(self.space)
        self.label = f"index:{self.space}"

    def retrieve(self, queries, k=K, filters=None):
        return stamped(self.corpus.search(self.space, queries, k, filters), self.name)


@registry.register
class FusionRetriever(Retriever):
    """Reciprocal rank fusion of retrievers, each asked for max(k, fetch_k)."""

    name = "fusion"

    @dataclass
    class Config:
        method: str = "rrf"
        rrf_k: int = 60
        fetch_k: int = 60
        weights: list[float] | None = None

    def __init__(self, retrievers: Sequence[Retriever] | None = None, config=None, **fields):
        super().__init__(config, **fields)
        if not retrievers:
            raise ConfigError("fusion needs retrievers")
        if self.config.method != "rrf":
            raise ConfigError(f"no fusion method {self.config.method!r}")
        if self.config.weights is not None and len(self.config.weights) != len(retrievers):
            raise ConfigError(f"{len(self.config.weights)} weights for {len(retrievers)} retrievers")
        self.retrievers = list(retrievers)

    def describe(self):
        return super().describe() | {"retrievers": [r.describe() for r in self.retrievers]}

    def retrieve(self, queries, k=K, filters=None):
        labels = search.source_labels([getattr(r, "label", r.name) for r in self.retrievers])
        depth = max(k, self.config.fetch_k)
        rankings = [(label, r.retrieve(queries, depth, filters)) for label, r in zip(labels, self.retrievers, strict=True)]
        return search.fuse(rankings, k, self.config.rrf_k, self.config.weights, self.name)


@registry.register
class HybridRetriever(Retriever):
    """Fusion of all, or the listed, spaces of a corpus."""

    name = "hybrid"

    @dataclass
    class Config:
        representations: list[str] | None = None
        rrf_k: int = 60
        fetch_k: int = 60

    def __init__(self, corpus: Corpus | None = None, config=None, **fields):
        super().__init__(config, **fields)
        if corpus is None:
            raise ConfigError("the hybrid retriever needs corpus=")
        self.corpus = corpus
        spaces = self.config.representations or list(corpus.spaces)
        self.inner = FusionRetriever([IndexRetriever(corpus, representation=s) for s in spaces], rrf_k=self.config.rrf_k, fetch_k=self.config.fetch_k)

    def retrieve(self, queries, k=K, filters=None):
        return stamped(self.inner.retrieve(queries, k, filters), self.name)


def _completions(queries: DataFrame, prompt: Callable[[str], str], complete: Callable[[str], str]) -> DataFrame:
    @F.arrow_udf("string")
    def call(texts: pa.Array) -> pa.Array:
        return pa.array([complete(prompt(t.as_py() or "")) for t in texts], pa.string())

    return queries.withColumn("said", call(F.col("text")))


@registry.register
class MultiQueryRetriever(Retriever):
    """The query and up to n phrasings of it by a model, fused; each is asked for k."""

    name = "multi-query"

    @dataclass
    class Config:
        n: int = 4
        rrf_k: int = 60

    def __init__(self, inner: Retriever | None = None, complete: Callable[[str], str] | None = None, config=None, **fields):
        super().__init__(config, **fields)
        if inner is None or complete is None:
            raise ConfigError("multi-query needs inner= and complete=")
        self.inner, self.complete = inner, complete

    def describe(self):
        return super().describe() | {"inner_fingerprint": self.inner.fingerprint()}

    def phrasings(self, queries: DataFrame) -> DataFrame:
        """(qid, variant, text): variant 0 is the query itself."""
        n = self.config.n
        said = _completions(queries, lambda q: f"Write {n} other ways to ask this question, one on each line and nothing else.\n\nQuestion: {q}", self.complete)
        lines = F.slice(F.filter(F.transform(F.split("said", r"\R"), F.trim), lambda x: x != ""), 1, n)
        return said.select("qid", F.posexplode(F.concat(F.array("text"), lines)).alias("variant", "text"))

    def retrieve(self, queries, k=K, filters=None):
        # written, so that the model is asked once and nothing stays cached
        shared_folder(queries.sparkSession)
        variants = self.phrasings(queries).checkpoint()
        rankings = [(f"q{i}", self.inner.retrieve(variants.where(F.col("variant") == i).select("qid", "text"), k, filters)) for i in range(self.config.n + 1)]
        return search.fuse(rankings, k, self.config.rrf_k, None, self.name)


@registry.register
class HydeRetriever(Retriever):
    """Searches by a passage that a model makes up for the query."""

    name = "hyde"

    def __init__(self, inner: Retriever | None = None, complete: Callable[[str], str] | None = None):
        super().__init__()
        if inner is None or complete is None:
            raise ConfigError("hyde needs inner= and complete=")
        self.inner, self.complete = inner, complete

    def describe(self):
        return super().describe() | {"inner_fingerprint": self.inner.fingerprint()}

    def retrieve(self, queries, k=K, filters=None):
        said = _completions(queries, lambda q: f"Write a short factual passage, as from a document, that answers this question.\n\nQuestion: {q}", self.complete)
        shaped = said.select("qid", F.coalesce(F.nullif(F.trim("said"), F.lit("")), "text").alias("text"))
        return stamped(self.inner.retrieve(shaped, k, filters), self.name)
