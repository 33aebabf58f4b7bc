"""Pipelines: index sources, answer questions, and both built from a spec."""

from __future__ import annotations

import inspect
import queue
import threading
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from siftwell.errors import ConfigError
from siftwell.operators import chunking, encode, enrich, generate, index, refine, retrieve, service  # noqa: F401 (service registers itself)
from siftwell.plans.component import Component, registry
from siftwell.plans.space import CHAINS, validate_spec
from siftwell.sources import blobs, parsers
from siftwell.sources.detect import detect_format

Trace = Callable[..., None]


def _clock() -> Column:
    """Milliseconds of the clock of the executor that handles the row."""
    return F.reflect(F.lit("java.lang.System"), F.lit("currentTimeMillis")).cast("long")


class Traced:
    """Stages that are counted and timed while the plan that they are part of is computed.

    With a trace, the rows of a stage are observed where they pass: their number
    and the clock at the first and the last of them.  Nothing is computed or kept
    for it, and the plan is else what it is without one, but that no filter moves
    below a stage whose rows are counted.  `report` tells the
    trace what was seen; it is called by pipelines that write their rows, and by
    the caller once the rows that a pipeline returned are computed.  A stage that
    several actions compute is told as the first of them saw it.  Its duration is
    that of making its plan (with what is computed then) and of its rows' passing;
    stages whose rows pass together overlap.
    """

    trace: Trace | None = None

    def _told(self) -> list[tuple]:
        return self.__dict__.setdefault("_pending", [])

    def timed(self, stage: str, make: Callable[[], DataFrame], cached: bool = False, **detail: Any) -> DataFrame:
        """make's rows, observed; cached says that only rows which a cache lacked are among them."""
        if self.trace is None:
            return make()
        began = time.perf_counter()
        rows = make()
        seen = Observation(f"{stage}-{uuid.uuid4().hex}")
        self._told().append((stage, 1000 * (time.perf_counter() - began), seen, cached, detail))
        return rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.min(_clock()).alias("first"), F.max(_clock()).alias("last"))

    def acted(self, stage: str, act: Callable[[], Any]) -> None:
        """A stage that computes something at once."""
        began = time.perf_counter()
        act()
        if self.trace is not None:
            self._told().append((stage, 1000 * (time.perf_counter() - began), None, False, {}))

    def report(self, seconds: float = 10.0) -> None:
        """Tells trace, in the order of the stages, of those that were computed; others are waited for so long and stay to be told."""
        until, left = time.monotonic() + seconds, []
        for entry in self._told():
            stage, duration, seen, cached, detail = entry
            found = _observed(seen, until - time.monotonic()) if seen is not None else {}
            if found is None:
                left.append(entry)
                continue
            if found:
                duration += (found["last"] or 0) - (found["first"] or 0)
                detail = detail | {"rows": found["rows"]} | ({"cache_hit": found["rows"] == 0} if cached else {})
            self.trace(stage, duration, **detail)
        self._pending = left


def _observed(seen: Observation, seconds: float) -> dict[str, Any] | None:
    """What was observed, or none where no action has ended in time: an observation itself waits without end.

    It is empty where the action found its rows elsewhere, in a cache or not at
    all, and passed none by the counter.
    """
    answer: queue.SimpleQueue = queue.SimpleQueue()

    def wait() -> None:
        try:
            answer.put(seen.get)
        except Py4JJavaError:
            answer.put({})

    threading.Thread(target=wait, daemon=True).start()
    try:
        return answer.get(timeout=max(seconds, 0.1))
    except queue.Empty:
        return None


class IndexingPipeline(Traced):
    """sources -> documents -> chunks -> enriched chunks -> sinks, as one plan.

    With cache, a Parquet folder, documents are parsed once for each content and
    parser fingerprint, and raw contents are kept beside them; with a catalogue,
    the documents' names are recorded.
    """

    def __init__(
        self, parser: parsers.Parser, chunker: chunking.Chunker, sinks: Sequence[Any] = (), enrichers: Sequence[enrich.Enricher] = (), cache: str | None = None, trace: Trace | None = None, catalogue: blobs.Catalogue | None = None
    ):
        self.parser, self.chunker, self.sinks, self.enrichers = parser, chunker, list(sinks), list(enrichers)
        self.cache, self.trace, self.catalogue = cache, trace, catalogue

    def documents(self, sources: DataFrame) -> DataFrame:
        named = blobs.with_doc_id(detect_format(sources))
        if self.catalogue:
            self.catalogue.record(named)
        rows = named.dropDuplicates(["doc_id"])
        if not self.cache:
            return self.timed("parse", lambda: self.parser.parse(rows))
        self.acted("store_raw", lambda: blobs.through_cache(rows, rows.sparkSession, f"{self.cache}/raw", ["doc_id"], blobs.raw_blobs))
        path = f"{self.cache}/parsed/{self.parser.fingerprint()}"
        return blobs.through_cache(rows, rows.sparkSession, path, ["doc_id"], lambda new: self.timed("parse", lambda: self.parser.parse(new), cached=True))

    def chunks(self, documents: DataFrame) -> DataFrame:
        cut = self.timed("chunk", lambda: self.chunker.chunk(documents))
        return self.timed("enrich", lambda: enrich.enrich(cut, documents, self.enrichers)) if self.enrichers else cut

    def index(self, sources: DataFrame) -> DataFrame:
        return self.index_documents(self.documents(sources))

    def index_documents(self, documents: DataFrame) -> DataFrame:
        """Chunks, written to every sink; they are computed once.

        Where a corpus of tables is the only sink, it reads them once and those
        returned are what it has stored; else they are persisted.
        """
        chunks = self.chunks(documents)
        if len(self.sinks) == 1 and isinstance(self.sinks[0], index.Corpus) and isinstance(self.sinks[0].store, index.TableStore):
            self.sinks[0].add(chunks)
            self.report()
            return self.sinks[0].store.last()
        chunks = chunks.persist()
        for sink in self.sinks:
            sink.add(chunks)
        if self.sinks:
            self.report()
        return chunks


class QueryPipeline(Traced):
    """queries -> rankings -> refined candidates."""

    def __init__(self, retriever: retrieve.Retriever, corpus: index.Corpus, refiners: Sequence[refine.Refiner] = (), fetch_k: int = 50, trace: Trace | None = None):
        self.retriever, self.corpus, self.refiners, self.fetch_k, self.trace = retriever, corpus, list(refiners), fetch_k, trace

    def query(self, queries: DataFrame, k: int = 10, filters: Mapping[str, Any] | None = None) -> DataFrame:
        rankings = self.timed("retrieve", lambda: self.retriever.retrieve(queries, self.fetch_k, filters))
        chunks = self.corpus.store.chunks()
        return self.timed("refine", lambda: refine.refine(refine.candidates(rankings, chunks), queries, chunks, self.refiners, k))


def default_retriever(corpus: index.Corpus) -> retrieve.Retriever:
    """One space is searched as it is, several are fused."""
    return retrieve.IndexRetriever(corpus) if len(corpus.spaces) == 1 else retrieve.HybridRetriever(corpus)


class RagPipeline(Traced):
    """Index and ask, over one corpus."""

    def __init__(self, corpus: index.Corpus, parser=None, chunker=None, enrichers=(), retriever=None, refiners=(), generator=None, fetch_k: int = 50, cache: str | None = None, trace: Trace | None = None):
        if retriever is not None and getattr(retriever, "corpus", corpus) is not corpus:
            raise ConfigError("the retriever searches another corpus")
        self.corpus, self.trace = corpus, trace
        self.indexing = IndexingPipeline(parser or parsers.AutoParser(), chunker or chunking.FixedChunker(), [corpus], enrichers, cache, trace)
        self.querying = QueryPipeline(retriever or default_retriever(corpus), corpus, refiners, fetch_k, trace)
        self.generator = generator or generate.ExtractiveGenerator()

    def index(self, sources: DataFrame) -> DataFrame:
        return self.indexing.index(sources)

    def index_documents(self, documents: DataFrame) -> DataFrame:
        return self.indexing.index_documents(documents)

    def query(self, queries: DataFrame, k: int = 10, filters=None) -> DataFrame:
        return self.querying.query(queries, k, filters)

    def ask(self, queries: DataFrame, k: int = 8, filters=None) -> DataFrame:
        """(qid, text, citations, usage) of every query."""
        found = self.query(queries, k, filters)
        return self.timed("generate", lambda: self.generator.generate(queries, found))

    def report(self, seconds: float = 10.0) -> None:
        for part in (self.indexing, self.querying):
            part.report(seconds)
        super().report(seconds)

    def components(self) -> dict[str, Any]:
        return {
            "parser": self.indexing.parser, "chunker": self.indexing.chunker, "enrich": self.indexing.enrichers, "representations": list(self.corpus.spaces.values()),
            "retriever": self.querying.retriever, "refine": self.querying.refiners, "generator": self.generator,
        }

    def describe(self) -> dict:
        return {s: [x.describe() for x in c] if isinstance(c, list) else c.describe() for s, c in self.components().items()}

    def fingerprints(self) -> dict[str, str]:
        return {s: "+".join(x.fingerprint() for x in c) if isinstance(c, list) else c.fingerprint() for s, c in self.components().items()}


class PipelineBuilder:
    """Specs to pipelines: names are looked up in the registry, nested specs are built first, corpus and callables are given."""

    #: kinds of parameters that are specs themselves
    NESTED = {"embedder": "embedder", "encoder": "sparse_encoder", "inner": "retriever", "retrievers": "retriever"}

    def __init__(self, spark: SparkSession, given: Mapping[str, Any] | None = None, cache: str | None = None, fetch_k: int = 50):
        self.spark, self.given, self.cache, self.fetch_k = spark, dict(given or {}), cache, fetch_k

    def _make(self, kind: str, entry: Mapping[str, Any], **extra: Any) -> Component:
        cls = registry.get(kind, entry["name"])
        params = {k: self._resolve(k, v, extra) for k, v in dict(entry.get("params") or {}).items()}
        accepted = inspect.signature(cls.__init__).parameters
        for name, value in (extra | self.given).items():
            if name in accepted and name not in params:
                params[name] = value
        try:
            return cls(**params)
        except TypeError as error:
            raise ConfigError(f"{kind} {entry['name']}: {error}") from error

    def _resolve(self, name: str, value: Any, extra: dict) -> Any:
        kind = self.NESTED.get(name)
        if kind and isinstance(value, Mapping):
            return self._make(kind, value, **extra)
        if kind and isinstance(value, (list, tuple)):
            return [self._make(kind, v, **extra) for v in value]
        return value

    def representations(self, spec: Mapping[str, Any]) -> list[index.Representation]:
        default = [{"name": "dense", "params": {"embedder": {"name": "hashing"}}}, {"name": "lexical"}]
        return [self._make("representation", r) for r in spec.get("representations") or default]

    def front(self, spec: Mapping[str, Any]) -> tuple[parsers.Parser, chunking.Chunker, list[enrich.Enricher]]:
        """What comes before a corpus."""
        parser = self._make("parser", spec["parser"]) if "parser" in spec else parsers.AutoParser()
        chunker = self._make("chunker", spec["chunker"]) if "chunker" in spec else chunking.FixedChunker()
        return parser, chunker, [self._make("enricher", e) for e in spec.get("enrich", ())]

    def build(self, spec: Mapping[str, Any], corpus: index.Corpus | None = None, trace: Trace | None = None) -> RagPipeline:
        """The pipeline of spec, over corpus if one of its stages is there already."""
        validate_spec(spec)
        if corpus is None:
            store = self._make("vector_store", spec["vector_store"], spark=self.spark) if "vector_store" in spec else index.TableStore(self.spark)
            corpus = index.Corpus(store, self.representations(spec))
        parser, chunker, enrichers = self.front(spec)
        parts: dict[str, Any] = {"parser": parser, "chunker": chunker, "enrichers": enrichers}
        for stage, kind, name in (("retriever", "retriever", "retriever"), ("refine", "refiner", "refiners"), ("generator", "generator", "generator")):
            if stage in spec:
                entry = spec[stage]
                parts[name] = [self._make(kind, e, corpus=corpus) for e in entry] if stage in CHAINS else self._make(kind, entry, corpus=corpus)
        return RagPipeline(corpus, cache=self.cache, fetch_k=self.fetch_k, trace=trace, **parts)


def ingest(spark: SparkSession, path: str, parser: parsers.Parser | None = None, **metadata: str) -> DataFrame:
    """Documents of the files at path, in one call."""
    sources = blobs.with_doc_id(detect_format(blobs.read_sources(spark, path, **metadata)))
    return (parser or parsers.AutoParser()).parse(sources)


def cached(embedder: encode.Embedder, path: str) -> encode.EmbeddingCache:
    return encode.EmbeddingCache(embedder, path)


def trace_frame(spark: SparkSession, events: Sequence[tuple]) -> DataFrame:
    """Trace events (trial_id, stage, duration_ms, cache_hit, usage) as a table."""
    return spark.createDataFrame(list(events), "trial_id string, stage string, duration_ms double, cache_hit boolean, usage map<string,double>").withColumn("usage", F.col("usage"))
