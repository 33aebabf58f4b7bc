"""The corpus: declared search spaces over one chunk table, kept as Parquet versions."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell import schema
from siftwell.errors import ConfigError, StorageError
from siftwell.operators import search
from siftwell.operators.encode import Embedder, SparseEncoder
from siftwell.operators.filters import matching
from siftwell.operators.lexical import LexicalIndex
from siftwell.operators.store import Versions, latest, passing, stored
from siftwell.plans.component import Component, registry
from siftwell.sources.folders import Folder

__all__ = ["Corpus", "DenseRepresentation", "LexicalIndex", "LexicalRepresentation", "Representation", "SparseRepresentation", "TableStore", "VectorSpec", "latest"]


@dataclass(frozen=True)
class VectorSpec:
    """A declared space: dense spaces have dimensions and a distance."""

    name: str
    kind: str
    dimensions: int | None = None
    distance: str = "cosine"

    def fits(self, other: VectorSpec) -> bool:
        return self.kind == other.kind and (self.kind != "dense" or (self.dimensions, self.distance) == (other.dimensions, other.distance))


class TableStore(Component):
    """Chunks and their vectors by id: rows are appended in batches and the last one wins.

    They are Parquet, and opening a path again finds what is there; without a
    path they lie in the shared folder until `drop`.  Each space has a table of
    its own, so that refreshing one leaves the others and the payload alone.
    """

    kind, name = "vector_store", "table"

    def __init__(self, spark: SparkSession, path: str | None = None, config=None, **fields):
        super().__init__(config, **fields)
        self.spark, self.path = spark, path or passing(spark)
        self.specs: dict[str, VectorSpec] = {}
        self._tables: dict[str, Versions] = {}
        self._folder = Folder(spark, self.path)
        if self._folder.names("specs"):
            self.specs = {r["name"]: VectorSpec(r["name"], r["kind"], r["dimensions"], r["distance"]) for r in spark.read.schema(_SPEC).json(f"{self.path}/specs").collect()}

    def ensure_schema(self, specs: Sequence[VectorSpec]) -> None:
        for spec in specs:
            known = self.specs.get(spec.name)
            if known is not None and not known.fits(spec):
                raise ConfigError(f"space {spec.name!r} is {known}, not {spec}")
        new = [s for s in specs if s.name not in self.specs]
        if new:
            self.spark.createDataFrame([(s.name, s.kind, s.dimensions, s.distance) for s in new], _SPEC).coalesce(1).write.mode("append").json(f"{self.path}/specs")
        self.specs |= {s.name: s for s in new}

    def _table(self, name: str) -> Versions:
        if name not in self._tables:
            self._tables[name] = Versions(self.spark, self.path, name)
        return self._tables[name]

    def upsert(self, chunks: DataFrame, vectors: Mapping[str, str]) -> None:
        """chunks with a vector column for each space in vectors (space: column); of rows with one id, the last is taken whole."""
        if unknown := sorted(set(vectors) - set(self.specs)):
            raise StorageError(f"spaces {unknown} are not declared")
        if lacking := [c for c in vectors.values() if c not in chunks.columns]:
            raise StorageError(f"chunks have no {lacking}")
        payload, rows = [c for c in chunks.columns if c not in vectors.values()], chunks.withColumn("__at", F.monotonically_increasing_id())
        staged = f"staging-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{staged}")
        rows = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{staged}")
        try:
            for space, column in vectors.items():
                spec = self.specs[space]
                if spec.kind == "dense" and rows.where(F.col(column).isNull() | (F.size(column) != spec.dimensions)).limit(1).count():
                    raise StorageError(f"space {space!r} needs vectors of {spec.dimensions}")
            # ids alone are compared; texts move only if an id stands twice
            last = rows.groupBy("id").agg(F.max("__at").alias("__at"), F.count("*").alias("n"))
            kept = rows if last.where("n > 1").limit(1).count() == 0 else rows.join(last.select("id", "__at"), ["id", "__at"], "left_semi")
            self._table("chunks").append(kept.select(*payload))
            for space, column in vectors.items():
                self._table(f"space-{space}").append(kept.select("id", F.col(column).alias("vector")))
        finally:
            self._folder.remove(staged)

    def update_vectors(self, space: str, rows: DataFrame) -> None:
        """(id, vector) for chunks that are there; the payload and other spaces stay."""
        if space not in self.specs:
            raise StorageError(f"space {space!r} is not declared")
        missing = rows.join(self.chunks().select("id"), "id", "left_anti").select("id").limit(3).collect()
        if missing:
            raise StorageError(f"no chunk {', '.join(str(r.id) for r in missing)}")
        self._table(f"space-{space}").append(rows.select("id", "vector").dropDuplicates(["id"]))

    def last(self, space: str | None = None) -> DataFrame:
        """The chunks of the last upsert, or their rows in a space."""
        held = self._table("chunks" if space is None else f"space-{space}")
        return held.rows(held.batches[-1:]).drop("seq")

    def replaced(self) -> bool:
        """Whether rows that were stored are dead now."""
        return self._table("chunks").dead() is not None

    def chunks(self) -> DataFrame:
        live = self._table("chunks").live()
        return self.spark.createDataFrame([], schema.CHUNK) if live is None else live.drop("seq")

    def space(self, name: str) -> DataFrame:
        if name not in self.specs:
            raise StorageError(f"space {name!r} is not declared")
        live = self._table(f"space-{name}").live()
        if live is None:
            kind = schema.SPARSE if self.specs[name].kind == "sparse" else "array<double>"
            return self.spark.createDataFrame([], f"id string, vector {kind}")
        return live.drop("seq")

    def fetch(self, filters: Mapping[str, Any] | None = None, limit: int = 100) -> DataFrame:
        """Payload of the first limit matching chunks, in order of insertion and then id."""
        live = self._table("chunks").live()
        return self.chunks() if live is None else matching(live, filters).orderBy("seq", "doc_id", "index", "id").limit(limit).drop("seq")

    def compact(self) -> None:
        """Every table as one batch."""
        for name in ("chunks", *(f"space-{s}" for s in self.specs)):
            self._table(name).compact()

    def drop(self) -> None:
        """Deletes everything, the indices of representations included."""
        self._folder.remove()
        self.specs, self._tables = {}, {}


_SPEC = "name string, kind string, dimensions int, distance string"
registry.register(TableStore)


class Representation(Component):
    """One search space of a corpus."""

    kind = "representation"

    def __init__(self, space: str | None = None, config=None, **fields):
        super().__init__(config, **fields)
        self.space = space or self.name

    def spec(self) -> VectorSpec | None:
        return None

    def encode(self, chunks: DataFrame) -> DataFrame | None:
        return None

    @property
    def indexes(self) -> bool:
        """Whether add keeps something beside the store's vectors."""
        return False

    def attach(self, store: TableStore) -> None:
        """Called once, with the store of the corpus that this belongs to."""

    def add(self, chunks: DataFrame, vectors: DataFrame | None = None) -> None:
        """Called with the chunks that the store has just taken; vectors: (vector) of all of them, where it holds them."""

    def search(self, corpus: Corpus, queries: DataFrame, k: int, filters=None) -> DataFrame:
        raise NotImplementedError


@registry.register
class DenseRepresentation(Representation):
    """Dense vectors by an embedder, searched by cosine."""

    name = "dense"

    def __init__(self, embedder: Embedder | None = None, space: str | None = None, config=None, **fields):
        super().__init__(space, config, **fields)
        if embedder is None:
            raise ConfigError("the dense representation needs embedder=")
        self.embedder = embedder

    def describe(self):
        return super().describe() | {"space": self.space, "embedder": self.embedder.describe()}

    def spec(self):
        return VectorSpec(self.space, "dense", self.embedder.dimensions, self.embedder.distance)

    def column(self, chunks):
        return self.embedder.passage(F.col("text"))

    def search(self, corpus, queries, k, filters=None):
        asked = queries.select("qid", self.embedder.query(F.col("text")).alias("vector"))
        return corpus.asked(self.space, asked, k, filters) or search.dense_search(asked, corpus.side(self.space, filters), k)


@registry.register
class SparseRepresentation(Representation):
    """Sparse vectors by an encoder, searched by inner product.

    With idf, a query's values are multiplied by the inverse document frequency
    of their indices among the chunks that are stored now.  Frequencies are
    counted once for each batch, when it is added, and kept in versions beside
    the vectors; only where chunks were replaced since are they counted anew.
    """

    name = "sparse"

    @dataclass
    class Config:
        idf: bool = False

    def __init__(self, encoder: SparseEncoder | None = None, space: str | None = None, config=None, **fields):
        super().__init__(space, config, **fields)
        if encoder is None:
            raise ConfigError("the sparse representation needs encoder=")
        self.encoder = encoder
        self.frequencies: Versions | None = None

    def describe(self):
        return super().describe() | {"space": self.space, "encoder": self.encoder.describe()}

    def spec(self):
        return VectorSpec(self.space, "sparse")

    def column(self, chunks):
        return self.encoder.passage(F.col("text"))

    @property
    def indexes(self):
        return self.config.idf

    def attach(self, store):
        if self.config.idf and store.path and self.frequencies is None:
            self.frequencies = Versions(store.spark, store.path, f"frequencies-{self.space}")

    def add(self, chunks, vectors=None):
        if self.frequencies is not None:
            self.frequencies.append(_frequencies(chunks.select(self.column(chunks).alias("vector")) if vectors is None else vectors), replace=False)

    def fitted(self, corpus: Corpus, n: int | None = None) -> DataFrame:
        """(i, idf) of every index that a stored chunk has; n: their number, counted here unless it is given."""
        held = self.frequencies.rows(self.frequencies.batches) if self.frequencies is not None and not corpus.store.replaced() else None
        counted = _frequencies(corpus.store.space(self.space)) if held is None else held.groupBy("i").agg(F.sum("df").alias("df"))
        n = corpus.store.chunks().count() if n is None else n
        return counted.select("i", search.idf(F.lit(float(n)), F.col("df")).alias("idf"))

    def weighted(self, asked: DataFrame, fitted: DataFrame, n: int) -> DataFrame:
        """asked (qid, vector) with its values multiplied; an index that no chunk has is as rare as can be."""
        flat = asked.select("qid", F.explode(F.arrays_zip(F.col("vector.indices").alias("i"), F.col("vector.values").alias("v"))).alias("t")).select("qid", F.col("t.i").alias("i"), F.col("t.v").alias("v"))
        flat = stored(flat)
        rare = search.idf(F.lit(float(n)), F.lit(0.0))
        entries = flat.join(fitted.join(F.broadcast(flat.select("i").distinct()), "i", "left_semi"), "i", "left").select("qid", F.struct("i", (F.col("v") * F.coalesce("idf", rare)).alias("v")).alias("e"))
        joined = entries.groupBy("qid").agg(F.array_sort(F.collect_list("e")).alias("e"))
        made = joined.select("qid", F.struct(F.transform("e", lambda e: e["i"]).alias("indices"), F.transform("e", lambda e: e["v"]).alias("values")).alias("__vector"))
        return asked.join(made, "qid", "left").select("qid", F.coalesce("__vector", "vector").alias("vector"))

    def search(self, corpus, queries, k, filters=None):
        asked = queries.select("qid", self.encoder.query(F.col("text")).alias("vector"))
        found = corpus.asked(self.space, asked, k, filters)  # a service weighs by itself
        if found is not None:
            return found
        if self.config.idf:
            n = corpus.store.chunks().count()
            asked = self.weighted(asked, self.fitted(corpus, n), n)
        return search.sparse_search(asked, corpus.side(self.space, filters), k, vector="vector")


def _frequencies(vectors: DataFrame) -> DataFrame:
    """(i, df): in how many vectors each index stands."""
    return vectors.select(F.explode(F.array_distinct("vector.indices")).alias("i")).groupBy("i").agg(F.count("*").alias("df"))


@registry.register
class LexicalRepresentation(Representation):
    """BM25 by a stored lexical index beside the corpus's store, or by one that is given."""

    name = "lexical"

    @dataclass
    class Config:
        k1: float = 1.5
        b: float = 0.75

    def __init__(self, space: str | None = None, lexical: LexicalIndex | None = None, config=None, **fields):
        super().__init__(space, config, **fields)
        self.index = lexical

    def describe(self):
        return super().describe() | {"space": self.space}

    @property
    def indexes(self):
        return True

    def attach(self, store):
        if self.index is None:
            self.index = LexicalIndex(store.spark, f"{store.path}/lexical-{self.space}" if store.path else None, k1=self.config.k1, b=self.config.b)

    def add(self, chunks, vectors=None):
        self.index.add(chunks)

    def search(self, corpus, queries, k, filters=None):
        allowed = matching(corpus.store.chunks(), filters).select(F.col("id").alias("chunk_id")) if filters else None
        return self.index.search(queries, k, allowed=allowed, k1=self.config.k1, b=self.config.b)


class Corpus(Component):
    """A store and the representations that it is searched by; queries are texts."""

    kind, name = "corpus", "corpus"

    def __init__(self, store: TableStore, representations: Sequence[Representation]):
        super().__init__()
        if not representations:
            raise ConfigError("a corpus needs a representation")
        names = [r.space for r in representations]
        if twice := sorted({n for n in names if names.count(n) > 1}):
            raise ConfigError(f"spaces {twice} stand twice")
        self.store, self.spaces = store, {r.space: r for r in representations}
        store.ensure_schema([s for r in representations if (s := r.spec()) is not None])
        for r in representations:
            r.attach(store)

    def describe(self):
        return super().describe() | {"representations": [r.describe() for r in self.spaces.values()]}

    def add(self, chunks: DataFrame) -> None:
        """All vector columns in one projection, and one upsert."""
        own = {s: r for s, r in self.spaces.items() if r.spec() is not None}
        columns = {s: f"__vector_{uuid.uuid4().hex[:8]}" for s in own}
        self.store.upsert(chunks.select("*", *[own[s].column(chunks).alias(c) for s, c in columns.items()]), columns)
        taken = self.store.last()
        for s, r in self.spaces.items():
            # what was just encoded is not encoded again
            if s in own and isinstance(self.store, TableStore):
                r.add(taken, self.store.last(s))
            else:
                r.add(taken)

    def update_representation(self, space: str) -> None:
        """Encodes one space anew."""
        r = self.representation(space)
        if r.spec() is None:
            return
        chunks = self.store.chunks()
        self.store.update_vectors(space, chunks.select("id", r.column(chunks).alias("vector")))

    def representation(self, space: str) -> Representation:
        if space not in self.spaces:
            raise ConfigError(f"no space {space!r}; there are {', '.join(self.spaces)}")
        return self.spaces[space]

    def asked(self, space: str, vectors: DataFrame, k: int, filters=None) -> DataFrame | None:
        """Rankings by the store itself, where it searches; None where its vectors are tables."""
        find = getattr(self.store, "search", None)
        return None if find is None else find(space, vectors, k, filters)

    def side(self, space: str, filters=None) -> DataFrame:
        """(id, vector) of a space, of matching chunks."""
        vectors = self.store.space(space)
        return vectors.join(matching(self.store.chunks(), filters).select("id"), "id", "left_semi") if filters else vectors

    def search(self, space: str, queries: DataFrame, k: int, filters: Mapping[str, Any] | None = None) -> DataFrame:
        return self.representation(space).search(self, queries, k, filters)

    def fetch(self, filters=None, limit: int = 100) -> DataFrame:
        return self.store.fetch(filters, limit)
