"""Results of pipeline stages, kept under the fingerprints of all that led to them."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell import schema
from siftwell.errors import StorageError
from siftwell.operators import enrich
from siftwell.operators.filters import matching
from siftwell.operators.index import Corpus, Representation, VectorSpec
from siftwell.operators.store import passing
from siftwell.plans.component import Component, digest16
from siftwell.sources.folders import Folder

Told = Callable[..., None]


def table_fingerprint(rows: DataFrame) -> str:
    """Of the rows themselves, in any order: their number and the sums of two hashes of all columns."""
    columns = [F.to_json(c) if kind.startswith(("map", "struct", "array")) else F.col(c) for c, kind in sorted(rows.dtypes)]
    of = lambda h: F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string")
    n, a, b = rows.agg(F.count("*"), of(F.xxhash64(*columns)), of(F.hash(*columns))).first()
    return digest16([sorted(rows.dtypes), n, a, b])


class StageStore:
    """Tables of stages in a folder; a chain of fingerprints names each, so equal beginnings of pipelines are computed once.

    What is stored is found again in any order of specs and, with a root, by any
    later session.  A marker is written last: a table without one was cut off
    and is made again.  Fingerprints are those of configurations; callables that
    are injected do not show in them, so another one needs another root.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self._passing = spark, root is None
        self.folder = Folder(spark, root or passing(spark))
        #: how often each stage was computed here
        self.made: Counter[str] = Counter()

    def home(self, stage: str, chain: Sequence[Any]) -> tuple[str, str]:
        """The folder of a stage's result and its marker."""
        key = digest16(list(chain))
        return f"{self.folder.path}/{stage}/{key}", f"done/{stage}-{key}"

    def has(self, marker: str) -> bool:
        return self.folder.has(marker)

    def keep(self, stage: str, chain: Sequence[Any], make: Callable[[], DataFrame], tell: Told | None = None) -> DataFrame:
        """The stage's table: what is stored under chain, or what make gives, stored."""
        path, marker = self.home(stage, chain)
        began, known = time.perf_counter(), self.has(marker)
        if not known:
            make().write.mode("overwrite").parquet(path)
            self.folder.mark(marker)
            self.made[stage] += 1
        if tell:
            tell(stage, 0.0 if known else 1000 * (time.perf_counter() - began), cache_hit=known)
        return self.spark.read.parquet(path)

    def build(self, stage: str, chain: Sequence[Any], make: Callable[[str], None]) -> str:
        """The folder of something that make writes itself."""
        path, marker = self.home(stage, chain)
        if not self.has(marker):
            self.folder.remove(path.removeprefix(f"{self.folder.path}/"))
            make(path)
            self.folder.mark(marker)
            self.made[stage] += 1
        return path

    def release(self) -> None:
        """Deletes what was stored, unless a root was given."""
        if self._passing:
            self.folder.remove()

    # --- the stages of a pipeline ---------------------------------------------------------------------------------------

    def documents(self, source: DataFrame, fingerprint: str, parser: Component, parse: Callable[[], DataFrame], tell: Told | None = None) -> tuple[DataFrame, list]:
        """Documents and the chain that names them; a source of documents is taken as it is."""
        if "content" not in source.columns:
            return source, [fingerprint]
        chain = [fingerprint, parser.describe()]
        return self.keep("parse", chain, parse, tell), chain

    def chunks(self, documents: DataFrame, chain: list, chunker, enrichers: Sequence[enrich.Enricher], tell: Told | None = None) -> tuple[DataFrame, list]:
        """Chunks after all enrichers, each of which is a stage of its own."""
        chain = [*chain, chunker.describe()]
        rows = self.keep("chunk", chain, lambda: chunker.chunk(documents), tell)
        for one in enrichers:
            chain, before = [*chain, one.describe()], rows
            rows = self.keep("enrich", chain, lambda before=before, one=one: one.enrich(before, documents), tell)
        return rows, chain

    def corpus(self, chunks: DataFrame, chain: list, representations: Sequence[Representation]) -> Corpus:
        """A corpus whose spaces are stored one by one, so that each is encoded once whatever others stand beside it."""
        vectors = {}
        for r in representations:
            if r.spec() is not None:
                vectors[r.space] = self.keep("space", [*chain, r.describe()], lambda r=r: chunks.select("id", r.column(chunks).alias("vector")))
            if r.indexes:

                def fill(path: str, r: Representation = r) -> None:
                    r.attach(StagedStore(self.spark, path, chunks, {}))
                    r.add(chunks)

                path = self.build("index", [*chain, r.describe()], fill)
                r.attach(StagedStore(self.spark, path, chunks, {}))
        return Corpus(StagedStore(self.spark, self.folder.path, chunks, vectors), representations)


class StagedStore(Component):
    """Chunks and vectors that a stage store holds, to be read only."""

    kind, name = "vector_store", "staged"

    def __init__(self, spark: SparkSession, path: str, chunks: DataFrame, vectors: Mapping[str, DataFrame]):
        super().__init__()
        self.spark, self.path, self._chunks, self._vectors = spark, path, chunks, dict(vectors)
        self.specs: dict[str, VectorSpec] = {}

    def ensure_schema(self, specs: Sequence[VectorSpec]) -> None:
        self.specs = {s.name: s for s in specs}

    def replaced(self) -> bool:
        return False

    def chunks(self) -> DataFrame:
        return self._chunks

    def space(self, name: str) -> DataFrame:
        if name not in self._vectors:
            raise StorageError(f"space {name!r} is not stored")
        return self._vectors[name]

    def fetch(self, filters: Mapping[str, Any] | None = None, limit: int = 100) -> DataFrame:
        return matching(self._chunks, filters).orderBy("doc_id", "index", "id").limit(limit)

    def upsert(self, chunks: DataFrame, vectors: Mapping[str, str]) -> None:
        raise StorageError("stored stages are not written to")

    def last(self) -> DataFrame:
        return self.spark.createDataFrame([], schema.CHUNK)
