"""A vector database behind the corpus: executors talk to it in batches through an injected client."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siftwell import schema
from siftwell.errors import ConfigError, StorageError
from siftwell.operators import search
from siftwell.operators.index import VectorSpec
from siftwell.plans.component import Component, registry

PAYLOAD = ("id", "doc_id", "text", "index", "char_start", "char_end", "page_start", "page_end", "metadata")


def point_id(chunk_id: str) -> str:
    """The database's id of a chunk: the same for the same chunk id, so that writing again replaces."""
    return str(uuid.uuid5(uuid.NAMESPACE_URL, chunk_id))


@registry.register
class ServiceStore(Component):
    """Chunks and vectors in a service.

    connect is called once in each batch's process and gives a client with

    * spaces() -> {name: (kind, dimensions)} or None, create(specs) and drop(),
    * write(points), each {id, vectors: {space: value}, payload},
    * update(space, [(id, value)]),
    * search(space, value, k, filters) -> [(payload, score)],
    * scroll(filters, limit, low, high) -> payloads of the points whose ids,
      as text, are from low up to but not high ("" and None: without a bound),
      in the order of ids; limit None is all.

    What is read from the service is read by ranges of point ids, each a task of
    its own; ids are hashes, so the ranges are even.
    """

    kind, name = "vector_store", "service"

    def __init__(self, spark: SparkSession, connect: Callable[[], Any] | None = None, recreate: bool = False, batch: int = 256, ranges: int | None = None):
        super().__init__()
        if connect is None:
            raise ConfigError("the service store needs connect=")
        self.spark, self.connect, self.recreate, self.batch = spark, connect, recreate, batch
        self.ranges = ranges or 4 * spark.sparkContext.defaultParallelism
        self.path: str | None = None
        self.specs: dict[str, VectorSpec] = {}
        self._last: DataFrame | None = None

    def _call(self, what: str, call: Callable[[Any], Any]) -> Any:
        try:
            return call(self.connect())
        except (ConfigError, StorageError):
            raise
        except Exception as error:
            raise StorageError(f"the vector service could not {what}: {error}") from error

    def ensure_schema(self, specs: Sequence[VectorSpec]) -> None:
        """Creates the spaces, or compares them with those that are there; others are dropped only with recreate."""
        there = self._call("list its spaces", lambda c: c.spaces())
        lacking = [s.name for s in specs if there is not None and (s.name not in there or there[s.name][0] != s.kind or (s.kind == "dense" and there[s.name][1] != s.dimensions))]
        if lacking and not self.recreate:
            raise ConfigError(f"the service has {there}, which does not fit {', '.join(lacking)}; a changed set of spaces needs a new collection")
        if there is None or lacking:
            if lacking:
                self._call("drop its spaces", lambda c: c.drop())
            self._call("create its spaces", lambda c: c.create(list(specs)))
        self.specs = {s.name: s for s in specs}

    def _send(self, rows: DataFrame, what: str, send: Callable[[Any, list[dict]], None]) -> int:
        """Rows to the service, batch by batch, from the executors; the number that went."""
        connect, size = self.connect, self.batch

        def run(batches):
            client, n = connect(), 0
            for batch in batches:
                for i in range(0, batch.num_rows, size):
                    part = batch.slice(i, size).to_pylist()
                    try:
                        send(client, part)
                    except Exception as error:
                        raise StorageError(f"the vector service could not {what}: {error}") from error
                    n += len(part)
            yield pa.RecordBatch.from_pydict({"n": [n]})

        return rows.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0

    def upsert(self, chunks: DataFrame, vectors: Mapping[str, str]) -> None:
        if unknown := sorted(set(vectors) - set(self.specs)):
            raise StorageError(f"spaces {unknown} are not declared")
        spaces = dict(vectors)

        def send(client, part):
            client.write([{"id": point_id(r["id"]), "vectors": {s: r[c] for s, c in spaces.items()}, "payload": {k: dict(r[k] or {}) if k == "metadata" else r[k] for k in PAYLOAD if k in r}} for r in part])

        self._send(chunks, "write", send)
        self._last = chunks.drop(*vectors.values())

    def update_vectors(self, space: str, rows: DataFrame) -> None:
        if space not in self.specs:
            raise StorageError(f"space {space!r} is not declared")
        self._send(rows.select("id", "vector"), "update", lambda client, part: client.update(space, [(point_id(r["id"]), r["vector"]) for r in part]))

    def search(self, space: str, queries: DataFrame, k: int, filters: Mapping[str, Any] | None = None) -> DataFrame:
        """Rankings of queries (qid, vector), each asked of the service."""
        if space not in self.specs:
            raise StorageError(f"space {space!r} is not declared")
        connect, asked = self.connect, dict(filters or {})

        def run(batches):
            client = connect()
            for batch in batches:
                hits = [(q, p["id"], float(s)) for q, v in zip(batch["qid"].to_pylist(), batch["vector"].to_pylist(), strict=True) for p, s in client.search(space, v, k, asked)]
                yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in hits], batch.schema.field("qid").type), pa.array([h[1] for h in hits], pa.string()), pa.array([h[2] for h in hits], pa.float64())], names=["qid", "chunk_id", "score"])

        kind = queries.schema["qid"].dataType.simpleString()
        return search.ranked(queries.select("qid", "vector").mapInArrow(run, f"qid {kind}, chunk_id string, score double"), k, self.specs[space].kind)

    def fetch(self, filters: Mapping[str, Any] | None = None, limit: int | None = 100) -> DataFrame:
        """Payloads that match; of more than limit, those of the first point ids."""
        rows = _scrolled(self.spark, self.connect, dict(filters or {}), limit, self.ranges)
        return (rows if limit is None else rows.orderBy("point").limit(limit)).drop("point")

    def chunks(self) -> DataFrame:
        return self.fetch(limit=None)

    def last(self) -> DataFrame:
        return self._last if self._last is not None else self.chunks().limit(0)


_CHUNKS = pa.schema([("point", pa.string()), *((k, pa.map_(pa.string(), pa.string()) if k == "metadata" else pa.int32() if k in ("index", "char_start", "char_end", "page_start", "page_end") else pa.string()) for k in PAYLOAD)])


def id_ranges(n: int) -> list[tuple[str, str | None]]:
    """n even ranges of ids that begin with eight hexadecimal digits."""
    cuts = [f"{(i << 32) // n:08x}" for i in range(1, n)]
    return list(zip(["", *cuts], [*cuts, None], strict=True))


def _scrolled(spark: SparkSession, connect: Callable[[], Any], filters: dict, limit: int | None, ranges: int) -> DataFrame:
    """(point, payload ...) of a service's points, a partition for each range of ids."""
    name, schema_text = f"siftwell_scroll_{uuid.uuid4().hex}", f"point string, {schema.CHUNK}"

    class Reader(DataSourceReader):
        def partitions(self):
            return [InputPartition(r) for r in id_ranges(ranges)]

        def read(self, partition):
            try:
                held = []
                for p in connect().scroll(filters, limit, *partition.value):
                    held.append({"point": point_id(p["id"])} | {k: list((p.get(k) or {}).items()) if k == "metadata" else p.get(k) for k in PAYLOAD})
                    if len(held) == 1000:
                        yield pa.RecordBatch.from_pylist(held, _CHUNKS)
                        held = []
                yield pa.RecordBatch.from_pylist(held, _CHUNKS)
            except Exception as error:
                raise StorageError(f"the vector service could not scroll: {error}") from error

    class Scroll(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema_text

        def reader(self, schema):
            return Reader()

    spark.dataSource.register(Scroll)
    return spark.read.format(name).load()
