"""Blobs by key, raw capture, parse cache and document catalogue."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.errors import ConfigError, StorageError
from siftwell.plans.component import Component, registry
from siftwell.sources.detect import canonical_extension
from siftwell.sources.folders import Folder, shared_folder


class BlobStore(Component):
    """put overwrites, get raises where nothing is, exists never raises."""

    kind = "blob_store"

    def put(self, key: str, data: bytes) -> None:
        raise NotImplementedError

    def get(self, key: str) -> bytes:
        raise NotImplementedError

    def exists(self, key: str) -> bool:
        raise NotImplementedError

    def url(self, key: str) -> str | None:
        return None


@registry.register
class LocalBlobStore(BlobStore):
    """Files under a root folder; a key cannot leave it."""

    name = "local"

    def __init__(self, root: str):
        super().__init__()
        self.root = Path(root).resolve()

    def _path(self, key: str) -> Path:
        path = (self.root / key).resolve()
        if not key or path == self.root or self.root not in path.parents:
            raise StorageError(f"{key!r} is no key under {self.root}")
        return path

    def put(self, key, data):
        path = self._path(key)
        path.parent.mkdir(parents=True, exist_ok=True)
        handle, temporary = tempfile.mkstemp(dir=path.parent)
        try:
            with os.fdopen(handle, "wb") as f:
                f.write(data)
            os.replace(temporary, path)
        except BaseException:
            Path(temporary).unlink(missing_ok=True)
            raise

    def get(self, key):
        try:
            return self._path(key).read_bytes()
        except OSError as error:
            raise StorageError(f"nothing at {key!r}") from error

    def exists(self, key):
        try:
            return self._path(key).is_file()
        except StorageError:
            return False

    def url(self, key):
        return self._path(key).as_uri()


#: file systems in which a file takes another's place by a rename; others are object stores
RENAMING = (None, "file", "hdfs", "viewfs", "webhdfs", "har")


@registry.register
class HadoopBlobStore(BlobStore):
    """Blobs in any file system that Spark reaches (s3a://, hdfs://, file:).

    The root is made if it is not there.  A blob is written beside its place and
    put there in one step, so that a reader finds the old one or the new one; in
    an object store, where an upload is such a step itself, it is written at once.  sign, a function of (address,
    seconds), makes addresses that need no credentials.
    """

    name = "hadoop"

    def __init__(self, spark: SparkSession, root: str, sign=None, seconds: int = 3600):
        super().__init__()
        self.spark, self.root, self.sign, self.seconds = spark, root.rstrip("/"), sign, seconds

    def _file(self, key: str):
        if not key or key.startswith("/") or ".." in key.split("/"):
            raise StorageError(f"{key!r} is no key")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def put(self, key, data):
        fs, path = self._file(key)
        hadoop, here = self.spark._jvm.org.apache.hadoop.fs, path.toUri().getScheme() not in RENAMING
        beside = path if here else hadoop.Path(path.getParent(), f".{uuid.uuid4().hex}")
        fs.mkdirs(path.getParent())
        try:
            out = fs.create(beside, True)
            try:
                out.write(bytearray(data))
            finally:
                out.close()
            if not here:
                options = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
                options[0] = getattr(hadoop, "Options$Rename").OVERWRITE
                hadoop.FileContext.getFileContext(path.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(beside, path, options)
        except Py4JJavaError as error:
            if not here:
                fs.delete(beside, False)
            raise StorageError(f"{key!r} could not be put in its place: {error.java_exception}") from error

    def get(self, key):
        if not self.exists(key):
            raise StorageError(f"nothing at {key!r}")
        rows = self.spark.read.format("binaryFile").load(f"{self.root}/{key}").select("content").collect()
        return bytes(rows[0].content)

    def exists(self, key):
        try:
            fs, path = self._file(key)
            return fs.exists(path)
        except Exception:
            return False

    def url(self, key):
        address = f"{self.root}/{key}"
        return address if self.sign is None else self.sign(address, self.seconds)


def read_sources(spark: SparkSession, path: str, **metadata: str) -> DataFrame:
    """(uri, content, length, metadata) of the files at path; a missing path fails at once."""
    entries = F.create_map(*[F.lit(str(x)) for kv in metadata.items() for x in kv]) if metadata else F.create_map().cast("map<string,string>")
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("uri"), "content", "length", entries.alias("metadata"))


def bytes_source(spark: SparkSession, rows: list[tuple[str, bytes]], **metadata: str) -> DataFrame:
    """The same of (name, bytes) pairs."""
    out = [(name, bytearray(data), len(data), {k: str(v) for k, v in metadata.items()}) for name, data in rows]
    return spark.createDataFrame(out, "uri string, content binary, length long, metadata map<string,string>")


def with_doc_id(sources: DataFrame) -> DataFrame:
    """doc_id: SHA-256 of the bytes; of the uri where there are none."""
    return sources.withColumn("doc_id", F.coalesce(F.sha2("content", 256), F.sha2("uri", 256), F.uuid()))


def raw_blobs(sources: DataFrame) -> DataFrame:
    """(key, doc_id, content) to store: raw/hash/original.ext, one for each content."""
    key = F.concat(F.lit("raw/"), "doc_id", F.lit("/original"), canonical_extension(F.col("format"), F.col("uri")))
    return sources.dropDuplicates(["doc_id"]).select(key.alias("key"), "doc_id", "content")


def missing(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """rows whose keys are not stored yet: what a cache has to compute or capture."""
    return rows.join(stored.select(*keys).distinct(), keys, "left_anti")


def through_cache(rows: DataFrame, spark: SparkSession, path: str, keys: list[str], compute) -> DataFrame:
    """compute(rows that the Parquet cache at path lacks), appended to it, and then all of rows joined with the cache."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    new = compute(missing(rows, spark.read.parquet(path), keys) if there else rows)
    new.write.mode("append").parquet(path)
    return rows.select(*keys).distinct().join(spark.read.schema(new.schema).parquet(path).dropDuplicates(keys), keys)


class Catalogue:
    """Documents that were indexed: the first file name of a content stays unless it is overwritten."""

    SCHEMA = "doc_id string, source_uri string, content_hash string, ext string, seq long"

    def __init__(self, spark: SparkSession, rows: DataFrame | None = None):
        self.spark = spark
        self.rows = rows if rows is not None else spark.createDataFrame([], self.SCHEMA)
        self._seq = 0

    def record(self, sources: DataFrame, overwrite: bool = False) -> None:
        self._seq += 1
        new = sources.select("doc_id", F.col("uri").alias("source_uri"), F.col("doc_id").alias("content_hash"), canonical_extension(F.col("format"), F.col("uri")).alias("ext"))
        new = first_wins(new.withColumn("seq", F.monotonically_increasing_id()), "doc_id").withColumn("seq", F.lit((-self._seq if overwrite else self._seq) * 1.0).cast("long"))
        # a checkpoint, so that the plan does not grow with every record
        shared_folder(self.spark)
        self.rows = first_wins(self.rows.unionByName(new.select(*self.rows.columns)), "doc_id").checkpoint()

    def documents(self) -> DataFrame:
        return self.rows.drop("seq")

    def get(self, doc_id: str):
        """The document's row, or None."""
        return self.documents().where(F.col("doc_id") == doc_id).first()

    def source_uri(self, doc_id: str) -> str | None:
        row = self.get(doc_id)
        return row.source_uri if row else None

    def download_url(self, doc_id: str, store: BlobStore | None) -> str | None:
        """Where the raw bytes of a document lie in store."""
        if store is None:
            raise ConfigError("a download url needs a blob store")
        row = self.get(doc_id)
        return store.url(f"raw/{doc_id}/original{row.ext}") if row else None


def first_wins(rows: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """The row of the least seq for each key."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*others), F.col(seq)).alias("r")).select(key, "r.*").select(*rows.columns)
