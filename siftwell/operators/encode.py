"""Encoders: texts to dense or sparse vectors, and a cache in front of them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.errors import ConfigError, EmbeddingError
from siftwell.functions.text import batch_counts, lowered, ranked_codes, split_words, tokens
from siftwell.plans.component import Component, registry


class Embedder(Component):
    """Dense vectors; passages and queries may be encoded differently."""

    kind = "embedder"
    distance = "cosine"

    @property
    def dimensions(self) -> int:
        raise NotImplementedError

    def passage(self, text: Column) -> Column:
        raise NotImplementedError

    def query(self, text: Column) -> Column:
        return self.passage(text)


@lru_cache(maxsize=1 << 18)
def _place(token: str, dimensions: int) -> tuple[int, float]:
    value = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "big")
    return value % dimensions, 1.0 if value >> 63 else -1.0


#: texts that are embedded at a time
EMBED_ROWS = 1_000


def hashed_vectors(texts: list[str], dimensions: int) -> np.ndarray:
    """Signed counts of each text's hashed words, scaled to length 1, as rows; zero without words.  The place of a word is looked up once for all texts."""
    words, row = split_words(pa.array([t.lower() for t in texts], pa.string()))
    coded = words.dictionary_encode()
    places = [_place(w, dimensions) for w in coded.dictionary.to_pylist()]
    bucket, sign = np.array([p for p, _ in places], np.int64), np.array([s for _, s in places])
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # sums of ones are exact in any order
    out = np.bincount(row * dimensions + bucket[codes], weights=sign[codes], minlength=len(texts) * dimensions).astype(np.float64).reshape(len(texts), dimensions)
    length = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(length > 0, length, 1.0)


def hashed_vector(text: str, dimensions: int) -> np.ndarray:
    return hashed_vectors([text], dimensions)[0]


@registry.register
class HashingEmbedder(Embedder):
    """Words hashed to signed buckets; needs no model."""

    name = "hashing"

    @dataclass
    class Config:
        dimensions: int = 256

    @property
    def dimensions(self):
        return self.config.dimensions

    def passage(self, text):
        dimensions = self.config.dimensions

        @F.arrow_udf("array<double>")
        def embed(texts: pa.Array) -> pa.Array:
            parts = (texts.slice(at, EMBED_ROWS).to_pylist() for at in range(0, len(texts), EMBED_ROWS))
            flat = np.concatenate([np.zeros(0), *(hashed_vectors([t or "" for t in part], dimensions).ravel() for part in parts)])
            return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, dimensions, dtype=np.int32)), pa.array(flat))

        return embed(text)


@registry.register
class CallableEmbedder(Embedder):
    """An injected model: a function of a list of texts that gives their vectors; queries may take an instruction in front."""

    name = "callable"

    @dataclass
    class Config:
        model: str = ""
        dimensions: int = 0
        query_instruction: str = ""
        normalize: bool = True
        batch_size: int = 32

    def __init__(self, encode: Callable[[list[str]], list] | None = None, config=None, **fields):
        super().__init__(config, **fields)
        if encode is None or self.config.dimensions <= 0:
            raise ConfigError("the callable embedder needs encode= and dimensions=")
        self.encode = encode

    @property
    def dimensions(self):
        return self.config.dimensions

    def passage(self, text):
        encode, c = self.encode, self.config

        @F.arrow_udf("array<double>")
        def embed(texts: pa.Array) -> pa.Array:
            values, out = [t or "" for t in texts.to_pylist()], []
            for i in range(0, len(values), c.batch_size):
                part = values[i : i + c.batch_size]
                found = np.asarray(encode(part), dtype=float)
                if found.shape != (len(part), c.dimensions):
                    raise EmbeddingError(f"{len(part)} texts gave vectors of shape {found.shape}, not of {c.dimensions}")
                if c.normalize:
                    found = found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-300)
                out.extend(found.tolist())
            return pa.array(out, pa.list_(pa.float64()))

        return embed(text)

    def query(self, text):
        return self.passage(F.concat(F.lit(self.config.query_instruction), text))


class SparseEncoder(Component):
    kind = "sparse_encoder"

    def passage(self, text: Column) -> Column:
        raise NotImplementedError

    def query(self, text: Column) -> Column:
        return self.passage(text)


@registry.register
class HashedTermFrequency(SparseEncoder):
    """Term frequencies at hashed indices."""

    name = "hashed-tf"

    @dataclass
    class Config:
        buckets: int = 1 << 20

    def places(self, text: Column) -> Column:
        """The index of each word."""
        return F.transform(tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(self.config.buckets)).cast("int"))

    def passage(self, text):
        # a batch of rows is counted at a time: a sort by a function of two values in each row took most of an encoding
        @F.arrow_udf("struct<indices:array<int>,values:array<double>>")
        def count(lists: pa.Array) -> pa.Array:
            indices, codes = ranked_codes(lists.flatten())
            rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            kept, starts, n = batch_counts(rows, len(lists), codes, len(indices))
            return pa.StructArray.from_arrays([pa.ListArray.from_arrays(starts, indices.take(pa.array(kept))), pa.ListArray.from_arrays(starts, pa.array(n.astype(np.float64)))], ["indices", "values"])

        return count(self.places(text))


class CountedWords(SparseEncoder):
    """Term frequencies at indices that are made of words: a batch's distinct words are asked for theirs at once."""

    def indices(self, words: list[str]) -> list[int]:
        raise NotImplementedError

    def passage(self, text):
        place = self.indices

        @F.arrow_udf("struct<indices:array<int>,values:array<double>>")
        def count(texts: pa.Array) -> pa.Array:
            words, row = split_words(texts)
            coded = words.dictionary_encode()
            known, at = np.unique(np.array(place(coded.dictionary.to_pylist()), np.int32), return_inverse=True)
            kept, starts, n = batch_counts(row, len(texts), at[coded.indices.to_numpy(zero_copy_only=False)], len(known))
            return pa.StructArray.from_arrays([pa.ListArray.from_arrays(starts, pa.array(known[kept])), pa.ListArray.from_arrays(starts, pa.array(n.astype(np.float64)))], ["indices", "values"])

        return count(lowered(text))


NAMESPACES = ("passages", "queries")


class EmbeddingCache:
    """Vectors by (fingerprint, namespace, hash of the text) in a Parquet folder; only misses are encoded."""

    def __init__(self, inner: Embedder, path: str):
        self.inner, self.path = inner, path.rstrip("/")

    def fingerprint(self) -> str:
        return self.inner.fingerprint()

    def describe(self) -> dict:
        return self.inner.describe()

    def _folder(self, namespace: str) -> str:
        return f"{self.path}/{self.fingerprint()}/{namespace}"

    def stored(self, spark, namespace: str) -> DataFrame:
        empty = spark.createDataFrame([], "text_hash string, vector array<double>")
        jvm = spark._jvm.org.apache.hadoop.fs.Path(self._folder(namespace))
        if not jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm):
            return empty
        return spark.read.schema(empty.schema).parquet(self._folder(namespace))

    def embed(self, rows: DataFrame, text: str = "text", out: str = "vector", namespace: str = "passages") -> DataFrame:
        """rows with their vectors; each distinct missing text is encoded once, and written."""
        if namespace not in NAMESPACES:
            raise ConfigError(f"a namespace is one of {NAMESPACES}")
        spark = rows.sparkSession
        keyed = rows.withColumn("text_hash", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
        missing = keyed.select("text_hash", F.col(text).alias("__text")).dropDuplicates(["text_hash"]).join(self.stored(spark, namespace), "text_hash", "left_anti")
        encode = self.inner.passage if namespace == "passages" else self.inner.query
        missing.select("text_hash", encode(F.col("__text")).alias("vector")).write.mode("append").parquet(self._folder(namespace))
        vectors = self.stored(spark, namespace).dropDuplicates(["text_hash"]).withColumnRenamed("vector", out)
        return keyed.join(vectors, "text_hash", "left").drop("text_hash")
