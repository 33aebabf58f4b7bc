"""Incremental ingestion: files that arrive are parsed, chunked and added once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.plans.pipeline import IndexingPipeline
from siftwell.sources import blobs
from siftwell.sources.detect import detect_format


def watch_files(spark: SparkSession, path: str, pattern: str = "*", per_trigger: int = 1000) -> DataFrame:
    """A stream of (uri, content, length) of the files that arrive in path."""
    binary = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(binary).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).load(path)
    return files.select(F.col("path").alias("uri"), "content", "length")


def ingest_stream(stream: DataFrame, pipeline: IndexingPipeline, known: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None):
    """A query that indexes each content once, whenever it arrives again.

    The stream's state, kept with the checkpoint, holds the hashes of contents
    that came before, so a batch looks up its own contents and reads nothing that
    is stored; for many millions of them, set RocksDB as the session's state
    store.  Documents are written to known, in a folder of their batch, before
    they are indexed, so chunks do not depend on files that may go.  A batch that
    is run again after a failure writes the same folder again and upserts the
    same chunks: the sinks' last write wins.
    """
    new = stream.withColumn("__content", F.sha2("content", 256)).dropDuplicates(["__content"]).drop("__content")

    def add(batch: DataFrame, number: int) -> None:
        folder = f"{known.rstrip('/')}/batch={number}"
        pipeline.parser.parse(blobs.with_doc_id(detect_format(batch))).write.mode("overwrite").parquet(folder)
        documents = batch.sparkSession.read.parquet(folder)
        if documents.limit(1).count():
            chunks = pipeline.index_documents(documents)
            if on_batch:
                on_batch(chunks, number)
            chunks.unpersist()

    return new.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
