"""Corpus pipeline: the stages in order, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import bpe, decontaminate, language, ngram_join, quality
from siftwell.llm.shared import Scratch, discarding, without_ids

TOKENIZER = "byte_bpe_50k.json"
#: a document stays if the probability of quality 1 is at least this
QUALITY = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from all labels, does not reject."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), modulus=0)
    return quality.predict(docs, model).where(F.col("score") >= QUALITY).select(*docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language or several: those without a letter, or that no set of learnt languages explains better than chance, go."""
    return language.predict(docs, language.fit(docs, modulus=0)).where("known").select(*docs.columns)


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each component of near duplicates."""
    found = ngram_join.near_duplicates(docs)
    return without_ids(docs, found.where("doc_id <> component_id").select("doc_id"))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without_ids(docs, found.where("contaminated").select("doc_id"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what is left."""
    return bpe.round_trip(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality", quality_stage), ("language", language_stage), ("near duplicates", duplicates_stage), ("decontamination", benchmark_stage), ("tokens", tokens_stage)]

#: The models and joins of these stages are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage returns for the documents of sf_dir.

    Null and repeated ids, null and empty texts and empty tables are handled as
    each operator defines: rows without an id are no duplicates and never
    contaminated, repeated rows go or stay together.  A stage's intermediate
    tables and its input are deleted when its result has been written.
    """
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for number, (_, stage) in enumerate(STAGES):
        with discarding():
            docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{number}")
        scratch.drop(f"stage-{number - 1}")
    return docs
