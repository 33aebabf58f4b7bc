"""Metrics of rankings and answers, as joins and aggregates."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from siftwell.errors import ConfigError, EvaluationError
from siftwell.functions.text import counted, let, normalised, tokens
from siftwell.plans.component import Component, registry

#: texts whose words are compared with passages at a time
PASSAGE_ROWS = 200


def by_document(rankings: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rankings (qid, doc_id, rank) of documents: each stands where its first chunk does, without gaps."""
    first = rankings.join(chunks.select(F.col("id").alias("chunk_id"), "doc_id"), "chunk_id").groupBy("qid", "doc_id").agg(F.min("rank").alias("at"))
    w = Window.partitionBy("qid").orderBy("at")
    return first.select("qid", "doc_id", F.row_number().over(w).alias("rank"))


class Passages:
    """Runs of words (qid, n, run) of a block of queries, as numbers of their words."""

    def __init__(self, wanted: pa.Table):
        qids, runs = wanted["qid"].combine_chunks(), wanted["run"].combine_chunks()
        self.kind, self.qids = qids.type, qids.to_pylist()
        self.words = pc.unique(pc.list_flatten(runs))
        number = pc.index_in(pc.list_flatten(runs), self.words).to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = wanted["n"].to_numpy()
        starts = np.cumsum(sizes) - sizes
        #: by length: sorted hashes, and for each the places in qids and the numbers
        self.by_length = {}
        for n in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == n)
            rows = number[starts[at, None] + np.arange(n)]
            hashes = _run_hashes(len(at), rows.T)
            by = np.argsort(hashes, kind="stable")
            self.by_length[n] = (hashes[by], at[by], rows[by])

    def found(self, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """(row, place in qids) of the runs that stand in lists of words, each once."""
        number = pc.fill_null(pc.index_in(pc.list_flatten(words), self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        row, ends = np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.cumsum(sizes), sizes)
        unknown = np.concatenate([[0], np.cumsum(number < 0)])
        out = [np.zeros((0, 2), np.int64)]
        for n, (hashes, at, runs) in self.by_length.items():
            first = np.arange(max(0, len(number) - n + 1))
            # inside a row, and of words that some query has
            first = first[(first + n <= ends[: len(first)]) & (unknown[first + n] == unknown[first])]
            mine = _run_hashes(len(first), (number[first + j] for j in range(n)))
            low, high = np.searchsorted(hashes, mine, "left"), np.searchsorted(hashes, mine, "right")
            times = high - low
            place = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
            here = np.repeat(first, times)
            # hashes find, numbers decide
            same = (number[here[:, None] + np.arange(n)] == runs[place]).all(axis=1)
            out.append(np.unique(np.stack([row[here[same]], at[place[same]]], axis=1), axis=0))
        return tuple(np.concatenate(out).T)


def _run_hashes(size: int, columns) -> np.ndarray:
    """Hashes of rows of numbers that are given column by column."""
    out = np.zeros(size, np.uint64)
    for column in columns:
        out = out * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64) + np.uint64(1)
    return out


def passages(texts: DataFrame, key: str, block: Passages) -> DataFrame:
    """(qid, key) of each row of texts (key, text) that has a run of the block; texts stay where they are."""
    share = texts.sparkSession.sparkContext.broadcast(block)

    def scan(batches):
        asked = share.value
        for batch in batches:
            for at in range(0, batch.num_rows, PASSAGE_ROWS):
                part = batch.slice(at, PASSAGE_ROWS)
                row, place = asked.found(part["w"])
                yield pa.RecordBatch.from_pydict({"qid": pa.array([asked.qids[i] for i in place], asked.kind), key: part[key].take(pa.array(row, pa.int64()))})

    rows = texts.select(key, tokens(F.col("text")).alias("w"))
    kinds = f"qid {from_arrow_type(block.kind).simpleString()}, {key} {rows.schema[key].dataType.simpleString()}"
    return rows.mapInArrow(scan, kinds).distinct()


def ideal(n: Column, k: int) -> Column:
    """DCG of n relevant items at the top of k."""
    return F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))


def ir_metrics(rankings: DataFrame, qrels: DataFrame, ks: Sequence[int] = (1, 5, 10), item: str = "doc_id") -> DataFrame:
    """(qid, recall@k ..., ndcg@k ..., mrr) of each query that has a relevant item."""
    if not ks or any(k <= 0 for k in ks):
        raise ValueError(f"cut-offs must be positive: {ks}")
    truth = qrels.select("qid", F.col(item).alias("item")).distinct()
    size = truth.groupBy("qid").agg(F.count("*").alias("n"))
    hits = truth.join(rankings.select("qid", F.col(item).alias("item"), "rank"), ["qid", "item"])
    gained = hits.groupBy("qid").agg(
        F.min("rank").alias("first"),
        *[F.sum((F.col("rank") <= k).cast("int")).alias(f"hits{k}") for k in ks],
        *[F.sum(F.when(F.col("rank") <= k, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias(f"dcg{k}") for k in ks],
    )
    rows = size.join(gained, "qid", "left")
    return rows.select(
        "qid",
        *[(F.coalesce(f"hits{k}", F.lit(0)) / F.col("n")).alias(f"recall@{k}") for k in ks],
        *[(F.coalesce(f"dcg{k}", F.lit(0.0)) / ideal(F.col("n"), k)).alias(f"ndcg@{k}") for k in ks],
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
    )


def token_f1(answer: Column, reference: Column) -> Column:
    """Harmonic mean of precision and recall of words as multisets; 1 if both are empty, 0 if one is.

    The counted words of both sides are sorted together: words in common stand
    side by side, so a long pair costs a sort and no comparison of all with all.
    """

    def f1(x: Column) -> Column:
        side = lambda c, n: F.transform(counted(x[c]), lambda t: F.struct(t["term"].alias("term"), F.lit(n).alias("side"), t["tf"].cast("int").alias("tf")))
        a, r = F.size(x["a"]), F.size(x["r"])
        ratio = let(F.array_sort(F.concat(side("a", 0), side("r", 1))), lambda both: 2.0 * F.aggregate(F.sequence(F.lit(1), F.size(both)), F.lit(0), lambda s, i: s + shared(both, i)) / (a + r))
        return F.when((a == 0) & (r == 0), F.lit(1.0)).when((a == 0) | (r == 0), F.lit(0.0)).otherwise(ratio)

    def shared(both: Column, i: Column) -> Column:
        one, other = F.element_at(both, i), F.get(both, i)  # get counts from 0: the one that follows
        return F.when(one["term"] == other["term"], F.least(one["tf"], other["tf"])).otherwise(F.lit(0))

    return let(F.struct(tokens(answer).alias("a"), tokens(reference).alias("r")), f1)


def exact_match(answer: Column, reference: Column) -> Column:
    return (normalised(answer) == normalised(reference)).cast("double")


def without_markers(text: Column) -> Column:
    return F.regexp_replace(text, r"\[\d+\]", " ")


def aggregate(scores: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row: the mean of each metric over the samples that have it."""
    return scores.agg(*[F.avg(F.col(f"`{m}`")).alias(m) for m in metrics])


class Evaluator(Component):
    """Scores of samples (qid, relevant chunk ids or document ids, reference) against rankings and answers."""

    kind = "evaluator"
    stage = ""

    def evaluate(self, samples: DataFrame, rankings: DataFrame, chunks: DataFrame, answers: DataFrame | None = None) -> DataFrame:
        raise NotImplementedError


@registry.register
class RetrievalEvaluator(Evaluator):
    """Recall, nDCG and reciprocal rank; chunk labels win over document labels, unlabelled samples score nothing."""

    name, stage = "ir", "retrieval"

    @dataclass
    class Config:
        k_values: tuple[int, ...] = (1, 5, 10)

    def __init__(self, config=None, **fields):
        super().__init__(config, **fields)
        if not self.config.k_values or any(not isinstance(k, int) or k <= 0 for k in self.config.k_values):
            raise ConfigError(f"k_values must be positive numbers: {self.config.k_values}")

    def metrics(self) -> list[str]:
        return [f"{m}@{k}" for m in ("recall", "ndcg") for k in self.config.k_values] + ["mrr"]

    def evaluate(self, samples, rankings, chunks, answers=None):
        by_chunk = F.size(F.coalesce("relevant_chunk_ids", F.array().cast("array<string>"))) > 0
        of_chunks = samples.where(by_chunk).select("qid", F.explode("relevant_chunk_ids").alias("chunk_id"))
        of_docs = samples.where(~by_chunk).select("qid", F.explode(F.coalesce("relevant_doc_ids", F.array().cast("array<string>"))).alias("doc_id"))
        scored = ir_metrics(rankings, of_chunks, self.config.k_values, "chunk_id").unionByName(ir_metrics(by_document(rankings, chunks), of_docs, self.config.k_values, "doc_id"))
        return samples.select("qid").join(scored, "qid", "left")


@registry.register
class AnswerMatchEvaluator(Evaluator):
    """Token F1 and exact match of answers that have a reference."""

    name, stage = "answer-match", "generation"

    @dataclass
    class Config:
        strip_citations: bool = True

    def metrics(self) -> list[str]:
        return ["token_f1", "exact_match"]

    def evaluate(self, samples, rankings, chunks, answers=None):
        if answers is None:
            return samples.select("qid", F.lit(None).cast("double").alias("token_f1"), F.lit(None).cast("double").alias("exact_match"))
        text = without_markers(F.col("text")) if self.config.strip_citations else F.col("text")
        both = samples.select("qid", "reference_answer").join(answers.select("qid", text.alias("__a")), "qid", "left")
        known = F.col("__a").isNotNull() & (F.coalesce("reference_answer", F.lit("")) != "")
        return both.select("qid", F.when(known, token_f1(F.col("__a"), F.col("reference_answer"))).alias("token_f1"), F.when(known, exact_match(F.col("__a"), F.col("reference_answer"))).alias("exact_match"))


#: what a judge may report of an answer
JUDGED = ("faithfulness", "answer_relevancy", "context_precision", "context_recall")


def judge_key(model: str) -> Column:
    """Key of a verdict: the model, the question and the answer."""
    sep = F.lit("\x00")
    return F.sha2(F.concat(F.lit(model), sep, F.col("question"), sep, F.col("answer")), 256)


@registry.register
class JudgeEvaluator(Evaluator):
    """Verdicts of an injected judge on answers and their passages.

    judge takes a list of {question, answer, contexts, reference} and gives a
    mapping of metrics for each; a metric that it leaves out or puts to None is
    an abstention and joins no mean.  With cache, a Parquet folder, a pair of
    question and answer is judged once.
    """

    name, stage = "judge", "generation"

    @dataclass
    class Config:
        model: str = ""
        batch_size: int = 16

    def __init__(self, judge: Callable[[list[dict]], list[dict]] | None = None, cache: str | None = None, config=None, **fields):
        super().__init__(config, **fields)
        if judge is None:
            raise ConfigError("the judge evaluator needs judge=")
        self.judge, self.cache = judge, cache

    def metrics(self) -> list[str]:
        return list(JUDGED)

    def _verdicts(self, rows: DataFrame) -> DataFrame:
        judge, size = self.judge, self.config.batch_size
        fields = ("question", "answer", "contexts", "reference")

        def run(batches):
            for batch in batches:
                asked = [dict(zip(fields, row, strict=True)) for row in zip(*(batch[f].to_pylist() for f in fields), strict=True)]
                said = []
                for i in range(0, len(asked), size):
                    part = asked[i : i + size]
                    found = list(judge(part))
                    if len(found) != len(part):
                        raise EvaluationError(f"the judge gave {len(found)} verdicts for {len(part)} answers")
                    said.extend(found)
                values = [pa.array([None if v.get(m) is None else float(v[m]) for v in said], pa.float64()) for m in JUDGED]
                yield pa.RecordBatch.from_arrays([batch["key"], *values], names=["key", *JUDGED])

        return rows.select("key", *fields).mapInArrow(run, "key string, " + ", ".join(f"{m} double" for m in JUDGED))

    def evaluate(self, samples, rankings, chunks, answers=None):
        if answers is None:
            return samples.select("qid", *[F.lit(None).cast("double").alias(m) for m in JUDGED])
        passages = rankings.join(chunks.select(F.col("id").alias("chunk_id"), F.col("text").alias("passage")), "chunk_id").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "passage"))).alias("p"))
        rows = samples.select("qid", F.col("text").alias("question"), F.col("reference_answer").alias("reference")).join(answers.select("qid", F.col("text").alias("answer")), "qid").join(passages, "qid", "left")
        rows = rows.withColumn("contexts", F.coalesce(F.transform("p", lambda x: x["passage"]), F.array().cast("array<string>"))).drop("p").withColumn("key", judge_key(self.config.model))
        once = rows.dropDuplicates(["key"])
        if self.cache:
            from siftwell.sources.blobs import through_cache

            verdicts = through_cache(once, rows.sparkSession, self.cache, ["key"], self._verdicts)
        else:
            verdicts = self._verdicts(once)
        return samples.select("qid").join(rows.select("qid", "key").join(verdicts, "key").drop("key"), "qid", "left")
