"""Tuners: enumerate a space, run and score each spec, judge the finalists, log every trial."""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame

from siftwell.errors import ConfigError, SiftError
from siftwell.operators.metrics import Evaluator, aggregate
from siftwell.plans.component import Component, registry
from siftwell.plans.pipeline import IndexingPipeline, PipelineBuilder, RagPipeline
from siftwell.plans.space import SearchSpace, validate_spec
from siftwell.plans.stages import StageStore, table_fingerprint
from siftwell.plans.trials import Leaderboard, Trace, Trial, TrialLog, trial_costs, trial_frame, trial_id


class Tuner(Component):
    """Screens all specs with retrieval metrics; the best of them are run again with answers."""

    kind = "tuner"

    @dataclass
    class Config:
        screen_by: str = "ndcg@10"
        finalists: int = 5

    def specs(self, space: SearchSpace) -> Iterator[dict]:
        raise NotImplementedError

    def run(self, space: SearchSpace, samples: DataFrame, documents: DataFrame, builder: PipelineBuilder, evaluators: Sequence[Evaluator], log: TrialLog | None = None, k: int = 5, stages: StageStore | None = None) -> Leaderboard:
        """samples: (qid, text, relevant_chunk_ids, relevant_doc_ids, reference_answer); documents: those, or sources with their content.

        stages keeps what specs have in common; one with a root is found again by the next run.
        """
        screen = [e for e in evaluators if e.stage == "retrieval"]
        judges = [e for e in evaluators if e.stage == "generation"]
        if not screen:
            raise ConfigError("a tuner needs an evaluator of the retrieval stage")
        if self.config.finalists <= 0:
            raise ConfigError("finalists must be positive")
        if samples.limit(1).count() == 0:
            raise ConfigError("there are no samples")
        shared, trials, specs = Shared(builder, documents, stages or StageStore(samples.sparkSession)), [], {}

        def attempt(spec: dict, judges: Sequence[Evaluator]) -> None:
            trials.append(self._trial(spec, samples, shared, screen, judges, k))
            if log:
                log.append(trials[-1])

        for spec in self.specs(space):
            specs[trial_id(spec)] = spec
            attempt(spec, [])
        board = Leaderboard(trial_frame(samples.sparkSession, trials))
        if judges and self.config.screen_by in board.metrics():
            for row in board.top(self.config.finalists, by=self.config.screen_by).select("trial_id").collect():
                attempt(specs[row.trial_id], judges)
            board = Leaderboard(trial_frame(samples.sparkSession, trials))
        if stages is None:
            shared.release()
        return board

    def _trial(self, spec, samples, shared, screen, judges, k) -> Trial:
        began, trace = datetime.now().isoformat(timespec="seconds"), Trace(trial_id(spec))
        described, prints, metrics, note = spec, {}, {}, {}
        try:
            pipeline, chunks = shared.indexed(spec, trace)
            queries = samples.select("qid", "text")
            # every evaluator reads them
            found = pipeline.query(queries, k).persist()
            answers = pipeline.timed("generate", lambda: pipeline.generator.generate(queries, found)) if judges else None
            rankings = found.select("qid", "chunk_id", found["pos"].alias("rank"))
            for e in [*screen, *judges]:
                means = aggregate(e.evaluate(samples, rankings, chunks, answers), e.metrics()).first().asDict()
                metrics |= {m: float(v) for m, v in means.items() if v is not None}
            described, prints = pipeline.describe(), pipeline.fingerprints()
            found.unpersist()
            pipeline.report()
        except SiftError as error:
            metrics, note = {}, {"error": f"{type(error).__name__}: {error}"}
        paid = trial_costs(trace.frame(samples.sparkSession)).first() if trace.events else None
        cost, hits = (dict(paid.cost), dict(paid.cache_hits)) if paid else ({}, {})
        return Trial(trial_id(spec), described, prints, metrics, cost, hits, began, datetime.now().isoformat(timespec="seconds"), {"spec": spec, **note})


class Shared:
    """What specs have in common, by a stage store: one parse for each parser, one cut for each chunker, one encoding for each space of the same chunks, in whatever order specs come."""

    def __init__(self, builder: PipelineBuilder, source: DataFrame, stages: StageStore):
        self.builder, self.source, self.stages = builder, source, stages
        self.fingerprint = table_fingerprint(source)

    def indexed(self, spec: dict, trace: Trace) -> tuple[RagPipeline, DataFrame]:
        """The pipeline of spec over its indexed documents, and their chunks."""
        validate_spec(spec)
        parser, chunker, enrichers = self.builder.front(spec)
        documents, chain = self.stages.documents(self.source, self.fingerprint, parser, lambda: IndexingPipeline(parser, chunker).documents(self.source), trace)
        chunks, chain = self.stages.chunks(documents, chain, chunker, enrichers, trace)
        if "vector_store" in spec:  # a store of its own is filled for each spec
            pipeline = self.builder.build(spec, None, trace)
            pipeline.corpus.add(chunks)
        else:
            pipeline = self.builder.build(spec, self.stages.corpus(chunks, chain, self.builder.representations(spec)), trace)
        return pipeline, chunks

    def release(self) -> None:
        self.stages.release()


@registry.register
class GridTuner(Tuner):
    """Every spec of the space."""

    name = "grid"

    def specs(self, space):
        return space.expand()


@registry.register
class RandomTuner(Tuner):
    """A seeded sample of the space, without repetition; specs are made from the numbers that are drawn, and the space is not listed."""

    name = "random"

    @dataclass
    class Config:
        screen_by: str = "ndcg@10"
        finalists: int = 5
        n_trials: int = 10
        seed: int = 0

    def __init__(self, config=None, **fields):
        super().__init__(config, **fields)
        if self.config.n_trials <= 0:
            raise ConfigError("n_trials must be positive")

    def specs(self, space):
        n = space.size()
        yield from (space.at(i) for i in random.Random(self.config.seed).sample(range(n), min(self.config.n_trials, n)))
