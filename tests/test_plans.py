import json
import re
from dataclasses import dataclass
from enum import Enum

import pytest
from pyspark.sql import functions as F

from siftwell.errors import ConfigError, DuplicateComponent, StorageError, UnknownComponent
from siftwell.operators import encode, index, metrics, refine, retrieve
from siftwell.plans import pipeline, space, trials, tuner
from siftwell.plans.component import Component, Registry, registry
from siftwell.plans.space import SearchSpace, choice
from siftwell.sources import blobs, parsers
from siftwell.streaming import ingest


class Mode(Enum):
    A = "a"


class Thing(Component):
    kind, name = "parser", "thing"

    @dataclass
    class Config:
        size: int = 1
        api_key: str = "s"
        max_tokens: int = 5
        mode: Mode = Mode.A
        extra: dict | None = None


def test_components():
    a = Thing(size=2, extra={"headers": {"authorization": "x", "n": 1}})
    assert a.describe()["config"] == {"size": 2, "api_key": "<redacted>", "max_tokens": 5, "mode": "a", "extra": {"headers": {"authorization": "<redacted>", "n": 1}}}
    assert a.fingerprint() == Thing(size=2, api_key="other", extra={"headers": {"authorization": "y", "n": 1}}).fingerprint() != Thing(size=3).fingerprint()
    assert Thing(max_tokens=6).fingerprint() != Thing().fingerprint() and len(a.fingerprint()) == 16 and Thing(Thing.Config(size=4), max_tokens=7).config.size == 4
    for broken in (lambda: Thing(none=1), lambda: Thing(config=3), lambda: retrieve.HydeRetriever(), lambda: refine.KeywordRefiner(x=1)):
        with pytest.raises(ConfigError):
            broken()


def test_registry():
    r = Registry(group=None)
    r.register(Thing)
    r.register(Thing)
    assert r.create("parser", "thing", size=3).config.size == 3 and r.available("parser") == ["thing"] and r.manifest()["parser"][0]["fields"][1]["secret"]
    with pytest.raises(UnknownComponent):
        r.get("parser", "none")
    with pytest.raises(DuplicateComponent):
        r.register(type("Other", (Thing,), {}))
    assert {"fixed", "markdown-aware", "markdown-fixed"} <= set(registry.available("chunker"))


def test_space(tmp_path):
    s = SearchSpace(refine=[[choice("keyword")], [], [choice("score-threshold", min_score=[0.1, 0.2])]], chunker=[choice("fixed", overlap_chars=[0, 5], chunk_chars=[10]), choice("markdown-aware")])
    specs = list(s.expand())
    assert len(s) == len(specs) == 12 and s.dimensions() == ["chunker", "refine"] and specs[0]["chunker"] == specs[3]["chunker"] and specs[1]["refine"] == []
    nested = list(choice("dense", embedder=choice("hashing", dimensions=[8, 16]), tags=("a", "b")).expand())
    assert [n["params"]["embedder"]["params"]["dimensions"] for n in nested] == [8, 16] and nested[0]["params"]["tags"] == ("a", "b") and list(SearchSpace().expand()) == [{}]
    for broken in (lambda: SearchSpace(embedder=[choice("x")]), lambda: SearchSpace(chunker=[]), lambda: SearchSpace(refine=[choice("x")]), lambda: SearchSpace(chunker=["fixed"]), lambda: choice("x", a=[]), lambda: choice(""), lambda: space.validate_spec({"chunker": {}}), lambda: space.validate_spec({"refine": {"name": "x"}}), lambda: space.validate_spec({"chunker": {"name": "x", "more": 1}})):
        with pytest.raises(ConfigError):
            broken()
    space.save_spec(specs[0], str(tmp_path / "s.json"))
    assert space.load_spec(str(tmp_path / "s.json")) == specs[0]
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(ConfigError):
        space.load_spec(str(tmp_path / "bad.json"))


def trial(n, quality=None, cost=None, **spec):
    return trials.Trial(f"t{n}", spec or {"chunker": {"name": "fixed", "config": {"n": n}}}, {}, {} if quality is None else {"q": quality}, {} if cost is None else {"query_ms": cost})


def test_leaderboard(spark):
    board = trials.Leaderboard(trials.trial_frame(spark, [trial(1, 0.5, 10.0), trial(2, 0.9), trial(3, 0.5), trial(4), trial(1, 0.7, 20.0)]))
    assert [r.trial_id for r in board.top(5, by="q").collect()] == ["t2", "t1", "t3"] and board.best(by="q").trial_id == "t2" and len(board) == 4 and board.stages() == ["chunker"]
    assert board.to_table(by="q", n=2).splitlines() == ["| trial | q | query_ms |", "|-|-|-|", "| t2 | 0.9 |  |", "| t1 | 0.7 | 20 |"]
    assert trials.Leaderboard(board.frame.limit(0)).to_table(by="q").count("\n") == 1
    for broken in (lambda: board.top(0, by="q"), lambda: board.top(1, by="x"), lambda: board.marginals("parser", by="q")):
        with pytest.raises(ConfigError):
            broken()
    m = board.marginals("chunker", by="q").collect()
    assert m[0].option == "fixed(n=2)" and m[0].quality == pytest.approx(0.2) and sum(x.quality for x in m) == pytest.approx(0)
    shown = spark.createDataFrame([('{"refine": []}',), ('{"refine": [{"name": "a", "config": {}}, {"name": "b", "config": {"k": 1, "j": "x"}}]}',), ('{"chunker": {"name": "c"}}',)], "spec string")
    assert [r.o for r in shown.select(trials.option(F.col("spec"), "refine").alias("o")).collect()] == ["none", "a+b(j=x,k=1)", None]


def test_trial_log(tmp_path, spark):
    log = trials.TrialLog(str(tmp_path / "log.jsonl"))
    assert log.read() == []
    for t in (trial(1, 0.1), trial(2, 0.2), trial(1, 0.3)):
        log.append(t)
    assert [t.metrics["q"] for t in log] == [0.1, 0.2, 0.3] and log.latest()["t1"].metrics["q"] == 0.3
    assert [(r.trial_id, r.q) for r in log.query(spark, "select trial_id, metrics['q'] q from trials order by q desc").collect()] == [("t1", 0.3), ("t2", 0.2)]
    with open(log.path, "a") as f:
        f.write("{broken\n")
    with pytest.raises(StorageError, match="line 4"):
        log.read()
    with pytest.raises(Exception, match="no trial"):
        log.frame(spark).collect()
    with pytest.raises(ValueError, match="no new"):
        trials.Trial.from_json(json.dumps({"new": 1}))
    assert trials.Trial.from_json(trial(1, 0.5).to_json()) == trial(1, 0.5) and trials.trial_id({"a": 1, "b": 2}) == trials.trial_id({"b": 2, "a": 1})


def test_cost(spark):
    c = trials.Trace("t")
    c("parse", 10, True)
    c("parse", 5, False, {"input": 3, "flag": True, "note": "x"})
    c("generate", 7, usage={"output": 1})
    row = trials.trial_costs(c.frame(spark), {"input": 2.0}).first()
    assert row.cost == {"latency_ms": 22.0, "index_ms": 15.0, "query_ms": 7.0, "latency_ms.generate": 7.0, "latency_ms.parse": 15.0, "input": 3.0, "output": 1.0, "api_usd": 6.0} and row.cache_hits == {"parse": False}
    assert "api_usd" not in trials.trial_costs(c.frame(spark), {"other": 1.0}).first().cost
    trace = pipeline.trace_frame(spark, [("t", "parse", 1.0, True, {"input": 1.0}), ("t", "retrieve", 2.0, None, {}), ("u", "x", 3.0, None, {"z": 1.0})])
    assert {r.trial_id: (r.latency_ms, r.index_ms, r.query_ms) for r in trials.cost_rollup(trace).collect()} == {"t": (3.0, 1.0, 2.0), "u": (3.0, 0.0, 0.0)}
    assert {r.trial_id: r.api_usd for r in trials.usage_cost(trace, {"input": 5.0}).collect()} == {"t": 5.0, "u": None}


FACTS = b"# France\nThe capital of France is Paris.\n# Japan\nThe capital of Japan is Tokyo.\n# Food\nBread is made of flour.\n"


def rag(spark, **parts):
    return pipeline.RagPipeline(index.Corpus(index.TableStore(spark), [index.DenseRepresentation(encode.HashingEmbedder()), index.LexicalRepresentation()]), chunker=registry.create("chunker", "markdown-aware"), **parts)


def test_index_and_ask(spark, tmp_path):
    events = []
    p = rag(spark, refiners=[refine.KeywordRefiner(), refine.NeighborExpander()], cache=str(tmp_path / "cache"), trace=lambda *a, **k: events.append(a[0]))
    source = blobs.bytes_source(spark, [("facts.md", FACTS)])
    p.indexing.catalogue = blobs.Catalogue(spark)
    assert p.index(source).count() == 3 and p.index(source).count() == 3 and events == ["store_raw", "parse", "chunk"] * 2
    raw = spark.read.parquet(str(tmp_path / "cache" / "raw")).collect()
    assert len(raw) == 1 and raw[0].key.endswith("/original.md") and bytes(raw[0].content) == FACTS and p.indexing.catalogue.documents().first().source_uri == "facts.md"
    q = spark.createDataFrame([(1, "What is the capital of France?"), (2, "zzz qqq")], "qid long, text string")
    answers = {r.qid: r for r in p.ask(q, 2).collect()}
    assert len(events) == 6
    p.report()
    assert events[6:] == ["retrieve", "refine", "generate"]
    assert "Paris" in answers[1].text and answers[1].citations[0].marker == 1 and len(answers[1].citations[0].doc_id) == 64
    assert set(p.describe()) == set(p.fingerprints()) >= {"parser", "chunker", "refine"}
    other = index.Corpus(index.TableStore(spark), [index.LexicalRepresentation()])
    with pytest.raises(ConfigError):
        rag(spark, retriever=retrieve.IndexRetriever(other))
    assert isinstance(pipeline.default_retriever(other), retrieve.IndexRetriever)


def _shape(df):
    """The operators of a plan, without ids, counters and projections (those of two stages are merged where no counter is between them)."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    kinds = [m[1] for line in plan.splitlines() if (m := re.match(r"[ :]*(?:[+:]- )?([A-Z]\w+) ", line))]
    return [k for k in kinds if k not in ("CollectMetrics", "Project")], kinds.count("CollectMetrics")


def test_stages_are_observed_in_the_plan_they_are_part_of(spark, tmp_path):
    told = []
    note = lambda stage, ms, **detail: told.append((stage, ms, detail))
    source = blobs.bytes_source(spark, [("facts.md", FACTS), ("more.md", b"# More\nText.\n"), ("again.md", FACTS)])
    parts = (parsers.AutoParser(), registry.create("chunker", "markdown-aware"))
    bare, traced = (pipeline.IndexingPipeline(*parts, trace=t) for t in (None, note))
    plans = [_shape(p.chunks(p.documents(source))) for p in (bare, traced)]
    # nothing that Python makes is made twice: pages, spans, and the office kind of an archive
    assert plans[0][0].count("ArrowEvalPython") == 3
    assert plans[0][0] == plans[1][0] and [n for _, n in plans] == [0, 2]
    # nothing was computed yet: a stage that no action has computed stays to be told
    traced.report(0.5)
    assert told == []
    traced = pipeline.IndexingPipeline(*parts, trace=note)
    rows = traced.chunks(traced.documents(source))
    assert rows.count() == 4
    traced.report()
    assert [(s, d) for s, _, d in told] == [("parse", {"rows": 2}), ("chunk", {"rows": 4})] and all(ms >= 0 for _, ms, _ in told)
    traced.report()
    assert len(told) == 2
    # a cache: rows are those that it lacked
    for expected in (2, 0):
        told.clear()
        kept = pipeline.IndexingPipeline(*parts, cache=str(tmp_path / "cache"), trace=note)
        kept.documents(source)
        kept.report()
        assert [(s, d) for s, _, d in told] == [("store_raw", {}), ("parse", {"rows": expected, "cache_hit": expected == 0})]
    record = trials.Trace("t")
    for stage, ms, detail in told:
        record(stage, ms, **detail)
    cost = trials.trial_costs(record.frame(spark)).first()
    assert cost.cost["rows.parse"] == 0.0 and dict(cost.cache_hits) == {"parse": True}


def test_builder_and_tuners(spark, tmp_path):
    docs = spark.createDataFrame([("facts", FACTS.decode())], "doc_id string, markdown string")
    samples = spark.createDataFrame([(1, "capital of Japan", ["facts:1"], None, "The capital of Japan is Tokyo"), (2, "bread flour", ["facts:2"], None, "flour")], "qid long, text string, relevant_chunk_ids array<string>, relevant_doc_ids array<string>, reference_answer string")
    s = SearchSpace(chunker=[choice("markdown-aware")], representations=[[choice("lexical")], [choice("dense", embedder=choice("hashing", dimensions=[16]))]], generator=[choice("extractive")])
    log = trials.TrialLog(str(tmp_path / "trials.jsonl"))
    board = tuner.GridTuner(screen_by="ndcg@1", finalists=1).run(s, samples, docs, pipeline.PipelineBuilder(spark), [metrics.RetrievalEvaluator(k_values=(1,)), metrics.AnswerMatchEvaluator()], log)
    best = board.best(by="ndcg@1")
    assert len(board) == 2 and best.metrics["ndcg@1"] == 1.0 and best.metrics["token_f1"] > 0.5 and {"chunk", "retrieve"} <= {k.split(".")[-1] for k in best.cost} and len(log.read()) == 3
    picked = list(tuner.RandomTuner(n_trials=1, seed=3).specs(s))
    assert picked == list(tuner.RandomTuner(n_trials=1, seed=3).specs(s)) and len(list(tuner.RandomTuner(n_trials=9).specs(s))) == 2
    failing = SearchSpace(chunker=[choice("fixed", chunk_chars=[0])])
    failed = tuner.GridTuner().run(failing, samples, docs, pipeline.PipelineBuilder(spark), [metrics.RetrievalEvaluator()])
    assert "ConfigError" in failed.frame.first().metadata["error"]
    # chunks and corpora are shared by the specs that have them in common
    several = SearchSpace(chunker=[choice("markdown-aware"), choice("fixed")], representations=[[choice("lexical")]], refine=[[], [choice("keyword")], [choice("score-threshold")]])
    shared = tuner.GridTuner(screen_by="ndcg@1").run(several, samples, docs, pipeline.PipelineBuilder(spark), [metrics.RetrievalEvaluator(k_values=(1,))])
    hits = [r.cache_hits.get("chunk") for r in shared.frame.orderBy("line").collect()]
    assert hits == [False, True, True] * 2
    built = pipeline.PipelineBuilder(spark, given={"complete": lambda p: "x"}).build({"retriever": {"name": "multi-query", "params": {"inner": {"name": "index", "params": {"representation": "lexical"}}}}, "refine": [{"name": "keyword"}]})
    assert built.querying.retriever.inner.space == "lexical" and built.describe()["refine"][0]["name"] == "keyword"
    for broken in (lambda: tuner.GridTuner().run(s, samples, docs, None, []), lambda: tuner.GridTuner(finalists=0).run(s, samples, docs, None, [metrics.RetrievalEvaluator()]), lambda: tuner.GridTuner().run(s, samples.limit(0), docs, None, [metrics.RetrievalEvaluator()]), lambda: tuner.RandomTuner(n_trials=0)):
        with pytest.raises(ConfigError):
            broken()


def test_ingest_and_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.md").write_bytes(FACTS)
    assert pipeline.ingest(spark, str(inbox)).first().markdown == FACTS.decode()
    p = rag(spark, parser=parsers.AutoParser())
    arrive = lambda: ingest.ingest_stream(ingest.watch_files(spark, str(inbox)), p.indexing, str(tmp_path / "known"), str(tmp_path / "check")).awaitTermination(120)
    arrive()
    assert p.corpus.store.chunks().count() == 3
    (inbox / "same.md").write_bytes(FACTS)
    (inbox / "b.txt").write_text("something new")
    arrive()
    assert p.corpus.store.chunks().count() == 4 and spark.read.parquet(str(tmp_path / "known")).count() == 2
    # a third start remembers both, and a batch that fails is run again
    (inbox / "again.txt").write_text("something new")
    (inbox / "c.txt").write_text("a third thing")
    seen = []

    def fail(chunks, number):
        seen.append(number)
        if len(seen) == 1:
            raise RuntimeError("cut off")

    for _ in range(2):
        run = ingest.ingest_stream(ingest.watch_files(spark, str(inbox)), p.indexing, str(tmp_path / "known"), str(tmp_path / "check"), fail)
        try:
            run.awaitTermination(120)
        except Exception as error:
            assert "cut off" in str(error)
    assert seen == [seen[0]] * 2 and p.corpus.store.chunks().count() == 5 and spark.read.parquet(str(tmp_path / "known")).count() == 3


def test_marginals_of_all_stages_in_one_pass(spark):
    rows = spark.createDataFrame([("a", "x", 1.0, 10.0), ("a", "y", 0.0, None), ("b", "x", 0.5, 2.0), ("b", "y", None, 9.0)], "chunker string, refine string, metric double, cost double")
    got = {(r.stage, r.option): (r.trials, round(r.quality, 6), round(r.cost, 6)) for r in trials.marginals(rows, ["chunker", "refine"]).collect()}
    assert got == {("chunker", "a"): (2, 0.0, 1.0), ("chunker", "b"): (1, 0.0, -2.0), ("refine", "x"): (2, 0.25, 2.0), ("refine", "y"): (1, -0.5, -4.0)}
    t = spark.createDataFrame([("b", {"q": 1.0}), ("a", {"q": 1.0}), ("c", {})], "trial_id string, metrics map<string,double>")
    assert [r.trial_id for r in trials.top(t, "q", 5).collect()] == ["a", "b"]
    with pytest.raises(ConfigError):
        trials.top(t, "q", 0)


def test_nothing_outside_llm_imports_it():
    from pathlib import Path

    root = Path(pipeline.__file__).parent.parent
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "siftwell.llm" in p.read_text()]
    assert F is not None
