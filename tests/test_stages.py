"""Stages that are stored, spaces that are not listed, logs of many writers, and plans that do not grow."""

import random

import pytest
from pyspark.sql import functions as F

from siftwell.errors import StorageError
from siftwell.operators import encode, index, metrics, refine
from siftwell.plans import pipeline, stages, trials, tuner
from siftwell.plans.component import registry
from siftwell.plans.space import SearchSpace, choice
from siftwell.sources import blobs
from siftwell.sources.folders import Folder

FACTS = b"# France\nThe capital of France is Paris.\n# Japan\nThe capital of Japan is Tokyo.\n# Food\nBread is made of flour.\n"


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_plans_do_not_grow_with_the_batches_of_a_store(spark):
    corpus, sizes = index.Corpus(index.TableStore(spark), [index.DenseRepresentation(encode.HashingEmbedder(dimensions=8)), index.LexicalRepresentation()]), []
    p = pipeline.RagPipeline(corpus, chunker=registry.create("chunker", "markdown-aware"), refiners=[refine.NeighborExpander()])
    asked = spark.createDataFrame([(1, "capital of France")], "qid long, text string")
    for n in range(6):
        docs = spark.createDataFrame([(f"d{n % 3}", FACTS.decode() + f"\n# N{n}\nnumber {n}\n")], "doc_id string, markdown string")
        p.index_documents(docs).unpersist()
        sizes.append(len(plan_of(p.ask(asked, 2))))
    assert max(sizes) < 1.5 * sizes[1] and max(sizes) < 2_000_000
    assert corpus.store.chunks().count() == 12 and "Paris" in p.ask(asked, 2).first().text
    corpus.store.drop()


def test_text_is_not_shuffled_to_be_ranked_or_expanded(spark):
    c = spark.range(200).selectExpr("concat('d:', id) as id", "'d' as doc_id", "concat('text ', id) as text", "cast(id as int) as index", "cast(id * 10 as int) as char_start", "cast(id * 10 + 9 as int) as char_end", "1 as page_start", "1 as page_end")
    store = index.TableStore(spark)
    store.upsert(c, {})
    rankings = spark.createDataFrame([(1, "d:5", 1.0, 1, "x"), (1, "d:9", 0.5, 2, "x")], "qid long, chunk_id string, score double, rank int, retriever_name string")
    rows = refine.candidates(rankings, store.chunks())
    text = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "hashpartitioning" not in text
    grown = refine.NeighborExpander().refine(rows, None, store.chunks())
    assert {r.chunk_id: r.text for r in grown.collect()} == {"d:5": "text 4 text 5 text 6", "d:9": "text 8 text 9 text 10"}


def test_stages_are_found_again_in_any_order_and_session(spark, tmp_path):
    sources = blobs.bytes_source(spark, [("a.md", FACTS), ("b.md", b"# Wine\nWine is made of grapes.\n")])
    samples = spark.createDataFrame([(1, "made of grapes", None, None, "x")], "qid long, text string, relevant_chunk_ids array<string>, relevant_doc_ids array<string>, reference_answer string")
    s = SearchSpace(
        chunker=[choice("markdown-aware"), choice("fixed", chunk_chars=[60, 90], overlap_chars=[0])], enrich=[[], [choice("heading")]],
        representations=[[choice("lexical")], [choice("lexical"), choice("dense", embedder=choice("hashing", dimensions=[8]))]], refine=[[], [choice("keyword")]],
    )
    specs = list(s.expand())
    random.Random(5).shuffle(specs)
    builder, root = pipeline.PipelineBuilder(spark), str(tmp_path / "stages")
    kept = stages.StageStore(spark, root)
    shared, answers = tuner.Shared(builder, sources, kept), {}
    for n, spec in enumerate(specs[:14]):
        made, chunks = shared.indexed(spec, trials.Trace("t"))
        answers[n] = sorted(map(repr, made.query(samples.select("qid", "text"), 3).select("chunk_id", "pos", "text").collect()))
    cutters = {repr(spec["chunker"]) for spec in specs[:14]}
    assert kept.made["parse"] == 1 and kept.made["chunk"] == len(cutters) == 3 and kept.made["enrich"] <= 3 and kept.made["space"] + kept.made["index"] <= 12
    again = stages.StageStore(spark, root)
    shared = tuner.Shared(builder, sources, again)
    for n, spec in list(enumerate(specs[:14]))[::5]:
        found = shared.indexed(spec, trials.Trace("t"))[0].query(samples.select("qid", "text"), 3).select("chunk_id", "pos", "text")
        assert sorted(map(repr, found.collect())) == answers[n]
        fresh = builder.build(spec)
        fresh.index(sources)
        assert sorted(map(repr, fresh.query(samples.select("qid", "text"), 3).select("chunk_id", "pos", "text").collect())) == answers[n]
    assert not again.made
    other = blobs.bytes_source(spark, [("a.md", FACTS)])
    assert stages.table_fingerprint(sources) == stages.table_fingerprint(sources.repartition(3)) != stages.table_fingerprint(other)
    # a table without its marker was cut off
    folder = Folder(spark, root)
    for name in folder.names("done"):
        if name.startswith("chunk-"):
            folder.remove(f"done/{name}")
    tuner.Shared(builder, sources, again).indexed(specs[0], trials.Trace("t"))
    assert again.made == {"chunk": 1}
    staged = shared.indexed(specs[0], trials.Trace("t"))[0].corpus.store
    assert staged.fetch({"doc_id": "none"}).count() == 0 and staged.fetch(limit=2).count() == 2
    with pytest.raises(StorageError):
        staged.upsert(sources, {})


def test_tuner_with_stages(spark):
    docs = spark.createDataFrame([("facts", FACTS.decode())], "doc_id string, markdown string")
    samples = spark.createDataFrame([(1, "capital of Japan", ["facts:1"], None, "x")], "qid long, text string, relevant_chunk_ids array<string>, relevant_doc_ids array<string>, reference_answer string")
    s = SearchSpace(chunker=[choice("markdown-aware"), choice("fixed", chunk_chars=[50], overlap_chars=[0])], representations=[[choice("lexical")]], refine=[[], [choice("keyword")], [choice("score-threshold")]])
    kept = stages.StageStore(spark)
    board = tuner.RandomTuner(n_trials=6, seed=2, screen_by="ndcg@1").run(s, samples, docs, pipeline.PipelineBuilder(spark), [metrics.RetrievalEvaluator(k_values=(1,))], stages=kept)
    assert len(board) == 6 and kept.made["chunk"] == 2 and kept.made["index"] == 2
    kept.release()
    assert not kept.folder.names()


def test_specs_of_a_huge_space_are_drawn_without_listing_it():
    axis = list(range(1, 101))
    s = SearchSpace(chunker=[choice("fixed", chunk_chars=axis, overlap_chars=axis), choice("markdown-aware")], refine=[[choice("score-threshold", min_score=axis), choice("neighbor-expander", window=axis)], []], retriever=[choice("index", a=axis, b=axis, c=axis, d=axis)])
    assert s.size() == (100**2 + 1) * (100**2 + 1) * 100**4
    drawn = list(tuner.RandomTuner(n_trials=10, seed=1).specs(s))
    assert len({repr(d) for d in drawn}) == 10 and drawn == list(tuner.RandomTuner(n_trials=10, seed=1).specs(s))
    assert s.at(0)["chunker"] == {"name": "fixed", "params": {"chunk_chars": 1, "overlap_chars": 1}} and s.at(s.size() - 1)["refine"] == []
    small = SearchSpace(chunker=[choice("fixed", chunk_chars=[1, 2], overlap_chars=[3, 4]), choice("markdown-aware")], refine=[[choice("keyword")], []])
    assert [small.at(i) for i in range(small.size())] == list(small.expand()) and len(small) == 10
    with pytest.raises(IndexError):
        small.at(10)


def test_a_log_of_many_writers(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    made = lambda k, q: trials.Trial(f"t{k}", {"chunker": {"name": "fixed"}}, {}, {"q": q})
    one, two = trials.SharedTrialLog(spark, path), trials.SharedTrialLog(spark, path)
    assert one.read() == []
    for n in range(4):
        one.append(made(1, float(n)))
        two.append(made(2, float(-n)))
    log = trials.SharedTrialLog(spark, path)
    assert [t.metrics["q"] for t in log] == [0.0, -0.0, 1.0, -1.0, 2.0, -2.0, 3.0, -3.0]
    assert {k: t.metrics["q"] for k, t in log.latest().items()} == {"t1": 3.0, "t2": -3.0}
    assert [tuple(r) for r in log.query(spark, "select trial_id, metrics['q'] from trials order by 1").collect()] == [("t1", 3.0), ("t2", -3.0)]
    assert len(Folder(spark, path).names()) == 8 and not [n for n in Folder(spark, path).names() if n.endswith(".part")]
    Folder(spark, path).put("zz.json", b"{broken\n")
    with pytest.raises(StorageError):
        log.read()
    assert F is not None
