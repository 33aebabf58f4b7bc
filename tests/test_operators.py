import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.errors import ConfigError, EnrichmentError, StorageError
from siftwell.functions import text as tx
from siftwell.operators import chunking, encode, enrich, filters, generate, index, metrics, refine, retrieve, search, service


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, markdown string")


def chunks(spark, *texts, doc="d"):
    rows = [(f"{doc}:{i}", doc, t, i, i, i + 1, 1, 1, {"lang": "en" if i % 2 == 0 else "de"}) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "id string, doc_id string, text string, index int, char_start int, char_end int, page_start int, page_end int, metadata map<string,string>")


def asked(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "qid long, text string")


def test_tokens_and_space(spark):
    df = spark.createDataFrame([("Ünï_x 9² — don't",), (None,), ("  a\x1c\x85",)], "t string")
    rows = df.select(tx.tokens(F.col("t")).alias("w"), tx.strip(F.col("t")).alias("s"), tx.is_blank(F.lit("  \x1f")).alias("b"), tx.lstrip(F.col("t")).alias("l")).collect()
    assert rows[0].w == re.findall(r"\w+", "ünï_x 9² — don't") and rows[1].w == [] and rows[2].s == "a" and rows[0].b and rows[2].l == "a\x1c\x85"


def test_uuid5(spark):
    import uuid

    names = ["", "d:0", "Ümläut 東京", "x" * 500]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.u for r in df.select(tx.uuid5(F.col("n"), str(uuid.NAMESPACE_URL)).alias("u")).collect()] == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_fixed_chunks(spark):
    text = "A sentence of words. " * 1000
    rows = chunking.FixedChunker(chunk_chars=400, overlap_chars=50).chunk(docs(spark, text)).orderBy("index").collect()
    assert rows[0].char_start == 0 and rows[-1].char_end == len(text) and all(b.char_start == a.char_end - 50 for a, b in zip(rows, rows[1:], strict=False))
    assert [r["index"] for r in rows] == list(range(len(rows))) and all(r.text == text[r.char_start : r.char_end] and r.id == f"d0:{r['index']}" for r in rows)
    paragraphs = "\n\n".join("p" * 100 for _ in range(10))
    assert any(r.text.endswith("\n\n") for r in chunking.FixedChunker(chunk_chars=250, overlap_chars=0).chunk(docs(spark, paragraphs)).collect())
    blank = chunking.FixedChunker(chunk_chars=10, overlap_chars=0).chunk(docs(spark, "x" * 10 + " " * 10 + "y" * 5, "", None)).collect()
    assert [(r["index"], r.char_start) for r in blank] == [(0, 0), (1, 20)]
    assert [tuple(s) for s in chunking.Breaks("abcdef").windows(0, 6, 2, 9)] == [(0, 2), (2, 4), (4, 6)]
    with pytest.raises(ConfigError):
        chunking.FixedChunker(chunk_chars=0)


def test_sections(spark):
    text = "intro\n# A\ntext\n#nospace\n   ## B\n####### no\n    # no\r# C # D"
    spans = chunking.sections(text)
    assert "".join(text[a:b] for a, b in spans) == text and [text[a:b].split("\n")[0] for a, b in spans] == ["intro", "# A", "   ## B", "# C ", "# D"]
    assert chunking.sections("# A\nx") == [(0, 5)] and chunking.sections("") == [] and len(chunking.sections("no heading")) == 1
    rows = chunking.MarkdownFixedChunker(max_chars=50, overlap_chars=5).chunk(docs(spark, "# A\nshort\n# B\n" + "x" * 120)).orderBy("index").collect()
    assert rows[0].text == "# A\nshort\n" and all(len(r.text) <= 50 for r in rows) and len(rows) > 3


def test_enrichers(spark):
    d = docs(spark, "# One\n" + "a" * 300 + "\n## Two\n" + "b" * 300)
    c = chunking.FixedChunker(chunk_chars=120, overlap_chars=0).chunk(d)
    rows = enrich.enrich(c, d, [enrich.HeadingEnricher()]).orderBy("index").collect()
    assert rows[0].text.startswith("# One\na") and rows[1].text.startswith("# One\n\na") and rows[-1].text.startswith("## Two\n\nb") and enrich.enrich(c, d, []) is c
    assert enrich.ContextualEnricher(lambda p: " ctx ").enrich(c, d).first().text.startswith("ctx\n\n")
    with pytest.raises(EnrichmentError):
        enrich.ContextualEnricher().enrich(c, d)
    with pytest.raises(Exception, match="completion failed"):
        enrich.ContextualEnricher(lambda p: 1 / 0).enrich(c, d).collect()
    more = enrich.synthetic(c, c.where("index = 0").select("id", F.lit("q?").alias("text"))).where("id like '%#aug%'").first()
    assert more.id == "d0:0#aug0" and more.metadata["synthetic"] == "true" and more["index"] == 0


def test_filters(spark):
    c = chunks(spark, "a", "b", "c").withColumn("page_start", F.when(F.col("index") == 2, F.lit(None).cast("int")).otherwise(F.col("page_start")))
    c = c.withColumn("metadata", F.map_concat("metadata", F.create_map(F.lit("page_start"), F.lit("9"))))
    ids = lambda f: sorted(r.id for r in filters.matching(c, f).collect())
    assert ids({}) == ids(None) == ["d:0", "d:1", "d:2"] and ids({"lang": "en"}) == ["d:0", "d:2"] and ids({"lang": ["de", "fr"], "doc_id": "d"}) == ["d:1"]
    assert ids({"page_start": 1}) == ["d:0", "d:1"] and ids({"page_start": 9}) == ["d:2"] and ids({"none": None}) == ["d:0", "d:1", "d:2"] and ids({"lang": []}) == []
    assert ids({"index": list(range(2, 5000))}) == ["d:2"] and ids({"index": 1.0}) == ["d:1"] and ids({"index": [0, 2.0]}) == ["d:0", "d:2"] and ids({"doc_id": ["d", None]}) == ids({})


def test_dense_search(spark):
    v = spark.createDataFrame([("d:0", [1.0, 0.0]), ("d:1", [0.0, 1.0]), ("d:2", [1.0, 1.0]), ("d:10", [0.0, 0.0]), ("d:9", [0.0, 0.0])], "id string, vector array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.0, 0.0])], "qid long, vector array<double>")
    for block in (10, 1):
        rows = search.dense_search(q, v, 5, block=block).orderBy("qid", "rank").collect()
        assert [r.chunk_id for r in rows if r.qid == 1] == ["d:0", "d:2", "d:1", "d:9", "d:10"] and [r.score for r in rows if r.qid == 2] == [0.0] * 5
    assert search.dense_search(q, v, 1, distance="dot").where("qid = 1").first().chunk_id == "d:2"
    with pytest.raises(ConfigError):
        search.dense_search(q, v, 1, distance="l9")


def test_sparse_search(spark):
    sparse = lambda rows, key: spark.createDataFrame([(k, (i, v)) for k, i, v in rows], f"{key}, sparse struct<indices:array<int>,values:array<double>>")
    c = sparse([("d:0", [1, 3], [0.5, 0.5]), ("d:1", [2, 4], [1.0, 1.0])], "id string")
    rows = search.sparse_search(sparse([(1, [1, 3], [1.0, 1.0])], "qid long"), c, 5).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in rows] == [("d:0", 1.0), ("d:1", 0.0)]


def test_bm25(spark):
    c = chunks(spark, "quick brown fox", "quick brown hare", "financial results of the quarter")
    rows = search.bm25_search(asked(spark, "Quick brown fox fox", "unknown", ""), c, 5).orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == ["d:0", "d:1"]
    n, avg = 3, (3 + 3 + 5) / 3
    part = lambda df: math.log(1 + (n - df + 0.5) / (df + 0.5)) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 3 / avg))
    assert rows[0].score == pytest.approx(2 * part(2) + part(1)) and rows[1].score == pytest.approx(2 * part(2))
    kept = search.bm25_search(asked(spark, "quick fox"), c, 5, filters={"lang": "de"}).collect()
    assert [(r.chunk_id, round(r.score, 9)) for r in kept] == [("d:1", round(part(2), 9))]
    assert search.bm25_search(asked(spark, "x"), c.limit(0), 5).collect() == []


def rankings(spark, *ids):
    return spark.createDataFrame([(1, f"d:{i}", 1.0 / (r + 1), r + 1) for r, i in enumerate(ids)], "qid long, chunk_id string, score double, rank int")


def test_fusion(spark):
    a, b = rankings(spark, 0, 1, 2), rankings(spark, 2, 3)
    rows = search.fuse([("a", a), ("b", b)], 10).orderBy("rank").collect()
    assert rows[0].chunk_id == "d:2" and rows[0].sources == {"a": 3, "b": 1} and rows[0].score == pytest.approx(1 / 63 + 1 / 61) and len(rows) == 4
    assert search.source_labels(["index", "index", "bm25", "index"]) == ["index", "index#1", "bm25", "index#2"]
    assert search.fuse([("a", a), ("b", b)], 1, weights=[5.0, 0.1]).first().chunk_id == "d:0"
    with pytest.raises(ValueError, match="weights"):
        search.fuse([("a", a)], 1, weights=[1.0, 2.0])
    with pytest.raises(ConfigError):
        search.fuse([], 1)


def expanded(spark, spans, window=1, anchor=1, marks=None):
    rows = [(f"d:{i}", "d", t, i, a, b, 1 + i, 1 + i, (marks or {}).get(i, {})) for i, (t, a, b) in enumerate(spans)]
    c = spark.createDataFrame(rows, "id string, doc_id string, text string, index int, char_start int, char_end int, page_start int, page_end int, metadata map<string,string>")
    one = spark.createDataFrame([(1, f"d:{anchor}", 0.5, 1, "x")], "qid long, chunk_id string, score double, rank int, retriever_name string")
    return refine.NeighborExpander(window=window).refine(refine.candidates(one, c), asked(spark), c).first()


def test_neighbours(spark):
    r = expanded(spark, [("Hello world.", 0, 12), (" More text.", 12, 23), (" Even more.", 23, 34)])
    assert r.text == "Hello world. More text. Even more." and (r.char_start, r.char_end, r.page_start, r.page_end, r.score, r.chunk_id) == (0, 34, 1, 3, 0.5, "d:1") and r.metadata["expanded"] == "true"
    assert expanded(spark, [("Hello world", 0, 11), ("world today", 6, 17)]).text == "Hello world today"
    assert expanded(spark, [("First.", 0, 6), ("Second.", 10, 17)]).text == "First. Second."
    assert expanded(spark, [("abcdef", 0, 6), ("bcd", 1, 4)]).text == "abcdef"
    assert expanded(spark, [("q?", 0, 2), ("text", 2, 6)], marks={0: {"synthetic": "true"}}).text == "text"
    assert expanded(spark, [("a", 0, 1), ("b", 1, 2)], window=0).text == "b"


def test_refiners(spark):
    c = chunks(spark, "red green", "red", "blue")
    rows = refine.candidates(rankings(spark, 2, 1, 0), c)
    q = spark.createDataFrame([(1, "Red green")], "qid long, text string")
    out = refine.refine(rows, q, c, [refine.KeywordRefiner(), refine.ScoreThreshold(min_score=0.4)], 5).orderBy("pos").collect()
    assert [(r.chunk_id, r.score, r.pos) for r in out] == [("d:0", 1.0, 1), ("d:1", 0.5, 2)]
    top = refine.CrossEncoderReranker(lambda pairs: [len(t) for _, t in pairs]).refine(rows, q, c).orderBy("pos").first()
    assert top.chunk_id == "d:0" and top.score == 9.0
    with pytest.raises(ConfigError):
        refine.CrossEncoderReranker()


def test_packing_and_answers(spark):
    c = chunks(spark, "a" * 50, "b" * 50, "c" * 50)
    rows = refine.candidates(rankings(spark, 1, 0, 2), c)
    assert [r.marker for r in generate.pack(rows, 60).collect()] == [1] and len(generate.pack(rows, 110).collect()) == 2 and len(generate.pack(rows, 5).collect()) == 1
    context = generate.contexts(generate.pack(rows, 1000)).first()
    assert context.prompt_block.startswith("[1] bbb") and "\n\n[2] aaa" in context.prompt_block and [x.chunk_id for x in context.citations] == ["d:1", "d:0", "d:2"]
    q = spark.createDataFrame([(1, "q"), (2, "nothing")], "qid long, text string")
    out = {r.qid: r for r in generate.ExtractiveGenerator().generate(q, rows).collect()}
    assert out[1].text == "b" * 50 + " [1]" and [x.marker for x in out[1].citations] == [1] and out[2].text == generate.NO_CONTEXT and out[2].citations == []
    said = {r.qid: r for r in generate.ModelGenerator(lambda p: "see [2] and [9]" if "Passages:\n[1]" in p else "none").generate(q, rows).collect()}
    assert [x.marker for x in said[1].citations] == [2] and said[2].text == "none" and said[1].usage["output_chars"] == 15.0
    with pytest.raises(ConfigError):
        generate.ModelGenerator()


@pytest.mark.parametrize(("found", "truth", "k", "recall"), [([1, 2, 3], [1], 1, 1.0), ([1, 2, 3], [3], 1, 0.0), ([1, 2, 3], [1, 9], 5, 0.5), ([], [1], 5, 0.0), ([5, 1, 7, 2], [1, 2], 4, 1.0)])
def test_ir_metrics(spark, found, truth, k, recall):
    r = rankings(spark, *found) if found else rankings(spark, 0).limit(0)
    t = spark.createDataFrame([(1, f"d:{i}") for i in truth], "qid long, chunk_id string")
    row = metrics.ir_metrics(r, t, (k,), "chunk_id").first()
    ranks = [n + 1 for n, i in enumerate(found) if i in truth]
    gain = sum(1 / math.log2(n + 1) for n in ranks if n <= k) / sum(1 / math.log2(n + 1) for n in range(1, min(len(truth), k) + 1))
    assert row[f"recall@{k}"] == pytest.approx(recall) and row.mrr == pytest.approx(1 / ranks[0] if ranks else 0) and row[f"ndcg@{k}"] == pytest.approx(gain)


def test_evaluators(spark):
    c = chunks(spark, "a", "b", doc="x").unionByName(chunks(spark, "c", doc="y"))
    r = spark.createDataFrame([(1, "x:1", 1), (1, "x:0", 2), (1, "y:0", 3), (2, "y:0", 1)], "qid long, chunk_id string, rank int")
    samples = spark.createDataFrame([(1, "q", [], ["y"], "the cat sat"), (2, "q", ["y:0"], ["nope"], None), (3, "q", None, None, "x")], "qid long, text string, relevant_chunk_ids array<string>, relevant_doc_ids array<string>, reference_answer string")
    scores = {s.qid: s for s in metrics.RetrievalEvaluator(k_values=(1, 2)).evaluate(samples, r, c).collect()}
    assert scores[1].mrr == 0.5 and scores[1]["recall@2"] == 1.0 and scores[2].mrr == 1.0 and scores[3].mrr is None
    answers = spark.createDataFrame([(1, "The cat [1]"), (2, "x")], "qid long, text string")
    judged = metrics.AnswerMatchEvaluator().evaluate(samples, r, c, answers)
    assert {s.qid: s.token_f1 for s in judged.collect()} == {1: 0.8, 2: None, 3: None}
    assert metrics.aggregate(judged, ["token_f1", "exact_match"]).first().asDict() == {"token_f1": 0.8, "exact_match": 0.0}
    for bad in ((), (0,), (1.5,)):
        with pytest.raises(ConfigError):
            metrics.RetrievalEvaluator(k_values=bad)


@pytest.mark.parametrize(("a", "b", "f1", "em"), [("the cat", "the cat sat", 0.8, 0), ("", "", 1, 1), ("...", "!!!", 1, 1), ("x", "", 0, 0), ("Paris.", "paris", 1, 1), ("a a a", "a b", 0.4, 0)])
def test_answer_match(spark, a, b, f1, em):
    df = spark.createDataFrame([(1, a, b)], "qid int, answer string, reference string")
    row = df.select(metrics.token_f1(F.col("answer"), F.col("reference")), metrics.exact_match(F.col("answer"), F.col("reference"))).first()
    assert tuple(row) == pytest.approx((f1, em))


def test_embedders(spark, tmp_path):
    e = encode.HashingEmbedder(dimensions=16)
    df = spark.createDataFrame([("a b a",), ("",), ("a b a",)], "text string")
    rows = df.select(e.passage(F.col("text")).alias("v")).collect()
    assert np.allclose(rows[0].v, encode.hashed_vector("a b a", 16)) and sum(x * x for x in rows[0].v) == pytest.approx(1) and not any(rows[1].v)
    calls = spark.sparkContext.accumulator(0)

    def model(texts):
        calls.add(len(texts))
        return [[float(len(t)), 1.0] for t in texts]

    cache = encode.EmbeddingCache(encode.CallableEmbedder(model, dimensions=2, normalize=False, query_instruction="Q: "), str(tmp_path / "v"))
    assert [r.vector for r in cache.embed(df).orderBy("text").collect()] == [[0.0, 1.0], [5.0, 1.0], [5.0, 1.0]] and calls.value == 2
    cache.embed(df).count()
    assert calls.value == 2 and cache.embed(df.limit(1), namespace="queries").first().vector == [8.0, 1.0] and calls.value == 3
    with pytest.raises(Exception, match="gave vectors"):
        df.select(encode.CallableEmbedder(lambda t: [[1.0]], dimensions=2).passage(F.col("text"))).collect()
    sparse = df.select(encode.HashedTermFrequency().passage(F.col("text")).alias("s")).first().s
    assert sorted(sparse.values) == [1.0, 2.0] and sparse.indices == sorted(sparse.indices)


def corpus(spark, path=None, *more):
    return index.Corpus(index.TableStore(spark, path), [index.DenseRepresentation(encode.HashingEmbedder(dimensions=32)), index.LexicalRepresentation(), *more])


def test_store_is_found_again_and_takes_rows_whole(spark, tmp_path):
    path, spec = str(tmp_path / "store"), index.VectorSpec("v", "dense", 1)
    rows = lambda *r: spark.createDataFrame([(i, "d", t, 0, [x]) for i, t, x in r], "id string, doc_id string, text string, index int, vector array<double>").coalesce(1)
    shown = lambda s: {r.id: (r.text, r.vector[0]) for r in s.chunks().join(s.space("v"), "id").collect()}
    store = index.TableStore(spark, path)
    store.ensure_schema([spec])
    store.upsert(rows(("a", "v1", 1.0), ("b", "v1", 1.0)), {"v": "vector"})
    store.upsert(rows(("a", "v2", 2.0)), {"v": "vector"})
    again = index.TableStore(spark, path)
    assert again.specs == {"v": spec} and shown(again) == {"a": ("v2", 2.0), "b": ("v1", 1.0)}
    again.upsert(rows(("a", "lost", 0.0), ("a", "v3", 3.0), ("c", "v3", 3.0)), {"v": "vector"})
    assert shown(again) == shown(index.TableStore(spark, path)) == {"a": ("v3", 3.0), "b": ("v1", 1.0), "c": ("v3", 3.0)}
    again.compact()
    assert shown(again) == shown(index.TableStore(spark, path)) == {"a": ("v3", 3.0), "b": ("v1", 1.0), "c": ("v3", 3.0)}
    # a batch that was cut off before its marker is not read
    again._table("chunks")._write("rows", 99, rows(("z", "cut", 0.0)).drop("vector"))
    assert "z" not in {r.id for r in index.TableStore(spark, path).chunks().collect()}
    with pytest.raises(ConfigError):
        index.TableStore(spark, path).ensure_schema([index.VectorSpec("v", "dense", 8)])


def service_client(path):
    """A service in a file of lines, as executors and driver reach it."""
    import json
    import os

    class Client:
        def _lines(self):
            return [json.loads(x) for x in open(path)] if os.path.exists(path) else []

        def _put(self, *rows):
            with open(path, "a") as f:
                f.write("".join(json.dumps(r) + "\n" for r in rows))

        def spaces(self):
            found = [x["spaces"] for x in self._lines() if "spaces" in x]
            return {k: tuple(v) for k, v in found[-1].items()} if found else None

        def create(self, specs):
            self._put({"spaces": {s.name: (s.kind, s.dimensions) for s in specs}})

        def drop(self):
            os.remove(path)

        def write(self, points):
            self._put(*({"point": p} for p in points))

        def update(self, space, values):
            self._put(*({"id": i, "space": space, "value": v} for i, v in values))

        def _points(self):
            out = {}
            for x in self._lines():
                if "point" in x:
                    out[x["point"]["id"]] = x["point"]
                elif "value" in x:
                    out[x["id"]]["vectors"][x["space"]] = x["value"]
            return list(out.values())

        def scroll(self, filters, limit, low="", high=None):
            points = sorted((p for p in self._points() if p["id"] >= low and (high is None or p["id"] < high)), key=lambda p: p["id"])
            kept = [p["payload"] for p in points if all(p["payload"].get(k, p["payload"]["metadata"].get(k)) == v for k, v in filters.items())]
            return kept[:limit]

        def search(self, space, value, k, filters):
            allowed = {p["id"] for p in self.scroll(filters, None)}
            scored = [(p["payload"], sum(a * b for a, b in zip(p["vectors"][space], value, strict=True))) for p in self._points() if p["payload"]["id"] in allowed]
            return sorted(scored, key=lambda x: -x[1])[:k]

    return Client()


def test_service_store(spark, tmp_path):
    path = str(tmp_path / "service.jsonl")
    connect = lambda: service_client(path)
    c = index.Corpus(service.ServiceStore(spark, connect, batch=2), [index.DenseRepresentation(encode.HashingEmbedder(dimensions=32)), index.LexicalRepresentation()])
    c.add(chunks(spark, "quick brown fox", "slow green turtle", "blue whale"))
    c.add(chunks(spark, "red fox").withColumn("id", F.lit("d:1")))
    assert {r.id: r.text for r in c.store.chunks().collect()} == {r.id: r.text for r in c.fetch().collect()} == {"d:0": "quick brown fox", "d:1": "red fox", "d:2": "blue whale"}
    assert c.search("dense", asked(spark, "blue whale"), 1).first().chunk_id == "d:2" and c.search("lexical", asked(spark, "fox"), 5).count() == 2
    assert [r.id for r in c.fetch({"index": 2}).collect()] == ["d:2"] and c.search("dense", asked(spark, "fox"), 5, {"index": 2}).count() == 1
    c.store.update_vectors("dense", spark.createDataFrame([("d:0", [9.0] + [0.0] * 31)], "id string, vector array<double>"))
    assert connect().scroll({}, 1) and service.point_id("d:0") == service.point_id("d:0") != service.point_id("d:1")
    firsts = sorted(("d:0", "d:1", "d:2"), key=service.point_id)
    assert [r.id for r in c.fetch(limit=2).collect()] == firsts[:2]
    assert c.store.chunks().rdd.getNumPartitions() == 16 and service.ServiceStore(spark, connect, ranges=3).chunks().rdd.getNumPartitions() == 3
    ranges = service.id_ranges(7)
    assert all(sum(low <= service.point_id(str(i)) and (high is None or service.point_id(str(i)) < high) for low, high in ranges) == 1 for i in range(300))
    again = service.ServiceStore(spark, connect)
    again.ensure_schema([index.VectorSpec("dense", "dense", 32)])
    with pytest.raises(ConfigError):
        again.ensure_schema([index.VectorSpec("dense", "dense", 8)])
    service.ServiceStore(spark, connect, recreate=True).ensure_schema([index.VectorSpec("dense", "dense", 8)])
    assert connect().spaces() == {"dense": ("dense", 8)} and connect().scroll({}, None) == []
    with pytest.raises(StorageError):
        again.upsert(chunks(spark, "x"), {"what": "text"})

    def broken():
        raise OSError("no route")

    with pytest.raises(StorageError, match="no route"):
        service.ServiceStore(spark, broken).ensure_schema([])


@pytest.mark.parametrize("stored", [False, True])
def test_lexical_index(spark, tmp_path, stored):
    path = str(tmp_path / "lexical") if stored else None
    first, second = chunks(spark, "quick brown fox", "quick brown hare", "--"), chunks(spark, "slow fox fox").withColumn("id", F.lit("d:1"))
    lexical = index.LexicalIndex(spark, path)
    assert lexical.search(asked(spark, "fox"), 5).collect() == []
    lexical.add(first)
    lexical.add(second)
    now = first.where("id <> 'd:1'").unionByName(second)
    for held in (lexical, index.LexicalIndex(spark, path)) if stored else (lexical,):
        for question in ("quick fox", "hare", "slow brown unknown", ""):
            want = [(r.chunk_id, round(r.score, 9)) for r in search.bm25_search(asked(spark, question), now, 5).orderBy("rank").collect()]
            assert [(r.chunk_id, round(r.score, 9)) for r in held.search(asked(spark, question), 5).orderBy("rank").collect()] == want
    lexical.compact()
    assert lexical.stats().first().n == 3 and [r.chunk_id for r in lexical.search(asked(spark, "hare"), 5).collect()] == []
    plan = lexical.search(asked(spark, "fox"), 5)._jdf.queryExecution().toString()
    assert not stored or ("PushedFilters" in plan and "text" not in plan.split("== Physical Plan ==")[-1].split("ReadSchema")[-1][:80])


@pytest.mark.parametrize("stored", [False, True])
def test_corpus(spark, tmp_path, stored):
    c = corpus(spark, str(tmp_path / "store") if stored else None, index.SparseRepresentation(encode.HashedTermFrequency()))
    c.add(chunks(spark, "quick brown fox", "slow green turtle"))
    c.add(chunks(spark, "blue whale").withColumn("id", F.lit("d:1")))
    assert {r.id: r.text for r in c.fetch().collect()} == {"d:0": "quick brown fox", "d:1": "blue whale"}
    assert c.search("lexical", asked(spark, "turtle"), 5).count() == 0
    for space in ("dense", "sparse"):
        assert c.search(space, asked(spark, "blue whale"), 1).first().chunk_id == "d:1"
    assert [r.id for r in c.fetch({"index": [0, 2]}, 1).collect()] and c.search("dense", asked(spark, "fox"), 5, {"lang": "de"}).count() == 0
    store = c.store
    store.update_vectors("dense", spark.createDataFrame([("d:0", [0.0] * 31 + [1.0])], "id string, vector array<double>"))
    assert store.space("dense").where("id = 'd:0'").first().vector[-1] == 1.0 and store.space("sparse").count() == 2 and store.chunks().count() == 2
    c.update_representation("dense")
    assert c.search("dense", asked(spark, "quick brown fox"), 1).first().chunk_id == "d:0"
    for broken in (lambda: store.update_vectors("dense", spark.createDataFrame([("no", [0.0])], "id string, vector array<double>")), lambda: store.upsert(chunks(spark, "x"), {"what": "text"}), lambda: store.upsert(chunks(spark, "x").withColumn("v", F.array(F.lit(1.0))), {"dense": "v"})):
        with pytest.raises(StorageError):
            broken()
    with pytest.raises(ConfigError):
        store.ensure_schema([index.VectorSpec("dense", "dense", 8)])
    with pytest.raises(ConfigError):
        c.search("none", asked(spark, "x"), 1)
    with pytest.raises(ConfigError):
        index.Corpus(store, [])
    with pytest.raises(ConfigError):
        index.Corpus(store, [index.LexicalRepresentation(), index.LexicalRepresentation()])


def test_retrievers(spark):
    c = corpus(spark)
    c.add(chunks(spark, "quick brown fox", "slow green turtle", "red fox"))
    q = asked(spark, "fox", "turtle")
    hybrid = retrieve.HybridRetriever(c).retrieve(q, 3)
    assert {(r.retriever_name, frozenset(r.sources)) for r in hybrid.where("rank = 1").collect()} == {("hybrid", frozenset({"index:dense", "index:lexical"}))}
    lexical = retrieve.IndexRetriever(c, representation="lexical")
    assert lexical.retrieve(q, 1).first().retriever_name == "index"
    many = retrieve.MultiQueryRetriever(lexical, lambda p: "green animal\n\n red  \nmore\nand more\ntoo many", n=3).retrieve(q, 5).where("qid = 0").collect()
    assert {r.chunk_id for r in many} == {"d:0", "d:1", "d:2"} and many[0].retriever_name == "multi-query"
    assert retrieve.HydeRetriever(lexical, lambda p: "turtle").retrieve(q, 1).where("qid = 0").first().chunk_id == "d:1"
    assert retrieve.HydeRetriever(lexical, lambda p: "  ").retrieve(q, 1).where("qid = 0").first().chunk_id == "d:2"
    weighted = retrieve.FusionRetriever([lexical, lexical], weights=[1.0, 2.0]).retrieve(q, 1).where("qid = 1").first()
    assert weighted.score == pytest.approx(3 / 61) and set(weighted.sources) == {"index:lexical", "index:lexical#1"}
    for broken in (lambda: retrieve.IndexRetriever(c), lambda: retrieve.IndexRetriever(), lambda: retrieve.IndexRetriever(c, representation="x"), lambda: retrieve.FusionRetriever([]), lambda: retrieve.FusionRetriever([lexical], method="max"), lambda: retrieve.FusionRetriever([lexical], weights=[1, 2])):
        with pytest.raises(ConfigError):
            broken()


def test_judge(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def judge(rows):
        calls.add(len(rows))
        return [{"faithfulness": 1.0 if "the" in r["answer"] else None, "context_recall": float(len(r["contexts"]))} for r in rows]

    c = chunks(spark, "a", "b")
    samples = spark.createDataFrame([(1, "q", "r"), (2, "q", "r"), (3, "p", None)], "qid long, text string, reference_answer string")
    answers = spark.createDataFrame([(1, "the x"), (2, "the x"), (3, "y")], "qid long, text string")
    r = spark.createDataFrame([(1, "d:1", 1), (1, "d:0", 2), (2, "d:0", 1), (2, "d:1", 2)], "qid long, chunk_id string, rank int")
    e = metrics.JudgeEvaluator(judge, cache=str(tmp_path / "judged"))
    got = {s.qid: s for s in e.evaluate(samples, r, c, answers).collect()}
    assert got[1].faithfulness == got[2].faithfulness == 1.0 and got[3].faithfulness is None and got[1].context_recall == 2.0 and got[3].context_recall == 0.0 and calls.value == 2
    e.evaluate(samples, r, c, answers).collect()
    assert calls.value == 2 and metrics.aggregate(e.evaluate(samples, r, c, answers), ["faithfulness"]).first()[0] == 1.0
    with pytest.raises(Exception, match="0 verdicts"):
        metrics.JudgeEvaluator(lambda rows: []).evaluate(samples, r, c, answers).collect()
