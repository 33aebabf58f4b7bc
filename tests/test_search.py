"""What a task of a search keeps and hands on."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftwell.errors import StorageError
from siftwell.functions import text as tx
from siftwell.operators import chunking, encode, index, metrics, search
from siftwell.plans import catalogue, pipeline


def test_best_of_slices():
    draw = np.random.default_rng(1)
    # few distinct scores: most are ties, which ids decide
    scores, ids = draw.integers(-3, 4, (5, 300)) / 4.0, np.array([str(x) for x in draw.permutation(300)], object)
    touched = draw.random((5, 300)) < 0.7
    for k in (1, 7, 400):
        for held in (None, touched):
            best = search._Best(5, k)
            for at in range(0, 300, 37):
                best.add(scores[:, at : at + 37], ids[at : at + 37], None if held is None else held[:, at : at + 37])
            got = {(r["qid"], r["chunk_id"], r["score"]) for b in best.rows(list("abcde"), pa.string()) for r in b.to_pylist()}
            want = set()
            for q, name in enumerate("abcde"):
                rows = [(scores[q, r], ids[r]) for r in range(300) if held is None or held[q, r]]
                want |= {(name, i, s) for s, i in sorted(rows, reverse=True)[:k]}
            assert got == want


def test_products():
    draw = np.random.default_rng(2)
    asked, rows = draw.random((6, 9)) * (draw.random((6, 9)) < 0.5), draw.random((40, 9)) * (draw.random((40, 9)) < 0.5)
    q, key = np.nonzero(asked)
    block = search._Entries(pa.array(range(6)), pa.array(q), pa.array(key), pa.array(asked[q, key]))
    at, other = np.nonzero(rows)
    number = np.array([block.keys.to_pylist().index(x) for x in other])
    for zeros in (True, False):
        scores, touched = block.products(at, number, rows[at, other], 40, zeros)
        assert scores == pytest.approx(asked @ rows.T)
    assert (touched == ((asked > 0).astype(int) @ (rows > 0).T.astype(int) > 0)).all()


def test_pairs_are_not_shuffled(spark, tmp_path):
    """A task hands on k rows of a query: pairs of query and chunk were grouped by a shuffle, postings were dealt by ranges."""
    chunks = spark.range(400).selectExpr("concat('d:', id) AS id", "concat('the text of number ', id % 7) AS text").repartition(3)
    queries = spark.createDataFrame([(q, f"the number {q}") for q in range(5)], "qid long, text string")
    held = index.LexicalIndex(spark, str(tmp_path / "lexical"))
    held.add(chunks)
    found = held.search(queries, 2)
    plan = found._jdf.queryExecution().toString().split("== Physical Plan ==")[-1]
    assert "HashAggregate" not in plan and "SortAggregate" not in plan
    assert sorted((r.qid, r["rank"], r.chunk_id) for r in found.collect()) == [(q, n + 1, f"d:{i}") for q in range(5) for n, i in enumerate(sorted((str(x) for x in range(400) if x % 7 == q), reverse=True)[:2])]
    fused = search.fuse([("a", found), ("b", found)], 2)
    assert fused._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2  # one for each ranking
    assert fused.where("qid = 1 AND rank = 1").first().sources == {"a": 1, "b": 1}


def test_an_index_of_postings_is_refused(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "default" / "lengths"))
    with pytest.raises(StorageError, match="postings"):
        index.LexicalIndex(spark, str(tmp_path))


def test_passages(spark):
    """Runs are found inside a row alone and by their words; every run of every text was a row of a join."""
    words = lambda *texts: pa.array([t.split() if t is not None else None for t in texts], pa.list_(pa.string()))
    runs = [(1, "a b c"), (1, "b c d"), (2, "a b c"), (3, "z"), (4, "c a")]
    wanted = pa.table({"qid": [q for q, _ in runs], "n": [len(r.split()) for _, r in runs], "run": words(*(r for _, r in runs))})
    block = metrics.Passages(wanted)
    row, place = block.found(words("x a b c d", "b c", "d a", None, "", "z z c", "a b", "c b a"))
    assert sorted((r, block.qids[p]) for r, p in zip(row, place, strict=True)) == [(0, 1), (0, 1), (0, 2), (5, 3)]
    texts = spark.createDataFrame([(7, "X a-b  C d"), (8, "z"), (9, None)], "id long, text string")
    found = metrics.passages(texts, "id", block)
    assert sorted((r.qid, r.id) for r in found.collect()) == [(1, 7), (2, 7), (3, 8)]
    assert "Generate" not in found._jdf.queryExecution().toString()


def test_synthetic_chunks_are_cut_once(spark, sf_dir):
    """Texts went to Python once for each place that the chunks have in the plan, in batches of 10,000 rows."""
    made = catalogue.enrich_synthetic(spark, sf_dir)
    assert "EvalPython" not in made._jdf.queryExecution().toString()
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def test_words_are_counted_a_batch_at_a_time(spark):
    """Encoders and the index sorted and compared the words of each row by interpreted functions, which was most of the time of search_hybrid."""
    texts = ["b a b", "", None, "É é é x_1", "1 1 1 2", "b"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(2)
    words = {r.id: r.w for r in df.select("id", tx.tokens(F.col("text")).alias("w")).collect()}
    rows = search.term_rows(df)
    encoded = df.select("id", encode.HashedTermFrequency(buckets=7).passage(F.col("text")).alias("v"))
    for plan in (rows, encoded):
        said = plan._jdf.queryExecution().executedPlan().toString()
        assert "array_sort" not in said and "sort_array" not in said and "filter(" not in said
    assert {r.id: (r.len, dict(zip(r.terms, r.tfs, strict=True))) for r in rows.collect()} == {i: (len(w), dict(Counter(w))) for i, w in words.items()}
    assert all(r.terms == sorted(r.terms, key=str.encode) for r in rows.collect())
    at = {r.id: Counter(r.p) for r in df.select("id", encode.HashedTermFrequency(buckets=7).places(F.col("text")).alias("p")).collect()}
    assert {r.id: list(zip(r.v.indices, r.v.values, strict=True)) for r in encoded.collect()} == {i: sorted(c.items()) for i, c in at.items()}
    lengths = df.select("id", catalogue._Lengths().passage(F.col("text")).alias("v")).collect()
    assert {r.id: r.v for r in lengths} == {i: [float(sum(len(t) % 16 == k for t in w)) for k in range(16)] for i, w in words.items()}
    assert search.term_rows(df.limit(0)).collect() == []


def test_words_of_a_batch(spark):
    """Words are found by classes of bytes, where a regular expression made a text of each: they are those of `tokens`, whatever lies at the ends of rows."""
    draw = np.random.default_rng(3)
    alphabet = np.array(list("ab1_ .,\u00e9\u07c0\u5b57\U0001d49c\u0663\u0308\u0301\u00b2\x00\u0130\u00df\U00010348\n-"))
    texts = ["".join(draw.choice(alphabet, n)) for n in draw.integers(0, 9, 3000)] + ["", "b", "c ", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(2)
    rows = df.select("id", tx.tokens(F.col("text")).alias("w"), tx.lowered(F.col("text")).alias("t")).orderBy("id").collect()
    for at, end in ((0, len(rows)), (17, 900), (5, 5), (3000, 3001)):
        words, row = tx.split_words(pa.array([r.t for r in rows], pa.string()).slice(at, end - at))
        words.validate(full=True)
        got = [[] for _ in range(at, end)]
        for w, i in zip(words.to_pylist(), row.tolist(), strict=True):
            got[i].append(w)
        assert got == [r.w for r in rows[at:end]]
    assert {r.id: (r.len, dict(zip(r.terms, r.tfs, strict=True))) for r in search.term_rows(df).collect()} == {r.id: (len(r.w), dict(Counter(r.w))) for r in rows}
    assert "regexp" not in search.term_rows(df)._jdf.queryExecution().executedPlan().toString()


def test_pages_are_joined_once_a_document(spark, sf_dir):
    """A document's pages were joined anew for each of its chunks."""
    plan = catalogue._chunks(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_join" in plan and "substring(array_join" not in plan
    text = "".join(f"line {i} of a long text\n" for i in range(2000))
    found = chunking.FixedChunker().chunk(spark.createDataFrame([("d", text)], "doc_id string, markdown string")).collect()
    assert len(found) > 20 and all(r.text == text[r.char_start : r.char_end] for r in found)


def test_what_was_encoded_is_counted_as_it_is_stored(spark):
    """Frequencies encoded every batch a second time."""
    asked = []

    class Watched(catalogue._Initials):
        def passage(self, text):
            asked.append(1)
            return super().passage(text)

    corpus = index.Corpus(index.TableStore(spark), [index.SparseRepresentation(Watched(), idf=True)])
    rows = spark.createDataFrame([("a", "ab ab cd"), ("b", "ab x"), ("c", None)], "id string, text string")
    corpus.add(rows)
    assert len(asked) == 1
    own = corpus.representation("sparse")
    counted = {r.i: r.df for r in own.frequencies.rows(own.frequencies.batches).collect()}
    assert counted == {ord("a") * 32 + 2: 2, ord("c") * 32 + 2: 1, ord("x") * 32 + 1: 1}
    corpus.add(rows.where("id = 'b'").withColumn("text", F.lit("zzz")))
    assert len(asked) == 2 and corpus.store.replaced()
    assert {r.i for r in own.fitted(corpus).collect()} == {ord("a") * 32 + 2, ord("c") * 32 + 2, ord("z") * 32 + 3}
    corpus.store.drop()


def test_vectors_of_a_batch():
    """Words went through a loop of Python one by one."""
    texts = ["b a b", "", "É é x_1 ßİ 1,2", "Ab-aB", "a" * 300, " "]
    for text, got in zip(texts, encode.hashed_vectors(texts, 16), strict=True):
        want = np.zeros(16)
        for word in re.findall(r"\w+", text.lower()):
            value = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
            want[value % 16] += 1.0 if value >> 63 else -1.0
        length = np.sqrt(want @ want)
        assert (got == (want / length if length else want)).all()
    assert encode.hashed_vectors([], 16).shape == (0, 16)


def test_an_indexed_corpus_is_not_cached(spark):
    """All chunks were kept by the executors, where the corpus has stored them."""
    corpus = index.Corpus(index.TableStore(spark), [index.DenseRepresentation(encode.HashingEmbedder(dimensions=8)), index.LexicalRepresentation()])
    rag = pipeline.RagPipeline(corpus, chunker=chunking.FixedChunker(chunk_chars=40, overlap_chars=5))
    docs = spark.createDataFrame([("d", "some words of a text. " * 9), ("e", "others")], "doc_id string, markdown string")
    made = rag.index_documents(docs)
    level = made.storageLevel
    assert not (level.useMemory or level.useDisk) and "InMemoryRelation" not in made._jdf.queryExecution().toString()
    want = chunking.FixedChunker(chunk_chars=40, overlap_chars=5).chunk(docs)
    assert made.columns == want.columns and sorted(map(repr, made.collect())) == sorted(map(repr, want.collect()))
    corpus.store.drop()
