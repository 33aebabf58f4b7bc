"""Queries that ask everything, held to brute force on the smallest tables."""

import math
import re
from collections import Counter

from siftwell.plans import catalogue


def words(text):
    return re.findall(r"\w+", text.lower())


def bm25(items, texts):
    """{qid: {id: score}} of every text with a word of the item."""
    counts = {i: Counter(words(t)) for i, t in texts.items()}
    size = {i: sum(c.values()) for i, c in counts.items()}
    mean, df = sum(size.values()) / len(size), Counter(w for c in counts.values() for w in c)
    out = {}
    for qid, text in items.items():
        scores = Counter()
        for w in set(words(text)):
            for i, c in counts.items():
                if w in c:
                    scores[i] += math.log(1 + (len(counts) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * size[i] / mean))
        out[qid] = scores
    return out


def test_every_item_is_searched_with_all_its_words(spark, sf_dir):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    chunks = {r.id: r.text for r in catalogue.chunk_fixed(spark, sf_dir).collect()}
    want, got = bm25(items, chunks), {}
    for r in catalogue.QUERIES["search_bm25_topk"](spark, sf_dir).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.chunk_id, r.score))
    assert sorted(got) == sorted(items) and max(items) >= 10
    for qid, rows in got.items():
        best = sorted(((round(s, 9), i) for i, s in want[qid].items()), reverse=True)[:10]
        assert [i for _, i, _ in sorted(rows)] == [i for _, i in best]
        assert all(abs(s - round(b, 6)) < 2e-6 for (_, _, s), (b, _) in zip(sorted(rows), best, strict=True))


def test_queries_without_sql_answer_every_item(spark, sf_dir):
    items = {r.item_id for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    for name in ("rag_answers", "search_hybrid", "search_hyde", "extractive_answer"):
        assert {r.qid for r in catalogue.QUERIES[name](spark, sf_dir).collect()} == items, name
        spark.catalog.clearCache()


def test_relevant_documents_have_a_passage_of_the_item(spark, sf_dir):
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    runs = {}
    for qid, w in items.items():
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            runs.setdefault(" ".join(w[k : k + n]), set()).add(qid)
    sizes, want = {len(r.split()) for r in runs}, set()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        w = words(r.text or "")
        want |= {(q, str(r.doc_id)) for n in sizes for k in range(len(w) - n + 1) for q in runs.get(" ".join(w[k : k + n]), ())}
    assert {(r.qid, r.doc_id) for r in catalogue._passage_documents(spark, sf_dir).collect()} == want and want
    assert {r.qid for r in catalogue.QUERIES["ir_doc_level"](spark, sf_dir).collect()} == {q for q, _ in want}


def test_every_vector_is_searched_for_ids_divisible_by_100(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    unit = {r.vec_id: [x / math.hypot(*r.embedding) for x in r.embedding] for r in rows}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    kept = {r.vec_id: [max(x, 0.0) for x in r.embedding] for r in rows}
    asked = [i for i in sorted(unit) if i % 100 == 0]
    for name, vectors, among in (
        ("search_dense_topk", unit, set(unit)), ("search_dense_filtered", unit, {r.vec_id for r in rows if r.label in (1, 3)}), ("search_sparse_dot", kept, set(kept))
    ):
        got = {}
        for r in catalogue.QUERIES[name](spark, sf_dir).collect():
            got.setdefault(r.qid, []).append((r["rank"], int(r.chunk_id)))
        assert sorted(got) == asked, name
        for qid in asked:
            best = sorted(((round(dot(vectors[qid], vectors[i]), 9), str(i)) for i in among), reverse=True)[:10]
            assert [i for _, i in sorted(got[qid])] == [int(i) for _, i in best], (name, qid)
