import hashlib
import re
from collections import defaultdict

import pyarrow as pa
import pytest

from siftwell.llm import bytewords as bw
from siftwell.llm import decontaminate as dc
from siftwell.llm.shared import Scratch

from .conftest import fold, ids

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items, window=10):
    found = defaultdict(set)
    for item, text in items:
        w = WORDS.findall(fold(text))
        size = min(window, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            if item is not None:
                found[tuple(w[k : k + size])].add(str(item))
    out = []
    for doc, text in docs:
        w, hit, names = WORDS.findall(fold(text)), set(), set()
        for size in {len(x) for x in found}:
            for k in range(len(w) - size + 1):
                if owners := found.get(tuple(w[k : k + size])):
                    names |= owners
                    hit |= set(range(k, k + size))
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(map(repr, out))


def run(docs, items, **kw):
    return sorted(repr(tuple(r)) for r in dc.contamination(docs, items, **kw).collect())


@pytest.mark.parametrize("kw", [{}, {"block_words": 300}])
def test_equals_brute_force(sf001, kw):
    docs, items = sf001("documents"), sf001("benchmark")
    expected = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert run(docs, items, **kw) == expected and any("True" in x for x in expected)


def test_short_items_overlaps_and_odd_rows(spark, odd_docs, odd_rows, no_docs):
    items = [(1, "Brown fox"), (2, "lazy dog and"), (10, "the quick brown fox jumps over the lazy dog and runs into"), (11, "brown FOX"), (12, None), (13, "--"), (None, "quick"), (14, "word5 x5 word6"), (15, "東京"), (1, "runs into the")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = brute(odd_rows, items)
    assert run(odd_docs, bench) == expected
    assert run(odd_docs, bench, block_words=4) == expected
    assert run(odd_docs, bench.limit(0)) == brute(odd_rows, [])
    assert run(no_docs, bench) == []
    assert ids(dc.contamination(odd_docs, bench).collect()) == sorted((i for i, _ in odd_rows), key=lambda x: (x is None, x))


def test_phrases_do_not_cross_documents(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "e f"), (3, "c d e f")], "doc_id long, text string").coalesce(1)
    assert [r.doc_id for r in dc.contamination(docs, spark.createDataFrame([(1, "d e")], "item_id long, text string")).collect() if r.contaminated] == [3]


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x fox some brown quick"), (2, "quick " + "y " * 30 + "brown fox"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "quick brown fox")], "item_id long, text string")
    index = Scratch(spark).keep(dc.build_index(docs), "index")
    assert {(r.doc_id, r.item_id) for r in dc.proximity(index, items, span=5).collect()} == {(1, "7")}
    assert {r.doc_id for r in dc.proximity(index, items, span=40).collect()} == {1, 2}
    assert [r.doc_id for r in dc.search_index(index, items.selectExpr("item_id", "'brown quick' as text")).collect() if r.contaminated] == [1]


def test_index_holds_every_position(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, None), (3, "b c")], "doc_id long, text string").coalesce(1)
    data, off = bw.text_buffer(pa.array(["a b c"]))
    wanted = bw.words(data, off, bw.ALNUM)[0]
    found, words = set(), {}
    for row in dc.build_index(docs).collect():
        shard = dc.Shard(row.n_words, bytes(row.terms), bytes(row.counts), bytes(row.positions), wanted)
        at = shard.row_of(shard.position)
        found |= {(row.doc_ids[r], "abc"[t], int(p - shard.row_start[r])) for r, t, p in zip(at.tolist(), shard.term.tolist(), shard.position.tolist(), strict=True)}
        words |= dict(zip(row.doc_ids, row.n_words, strict=True))
    assert words == {1: 3, 2: 0, 3: 2} and found == {(1, "a", 0), (1, "b", 1), (1, "a", 2), (3, "b", 0), (3, "c", 1)}
