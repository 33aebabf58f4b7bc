import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from siftwell.llm import ngram_join
from siftwell.llm.shared import Forest, Scratch

from .conftest import fold


def brute(rows):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", fold(text))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    shared, postings, forest = Counter(), defaultdict(list), Forest()
    for a, s in enumerate(sets):
        for gram in s:
            postings[gram].append(a)
    for where in postings.values():
        shared.update(itertools.combinations(where, 2))
    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            forest.join(rows[a][0], rows[b][0])
    return {i: (len(s), forest.find(i)) for (i, _), s in zip(rows, sets, strict=True)}


def run(df, **kw):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df, **kw).collect()}


@pytest.mark.parametrize("kw", [{}, {"block_nodes": 3}])
def test_equals_brute_force(sf001, kw):
    docs = sf001("documents")
    assert run(docs, **kw) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_chains_and_a_group_over_many_blocks(spark):
    words = [f"w{i}" for i in range(400)]
    chain = [(i, " ".join(words[10 * i : 10 * i + 120])) for i in range(25)]  # neighbours link, ends do not
    group = [(100 + i, " ".join([*words[:150], f"own{i}"] if i else words[:150])) for i in range(40)]
    apart = [(200 + i, " ".join([*words[:100], *(f"z{i}-{j}" for j in range(40 + i))])) for i in range(6)]
    rows = chain + group + apart
    expected = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert run(df) == expected
    assert run(df, block_nodes=4) == expected


def test_odd_rows(odd_docs, no_docs):
    rows = ngram_join.near_duplicates(odd_docs).collect()
    assert len(rows) == 12
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in rows}
    assert {(1, 13, 1), (2, 13, 1), (10, 14, 1), (None, 14, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (8, 1, 8), (9, 1, 9)} <= got
    assert ngram_join.near_duplicates(no_docs).collect() == []


def test_tree_bounds_never_lose_a_link():
    rng = np.random.default_rng(5)
    for _ in range(30):
        base = rng.integers(1, 1 << 62, 60).astype(np.uint64)
        sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(40, 60)], rng.integers(1, 1 << 62, rng.integers(0, 6)).astype(np.uint64)])) for _ in range(40)]
        forest, expected = Forest(), Forest()
        for a, b in ngram_join.link_block(list(range(40)), sets, 80):
            assert ngram_join.linked(sets[a], sets[b], 80)
            forest.join(a, b)
        for a, b in itertools.combinations(range(40), 2):
            if len(np.intersect1d(sets[a], sets[b])) * 100 >= 80 * len(np.union1d(sets[a], sets[b])):
                expected.join(a, b)
        assert [forest.find(i) for i in range(40)] == [expected.find(i) for i in range(40)]


def test_sets_that_share_a_number_are_told_apart(spark):
    rows = spark.createDataFrame([(1, 5, 70), (2, 5, 71), (3, 5, 70), (4, 6, 70), (5, None, None)], "doc_id long, node long, twin long")
    node = {r.doc_id: r.node for r in ngram_join._told_apart(rows, Scratch(spark)).collect()}
    assert node[1] == node[3] != node[2] and node[2] != 5 and node[4] == 6 and node[5] is None
    alone = ngram_join._told_apart(rows.where("doc_id <> 2"), Scratch(spark))
    assert {r.doc_id: r.node for r in alone.collect()} == {1: 5, 3: 5, 4: 6, 5: None} and alone.columns == ["doc_id", "node"]
