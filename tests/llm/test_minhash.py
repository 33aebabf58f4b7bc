import random

import duckdb
import numpy as np
import pytest

from siftwell.llm import minhash as mh
from siftwell.llm import queries
from tests.llm.conftest import fold, ids


def shingles(text, k=4):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", fold(text)) if w]
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def plain(rows, k=4):
    """(doc_id, n_shingles, component_id, kept) by all pairs."""
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[find(i)] = min(low.get(find(i), doc), doc)
    alone = [sum(find(j) == find(i) for j in range(len(rows))) == 1 for i in range(len(rows))]
    out = []
    for i, (doc, _) in enumerate(rows):
        c = doc if alone[i] else low.get(find(i))
        out.append((doc, len(sets[i]), c, True if c is None else doc == c))
    return out


def random_set(rng, n):
    return np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))


def test_estimates_follow_the_similarity():
    rng = np.random.default_rng(1)
    for n, shared in ((50, 40), (400, 200), (4000, 3600), (4000, 0), (1, 1)):
        errors = []
        for _ in range(40):
            a, b, c = random_set(rng, shared), random_set(rng, n - shared), random_set(rng, n - shared)
            x, y = np.union1d(a, b), np.union1d(a, c)
            errors.append(mh.similarity(mh.sketch(x), mh.sketch(y), len(x), len(y)) - shared / (2 * n - shared))
        assert abs(np.mean(errors)) < 0.02, (n, shared, np.mean(errors))


def test_registers_hold_zeros_and_mantissa():
    for h in (1, 0, 1 << 40, (1 << 56) - 1, 0x00ABCDEF12345678):
        registers = mh.sketch(np.array([h], np.uint64))
        bits = f"{h:056b}"
        zeros = min(len(bits) - len(bits.lstrip("0")), 53)
        behind = (bits + "0" * 64)[zeros + 1 : zeros + 11]
        assert registers[0] == (zeros + 1) << 10 | int(behind, 2) and not registers[1:].any()
    assert not mh.sketch(np.zeros(0, np.uint64)).any()


def test_collisions_of_unrelated_sets_are_expected():
    rng = np.random.default_rng(2)
    found = [int(((a := mh.sketch(random_set(rng, 20_000))) == (b := mh.sketch(random_set(rng, 20_000)))).sum()) for _ in range(300)]
    assert abs(np.mean(found) - mh.chance(mh.spread_of(20_000), mh.spread_of(20_000))) < 0.1


@pytest.mark.parametrize("n", [1, 5, 12, 60, 300, 3000])
def test_linked_pairs_share_bands_and_pass_the_estimate(n):
    rng, least = np.random.default_rng(n), mh.least_matches(80)
    for _ in range(200):
        shared = max(1, -(-n * 8 // 9)) if n > 1 else 1
        a, b, c = random_set(rng, shared), random_set(rng, n - shared), random_set(rng, n - shared)
        x, y = np.union1d(a, b), np.union1d(a, c)
        if 100 * shared < 80 * (len(x) + len(y) - shared):
            x = a
        rx, ry = mh.sketch(x), mh.sketch(y)
        assert (mh.band_keys(rx) == mh.band_keys(ry)).any()
        same, of = mh.matches(rx, ry, mh.spread_of(len(x)), mh.spread_of(len(y)))
        assert same >= least[of] - 1


def corpus():
    rnd = random.Random(3)
    rows, vocabulary = [], [f"w{i}" for i in range(500)]
    for g in range(12):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([3, 6, 20, 80, 400]))]
        for v in range(rnd.choice([1, 4, 12])):
            words = list(base)
            for _ in range(rnd.randrange(0, 1 + len(words) // 12)):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            rows.append((len(rows) + 1, " ".join(words)))
        rows += [(len(rows) + 1, " ".join(base).upper())] * (g % 3)
    return rows


@pytest.mark.parametrize("sizes", [{}, {"block_nodes": 3}, {"block_sets": 4000}])
def test_against_all_pairs(spark, odd_rows, sizes):
    rows = corpus() + [(i + 1000 if i else None, t) for i, t in odd_rows if i != 6]
    docs = spark.createDataFrame([(*r, 7, "x", True) for r in rows], "doc_id long, text string, node int, prefix string, kept boolean").repartition(3)
    got = [tuple(r) for r in mh.near_duplicates(docs, **sizes).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain(rows)))


def test_odd_rows(odd_docs, no_docs):
    got = mh.near_duplicates(odd_docs)
    rows = got.collect()
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"] and len(rows) == 12 and ids(rows)[-1] is None
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, plain([(r.doc_id, r.text) for r in odd_docs.collect()])))
    assert mh.near_duplicates(no_docs).collect() == []


def test_sketches(spark, odd_docs, no_docs):
    rows = {(r.doc_id, r.n_shingles): r.registers for r in mh.sketches(odd_docs).collect()}
    assert all(len(x) == 512 for x in rows.values()) and mh.sketches(no_docs).collect() == []
    of = {i: np.frombuffer(x, np.uint16) for (i, _), x in rows.items()}
    n = {i: k for i, k in rows}
    assert mh.similarity(of[1], of[2], n[1], n[2]) > 0.99 and not of[3].any()


def test_query_and_sql(spark):
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = con.sql(queries.ORACLE_SQL["op12_minhash"])
    got = queries.op12_minhash(spark, "/root/testdata/sf0.001").select(want.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall())) and sum(not r.kept for r in got) > 0
