import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from siftwell.llm import lm_score

from .conftest import fold, ids


def brute(rows, mu, order=lm_score.ORDER):
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", fold(t)) + ["\0end"]) for i, t in rows]
    learnt = [w for i, w in docs if zlib.crc32(str(i).encode() if i is not None else b"") % 5 != 1]
    counts = [Counter(g for w in learnt for g in zip(*([["\0begin"] * (o - 1) + w][0][k:] for k in range(o)), strict=False)) for o in range(1, order + 1)]
    n, v = sum(counts[0].values()), len(counts[0])
    out = []
    for i, w in docs:
        base = score = 0.0
        padded = ["\0begin"] * (order - 1) + w
        for k, token in enumerate(w):
            p = (counts[0][token,] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            for o in range(2, order + 1):
                gram = tuple(padded[k + order - o : k + order])
                before = gram[:-1]
                seen = len(learnt) if set(before) == {"\0begin"} else counts[o - 2][before]
                p = (counts[o - 1][gram] + mu * p) / (seen + mu)
            score += math.log10(p)
        out.append((i, len(w), sum(counts[0][t,] > 0 for t in w), n, digits(base), digits(score)))
    return sorted(map(repr, out))


def digits(x):
    return f"{x:.9e}"


def shown(rows):
    return sorted(repr((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, digits(r.base_score), digits(r.score))) for r in rows)


def test_equals_brute_force_and_beats_the_base(sf001):
    docs = sf001("documents")
    rows = lm_score.score(docs).collect()
    assert shown(rows) == brute([(r.doc_id, r.text) for r in docs.collect()], rows[0].mu)
    out = [r for r in rows if r.held_out]
    assert out and sum(r.score for r in out) > sum(r.base_score for r in out)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_orders_and_odd_rows(odd_docs, odd_rows, order):
    rows = lm_score.score(odd_docs, order=order, mus=(8.0,)).collect()
    assert ids(rows) == sorted((i for i, _ in odd_rows), key=lambda x: (x is None, x))
    assert shown(rows) == brute(odd_rows, 8.0, order)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_weights_of_a_state_sum_to_one(order):
    texts = ["a b a c", "a a b", "c", "a b a b a c", ""]
    stream = lm_score.Stream(pa.table({"text": [*texts, "never seen", "a b x"]}), order, np.array([True] * len(texts) + [False] * 2))
    grams, known = [], 0
    for kind in range(order):
        u, at, total = stream.distinct(kind)
        grams.append((at, total.astype(float)))
        known = int((total > 0).sum()) if kind == 0 else known
    n, mus = float(grams[0][1].sum()), (0.5, 8.0)
    machine = lm_score.Automaton(stream, grams, n, known, mus, float(len(texts)))
    seen = np.flatnonzero(grams[0][1] > 0)
    going = seen[seen != np.searchsorted(stream.distinct(0)[0], lm_score.END)]  # nothing follows the end
    reached = {machine.start}
    while True:
        more = reached | {int(x) for s in reached for x in machine.read(np.full(len(going), s), going)[0]}
        if more == reached:
            break
        reached = more
    assert len(reached) > 1 or order == 1
    unseen = np.flatnonzero(grams[0][1] == 0)[:1]
    for state in reached:
        given = 10 ** machine.read(np.full(len(seen), state), seen)[1]
        rest = 10 ** machine.read(np.array([state]), unseen)[1]
        assert np.allclose(given.sum(axis=0) + rest[0], 1.0, atol=1e-12)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_lanes_carry_the_state_of_the_text(order):
    rng = random.Random(order)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(90))) for _ in range(40)]
    stream = lm_score.Stream(pa.table({"text": texts}), order, np.array([k % 3 > 0 for k in range(len(texts))]))
    grams = [(at, total.astype(float)) for _, at, total in map(stream.distinct, range(order))]
    machine = lm_score.Automaton(stream, grams, float(grams[0][1].sum()), 5, (1.0,), 26.0)
    whole, cut = (machine.walk(grams[0][0], stream.first, stream.counts, order, lane) for lane in (1000, 7))
    assert np.allclose(whole, cut, atol=1e-9) and (whole < 0).all()


def test_empty_table(no_docs):
    assert lm_score.score(no_docs).collect() == []
