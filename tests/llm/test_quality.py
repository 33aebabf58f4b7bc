import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftwell.llm import bytewords as bw
from siftwell.llm import quality

from .conftest import fold, ids


def _mix(x):
    x &= 2**64 - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def _gram(hashes):
    out = len(hashes)
    for j, h in enumerate(hashes):
        out = (out + h * int(bw._SHINGLE[j])) % 2**64
        out = _mix(out) if j == len(hashes) - 1 else out ^ out >> 29
    return out


def _shape(word):
    raw = word.encode()
    kinds = [8 if 33 <= b < 127 and not chr(b).isalnum() else 4 if 48 <= b <= 57 else 1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 or b >= 128 else 0 for b in raw]
    has = 0
    for k in kinds:
        has |= k
    return _mix(has | kinds[0] << 4 | (raw[-1] if kinds[-1] == 8 else 0) << 8 | min(int(math.log2(len(raw))), 7) << 16)


def plain_features(text):
    """{index: value}: families of words and shapes, one feature at a time."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    data, off = bw.text_buffer(pa.array([fold(" ".join(words))]))
    hashes = [int(h) for h in bw.words(data, off, bw.NOT_SPACE)[0]]
    shapes, out = [_shape(w) for w in words], Counter()
    for family, (tokens, k) in enumerate(((hashes, 1), (hashes, 2), (shapes, 1), (shapes, 2), (shapes, 3))):
        n = len(tokens) - k + 1
        for at in range(n):
            out[_mix(_gram(tokens[at : at + k]) + family * 0x9E3779B9) >> 64 - quality.BITS] += quality.SCALE / n
    return dict(out) | {1 << quality.BITS: 1.0}


def plain_ftrl(rows):
    z, n = Counter(), Counter()

    def weight(i):
        return 0.0 if abs(z[i]) <= quality.L1 else -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for x, y in rows:
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(w[i] * v for i, v in x.items())))))
            for i, v in x.items():
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * w[i]
                n[i] += g * g
    return weight


def test_equals_a_plain_version(sf001):
    docs = {r.doc_id: r.text for r in sf001("documents").collect()}
    labels = {r.doc_id: r.quality for r in sf001("labels").collect() if r.quality is not None}
    weight = plain_ftrl([(plain_features(docs[i]), y) for i, y in sorted(labels.items()) if i in docs and zlib.crc32(str(i).encode()) % 3 != 1])
    got = {r.doc_id: r for r in quality.quality(sf001("documents"), sf001("labels")).collect()}
    assert set(got) == set(docs)
    for i, text in docs.items():
        want = 1 / (1 + math.exp(-sum(weight(k) * v for k, v in plain_features(text).items())))
        assert got[i].score == pytest.approx(want, abs=2e-3) and got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)


def test_held_out_accuracy(sf01):
    rows = quality.quality(sf01("documents"), sf01("labels")).join(sf01("labels"), "doc_id").where("held_out").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([np.mean(np.array(good) > b) for b in bad]) > 0.97
    assert all((r.score >= 0.5) == bool(r.predicted) for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95


def test_held_out_labels_do_not_matter(sf001):
    docs, labels = sf001("documents"), sf001("labels")
    plain = {r.doc_id: r.score for r in quality.quality(docs, labels).collect()}
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    changed = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    other = quality.quality(docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit("y")), changed)
    assert {r.doc_id: r.score for r in other.collect()} == plain


def test_odd_rows(odd_docs, no_docs, odd_rows, sf001, spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 0), (6, 1, None), (8, 0, 1), (None, 1, 1), (9, None, 1), (99, 1, 0), (7, 1, 0), (10, 0, 0)], "doc_id long, quality int, toxic int")
    rows = quality.quality(odd_docs, labels).collect()
    assert ids(rows) == sorted((i for i, _ in odd_rows), key=lambda x: (x is None, x))
    empty = {r.score for r in rows if r.doc_id in (3, 4, 5)}
    assert len(empty) == 1 and all(0 <= r.score <= 1 for r in rows)
    assert quality.quality(no_docs, labels).collect() == []
    assert {r.score for r in quality.quality(odd_docs, labels.limit(0)).collect()} == {0.5}
    ones = quality.quality(odd_docs, labels.where("quality = 1")).collect()
    assert {r.score for r in ones} == {1.0} and {r.predicted for r in ones} == {1}


def test_features_of_a_text_do_not_depend_on_its_neighbours():
    def of(texts, k):
        data, off = bw.text_buffer(pa.array(texts))
        idx, row, x = quality.features(data, off)
        return sorted(zip(idx[row == k].tolist(), x[row == k].tolist(), strict=True))

    assert of(["Some words, here!! 12", "the other TEXT of it", ""], 1) == of(["the other TEXT of it"], 0)
    assert of(["", "a"], 0) == []


def test_ftrl_learns_and_keeps_unused_weights_at_zero():
    model = quality.Ftrl(8)
    for _ in range(200):
        model.update(np.array([0, 8]), np.array([1.0, 1.0]), 1)
        model.update(np.array([1, 8]), np.array([1.0, 1.0]), 0)
    w = model.weights()
    assert w[0] > 0.5 and w[1] < -0.5 and (w[2:8] == 0).all() and w[8] == pytest.approx(0, abs=0.5)
