"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

Features of a text: hashed single words and pairs of words, and hashed shapes
(capitals, digits, symbols) of single words, pairs and triples.  Each of these
families is scaled to its share of the text, so a score is a sparse dot product
of weights and shares, whatever the length.

Training reads at most SAMPLE labelled rows, those of the least hash of their
id, in one task (a bound that is a parameter), which holds the weights and one
batch of rows; everything else covers all rows.
Scoring is one pass without a shuffle; what it broadcasts is the weights,
2**BITS floats.

Defined results: null or wordless text is scored by the bias alone; rows with a
null id are scored as any other and not held out; a document that is labelled
twice counts with its lower label; without labels of both kinds every score is
the share of label 1 (0.5 without any); a text of any length is read whole, in
memory proportional to it; repeated rows repeat their result; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm import bytewords as bw
from siftwell.llm.shared import spread, trim

BITS = 18
SAMPLE = 8_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.02
SCALE = 6.0
_KIND = np.zeros(256, np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 4, 2
_KIND[[b for b in range(33, 127) if not chr(b).isalnum()]] = 8


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Shape of each word: which kinds of bytes it has, its first byte's kind, its last byte if a symbol, its length class."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lo, hi = int(starts[0]), int(ends[-1])
    kinds = np.append(_KIND[data[lo:hi]], np.uint8(0))
    bounds = np.stack([starts - lo, ends - lo], axis=1).ravel()
    has = np.bitwise_or.reduceat(kinds, bounds)[::2].astype(np.uint64)
    first, last = kinds[starts - lo].astype(np.uint64), data[ends - 1].astype(np.uint64)
    last[kinds[ends - 1 - lo] != 8] = 0
    long = np.minimum(np.log2(ends - starts), 7).astype(np.uint64)
    return bw.mix(has | first << np.uint64(4) | last << np.uint64(8) | long << np.uint64(16))


def features(data: np.ndarray, off: np.ndarray, bits: int = BITS):
    """(hashed indices, owning row, value) of every feature of some rows."""
    starts, ends, first = bw.split(data, off, bw.NOT_SPACE)
    words, shapes = bw.hash_words(data, starts, ends), _shapes(data, starts, ends)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    idx, rows, values = [], [], []
    for family, (tokens, k) in enumerate(((words, 1), (words, 2), (shapes, 1), (shapes, 2), (shapes, 3))):
        n = len(tokens) - k + 1
        if n <= 0:
            continue
        inside = row[:n] == row[k - 1 :]
        grams = (bw.ngrams(tokens, k) + np.uint64(family * 0x9E3779B9))[inside]
        of = row[:n][inside]
        share = 1.0 / np.maximum(1, np.bincount(of, minlength=len(off) - 1))
        idx.append((bw.mix(grams) >> np.uint64(64 - bits)).astype(np.int32))
        rows.append(of)
        values.append((SCALE * share[of]).astype(np.float32))
    if not idx:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.float32)
    return np.concatenate(idx), np.concatenate(rows), np.concatenate(values)


class Ftrl:
    """Per-coordinate follow-the-regularised-leader for logistic loss; the last weight is the bias."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, idx: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(idx)
        p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        sigma = (np.sqrt(self.n[idx] + g * g) - np.sqrt(self.n[idx])) / ALPHA
        self.z[idx] += g - sigma * w
        self.n[idx] += g * g


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, sample: int = SAMPLE, bits: int = BITS) -> np.ndarray | float:
    """Weights from the labelled documents whose crc32(doc_id) mod modulus is not held; a constant if there is one class."""
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("y"))
    if modulus:
        known = known.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) != held)
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    bias, one = np.int32(1 << bits).tobytes(), np.float32(1).tobytes()

    def extract(batches):
        for batch in batches:
            data, off = bw.text_buffer(batch["text"])
            at, values = [], []
            for i, j in bw.row_slices(off):
                idx, row, x = features(data, off[i : j + 1], bits)
                order = np.lexsort((idx, row))
                idx, row, x = idx[order], row[order], x[order]
                new = np.flatnonzero(np.concatenate([[True], (idx[1:] != idx[:-1]) | (row[1:] != row[:-1])])) if len(idx) else np.zeros(0, np.int64)
                idx, row, x = idx[new], row[new], np.add.reduceat(x, new) if len(new) else x
                cuts = np.searchsorted(row, np.arange(j - i + 1))
                # the last feature of each row is the bias
                at.extend(idx[a:b].tobytes() + bias for a, b in zip(cuts[:-1], cuts[1:], strict=True))
                values.extend(x[a:b].astype(np.float32).tobytes() + one for a, b in zip(cuts[:-1], cuts[1:], strict=True))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["y"], pa.array(at, pa.binary()), pa.array(values, pa.binary())], names=["doc_id", "y", "idx", "x"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(drawn), "doc_id").select("doc_id", "y", "text").mapInArrow(extract, "doc_id long, y int, idx binary, x binary")

    def learn(batches):
        """Rows in the order of epochs and ids; one batch is held at a time, however long the sampled texts are."""
        model, n, ones = Ftrl(1 << bits), 0, 0
        for part in (batch.slice(k, 16) for batch in batches for k in range(0, batch.num_rows, 16)):
            for epoch, y, idx, x in zip(*(part[c].to_pylist() for c in ("epoch", "y", "idx", "x")), strict=True):
                n, ones = n + (epoch == 0), ones + (epoch == 0 and y)
                model.update(np.frombuffer(idx, np.int32), np.frombuffer(x, np.float32), y)
        weights = model.weights().astype(np.float32).tobytes() if 0 < ones < n else None
        trim()
        yield pa.RecordBatch.from_pydict({"n": [n], "ones": [int(ones)], "weights": pa.array([weights], pa.binary())})

    turns = rows.withColumn("epoch", F.explode(F.array(*map(F.lit, range(EPOCHS))))).repartition(1).sortWithinPartitions("epoch", "doc_id", "y", "idx", "x")
    found = turns.select("epoch", "y", "idx", "x").mapInArrow(learn, "n long, ones long, weights binary").first()
    if found is None or found["weights"] is None:
        return found["ones"] / found["n"] if found and found["n"] else 0.5
    return np.frombuffer(found["weights"], np.float32)


def predict(docs: DataFrame, model: np.ndarray | float, bits: int = BITS) -> DataFrame:
    """docs with score, the probability of label 1, and predicted."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = docs.select(*names).schema.add("score", "double").add("predicted", "integer")

    def run(batches):
        weights = share.value
        for batch in batches:
            data, off = bw.text_buffer(batch["text"])
            if isinstance(weights, float):
                score = np.full(len(batch), weights)
            else:
                score = np.full(len(batch), float(weights[-1]))
                for i, j in bw.row_slices(off):
                    idx, row, x = features(data, off[i : j + 1], bits)
                    score[i:j] += np.bincount(row, weights=weights[idx] * x, minlength=j - i)
                score = 1.0 / (1.0 + np.exp(-np.clip(score, -35, 35)))
            trim()
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    return docs.select(*names).mapInArrow(run, schema)


def held_out(column, modulus: int, held: int):
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus)) == held, F.lit(False))


def quality(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs (doc_id, text)."""
    model = fit(docs, labels, modulus, held)
    rows = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return predict(rows, model).select("doc_id", held_out("doc_id", modulus, held).alias("held_out"), "score", "predicted")
