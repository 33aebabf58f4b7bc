"""Language ID: each document is a mixture of languages.

Training counts hashed byte trigrams of letters for each language over all
labelled documents.  A document is cut into units of a few words; expectation
maximisation estimates which share of the units each language wrote, and the
language set grows, by the next largest share, as long as its likelihood, less a
penalty for each further language and the size of the document, does.  The
prediction is the largest share of that set.  The score is the expected share of
the predicted language: its share in each set that was tried, weighted by the
penalised likelihood of the set.

Counts are pre-aggregated before their shuffle (a row for each language and
bucket and task, which holds HELD_LANGUAGES at most); executors make the model's
row of each language, and what is broadcast has 2**BITS floats a language.  A
lang column of more than MOST_LANGUAGES values is refused.

Defined results: null text or text without a letter is `und` with score 0; a
null doc_id is not held out; rows whose lang is null are predicted and not
learnt from; with no labelled row at all every prediction is `und`; equal shares
go to the language whose name sorts first; a text of any length is read whole,
in memory proportional to it; repeated rows repeat their result; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.llm import bytewords as bw
from siftwell.llm.quality import held_out
from siftwell.llm.shared import Scratch, spread, trim

BITS = 14
UNIT_WORDS = 6
PENALTY = 4.0
#: the bound of what is broadcast, 128 MB, of which the driver holds one copy and one more while it is sent
MOST_LANGUAGES = 2048
#: languages whose counts, 128 KB each, a task holds before it sends them on
HELD_LANGUAGES = 64
ROUNDS = 8
_LETTER = bw.byte_class(lambda b: b >= 0x80 or chr(b).isalpha())
_HAS_LETTER = regex.compile(r"\p{L}")


def trigrams(data: np.ndarray, off: np.ndarray, bits: int = BITS):
    """(bucket of each trigram, its row, its unit, unit rows): letters, lower case, words set apart by one space."""
    lo, hi = int(off[0]), int(off[-1])
    raw = bw.FOLD[data[lo:hi]]
    after = np.zeros(len(raw), bool)
    after[1:] = raw[:-1] == 0xC3
    latin = after & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97)
    raw = raw + latin.astype(np.uint8) * np.uint8(0x20)
    letter = _LETTER[raw]
    edge = off[:-1] - lo
    edge = edge[edge < len(raw)]
    start = letter.copy()
    start[1:] &= ~letter[:-1]
    start[edge] |= letter[edge]
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    # a space stands before each word and after each text: trigrams never span two rows
    at = np.flatnonzero(letter)
    n_before = np.cumsum(start)[at]
    out = np.full(len(at) + (int(n_before[-1]) if len(at) else 0) + 2, 0x20, np.uint8)
    place = np.arange(len(at)) + n_before
    out[place] = raw[at]
    code = (out[:-2].astype(np.uint32) << 16 | out[1:-1].astype(np.uint32) << 8 | out[2:]) * np.uint32(0x9E3779B1)
    keep = place - 1  # the trigram whose middle byte is a letter
    bucket = (code[keep] >> np.uint32(32 - bits)).astype(np.int32)
    rows = row[at]
    word_row = rows[np.flatnonzero(np.diff(n_before, prepend=0))] if len(at) else np.zeros(0, np.int64)
    first_word = np.searchsorted(word_row, np.arange(len(off)))
    of_word = n_before - 1
    unit_key = (of_word - first_word[rows]) // UNIT_WORDS
    new = np.ones(len(at), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (unit_key[1:] != unit_key[:-1])
    starts = np.flatnonzero(new)
    return bucket, rows, starts, rows[starts]


class Model:
    """Log probabilities, buckets x languages."""

    def __init__(self, languages: list[str], log: np.ndarray):
        self.languages, self.log = languages, log


def log_chances(counts: np.ndarray) -> np.ndarray:
    """Of each bucket, in the order of counts."""
    return np.log((counts + 0.5) / (counts.sum() + 0.5 * len(counts))).astype(np.float32)


def fit(docs: DataFrame, modulus: int = 3, held: int = 1, bits: int = BITS) -> Model | None:
    """The model of the documents whose lang is known and whose crc32(doc_id) mod modulus is not held."""
    known = spread(docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))).where("lang is not null and text is not null")
    if modulus:
        known = known.where(~held_out("doc_id", modulus, held))

    def count(batches):
        totals: dict[str, np.ndarray] = {}

        def told():
            for name, cells in totals.items():
                some = np.flatnonzero(cells)
                yield pa.RecordBatch.from_pydict({"lang": [name] * len(some), "bucket": pa.array(some, pa.int32()), "n": pa.array(cells[some], pa.int64())})
            totals.clear()

        for batch in batches:
            lang = batch["lang"].dictionary_encode()
            names, which = lang.dictionary.to_pylist(), lang.indices.to_numpy(zero_copy_only=False)
            data, off = bw.text_buffer(batch["text"])
            for i, j in bw.row_slices(off):
                bucket, rows, _, _ = trigrams(data, off[i : j + 1], bits)
                here = which[i:j][rows]
                for k in np.unique(which[i:j]).tolist():
                    cell = np.bincount(bucket[here == k], minlength=1 << bits)
                    totals[names[k]] = totals[names[k]] + cell if names[k] in totals else cell
                if len(totals) > HELD_LANGUAGES:
                    yield from told()
            trim()
        yield from told()

    def chances(table: pa.Table) -> pa.Table:
        counts = np.zeros(1 << bits)
        counts[table["bucket"].to_numpy()] = table["n"].to_numpy()
        return pa.table({"lang": table["lang"].slice(0, 1), "log": pa.array([log_chances(counts).tobytes()], pa.binary())})

    cells = known.select("text", "lang").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    scratch = Scratch(docs.sparkSession)
    cells = scratch.keep(cells, "cells")
    languages = sorted(r["lang"] for r in cells.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"the column lang has more than {MOST_LANGUAGES} values")
    if not languages:
        return None
    # a row of 64 KB for each language, made by executors and taken one by one
    log, number = np.zeros((1 << bits, len(languages)), np.float32), {x: k for k, x in enumerate(languages)}
    for row in scratch.keep(cells.groupBy("lang").applyInArrow(chances, "lang string, log binary"), "chances").toLocalIterator():
        log[:, number[row["lang"]]] = np.frombuffer(row["log"], np.float32)
    return Model(languages, log)


def _em(shares: np.ndarray, likely: np.ndarray, first: np.ndarray, rows: np.ndarray, units: np.ndarray, rounds: int) -> np.ndarray:
    for _ in range(rounds):
        part = likely * shares[rows]
        part /= part.sum(axis=1, keepdims=True) + 1e-300
        shares = np.add.reduceat(part, first, axis=0) / units[:, None]
    return shares


def mixtures(model: Model, data: np.ndarray, off: np.ndarray, bits: int = BITS):
    """For each row with a letter byte: row number, shares of the languages in its chosen set, expected share of the largest, whether the set explains it better than evenly drawn trigrams."""
    bucket, _, starts, unit_row = trigrams(data, off, bits)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros((0, len(model.languages))), np.zeros(0), np.zeros(0, bool)
    score = np.add.reduceat(model.log[bucket], starts, axis=0).astype(np.float64)
    first = np.flatnonzero(np.concatenate([[True], unit_row[1:] != unit_row[:-1]]))
    present = unit_row[first]
    rows, units = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(unit_row)))), np.diff(np.append(first, len(unit_row))).astype(float)
    peak = score.max(axis=1, keepdims=True)
    likely = np.exp(score - peak) + 1e-30
    n, units_of = len(model.languages), len(first)
    alone = np.add.reduceat(score, first, axis=0)
    base = np.add.reduceat(peak[:, 0], first)
    order = np.argsort(-_em(np.full((units_of, n), 1.0 / n), likely, first, rows, units, ROUNDS), axis=1, kind="stable")
    best = np.zeros((units_of, n))
    best[np.arange(units_of), alone.argmax(axis=1)] = 1.0
    best_value = alone.max(axis=1)
    # of every set tried: its penalised likelihood and, for sets of several, its shares
    tried = [(np.arange(units_of), alone, None)]
    growing = np.arange(units_of)
    for k in range(2, n + 1):
        inside = np.zeros(units_of, bool)
        inside[growing] = True
        part, of = likely[inside[rows]], np.repeat(np.arange(len(growing)), units[growing].astype(np.int64))
        begin = np.cumsum(units[growing].astype(np.int64)) - units[growing].astype(np.int64)
        allowed = np.zeros((len(growing), n))
        np.put_along_axis(allowed, order[growing, :k], 1.0 / k, axis=1)
        shares = _em(allowed, part, begin, of, units[growing], ROUNDS // 2)
        value = base[growing] + np.add.reduceat(np.log((part * shares[of]).sum(axis=1) + 1e-300), begin) - (k - 1) * (PENALTY + 0.5 * np.log(units[growing]))
        tried.append((growing, value[:, None], shares))
        better = value > best_value[growing]
        best[growing[better]], best_value[growing[better]] = shares[better], value[better]
        growing = growing[better]
        if not len(growing):
            break
    top, above, total = best.argmax(axis=1), np.zeros(units_of), np.zeros(units_of)
    for of, value, shares in tried:
        weight = np.exp(np.minimum(value - best_value[of, None], 0.0))
        total[of] += weight.sum(axis=1)
        above[of] += weight[np.arange(len(of)), top[of]] if shares is None else weight[:, 0] * shares[np.arange(len(of)), top[of]]
    letters = np.add.reduceat(np.diff(np.append(starts, len(bucket))), first)
    return present, best, above / total, best_value > -letters * np.log(1 << bits)


def predict(docs: DataFrame, model: Model | None, bits: int = BITS) -> DataFrame:
    """docs with lang_pred, score, the shares of the chosen languages and whether the text is of a learnt language at all."""
    share = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "mixture", "known")]
    schema = docs.select(*names).schema.add("lang_pred", "string").add("score", "double").add("mixture", T.MapType(T.StringType(), T.DoubleType())).add("known", "boolean")

    def run(batches):
        model = share.value
        for batch in batches:
            data, off = bw.text_buffer(batch["text"])
            texts = batch["text"]
            pred, score, mixture, known = ["und"] * len(batch), np.zeros(len(batch)), [[] for _ in range(len(batch))], np.zeros(len(batch), bool)
            limit = bw.SLICE_BYTES if model is None else max(1 << 16, bw.SLICE_BYTES * 4 // len(model.languages))
            for i, j in bw.row_slices(off, limit) if model else ():
                ascii_letter = np.add.reduceat(np.append(_LETTER[data[off[i] : off[j]]] & (data[off[i] : off[j]] < 0x80), False), off[i:j] - off[i]) * (np.diff(off[i : j + 1]) > 0)
                rows, shares, expected, fits = mixtures(model, data, off[i : j + 1], bits)
                for r, s, c, fit in zip(rows.tolist(), shares, expected.tolist(), fits.tolist(), strict=True):
                    if not ascii_letter[r] and not _HAS_LETTER.search(texts[i + r].as_py()):
                        continue
                    top = int(s.argmax())
                    pred[i + r] = model.languages[top]
                    score[i + r], known[i + r] = min(1.0, c), fit
                    mixture[i + r] = [(model.languages[k], float(s[k])) for k in np.flatnonzero(s > 0)]
            trim()
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(mixture, pa.map_(pa.string(), pa.float64())), pa.array(known)], names=[*names, "lang_pred", "score", "mixture", "known"])

    return docs.select(*names).mapInArrow(run, schema)


def identify(docs: DataFrame, modulus: int = 3, held: int = 1) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row of docs (doc_id, text, lang)."""
    model = fit(docs, modulus, held)
    rows = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return predict(rows, model).select("doc_id", held_out("doc_id", modulus, held).alias("held_out"), "lang_pred", "score")
