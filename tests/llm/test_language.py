import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftwell.llm import bytewords as bw
from siftwell.llm import language

from .conftest import ids


def plain_trigrams(text):
    """(bucket, unit) of each trigram whose middle byte is a letter."""
    raw, out, word, inside = [], [], -1, False
    before = 0
    for b in (text or "").encode():
        low = b + 32 if 65 <= b <= 90 or before == 0xC3 and 0x80 <= b <= 0x9E and b != 0x97 else b
        raw.append(low)
        before = b + 32 if 65 <= b <= 90 else b
    chars, units = [32], [None]
    for b in raw:
        letter = b >= 128 or 97 <= b <= 122
        if letter and not inside:
            word += 1
            if word:
                chars.append(32)
                units.append(None)
        if letter:
            chars.append(b)
            units.append(word // language.UNIT_WORDS)
        inside = letter
    chars.append(32)
    for k in range(1, len(chars) - 1):
        if units[k] is not None:
            code = (chars[k - 1] << 16 | chars[k] << 8 | chars[k + 1]) * 0x9E3779B1 % (1 << 32)
            out.append((code >> 32 - language.BITS, units[k]))
    return out


def plain_model(rows, every=False):
    counts = defaultdict(Counter)
    for i, text, lang in rows:
        if lang is not None and text is not None and (every or not held(i)):
            counts[lang].update(b for b, _ in plain_trigrams(text))
    return {lang: {"n": sum(c.values()), "c": c} for lang, c in counts.items() if c}


def plain_mixture(model, text):
    """(predicted, expected share, language set, known) by the definitions, one unit and language at a time."""
    langs, units, grams = sorted(model), defaultdict(lambda: defaultdict(float)), plain_trigrams(text)
    for b, u in grams:
        for x in langs:
            units[u][x] += math.log((model[x]["c"][b] + 0.5) / (model[x]["n"] + 0.5 * (1 << language.BITS)))
    rows = [units[u] for u in sorted(units)]
    if not rows:
        return "und", 0.0, set(), False
    peaks = [max(r.values()) for r in rows]
    likely = [{x: math.exp(r[x] - p) + 1e-30 for x in langs} for r, p in zip(rows, peaks, strict=True)]

    def em(shares, rounds):
        for _ in range(rounds):
            new = dict.fromkeys(langs, 0.0)
            for r in likely:
                total = sum(r[x] * shares[x] for x in langs) + 1e-300
                for x in langs:
                    new[x] += r[x] * shares[x] / total
            shares = {x: new[x] / len(rows) for x in langs}
        return shares

    order = sorted(langs, key=lambda x: -em(dict.fromkeys(langs, 1 / len(langs)), language.ROUNDS)[x])
    tried = [(sum(r[x] for r in rows), {x: 1.0}) for x in langs]
    best = max(tried, key=lambda t: t[0])
    for k in range(2, len(langs) + 1):
        shares = em({x: 1 / k if x in order[:k] else 0.0 for x in langs}, language.ROUNDS // 2)
        value = sum(peaks) + sum(math.log(sum(r[x] * shares[x] for x in langs) + 1e-300) for r in likely) - (k - 1) * (language.PENALTY + 0.5 * math.log(len(rows)))
        tried.append((value, shares))
        if value <= best[0]:
            break
        best = (value, shares)
    top = max(sorted(best[1]), key=lambda x: best[1][x])
    weights = [math.exp(v - best[0]) for v, _ in tried]
    return top, sum(w * s.get(top, 0.0) for w, (_, s) in zip(weights, tried, strict=True)) / sum(weights), {x for x in best[1] if best[1][x] > 0}, best[0] > -len(grams) * language.BITS * math.log(2)


def test_equals_a_plain_version(sf001, odd_docs):
    docs = sf001("documents").select("doc_id", "text", "lang").unionByName(odd_docs.where("doc_id <> 6 and doc_id is not null").select(F.col("doc_id") + 10**6, "text", "lang").toDF("doc_id", "text", "lang"))
    rows = [tuple(r) for r in docs.collect()]
    model = plain_model(rows)
    fitted = language.fit(docs)
    assert fitted.languages == sorted(model)
    for k, x in enumerate(fitted.languages):
        for b in (0, 17, 4000, *list(model[x]["c"])[:200]):
            assert float(fitted.log[b, k]) == pytest.approx(math.log((model[x]["c"][b] + 0.5) / (model[x]["n"] + 0.5 * (1 << language.BITS))), rel=1e-6)
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    for i, text, _ in rows:
        if text is None or len(text) < 1500:
            lang, share, *_ = plain_mixture(model, text)
            assert got[i].lang_pred == lang and got[i].score == pytest.approx(share, abs=1e-4), i


def test_a_set_of_languages_has_no_bound(spark):
    rng = random.Random(5)
    letters = {x: [chr(0x0400 + 40 * k + j) for j in range(20)] for k, x in enumerate("abcdefg")}
    text = lambda x, n: " ".join("".join(rng.choice(letters[x]) for _ in range(5)) for _ in range(n))
    docs = spark.createDataFrame([(3 * k, text(x, 3000), x) for k, x in enumerate("abcdefg")], "doc_id long, text string, lang string")
    model = language.fit(docs, modulus=0)
    mixed = " ".join(text(x, 90) for x in "abcdef")
    data, off = bw.text_buffer(pa.array([mixed]))
    _, shares, expected, known = language.mixtures(model, data, off)
    assert [model.languages[k] for k in shares[0].nonzero()[0]] == list("abcdef") and known[0] and 0.1 < expected[0] < 0.25


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_held_out_accuracy(sf01):
    docs = sf01("documents")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert {r.doc_id for r in out} == {r.doc_id for r in rows if held(r.doc_id)}
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.99
    assert all(0 <= r.score <= 1 for r in rows)


def test_predictions_ignore_the_labels_and_learn_from_nothing_held_out(sf001):
    docs = sf001("documents")
    plain = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs).collect()}
    other = docs.withColumn("lang", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("?"))
    assert {r.doc_id: (r.lang_pred, r.score) for r in language.identify(other).collect()} == plain


def test_mixtures_name_both_languages(spark, sf01):
    docs = sf01("documents")
    model = language.fit(docs)
    texts = {lang: docs.where((F.col("lang") == lang) & (F.length("text") > 3000)).first().text[:2000] for lang in ("en", "de", "fr")}
    rows = [(1, texts["en"] + "\n" + texts["de"][:1200]), (2, texts["fr"])]
    got = {r.doc_id: r.mixture for r in language.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert set(got[1]) == {"en", "de"} and got[1]["en"] > got[1]["de"] > 0.2 and set(got[2]) == {"fr"}


def test_odd_rows(odd_docs, no_docs, odd_rows):
    rows = language.identify(odd_docs).collect()
    assert ids(rows) == sorted((i for i, _ in odd_rows), key=lambda x: (x is None, x))
    by = {r.doc_id: r for r in rows}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (3, 4, 5, 9)) and by[1].lang_pred == "en"
    assert by[None].held_out is False
    assert language.identify(no_docs).collect() == []
    assert {r.lang_pred for r in language.identify(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_symbols_above_ascii_are_no_letters(spark, sf001):
    df = spark.createDataFrame([(1, "🎉🎉 — … 123"), (2, "東京")], "doc_id long, text string").withColumn("lang", F.lit("en"))
    by = {r.doc_id: r.lang_pred for r in language.identify(sf001("documents").select("doc_id", "text", "lang").where("doc_id > 2").unionByName(df)).where("doc_id < 3").collect()}
    assert by[1] == "und" and by[2] != "und"


def test_many_languages_are_counted_in_parts(spark, monkeypatch):
    monkeypatch.setattr(language, "HELD_LANGUAGES", 8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = lambda k: " ".join(letters[(k + i) % 26] + letters[k % 26] + letters[(3 * k) % 26] + letters[(k // 26 + i) % 26] for i in range(12))
    rows = [(3 * k + r, own(k), f"l{k:03d}") for k in range(40) for r in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    model = language.fit(docs, modulus=0)
    assert model.languages == sorted({r[2] for r in rows}) and model.log.shape == (1 << language.BITS, 40) and model.log.dtype == np.float32
    assert np.allclose(np.exp(model.log.astype(float)).sum(axis=0), 1, atol=1e-3)
    got = {r.doc_id: r.lang_pred for r in language.predict(docs.select("doc_id", "text"), model).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) >= 76
