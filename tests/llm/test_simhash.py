import hashlib
import random
import re

from pyspark.sql import functions as F

from siftwell.llm import simhash

from .conftest import ids


def expected(rows):
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: r[0])
    out = {}
    for k, (i, t) in enumerate(ordered):
        half = len(t) // 2
        after = ordered[(k + 1) % len(ordered)][1]
        out[i] = (len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest())
    return out


def test_edited_texts_and_likeness(sf001):
    docs = sf001("documents")
    got = simhash.edited_fingerprints(docs).collect()
    want = expected([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == want
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    assert sum(r.near_edited > r.near_next for r in got) > 0.9 * len(got)


def test_equal_texts_have_equal_fingerprints(sf01):
    rows = simhash.edited_fingerprints(sf01("documents")).join(sf01("documents").select("doc_id", "text"), "doc_id").collect()
    by = {}
    for r in rows:
        assert by.setdefault(r.text, r.fingerprint) == r.fingerprint
    assert len(set(by.values())) > 0.95 * len(by)


def plain_print(spark, texts):
    """Fingerprints by their definition, one term and bit at a time; only the hash is Spark's."""
    found, pairs = [], []
    for t in texts:
        words = re.split(r"[ \t\n\x0B\f\r]+", t.lower())
        pairs.append([(a, b) for a, b in zip(words, [*words[1:], None], strict=True)])
    distinct = sorted({p for ps in pairs for p in ps}, key=str)
    rows = spark.createDataFrame(distinct, "a string, b string").select("a", "b", *[F.xxhash64("a", "b", F.lit(k)).alias(f"h{k}") for k in range(2)]).collect()
    hashes = {(r.a, r.b): (r.h0 % 2**64) | (r.h1 % 2**64) << 64 for r in rows}
    for ps in pairs:
        votes = [0] * 128
        for a, b in ps:
            weight = min(len(a), simhash.MOST_WEIGHT)
            for k in range(128):
                votes[k] += weight if hashes[a, b] >> k & 1 else -weight
        bits = sum(1 << k for k, v in enumerate(votes) if v > 0)
        found.append(f"{bits & 2**64 - 1:016x}{bits >> 64:016x}")
    return found


def check_whole(spark, df, rows):
    """Every column of every row, with the next row by doc_id (null first) and hash of the text."""
    th = {r.text: r.th for r in spark.createDataFrame([(t or "",) for _, t in rows], "text string").distinct().select("text", F.xxhash64("text").alias("th")).collect()}
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, th[r[1]]))
    edits = [t[: len(t) - len(t) // 2] + rows[(k + 1) % len(rows)][1][: len(t) // 2] for k, (_, t) in enumerate(rows)]
    own, new = plain_print(spark, [t for _, t in rows]), plain_print(spark, edits)
    like = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 128
    want = [(i, len(t), hashlib.sha256(e.encode()).hexdigest(), own[k], new[k], like(own[k], new[k]), like(own[k], own[(k + 1) % len(rows)])) for k, ((i, t), e) in enumerate(zip(rows, edits, strict=True))]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


def test_equals_a_plain_version(spark, sf001, odd_docs, odd_rows):
    docs = sf001("documents").where("doc_id < 80 or doc_id % 10 = 3")
    check_whole(spark, simhash.edited_fingerprints(docs), [(r.doc_id, r.text) for r in docs.collect()])
    short = [(i, t) for i, t in odd_rows if i != 6]
    check_whole(spark, simhash.edited_fingerprints(odd_docs.where("doc_id is null or doc_id <> 6")), short)


def test_any_number_of_ranges(spark, sf001, monkeypatch):
    docs = sf001("documents").select("doc_id", "text", F.xxhash64("text").alias("th"))
    ordered = sorted((r.doc_id, r.text) for r in docs.collect())
    want = sorted((i, ordered[(k + 1) % len(ordered)]) for k, (i, _) in enumerate(ordered))
    for fan, broadcast in ((4, 1 << 20), (4, 0), (512, 0)):
        monkeypatch.setattr(simhash, "FAN", fan)
        monkeypatch.setattr(simhash, "BROADCAST_RANGES", broadcast)
        got = simhash.with_next(docs, range_bytes=8000).collect()
        assert sorted((r.doc_id, (r.next_id, r.next_text)) for r in got) == want


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    got = simhash.edited_fingerprints(odd_docs).collect()
    assert ids(got) == sorted((i for i, _ in odd_rows), key=lambda x: (x is None, x))
    one = next(r for r in got if r.doc_id == 3)
    assert one.n_chars == 0 and one.edited_sha256 == hashlib.sha256(b"").hexdigest() and one.fingerprint == "0" * 32
    assert next(r for r in got if r.doc_id == 7).n_chars == 22
    assert simhash.edited_fingerprints(no_docs).collect() == []
    single = simhash.edited_fingerprints(spark.createDataFrame([(5, "ab cd")], "doc_id long, text string")).collect()
    assert single[0].edited_sha256 == hashlib.sha256(b"ab ab").hexdigest() and single[0].near_next == 1.0


def test_within_finds_all_in_the_radius(spark):
    rng = random.Random(2)
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    base = [rng.getrandbits(128) for _ in range(30)]
    prints = base + [b ^ sum(1 << k for k in rng.sample(range(128), n)) for b in base for n in (0, 1, 2, 3, 4)]
    rows = [(i, signed(p >> 64), signed(p & (1 << 64) - 1)) for i, p in enumerate(prints)]
    df = spark.createDataFrame(rows, "doc_id long, f0 long, f1 long")
    got = {tuple(r) for r in simhash.within(df, df.where("doc_id % 3 = 0"), 3).collect()}
    first, of = {}, lambda p: prints.count(p)
    for i, p in enumerate(prints):
        first.setdefault(p, i)
    asked = {}
    for i, p in enumerate(prints):
        if i % 3 == 0:
            asked.setdefault(p, i)
    want = {(i, j, of(b), (a ^ b).bit_count()) for a, i in asked.items() for b, j in first.items() if (a ^ b).bit_count() <= 3}
    assert got == want and want


def test_main_path_is_native(sf001):
    plan = simhash.edited_fingerprints(sf001("documents"))._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan


def test_repeated_rows_are_edited_one_by_one(spark):
    a, b = "some words of a first text, told at length", "and quite another text here"
    for x, y in ((a, b), (b, a)):  # the hashes of the two are in one order here and in the other there
        rows = [(None, y), (None, y), (1, x), (1, x), (1, x), (2, y), (3, x), (3, x)]
        edits = [t[: len(t) - len(t) // 2] + rows[(k + 1) % len(rows)][1][: len(t) // 2] for k, (_, t) in enumerate(rows)]
        got = simhash.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        alone = simhash.fingerprints(spark.createDataFrame(list(enumerate(edits)), "doc_id long, text string"), ["doc_id"])
        prints = {r.doc_id: r.f for r in alone.select("doc_id", simhash.as_text().alias("f")).collect()}
        want = [(str(i), len(t), hashlib.sha256(e.encode()).hexdigest(), prints[k]) for k, ((i, t), e) in enumerate(zip(rows, edits, strict=True))]
        assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.edited_fingerprint) for r in got) == sorted(want)
