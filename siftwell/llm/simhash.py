"""Document fingerprints by SimHash, with DataFrame functions only.

Terms are pairs of consecutive lower-cased words (and the last word alone; white
space at an end of the text sets an empty word apart).
Each occurrence of a term votes with its weight, the length of its first word up
to MOST_WEIGHT, on each of BITS bits: for the bit where the term's hash has one,
against it where it has zero.  Two votes travel in each long, so a text needs
BITS / 2 sums, which each task pre-aggregates: one row a document leaves it.

`within` finds all fingerprints within a Hamming radius by permuted block
tables: of radius + 2 blocks, two are equal in every such pair, and each choice
of two blocks is the key of one table.

Defined results: null text is empty; a text without words has the fingerprint
zero, and a bit with as many votes for as against is zero; the next document
follows in ascending doc_id (null first), then by a hash of the text; repeated
rows each return a row, of which the last alone has another document after it; a
text of any length votes with all its words; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.shared import Scratch, spread

BITS = 128
MOST_WEIGHT = 8
#: text of a range of documents, ranges whose bounds stand in the plan, and ranges whose first ids are broadcast (16 bytes each)
RANGE_BYTES, FAN, BROADCAST_RANGES = 8 << 20, 512, 1 << 20
_PAIR = 0x0000000100000001


def terms(text: Column) -> Column:
    """Pairs of consecutive words; the last stands alone."""
    words = F.split(F.lower(text), r"\s+")
    return F.arrays_zip(words, F.slice(words, F.lit(2), F.size(words)))


def _hashes() -> list[Column]:
    return [F.xxhash64("a", "b", F.lit(seed)) for seed in range(BITS // 64)]


def _votes(weight: Column) -> list[Column]:
    """Sums of votes for the bits k and k + 32 of each hash, side by side in one long."""
    return [F.sum(F.shiftrightunsigned(F.col(f"h{i}"), k).bitwiseAND(F.lit(_PAIR)) * weight).alias(f"v{i}_{k}") for i in range(BITS // 64) for k in range(32)]


def _word(i: int) -> Column:
    """The i-th 64 bits of the fingerprint: those with more votes for than against."""
    out = F.lit(0).cast("long")
    for k in range(32):
        v = F.col(f"v{i}_{k}")
        out = out.bitwiseOR(F.when(2 * v.bitwiseAND(F.lit(0xFFFFFFFF)) > F.col("total"), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
        high = 1 << (k + 32)
        out = out.bitwiseOR(F.when(2 * F.shiftrightunsigned(v, 32) > F.col("total"), F.lit(high - (1 << 64) if k == 31 else high)).otherwise(F.lit(0)).cast("long"))
    return out


def fingerprints(texts: DataFrame, keys: list[str], carried: dict[str, Column] | None = None) -> DataFrame:
    """keys, f0, f1 ..., copies and carried columns of each distinct keys of texts (keys, text).

    A carried number is taken from the first term of a text alone; copies counts
    the rows of texts with these keys.
    """
    carried = carried or {}
    exploded = texts.select(*keys, *[c.alias(n) for n, c in carried.items()], F.posexplode(terms(F.col("text"))).alias("at", "term"))
    first, names = F.col("at") == 0, list(carried)
    flat = exploded.select(*keys, *[F.when(first, F.col(n)).alias(n) for n in names], F.when(first, 1).otherwise(0).alias("first"), F.col("term").getField("0").alias("a"), F.col("term").getField("1").alias("b"))
    weight = F.least(F.length("a"), F.lit(MOST_WEIGHT)).cast("long")
    voting = flat.select(*keys, *names, "first", *[h.alias(f"h{i}") for i, h in enumerate(_hashes())], weight.alias("w"))
    sums = voting.groupBy(*keys).agg(F.sum("w").alias("total"), F.sum("first").alias("copies"), *_votes(F.col("w")), *[F.max(n).alias(n) for n in names])
    return sums.select(*keys, *[_word(i).alias(f"f{i}") for i in range(BITS // 64)], "copies", *names)


def as_text(prefix: str = "f") -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(F.col(f"{prefix}{i}")), 16, "0") for i in range(BITS // 64)]))


def distance(a: str, b: str) -> Column:
    out = F.lit(0)
    for i in range(BITS // 64):
        out = out + F.bit_count(F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}")))
    return out


def likeness(a: str, b: str) -> Column:
    """Share of equal bits, 0 to 1."""
    return 1.0 - distance(a, b) / float(BITS)


def _ranges(docs: DataFrame, range_bytes: int):
    """rb, the number of a row's range of doc_id, for ranges of about range_bytes of text (null ids are in the first).

    Up to FAN ranges are quantiles of all ids; more are quantiles of the ids of
    each of FAN coarse ranges, in a table of one row for each, eight bytes a
    range.
    """
    total = docs.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    spark = docs.sparkSession
    # several ranges for each partition, so that their hashes fill the partitions evenly
    n = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // range_bytes))
    coarse = n if n <= FAN else math.isqrt(n - 1) + 1
    quantiles = lambda k: F.percentile_approx("doc_id", [i / k for i in range(1, k)], 10 * k)
    cuts = sorted(set(docs.agg(quantiles(coarse)).first()[0] or []))
    if not cuts:
        return lambda df: df.withColumn("rb", F.lit(0).cast("long"))
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts])
    above = lambda of: F.coalesce(F.size(F.filter(of, lambda b: b < F.col("doc_id"))), F.lit(0)).cast("long")
    if n <= FAN:
        return lambda df: df.withColumn("rb", above(bounds))
    fine = docs.where("doc_id is not null").select("doc_id", above(bounds).alias("__c")).groupBy("__c").agg(F.array_distinct(quantiles(coarse)).alias("__f"))
    fine = Scratch(spark).keep(fine, "ranges")
    wide = F.lit(coarse + 1).cast("long")

    def place(df):
        dealt = df.withColumn("__c", above(bounds)).join(F.broadcast(fine), "__c", "left")
        return dealt.withColumn("rb", F.col("__c") * wide + above(F.coalesce("__f", F.array().cast("array<long>")))).drop("__c", "__f")

    return place


def with_next(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """docs (doc_id, text, th) with next_id, next_th and next_text of the following row, the first row's after the last.

    Rows are dealt by ranges of doc_id, so the text is shuffled once and sorted
    within ranges; each range also gets the first row of the range that follows.
    """
    place = _ranges(docs, range_bytes)
    # the ids alone are read for this; there is a row for each range
    heads = place(docs.select("doc_id")).groupBy("rb").agg(F.max(F.col("doc_id").isNull()).alias("none"), F.min("doc_id").alias("low"))
    heads = Scratch(docs.sparkSession).keep(heads.select("rb", F.when(~F.col("none"), F.col("low")).alias("head_id")), "heads")
    turn = Window.orderBy("rb")
    target = F.coalesce(F.lag("rb").over(turn), F.max("rb").over(Window.partitionBy(F.lit(0))))
    follow = heads.select(target.alias("target"), "head_id")
    follow = F.broadcast(follow) if heads.count() <= BROADCAST_RANGES else follow
    copies = docs.join(follow, F.col("doc_id").eqNullSafe(F.col("head_id"))).groupBy("target").agg(F.min_by(F.struct("doc_id", "text", "th"), "th").alias("d")).select("target", "d.*")
    both = place(docs).withColumn("copy", F.lit(0)).unionByName(copies.select("doc_id", "text", "th", F.col("target").alias("rb"), F.lit(1).alias("copy")))
    w = Window.partitionBy("rb").orderBy("copy", F.col("doc_id").asc_nulls_first(), "th")
    lead = both.select("*", *[F.lead(c).over(w).alias(f"next_{n}") for c, n in (("doc_id", "id"), ("th", "th"), ("text", "text"))])
    return lead.where("copy = 0").select("doc_id", "text", "th", "next_id", "next_th", "next_text")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row of docs."""
    scratch = Scratch(docs.sparkSession)
    base = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    rows = with_next(base.withColumn("th", F.xxhash64("text")))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", "th", "next_id", "next_th", F.length("text").alias("n"), "text", edited.alias("edited"))
    sha = F.sha2(F.col("edited"), 256)
    digest = {f"s{k}": F.conv(F.substring(sha, 16 * k + 1, 16), 16, -10).cast("long") for k in range(4)}
    # the base text is kind 0; the edited one, kind 1, carries all that is known of the row.  Repeated rows fold where the row
    # after them is the same too, so that all texts of a group are equal
    both = rows.select("doc_id", "th", "next_id", "next_th", "n", *[c.alias(k) for k, c in digest.items()], F.posexplode(F.array("text", "edited")).alias("kind", "text"))
    both = both.select("doc_id", "th", *[F.when(F.col("kind") == 1, F.col(c)).alias(c) for c in ("next_id", "next_th")], "kind", "n", *digest, "text")
    carried = {c: F.when(F.col("kind") == 1, F.col(c)) for c in ("n", *digest)}
    prints = scratch.keep(fingerprints(both, ["doc_id", "th", "kind", "next_id", "next_th"], carried), "prints")
    own = [F.col(f"f{i}").alias(f"b{i}") for i in range(BITS // 64)]
    base = prints.where("kind = 0").select("doc_id", "th", *own)
    after = prints.where("kind = 0").select(F.col("doc_id").alias("next_id"), F.col("th").alias("next_th"), *[F.col(f"f{i}").alias(f"n{i}") for i in range(BITS // 64)])
    on = lambda left, right, a, b: left.join(right, left[a].eqNullSafe(right[a]) & (left[b] == right[b])).drop(right[a]).drop(right[b])
    joined = on(on(prints.where("kind = 1"), base, "doc_id", "th"), after, "next_id", "next_th")
    out = joined.select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), F.lower(F.concat(*[F.lpad(F.hex(f"s{k}"), 16, "0") for k in range(4)])).alias("edited_sha256"),
        as_text("b").alias("fingerprint"), as_text("f").alias("edited_fingerprint"), likeness("b", "f").alias("near_edited"), likeness("b", "n").alias("near_next"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    )
    return out.drop("copy")


def within(prints: DataFrame, queries: DataFrame, radius: int) -> DataFrame:
    """(query_id, doc_id, n_docs, distance): classes of equal fingerprints (doc_id, f0, f1 ...) at most radius bits from a query's.

    radius + 2 blocks of bits; a pair within the radius agrees on two of them.
    A class stands for its n_docs documents by its smallest doc_id, and queries
    of equal fingerprints for one another, so copies multiply nothing; a query's
    own class is named at distance 0.
    """
    parts = radius + 2
    edges = [round(k * BITS / parts) for k in range(parts + 1)]

    def block(name: str, k: int) -> Column:
        pieces = []
        for i in range(BITS // 64):
            lo, hi = max(edges[k], 64 * i), min(edges[k + 1], 64 * (i + 1))
            if lo < hi:
                pieces.append(F.shiftrightunsigned(F.shiftleft(F.col(f"{name}{i}"), 64 * (i + 1) - hi), 64 - (hi - lo)))
        return F.xxhash64(*pieces)

    def tables(name: str) -> Column:
        keys = [F.struct(F.lit(t).alias("t"), block(name, a).alias("x"), block(name, b).alias("y")) for t, (a, b) in enumerate(combinations(range(parts), 2))]
        return F.explode(F.array(*keys)).alias("key")

    names = lambda name: [f"{name}{i}" for i in range(BITS // 64)]
    as_query = queries.groupBy(*[F.col(f).alias(q) for f, q in zip(names("f"), names("q"), strict=True)]).agg(F.min("doc_id").alias("query_id"))
    classes = prints.groupBy(*names("f")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_docs"))
    index = classes.select(*names("f"), tables("f"))
    asked = as_query.select(*names("q"), tables("q"))
    near = index.join(asked, "key").where(distance("f", "q") <= radius).select(*names("f"), *names("q"), distance("f", "q").alias("distance")).distinct()
    return near.join(as_query, names("q")).join(classes, names("f")).select("query_id", "doc_id", "n_docs", "distance")
