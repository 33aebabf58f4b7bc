"""Benchmark decontamination: exact phrase and proximity matches through a positional inverted index.

The index is distributed by document and stored: each shard of training text is
a row with its distinct terms and, term after term, their sorted positions (with
a gap between documents).  A phrase starts from the postings of its rarest term
in the shard and intersects the offset-adjusted postings of its other terms,
rarest first.  Only postings of test terms are looked at.  No posting leaves its
shard, so a frequent term or passage is spread as its documents are, and no
shuffle is needed.

Benchmark windows go to the shards in query blocks of at most BLOCK_WORDS
words, the proven bound of what is broadcast; a larger benchmark searches the
index several times, block after block, and what is found in the documents that
are hit is merged.

Defined results: null text, of a document or an item, has no words; items
without words or without an id are never found; an item id that stands on
several rows is one item; a text of any length is indexed whole, in memory
proportional to it; repeated documents repeat their result; empty tables are
empty results, or documents without hits; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm import bytewords as bw
from siftwell.llm.shared import Scratch, new_number, pack, pack_sorted, spread, trim, unpack, unpack_sorted

WINDOW = 10
BLOCK_WORDS = 1 << 20
SHARD_BYTES = 2 << 20
GAP = 64


class Phrases:
    """A query block: windows of item words as term numbers, grouped by length."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        ids = sorted({i for i, _ in items})
        number = {x: n for n, x in enumerate(ids)}
        self.items, by_length, self.terms = ids, {}, np.zeros(0, np.uint64)
        data, off = bw.text_buffer(pa.array([t for _, t in items], pa.large_string()))
        w, first = bw.words(data, off, bw.ALNUM)
        self.terms = np.unique(w)
        term = np.searchsorted(self.terms, w)
        for k, (item, _) in enumerate(items):
            t = term[first[k] : first[k + 1]]
            length = min(window, len(t))
            for start in range(len(t) - length + 1 if length else 0):
                by_length.setdefault(length, {}).setdefault(tuple(t[start : start + length].tolist()), set()).add(number[item])
        self.groups = [(length, np.array(list(found), np.int64).reshape(-1, length), [sorted(x) for x in found.values()]) for length, found in sorted(by_length.items())]


INDEX = "shard long, doc_ids array<long>, n_words array<int>, terms binary, counts binary, positions binary"


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The postings of all words of docs (doc_id, text), a row for each shard; to be written before it is used."""

    def shards(batches):
        for batch in batches:
            data, off = bw.text_buffer(batch["text"])
            for i, j in bw.row_slices(off, shard_bytes):
                tokens, first = bw.words(data, off[i : j + 1], bw.ALNUM)
                position = np.arange(len(tokens)) + GAP * np.repeat(np.arange(j - i), np.diff(first))
                order = np.argsort(tokens, kind="stable")
                terms, start, counts = np.unique(tokens[order], return_index=True, return_counts=True)
                placed = position[order]
                steps = np.diff(placed, prepend=0)
                steps[start] = placed[start]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([new_number()], pa.int64()), pa.array([batch["doc_id"].slice(i, j - i).to_pylist()], pa.list_(pa.int64())), pa.array([np.diff(first).tolist()], pa.list_(pa.int32())), *(pa.array([x], pa.binary()) for x in (pack_sorted(terms), pack(counts), pack(steps)))],
                    names=["shard", "doc_ids", "n_words", "terms", "counts", "positions"],
                )
            trim()

    rows = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return rows.mapInArrow(shards, INDEX)


class Shard:
    """The stored postings of some documents, as far as a query block has their terms."""

    def __init__(self, n_words: list[int], terms: bytes, counts: bytes, positions: bytes, wanted: np.ndarray):
        stored, sizes, steps = unpack_sorted(terms), unpack(counts).astype(np.int64), unpack(positions).astype(np.int64)
        self.gap, n = GAP, np.array(n_words, np.int64)
        ends = np.cumsum(sizes)
        at = np.minimum(np.searchsorted(stored, wanted), max(0, len(stored) - 1))
        there = stored[at] == wanted if len(stored) else np.zeros(len(wanted), bool)
        lengths = np.where(there, sizes[at] if len(stored) else 0, 0)
        begin = np.where(there, (ends - sizes)[at] if len(stored) else 0, 0)
        self.start = np.concatenate([[0], np.cumsum(lengths)])
        self.term = np.repeat(np.arange(len(wanted)), lengths)
        pick = np.arange(self.start[-1]) + np.repeat(begin - self.start[:-1], lengths)
        # positions are stored as steps within a term
        total = np.cumsum(steps)
        self.position = total[pick] - np.repeat(total[begin] - steps[begin], lengths) if len(pick) else np.zeros(0, np.int64)
        self.row_start = np.cumsum(n) - n + GAP * np.arange(len(n))
        self.width = int(n.sum() + GAP * (len(n) + 2)) + 2
        self.codes = self.term * self.width + self.position

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        code = term * self.width + position
        at = np.searchsorted(self.codes, code)
        return (at < len(self.codes)) & (self.codes[np.minimum(at, len(self.codes) - 1)] == code) & (position >= 0)

    def _anchors(self, windows: np.ndarray):
        """Windows whose terms all occur here, their terms' order by rarity, and the postings of the rarest."""
        lengths = (self.start[1:] - self.start[:-1])[windows]
        possible = np.flatnonzero((lengths > 0).all(axis=1)) if len(self.codes) else np.zeros(0, np.int64)
        rarity = np.argsort(lengths[possible], axis=1, kind="stable")
        return possible, rarity, lengths

    def phrases(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window number, position of its first word) of every occurrence."""
        possible, rarity, lengths = self._anchors(windows)
        if not len(possible):
            return possible, possible
        anchor = rarity[:, 0]
        n = lengths[possible, anchor]
        which = np.repeat(np.arange(len(possible)), n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        begin = self.position[self.start[windows[possible, anchor]][which] + within] - anchor[which]
        for step in range(1, windows.shape[1]):
            offset = rarity[which, step]
            ok = self.has(windows[possible[which], offset], begin + offset)
            which, begin = which[ok], begin[ok]
        return possible[which], begin

    def near(self, windows: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
        """(window number, position of its rarest word) where every other word is within span words of it."""
        possible, rarity, lengths = self._anchors(windows)
        if not len(possible):
            return possible, possible
        anchor = rarity[:, 0]
        n = lengths[possible, anchor]
        which = np.repeat(np.arange(len(possible)), n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        centre = self.position[self.start[windows[possible, anchor]][which] + within]
        for step in range(1, windows.shape[1]):
            term = windows[possible[which], rarity[which, step]]
            at = np.searchsorted(self.codes, term * self.width + np.maximum(centre - span, 0))
            ok = (at < len(self.codes)) & (self.codes[np.minimum(at, len(self.codes) - 1)] <= term * self.width + centre + span)
            which, centre = which[ok], centre[ok]
        return possible[which], centre

    def row_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.row_start, position, "right") - 1


def _query_blocks(benchmark: DataFrame, window: int, block_words: int):
    """Phrases of at most block_words words each; the items stream through the driver one block at a time."""
    held, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).where("item_id is not null and text is not null")
    for item, text in rows.toLocalIterator():
        n = len(text) // 2 + 1
        if held and size + n > block_words:
            yield Phrases(held, window)
            held, size = [], 0
        held.append((item, text))
        size += n
    yield Phrases(held, window)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _open(batches, q: Phrases):
    """(shard, doc_ids, n_words, postings) of each stored row."""
    for batch in batches:
        for shard, ids, n, terms, counts, positions in zip(*(batch[c].to_pylist() for c in ("shard", "doc_ids", "n_words", "terms", "counts", "positions")), strict=True):
            yield shard, ids, n, Shard(n, terms, counts, positions, q.terms)


def _hits(n_words: list[int], shard: Shard, q: Phrases):
    """(number of words, merged spans, item ids) of each document of a shard."""
    rows, names = [[] for _ in n_words], [set() for _ in n_words]
    for length, windows, owners in q.groups:
        which, begin = shard.phrases(windows)
        row = shard.row_of(begin)
        for r, w, b in zip(row.tolist(), which.tolist(), (begin - shard.row_start[row]).tolist(), strict=True):
            rows[r].append((b, b + length))
            names[r].update(owners[w])
    for n, spans, found in zip(n_words, rows, names, strict=True):
        yield n, _merged(spans), [q.items[x] for x in found]


_SUMMED = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string"


def _summed(doc_ids: list, found) -> pa.RecordBatch:
    words, hits, n_items, digests = [], [], [], []
    for n, spans, items in found:
        names = sorted(set(items))
        words.append(n)
        hits.append(sum(b - a for a, b in spans))
        n_items.append(len(names))
        digests.append(hashlib.sha256(",".join(names).encode()).hexdigest())
    return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(words, pa.int64()), pa.array(hits, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256"])


def _one_block(index: DataFrame, phrases: Phrases) -> DataFrame:
    block = index.sparkSession.sparkContext.broadcast(phrases)

    def search(batches):
        for _, ids, n, shard in _open(batches, block.value):
            yield _summed(ids, _hits(n, shard, block.value))

    return index.mapInArrow(search, _SUMMED)


def _several_blocks(index: DataFrame, blocks, scratch: Scratch) -> DataFrame:
    """What each query block finds in each document, merged; a block is gone when what it found is written."""
    found = None
    for number, phrases in enumerate(blocks):
        block = index.sparkSession.sparkContext.broadcast(phrases)

        def search(batches, block=block):
            schema = pa.schema([("shard", pa.int64()), ("row", pa.int32()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
            for shard, _, n, postings in _open(batches, block.value):
                hits = [(shard, row, [x for s in spans for x in s], sorted(items)) for row, (_, spans, items) in enumerate(_hits(n, postings, block.value)) if items]
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, h, strict=True)) for h in hits], schema)

        part = scratch.keep(index.mapInArrow(search, "shard long, row int, spans array<long>, items array<string>"), f"hits-{number}")
        block.destroy()
        found = part if found is None else found.unionByName(part)
    merged = found.groupBy("shard", "row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    rows = index.select("shard", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("row", "doc")).select("shard", "row", "doc.doc_ids", "doc.n_words").toDF("shard", "row", "doc_id", "n_words")
    both = rows.join(merged, ["shard", "row"], "left").select("doc_id", "n_words", F.coalesce("spans", F.array().cast("array<long>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))

    def each(batches):
        for batch in batches:
            rows = zip(*(batch[c].to_pylist() for c in ("n_words", "spans", "items")), strict=True)
            yield _summed(batch["doc_id"].to_pylist(), ((n, _merged(list(zip(s[::2], s[1::2], strict=True))), items) for n, s, items in rows))

    return both.mapInArrow(each, _SUMMED)


def search_index(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each document of a stored index."""
    if window >= GAP:
        raise ValueError(f"window must be below {GAP}")
    blocks = _query_blocks(benchmark, window, block_words)
    one, two = next(blocks), next(blocks, None)
    found = _one_block(index, one) if two is None else _several_blocks(index, chain((one, two), blocks), Scratch(index.sparkSession))
    return found.withColumn("contaminated", F.col("n_hit") > 0)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The same of each row of docs (doc_id, text): the index is built, stored and searched."""
    return search_index(Scratch(docs.sparkSession).keep(build_index(docs), "postings"), benchmark, window, block_words)


def proximity(index: DataFrame, benchmark: DataFrame, span: int = 20, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, position): words whose item window lies, in any order, within span (below the gap) words of them."""
    if span >= GAP:
        raise ValueError(f"span must be below {GAP}")
    out, scratch = None, Scratch(index.sparkSession)
    for number, phrases in enumerate(_query_blocks(benchmark, window, block_words)):
        block = index.sparkSession.sparkContext.broadcast(phrases)

        def search(batches, block=block):
            q = block.value
            for _, ids, _, shard in _open(batches, q):
                found = set()
                for _, windows, owners in q.groups:
                    which, centre = shard.near(windows, span)
                    row = shard.row_of(centre)
                    for r, w, c in zip(row.tolist(), which.tolist(), (centre - shard.row_start[row]).tolist(), strict=True):
                        found.update((ids[r], q.items[o], c) for o in owners[w])
                cols = list(zip(*sorted(found, key=str), strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], names=["doc_id", "item_id", "position"])

        part = scratch.keep(index.mapInArrow(search, "doc_id long, item_id string, position long"), f"near-{number}")
        block.destroy()
        out = part if out is None else out.unionByName(part)
    return out.distinct()
