"""Near-duplicate removal by HyperMinHash.

1. A text's set of word shingles becomes REGISTERS buckets of its hashes; each
   keeps, of its least hash, the number of leading zeros (6 bits) and the
   MANTISSA bits behind the leading one: 512 bytes a document.
2. ROWS registers in turn are a band.  An empty bucket borrows for the bands the
   register of the first filled one in an order of its own, so that small sets
   have all bands too.  With 64 bands of 4, two sets of similarity 0.8 share none
   once in 4 * 10**14 pairs.
3. Band keys are counted over the whole corpus (blocks ask, buckets of keys
   answer); documents that share none are done.  The others fall into groups by
   shared keys, and groups are cut into blocks as those of the n-gram join are.
4. In a block, pairs that share a band, and are not connected yet, are estimated:
   equal registers less those that different minima would make equal by chance,
   over the buckets that either set fills.  A pair is given up where a pair at
   the threshold would have as few once in 10**12 times; all others are
   intersected on their full sets.

Equal sets are one node and copies multiply nothing.

Defined results: null or wordless text has no shingles and links with nothing; a
similarity of exactly the threshold links; a text of any length is read whole,
in memory proportional to it; a repeated row repeats its result; rows with a null
doc_id get a null component unless linked, and are kept then; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm import bytewords as bw
from siftwell.llm import ngram_join as nj
from siftwell.llm.shared import KEY_BITS, Scratch, answer, ask, pack_blocks, sizes, spread, told

BUCKET_BITS, MANTISSA, ROWS = 8, 10, 4
REGISTERS = 1 << BUCKET_BITS
SKETCH_WORDS = REGISTERS * 2 // 8
#: chance that a pair at the threshold is given up by its estimate
LOST = 1e-12
_EDGES = (np.arange(1, REGISTERS, dtype=np.uint64)) << np.uint64(64 - BUCKET_BITS)
_ORDER = np.random.Generator(np.random.PCG64(20250309)).permuted(np.tile(np.arange(REGISTERS, dtype=np.uint16), (REGISTERS, 1)), axis=1)
_ODD = np.random.Generator(np.random.PCG64(20250310)).integers(1, 1 << 63, REGISTERS, dtype=np.uint64) | np.uint64(1)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The registers of a sorted set of 64-bit hashes; an empty bucket is zero."""
    out = np.zeros(REGISTERS, np.uint16)
    if not len(shingles):
        return out
    # the set is sorted, so a bucket is a range of it and its least hash comes first
    cuts = np.concatenate([[0], np.searchsorted(shingles, _EDGES), [len(shingles)]])
    filled = np.flatnonzero(cuts[1:] > cuts[:-1])
    rest = shingles[cuts[filled]] << np.uint64(BUCKET_BITS)
    zeros = np.uint64(53) - np.frexp((rest >> np.uint64(11)).astype(np.float64))[1].astype(np.uint64)
    mantissa = (rest << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    out[filled] = ((zeros + np.uint64(1)) << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    return out


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of a set that is not empty."""
    filled, source = np.flatnonzero(registers), np.arange(REGISTERS)
    if len(filled) < REGISTERS:
        empty = np.flatnonzero(registers == 0)
        source[empty] = filled[_ORDER[empty][:, filled].argmin(axis=1)]
    held = source.astype(np.uint64) << np.uint64(16) | registers[source]
    with np.errstate(over="ignore"):
        return bw.mix((bw.mix(held) * _ODD).reshape(-1, ROWS).sum(axis=1, dtype=np.uint64))


_LOW = 2.0 ** -np.arange(1, 54)


def spread_of(n) -> np.ndarray:
    """For sets of n shingles, the chance that the least hash of a bucket has each number of leading zeros."""
    n = np.asarray(n, np.float64)[..., None]
    return (1 - _LOW / REGISTERS) ** n - (1 - 2 * _LOW / REGISTERS) ** n


def chance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Expected number of buckets in which two sets that share nothing have equal registers, by their spreads."""
    return REGISTERS * 2.0**-MANTISSA * (a * b).sum(axis=-1)


def matches(a: np.ndarray, b: np.ndarray, spread_a: np.ndarray, spread_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal registers of a and each of b, less those of chance, and the buckets that either fills."""
    either = (a != 0) | (b != 0)
    return ((a == b) & either).sum(axis=-1) - chance(spread_a, spread_b), either.sum(axis=-1)


def similarity(a: np.ndarray, b: np.ndarray, n: int, m: int) -> float:
    """The estimated Jaccard similarity of sets of n and m shingles."""
    same, of = matches(a, b, spread_of(n), spread_of(m))
    return float(np.clip(same / of, 0, 1)) if of else 0.0


def least_matches(percent: int, lost: float = LOST) -> np.ndarray:
    """For each number of filled buckets, how many equal ones a pair at the threshold has but for lost of the cases."""
    out, p = np.zeros(REGISTERS + 1, np.int64), percent / 100
    for n in range(1, REGISTERS + 1):
        total = 0.0
        for c in range(n + 1):
            total += math.comb(n, c) * p**c * (1 - p) ** (n - c)
            if total > lost:
                out[n] = c
                break
    return out


def link_sketches(ids: list[int], words: list[np.ndarray], percent: int, label: np.ndarray | None, least: np.ndarray) -> list[tuple[int, int]]:
    """Links that span the components of a block of sketches and sets; label marks what is already known to be connected."""
    registers, sets = np.stack([w[:SKETCH_WORDS].view(np.uint16) for w in words]), [w[SKETCH_WORDS:] for w in words]
    keys, count = np.stack([band_keys(r) for r in registers]), np.array([len(s) for s in sets], np.int64)
    spreads, lab = spread_of(count), np.arange(len(ids)) if label is None else label.copy()
    out = []
    for i in range(len(ids) - 1):
        js = i + 1 + np.flatnonzero(lab[i + 1 :] != lab[i])
        js = js[100 * np.minimum(count[js], count[i]) >= percent * np.maximum(count[js], count[i])]
        js = js[(keys[js] == keys[i]).any(axis=1)]
        if not len(js):
            continue
        same, of = matches(registers[i], registers[js], spreads[i], spreads[js])
        for j in js[same >= least[of] - 1].tolist():
            if lab[j] != lab[i] and nj.linked(sets[i], sets[j], percent):
                lab[lab == lab[j]] = lab[i]
                out.append((ids[i], ids[j]))
    return out


def _keys_of(sets: list[np.ndarray], first: dict) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """Registers and band keys of the first row of each node."""
    registers = {row: sketch(sets[row]) for row in first.values()}
    return registers, {row: band_keys(r) for row, r in registers.items()}


def _counted(keys: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - KEY_BITS)
    return np.unique(np.concatenate([k >> shift for k in keys.values()]), return_counts=True) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80, block_nodes: int = nj.BLOCK_NODES, block_sets: int = nj.BLOCK_SETS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs (doc_id, text); one document of each component is kept."""
    scratch = Scratch(docs.sparkSession)
    blocks = scratch.keep(pack_blocks(docs), "blocks")
    buckets, tasks = sizes(blocks)

    def asked(table):
        sets, _, first = nj.shingle_nodes(table, k)
        return [_counted(_keys_of(sets, first)[1])]

    def work(table: pa.Table, totals: dict) -> pa.Table:
        sets, nodes, first = nj.shingle_nodes(table, k)
        registers, keys = _keys_of(sets, first)
        known, found = _counted(keys)[0], totals.get(0, np.zeros(0, np.uint64))
        shared, held = [None] * len(sets), [None] * len(sets)
        for row, own in keys.items():
            several = found[np.searchsorted(known, own >> np.uint64(64 - KEY_BITS))] >= 2
            if several.any():
                shared[row] = own[several].view(np.int64)
                held[row] = registers[row].tobytes() + sets[row].tobytes()
        return nj.described(table, sets, nodes, shared, held)

    answers = answer(ask(blocks, asked, [KEY_BITS], buckets), tasks)
    rows = scratch.keep(told(blocks, answers, work, nj.DESCRIBED, tasks), "rows")
    scratch.drop("blocks")
    least = least_matches(percent)
    out = nj.components(rows, scratch, tasks, lambda ids, words, labels: link_sketches(ids, words, percent, labels, least), block_nodes, block_sets)
    return out.select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def sketches(docs: DataFrame, k: int = 4) -> DataFrame:
    """(doc_id, n_shingles, registers) of each row of docs (doc_id, text); registers are little-endian 16-bit numbers."""

    def rows(batches):
        for batch in batches:
            data, off = bw.text_buffer(batch["text"])
            for i, j in bw.row_slices(off):
                sets = list(bw.shingle_sets(data, off[i : j + 1], k))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s).tobytes() for s in sets], pa.binary())], names=["doc_id", "n_shingles", "registers"])

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).mapInArrow(rows, "doc_id long, n_shingles long, registers binary")
