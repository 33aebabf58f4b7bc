"""LM scoring: a smoothed n-gram model as a weighted backoff automaton.

A state is a context; a seen continuation is an arc that weighs

    log10((c(h w) + mu p(w | shorter h)) / (c(h) + mu)),

and the failure arc to the shorter context weighs log10(mu / (c(h) + mu)), so
an unseen continuation costs its failure arcs and the arc where it is found.
The unigram state gives every token (c + 0.5) / (N + 0.5 (V + 1)), which leaves
an unknown token its share.  The model is a probability distribution over
tokens in every state.

Nothing of the model is pruned and none of it is broadcast: blocks of documents
ask for the corpus-wide counts of the n-grams that they hold, buckets of
n-grams answer, the higher orders one after the other, so that the requests of
one are gone before those of the next are made.  From the answers each block builds the states, arcs
and failure arcs that its texts can reach, and walks them once from left to
right: every text (a long one in lanes, which first read
the few tokens that fix their state) carries its state and adds up its
weights.  mu is the one of MUS that serves the training text best when each
token is left out of its own counts.

Defined results: null text is empty and is one token, the end; a null doc_id
counts as one to learn from; repeated rows are learnt and scored each; a text of
any length is scored whole, in memory proportional to it; equal sums of two mus
go to the smaller; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm import bytewords as bw
from siftwell.llm.shared import Scratch, answer, ask, pack_blocks, sizes, told

ORDER = 3
MUS = (1.0, 8.0, 64.0, 1024.0)
#: tokens that one text carries its state over before the next lane of it begins
LANE = 256
END = np.uint64(0x656E64206F662074)
BEGIN = np.uint64(0x626567696E6E6E67)
_A, _B = np.uint64(0x9E6C63D0876A9A47), np.uint64(0xC2B2AE3D27D4EB4F)


def learns(doc_ids: list, modulus: int, held: int) -> np.ndarray:
    return np.array([zlib.crc32(("" if x is None else str(x)).encode()) % modulus != held for x in doc_ids], bool)


class Stream:
    """The tokens of a block's documents in order, and their n-gram keys of each order."""

    def __init__(self, table: pa.Table, order: int, train: np.ndarray):
        data, off = bw.text_buffer(table["text"])
        parts, counts = [], []
        for i, j in bw.row_slices(off):
            w, first = bw.words(data, off[i : j + 1], bw.NOT_SPACE)
            parts.append(np.insert(w, first[1:], END))
            counts.append(np.diff(first) + 1)
        self.counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])[:-1].astype(np.int64)
        self.trains = np.repeat(train, self.counts)
        token = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.keys, key = [token], token
        for o in range(2, order + 1):
            with np.errstate(over="ignore"):
                key = bw.mix(self.before(key, BEGIN) * _A + token * _B + np.uint64(o))
            self.keys.append(key)

    def before(self, values: np.ndarray, at_start) -> np.ndarray:
        """The value one token earlier; at_start for a document's first token."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.first] = at_start
        return out

    def distinct(self, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct keys of an order, where each token's key is among them, training counts."""
        u, at = np.unique(self.keys[kind], return_inverse=True)
        return u, at, np.bincount(at, weights=self.trains, minlength=len(u)).astype(np.uint64)


def left_out(stream: Stream, counts: list[np.ndarray], n: float, v: float, mu: float, n_docs: float) -> np.ndarray:
    """log10 probability of each token by a model whose counts lack that one occurrence of it: what mu is chosen by."""
    p = (counts[0] + 0.5) / (n + 0.5 * (v + 1))
    for lower, own in zip(counts[:-1], counts[1:], strict=True):
        state = stream.before(lower, n_docs)
        p = (np.maximum(own - 1, 0) + mu * p) / (np.maximum(state - 1, 0) + mu)
    return np.log10(p)


class Automaton:
    """States, arcs and failure arcs of a backoff model, as far as some texts can reach them.

    State 0 is the empty context.  Every n-gram of these texts that training has
    seen is an arc, from its context by its last token, to the longest context
    that it ends in; every context that training has seen is a state, and fails
    to its suffix.  Weights have a column for each mu.
    """

    def __init__(self, stream: Stream, grams: list[tuple[np.ndarray, np.ndarray]], n: float, v: float, mus: tuple, n_docs: float):
        """grams: for each order, where each token's n-gram is among the distinct ones, and their counts in training."""
        order = len(grams)
        sizes = [len(total) for _, total in grams]
        # contexts of a document's start come last, one for each length
        offset = np.cumsum([1, *sizes[: order - 1]])
        self.begin = int(offset[-1])
        self.start = self.begin + order - 2 if order > 1 and n_docs > 0 else 0
        held = np.concatenate([[0.0], *[total for _, total in grams[: order - 1]], np.full(max(0, order - 1), n_docs)])
        self.fail_to = np.zeros(len(held), np.int64)
        self.fail = np.stack([np.log10(mu / (held + mu)) for mu in mus], axis=1)
        self.tokens = sizes[0]
        seen, opens = grams[0][1][grams[0][0]] > 0, np.zeros(len(grams[0][0]), bool)
        opens[stream.first] = True

        def state(length: int, at: np.ndarray) -> np.ndarray:
            """The state of the last so many tokens up to each place."""
            return offset[length - 1] + grams[length - 1][0][at] if length else np.zeros(len(at), np.int64)

        def context(length: int, at: np.ndarray) -> np.ndarray:
            """The state of the tokens before each place."""
            return np.where(opens[at], self.begin + length - 1, state(length, np.maximum(at - 1, 0)))

        for length in range(2, order):
            places = _places(grams[length - 1][0], sizes[length - 1])
            self.fail_to[offset[length - 1] + np.arange(sizes[length - 1])] = state(length - 1, places)
            self.fail_to[self.begin + length - 1] = self.begin + length - 2
        # the empty context has an arc for every token
        places = _places(grams[0][0], sizes[0])
        base = (grams[0][1] + 0.5) / (n + 0.5 * (v + 1))
        self.root = np.repeat(np.log10(base)[:, None], len(mus), axis=1)
        self.root_to = np.where(seen[places], state(min(1, order - 1), places), 0)
        self.code, self.weight, self.to = np.zeros(0, np.int64), np.zeros((0, len(mus))), np.zeros(0, np.int64)
        given = [base] * len(mus)  # of each n-gram of the order below, for each mu
        for length in range(1, order):
            at, total = grams[length]
            places = _places(at, sizes[length])
            source, below = context(length, places), grams[length - 1][0][places]
            c = held[source]
            given = [(total + mu * p[below]) / (c + mu) for mu, p in zip(mus, given, strict=True)]
            kept = np.flatnonzero(total > 0)
            code = source[kept] * self.tokens + grams[0][0][places[kept]]
            by = np.argsort(code)
            kept = kept[by]
            # contexts of one length are numbered one after the other, but for those of a start: arcs stay apart by length
            self.code = np.concatenate([self.code, code[by]])
            self.weight = np.concatenate([self.weight, np.stack([np.log10(p[kept]) for p in given], axis=1)])
            self.to = np.concatenate([self.to, state(min(length + 1, order - 1), places)[kept]])
        if order > 2:
            by = np.argsort(self.code, kind="stable")  # runs that are sorted already
            self.code, self.weight, self.to = self.code[by], self.weight[by], self.to[by]

    def read(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after one token of each text, and the weights of the arcs taken."""
        weight, after, todo = np.zeros((len(state), self.root.shape[1])), np.empty_like(state), np.arange(len(state))
        while len(todo):
            now, by = state[todo], token[todo]
            code = now * self.tokens + by
            at = np.minimum(np.searchsorted(self.code, code), max(0, len(self.code) - 1))
            found = (self.code[at] == code) & (now > 0) if len(self.code) else np.zeros(len(todo), bool)
            weight[todo[found]] += self.weight[at[found]]
            after[todo[found]] = self.to[at[found]]
            empty = now == 0
            weight[todo[empty]] += self.root[by[empty]]
            after[todo[empty]] = self.root_to[by[empty]]
            failing = ~found & ~empty
            todo = todo[failing]
            weight[todo] += self.fail[now[failing]]
            state = state.copy()
            state[todo] = self.fail_to[now[failing]]
        return after, weight

    def walk(self, tokens: np.ndarray, first: np.ndarray, counts: np.ndarray, order: int, lane: int = LANE) -> np.ndarray:
        """Weight of the path of each text (first token, number of tokens), from left to right, all texts side by side."""
        lanes = -(-counts // lane)
        of = np.repeat(np.arange(len(first)), lanes)
        begin = (np.arange(len(of)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * lane
        length = np.minimum(lane, counts[of] - begin)
        # a lane inside a text reads the tokens before it, which fix its state, without their weights
        warm = np.minimum(begin, order - 1)
        state = np.where(begin == 0, self.start, 0)
        at, steps = first[of] + begin - warm, length + warm
        by = np.argsort(-steps, kind="stable")
        of, state, at, steps, warm = of[by], state[by], at[by], steps[by], warm[by]
        total = np.zeros((len(of), self.root.shape[1]))
        alive = np.searchsorted(-steps, -np.arange(1, int(steps[0]) + 1 if len(steps) else 1), "right")
        for step, n in enumerate(alive.tolist()):
            state[:n], weight = self.read(state[:n], tokens[at[:n] + step])
            if step < order:
                weight[warm[:n] > step] = 0.0
            total[:n] += weight
        out = np.zeros((len(first), total.shape[1]))
        np.add.at(out, of, total)
        return out


def _places(at: np.ndarray, size: int) -> np.ndarray:
    """A place of each distinct n-gram."""
    out = np.zeros(size, np.int64)
    out[at] = np.arange(len(at))
    return out


def score(docs: DataFrame, order: int = ORDER, modulus: int = 5, held: int = 1, mus: tuple = MUS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, mu) of each row of docs."""
    scratch = Scratch(docs.sparkSession)
    blocks = scratch.keep(pack_blocks(docs), "blocks")
    buckets, tasks = sizes(blocks)
    answers, row = None, None
    for kinds in ((0, 1)[:order], *((kind,) for kind in range(2, order))):

        def extract(table, kinds=kinds):
            stream = Stream(table, kinds[-1] + 1, learns(table["doc_id"].to_pylist(), modulus, held))
            return [(u, c) for u, _, c in map(stream.distinct, kinds)]

        found = answer(ask(blocks, extract, [64] * len(kinds), buckets * (1 if kinds[0] == 0 else 2)), tasks)
        part = scratch.keep(found.withColumn("kind", F.col("kind") + kinds[0]), f"answers-{kinds[0]}")
        row = part.where("kind = 0").agg(F.sum("n_keys"), F.sum("n_tokens")).first() if row is None else row
        answers = part if answers is None else answers.unionByName(part)
    v, n = row[0] or 0, row[1] or 0

    def work(table: pa.Table, totals: dict) -> pa.Table:
        doc_ids = table["doc_id"].to_pylist()
        stream = Stream(table, order, learns(doc_ids, modulus, held))
        grams, found, n_docs = [], [], 0.0
        for kind in range(order):
            u, at, _ = stream.distinct(kind)
            total = totals.pop(kind).astype(np.float64)
            if kind == 0:
                n_docs = float(total[np.searchsorted(u, END)])
            grams.append((at, total))
            found.append(total[at])
        by_doc = lambda x: np.add.reduceat(x, stream.first)
        alone = np.stack([by_doc(left_out(stream, found, n, v, mu, n_docs) * stream.trains) for mu in mus], axis=1)
        known, base = by_doc((found[0] > 0).astype(np.int64)), by_doc(np.log10((found[0] + 0.5) / (n + 0.5 * (v + 1))))
        del found
        scores = Automaton(stream, grams, n, v, mus, n_docs).walk(grams[0][0], stream.first, stream.counts, order)
        lists = pa.list_(pa.float64())
        return pa.table({
            "doc_id": table["doc_id"], "held_out": pa.array(~learns(doc_ids, modulus, held)), "n_tokens": pa.array(stream.counts.astype(np.int64)), "n_known": pa.array(known),
            "base_score": pa.array(base), "scores": pa.array(list(scores), lists), "alone": pa.array(list(alone), lists),
        })

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, scores array<double>, alone array<double>"
    rows = scratch.keep(told(blocks, answers, work, schema, tasks), "rows")
    scratch.drop("blocks", "answers-0", *(f"answers-{kind}" for kind in range(2, order)))
    fit = rows.agg(*[F.sum(F.col("alone")[i]) for i in range(len(mus))]).first()
    best = max(range(len(mus)), key=lambda i: (fit[i] if fit[i] is not None else 0.0, -i))
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", F.col("scores")[best].alias("score"), F.lit(mus[best]).alias("mu"))
