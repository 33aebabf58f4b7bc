"""BPE encoding and decoding: speculate and verify.

Texts are cut into words by the byte-level pattern.  For every word not met
before, a greedy longest match over the vocabulary proposes tokens; a vectorised
check then tests every adjacent pair of all proposals at once against the pairs
that are known to be compatible (two tokens are, if merging their joined bytes
gives these two tokens back).  A proposal whose pairs are all compatible is the
exact encoding; only words with an incompatible pair undergo exact merging, by
a heap, in n log n for a word of n bytes.

The vocabulary is read from a tokenizer file whose path is a parameter; a file
that asks for more than byte-level BPE (a normaliser, another pattern, an
unknown token, added tokens with flags) is refused.  Special tokens of the file
are matched in texts before all else.  Each worker keeps a bounded memo of
words; nothing is shuffled or broadcast.

Defined results: null text is empty and has no tokens; decoding ids that are not
valid UTF-8 puts U+FFFD for them; unknown ids are an error; of merges of equal
rank the leftmost goes first; a text of any length is encoded whole, a word of n
bytes in n log n; repeated rows repeat their result; empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.shared import spread, trim

#: fixed value: the pattern that cuts byte-level vocabularies' words
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMO = 300_000
#: pairs of tokens whose compatibility a worker keeps, nine bytes each
PAIRS = 1 << 20
MEMO_BYTES = 64
PREFIX, SHORT = 4, (3, 2, 1)
SHORT_WORD = 48
NEVER = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def unmet(file: dict) -> list[str]:
    """What a tokenizer file asks for and Codec does not do."""
    model, before = file["model"], file.get("pre_tokenizer") or {}
    out = [k for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges", "dropout") if model.get(k)]
    out += [k for k in ("normalizer", "post_processor") if file.get(k)]
    out += ["model type"] if model.get("type") != "BPE" else []
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        out.append("pre_tokenizer")
    if (file.get("decoder") or {}).get("type") != "ByteLevel":
        out.append("decoder")
    out += [f"added token {x['content']!r}" for x in file.get("added_tokens", []) if x.get("single_word") or x.get("lstrip") or x.get("rstrip")]
    return out


class Codec:
    """A byte-level BPE vocabulary: encode words, decode ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        if lacking := unmet(file):
            raise ValueError(f"{path} needs {', '.join(lacking)}")
        letters = byte_alphabet()
        self.bytes_of = {i: bytes(letters[c] for c in s) for s, i in file["model"]["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in file.get("added_tokens", [])}
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        merges = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
        vocab = file["model"]["vocab"]
        self.id_of = {b: i for i, b in self.bytes_of.items() if i not in set(self.special.values())}
        lengths: dict[bytes, set[int]] = {}
        for token in self.id_of:
            if len(token) >= PREFIX:
                lengths.setdefault(token[:PREFIX], set()).add(len(token))
        self.lengths = {p: (*sorted(x, reverse=True), *SHORT) for p, x in lengths.items()}
        self.single = [self.id_of[bytes([b])] for b in range(256)]
        self.size = max(self.bytes_of) + 1
        self.rank = {vocab[a] * self.size + vocab[b]: r for r, (a, b) in enumerate(merges)}
        self.merged = [vocab[a + b] for a, b in merges]
        self.words = regex.compile(PATTERN)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known = np.zeros(0, np.int64)
        self.fits = np.zeros(0, bool)
        self.memo: dict[str, tuple[int, ...]] = {}
        self.table = [self.bytes_of.get(i) for i in range(self.size)]
        self.text = [str(i) for i in range(self.size)]
        self.failed = self.proposed = 0

    # --- words -----------------------------------------------------------------------------------------------------

    def greedy(self, word: bytes) -> list[int]:
        """Longest match from the left; only lengths that some token with these first bytes has are tried."""
        out, i, n, ids, lengths = [], 0, len(word), self.id_of, self.lengths
        while i < n:
            for size in lengths.get(word[i : i + PREFIX], SHORT):
                if (t := ids.get(word[i : i + size])) is not None and i + size <= n:
                    out.append(t)
                    i += size
                    break
        return out

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Exact: the lowest-ranked, then leftmost, pair is merged until none is left."""
        return self._merge_short(word) if len(word) <= SHORT_WORD else self._merge_long(word)

    def _merge_short(self, word: bytes) -> tuple[int, ...]:
        tokens, size, rank = [self.single[b] for b in word], self.size, self.rank
        ranks = [rank.get(a * size + b, NEVER) for a, b in zip(tokens, tokens[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            i = ranks.index(best)
            tokens[i : i + 2] = [self.merged[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get(tokens[i - 1] * size + tokens[i], NEVER)
            if i < len(ranks):
                ranks[i] = rank.get(tokens[i] * size + tokens[i + 1], NEVER)
        return tuple(tokens)

    def _merge_long(self, word: bytes) -> tuple[int, ...]:
        tokens, size, rank = [self.single[b] for b in word], self.size, self.rank
        n = len(tokens)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, tokens[i], tokens[i + 1]) for i in range(n - 1) if (r := rank.get(tokens[i] * size + tokens[i + 1], NEVER)) != NEVER]
        heapq.heapify(heap)
        while heap:
            best, i, left, right = heapq.heappop(heap)
            j = after[i]
            if j >= n or tokens[i] != left or tokens[j] != right:
                continue
            tokens[i], tokens[j] = self.merged[best], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := rank.get(tokens[a] * size + tokens[b], NEVER)) != NEVER:
                    heapq.heappush(heap, (r, a, tokens[a], tokens[b]))
        return tuple(t for t in tokens if t >= 0)

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each pair of tokens, whether merging their joined bytes gives them back."""
        code = left * self.size + right
        if len(self.known) > PAIRS:
            self.known, self.fits = self.known[:0], self.fits[:0]
        new = np.setdiff1d(code, self.known)
        if len(new):
            fits = [self.merge(self.table[c // self.size] + self.table[c % self.size]) == (c // self.size, c % self.size) for c in new.tolist()]
            at = np.searchsorted(self.known, new)
            self.known, self.fits = np.insert(self.known, at, new), np.insert(self.fits, at, np.array(fits, bool))
        return self.fits[np.searchsorted(self.known, code)]

    def learn(self, words: list[str]) -> None:
        """Memo entries of new words: propose for all, verify all pairs at once, merge the words that fail."""
        if not words:
            return
        raw = [w.encode() for w in words]
        proposals = [self.greedy(b) for b in raw]
        flat = np.fromiter(chain.from_iterable(proposals), np.int64)
        cuts = np.cumsum([0, *map(len, proposals)])
        if len(flat) > 1:
            inside = np.ones(len(flat) - 1, bool)
            inside[cuts[1:-1] - 1] = False
            bad = np.flatnonzero(inside)
            bad = bad[~self.compatible(flat[bad], flat[bad + 1])]
            for k in np.unique(np.searchsorted(cuts, bad, "right") - 1).tolist():
                proposals[k] = self.merge(raw[k])
                self.failed += 1
        self.proposed += len(words)
        self.memo.update(zip(words, map(tuple, proposals), strict=True))

    # --- texts -----------------------------------------------------------------------------------------------------

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text; a few megabytes of text at a time is the caller's concern."""
        cut = [self._cut(t) for t in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        new = set(chain.from_iterable(words for parts in cut for words, _ in parts)).difference(self.memo)
        self.learn(list(new))
        memo, out = self.memo, []
        for parts in cut:
            ids: list[int] = []
            for words, special in parts:
                ids.extend(chain.from_iterable(map(memo.__getitem__, words)))
                if special is not None:
                    ids.append(special)
            out.append(ids)
        for w in [w for w in new if len(w) > MEMO_BYTES]:
            del memo[w]
        return out

    def _cut(self, text: str) -> list[tuple[list[str], int | None]]:
        if not self.special or not any(s in text for s in self.special):
            return [(self.words.findall(text), None)]
        parts = self.specials.split(text)
        return [(self.words.findall(p), self.special[parts[k + 1]] if k + 1 < len(parts) else None) for k, p in enumerate(parts) if k % 2 == 0]

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec a worker."""
    return Codec(path)


TEXTS = 1 << 20


def _batches(batch: pa.RecordBatch):
    """Texts of a batch, about a megabyte at a time."""
    held, size = [], 0
    for text in batch["text"]:
        held.append(text.as_py() or "")
        size += len(held[-1])
        if size >= TEXTS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _texts(docs: DataFrame) -> DataFrame:
    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of each row of docs (doc_id, text)."""

    def run(batches):
        c = codec(path)
        for batch in batches:
            ids = [x for texts in _batches(batch) for x in c.encode_batch(texts)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids are none."""

    def run(batches):
        c = codec(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([c.decode(x or []) for x in batch["ids"].to_pylist()], pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes each text and decodes its ids, in one pass."""

    def run(batches):
        c = codec(path)
        for batch in batches:
            n, ids_hash, text_hash = [], [], []
            for texts in _batches(batch):
                for ids in c.encode_batch(texts):
                    n.append(len(ids))
                    ids_hash.append(hashlib.sha256(",".join(map(c.text.__getitem__, ids)).encode()).hexdigest())
                    text_hash.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            trim()
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        c.memo.clear()  # an idle worker keeps the vocabulary alone
        trim()

    return _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
