"""Text functions on columns; all but the counts of whole batches stay in the JVM."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: letters, digits and _ of every script (Java's own \w leaves out or adds thousands of code points)
WORD = r"[\p{L}\p{N}_]+"
#: fixed value: the characters that count as white space
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once a row however often body's lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens(text: Column) -> Column:
    """Words of the lower-cased text, in order; none of null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def lowered(text: Column) -> Column:
    """What `split_words` takes: lower-cased as for `tokens`, empty for null."""
    return F.lower(F.coalesce(text, F.lit("")))


_ASCII_WORD = np.array([i < 128 and (chr(i).isalnum() or chr(i) == "_") for i in range(256)])


def _word_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 belong to a letter, a digit or _."""
    word = _ASCII_WORD[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead].astype(np.int32)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        code = first & (0x7F >> size)
        for k in range(1, 4):
            at = np.flatnonzero(size > k)
            code[at] = code[at] << 6 | data[np.minimum(lead[at] + k, len(data) - 1)] & 0x3F
        known, place = np.unique(code, return_inverse=True)
        good = np.array([c <= sys.maxunicode and unicodedata.category(chr(c))[0] in "LN" for c in known.tolist()])[place]
        for k in range(4):
            word[lead[good & (size > k)] + k] = True
    return word


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a batch of lowered texts, and the row of each: found by classes of bytes, since a regular expression took most of an index's time."""
    if not len(texts):
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    texts = texts.cast(pa.string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    word = _word_bytes(data)
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    # a row begins a word, whatever the row before ends with
    rows = ends[:-1][ends[:-1] < ends[1:]]
    begins[rows] = word[rows]
    row = np.searchsorted(ends, np.flatnonzero(begins), "right") - 1
    kept = data[word]
    places = np.append(np.flatnonzero(begins[word]), len(kept)).astype(np.int32)
    return pa.StringArray.from_buffers(len(row), pa.py_buffer(places), pa.py_buffer(kept)), row.astype(np.int64)


def counted(words: Column) -> Column:
    """Array of (term, tf) of an array of words, counted inside the row: runs of the sorted words."""

    def runs(s: Column) -> Column:
        first = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.element_at(s, i) != F.element_at(s, F.greatest(i - 1, F.lit(1)))))
        return let(first, lambda p: F.transform(p, lambda i, k: F.struct(F.element_at(s, i).alias("term"), (F.coalesce(F.get(p, k + 1), F.size(s) + 1) - i).alias("tf"))))

    none = F.array().cast("array<struct<term:string,tf:int>>")
    return let(F.sort_array(words), lambda s: F.when(F.size(s) == 0, none).otherwise(runs(s)))


def batch_counts(rows: np.ndarray, size: int, codes: np.ndarray, width: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Distinct codes (0 to width - 1) of the items of each of size rows, ascending: their codes, where each row's begin, and how often they occur."""
    width = max(1, width)
    key, n = np.unique(rows * width + codes, return_counts=True)
    starts = np.searchsorted(key, np.arange(size + 1, dtype=np.int64) * width)
    return key % width, pa.array(starts.astype(np.int32)), n


def ranked_codes(items: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct items in order, and the place of each item among them."""
    coded = items.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy(zero_copy_only=False).astype(np.int64)] = np.arange(len(order))
    return coded.dictionary.take(order), place[coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)]


def word_counts(text: Column) -> Column:
    """Struct (len, terms, tfs) of a text: the number of its words, the distinct ones in order, and how often each occurs; a batch of rows is counted at a time."""

    @F.arrow_udf("struct<len:int,terms:array<string>,tfs:array<int>>")
    def count(texts: pa.Array) -> pa.Array:
        words, row = split_words(texts)
        terms, codes = ranked_codes(words)
        kept, starts, n = batch_counts(row, len(texts), codes, len(terms))
        length = pa.array(np.bincount(row, minlength=len(texts)).astype(np.int32))
        return pa.StructArray.from_arrays([length, pa.ListArray.from_arrays(starts, terms.take(pa.array(kept))), pa.ListArray.from_arrays(starts, pa.array(n.astype(np.int32)))], ["len", "terms", "tfs"])

    return count(lowered(text))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def lstrip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{SPACE}+", "")


def is_blank(text: Column) -> Column:
    return text.rlike(rf"\A{SPACE}*\z")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    return let(F.struct(a.alias("a"), b.alias("b")), lambda x: F.when((F.size(x["a"]) == 0) | (F.size(x["b"]) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x["a"], x["b"])) / F.size(F.array_union(x["a"], x["b"]))))


def normalised(text: Column) -> Column:
    """Words joined by one space: what exact match compares."""
    return F.array_join(tokens(text), " ")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """0 if either vector is zero."""
    scale = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(scale == 0.0, F.lit(0.0)).otherwise(dot(a, b) / scale)


def data_url(mime: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))


def uuid5(name: Column, namespace: str) -> Column:
    """The name-based identifier (version 5) of a text in a namespace, itself an identifier."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    # the thirteenth digit is the version, the seventeenth has two fixed high bits
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12))
