"""Fill-in-the-middle transformation of texts.

A text is a UTF-32 array of code points.  Neighbouring classes are compared, so
that flatnonzero gives the boundaries of its units (code points, words or
lines); two boundaries are chosen by rank, and the three pieces between them are
sliced, encoded again and put in the order of a form:

* psm: <P>prefix<S>suffix<M>middle
* spm: <S>suffix<P>prefix<M>middle
* plain: the text as it is

What is drawn depends on the seed and the doc_id alone, so a lost task makes the
same rows again.  `restored` rebuilds a text from its output and form.

Defined results: null text is empty; an empty text, and one that holds a marker,
is plain and has null prefix_chars and middle_chars; a text of one unit has
pieces that may be empty; a text of any length is cut whole, in memory
proportional to it; a null doc_id draws as an empty one does; rows of one doc_id
draw alike, so repeated rows repeat their result; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm import bytewords as bw
from siftwell.llm.shared import spread

MARKS = ("<P>", "<S>", "<M>")
UNITS = ("chars", "words", "lines")
_SPACES = np.array([0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20], np.uint32)


def classes(points: np.ndarray, units: str) -> np.ndarray:
    """A number for each code point; a unit is a run of equal ones."""
    if units == "chars":
        return np.arange(len(points))
    if units == "lines":  # a line ends with its line feed
        return np.cumsum(points == 0x0A) - (points == 0x0A)
    # white space, letters and digits (all beyond ASCII among them), and the rest
    word = (points > 0x7F) | ((points >= 0x30) & (points <= 0x39)) | (((points | 0x20) >= 0x61) & ((points | 0x20) <= 0x7A))
    return np.where(np.isin(points, _SPACES), 0, np.where(word, 1, 2))


def boundaries(points: np.ndarray, units: str) -> np.ndarray:
    """Where units begin, and the end of the last: one more than there are units."""
    kinds = classes(points, units)
    inner = np.flatnonzero(kinds[1:] != kinds[:-1]) + 1
    return np.concatenate([[0], inner, [len(points)]]) if len(points) else np.zeros(1, np.int64)


def cut(text: str, units: str, first: int, second: int) -> tuple[int, list[str]]:
    """The number of units n, and the pieces between the boundaries of rank first and second modulo n + 1."""
    raw = text.encode("utf-32-le")
    at = boundaries(np.frombuffer(raw, "<u4"), units)
    low, high = sorted((first % len(at), second % len(at)))
    ends = [0, int(at[low]), int(at[high]), len(raw) // 4]
    return len(at) - 1, [raw[4 * a : 4 * b].decode("utf-32-le") for a, b in zip(ends, ends[1:], strict=False)]


def transformed(docs: DataFrame, units: str = "chars", seed: int = 1, percent: int = 90, spm_percent: int = 20, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each row of docs (doc_id, text).

    n counts units.  percent of the texts are cut, and spm_percent of those take
    the form spm.
    """
    if units not in UNITS:
        raise ValueError(f"units are {', '.join(UNITS)}, not {units!r}")
    p, s, m = marks

    def rows(batches):
        for batch in batches:
            _, off = bw.text_buffer(batch["text"])
            for i, j in bw.row_slices(off):
                yield each(batch.slice(i, j - i))

    def each(batch):
        out = {k: [] for k in ("n", "form", "prefix_chars", "middle_chars", "output")}
        for text, *drawn in zip(*(batch[c].to_pylist() for c in ("text", "h1", "h2", "h3", "h4")), strict=True):
            n, (prefix, middle, suffix) = cut(text, units, *drawn[:2])
            if not text or drawn[2] % 100 >= percent or any(mark in text for mark in marks):
                row = (n, "plain", None, None, text)
            elif drawn[3] % 100 < spm_percent:
                row = (n, "spm", len(prefix), len(middle), f"{s}{suffix}{p}{prefix}{m}{middle}")
            else:
                row = (n, "psm", len(prefix), len(middle), f"{p}{prefix}{s}{suffix}{m}{middle}")
            for column, value in zip(out.values(), row, strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([batch["doc_id"], *map(pa.array, out.values(), kinds)], names=["doc_id", *out])

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    texts = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    return texts.select("*", *draws).mapInArrow(rows, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output of a form was made from."""
    parts = F.split(output, "|".join(map(re.escape, marks)), -1)
    piece = lambda *at: F.concat(*[F.get(parts, F.lit(k)) for k in at])
    return F.when(form == "psm", piece(1, 3, 2)).when(form == "spm", piece(2, 3, 1)).otherwise(output)
