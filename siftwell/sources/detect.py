"""Format detection on (uri, content, format_hint)."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEAD = 8192

#: fixed values: signatures of the head, and formats of extensions in order
MAGIC = (
    ("25504446", "pdf"),
    ("89504E470D0A1A0A", "image"),
    ("FFD8FF", "image"),
    ("474946383761", "image"),
    ("474946383961", "image"),
    ("49492A00", "image"),
    ("4D4D002A", "image"),
)
EXTENSIONS = (
    (".pdf", "pdf"), (".docx", "docx"), (".pptx", "pptx"), (".xlsx", "xlsx"), (".html", "html"), (".htm", "html"), (".md", "md"), (".markdown", "md"), (".txt", "txt"),
    (".png", "image"), (".jpg", "image"), (".jpeg", "image"), (".tiff", "image"), (".tif", "image"), (".webp", "image"), (".gif", "image"),
)
MEMBERS = (("word/", "docx"), ("ppt/", "pptx"), ("xl/", "xlsx"))
CANONICAL = {"pdf": ".pdf", "docx": ".docx", "pptx": ".pptx", "xlsx": ".xlsx", "html": ".html", "md": ".md", "txt": ".txt"}
MIMES = (("89504E47", "image/png"), ("FFD8FF", "image/jpeg"), ("47494638", "image/gif"), ("49492A00", "image/tiff"), ("4D4D002A", "image/tiff"))


def head(content: Column, n: int = HEAD) -> Column:
    return F.substring(content, 1, n)


def _begins(content: Column, prefix: str) -> Column:
    return F.startswith(content, F.unhex(F.lit(prefix)))


def extension_format(uri: Column) -> Column:
    """Format of the uri's extension, or null."""
    return F.coalesce(*[F.when(F.endswith(F.lower(uri), F.lit(ext)), F.lit(fmt)) for ext, fmt in EXTENSIONS])


def image_mime(content: Column) -> Column:
    webp = _begins(content, "52494646") & (F.substring(content, 9, 4) == F.unhex(F.lit("57454250")))
    return F.coalesce(*[F.when(_begins(content, m), F.lit(mime)) for m, mime in MIMES], F.when(webp, F.lit("image/webp")), F.lit("application/octet-stream"))


def looks_like_text(content: Column) -> Column:
    """UTF-8 without NUL; a character that the end of the head cuts off is forgiven."""
    h = head(content)
    no_nul = F.instr(F.decode(h, "ISO-8859-1"), "\x00") == 0
    return no_nul & _valid(h)


def _valid(h: Column) -> Column:
    whole = F.is_valid_utf8(h)
    shorter = F.is_valid_utf8(F.substring(h, F.lit(1), F.greatest(F.lit(0), F.length(h) - 4)))
    return whole | shorter


@F.arrow_udf(T.StringType())
def _office(content: pa.Array) -> pa.Array:
    out = []
    for value in content:
        found = None
        try:
            if value.is_valid:
                with zipfile.ZipFile(io.BytesIO(value.as_py())) as z:
                    names = z.namelist()
                found = next((fmt for prefix, fmt in MEMBERS if any(n.startswith(prefix) for n in names)), None)
        except (zipfile.BadZipFile, OSError):
            pass
        out.append(found)
    return pa.array(out, pa.string())


def detect_format(sources: DataFrame) -> DataFrame:
    """sources (uri, content, and format_hint if there is one) with format.

    Only contents that begin as a ZIP archive leave the JVM, to read its
    directory.  Each row is read once: a union of archives and others would make
    or load every content twice.
    """
    c, uri = F.col("content"), F.coalesce(F.col("uri"), F.lit(""))
    hint = F.col("format_hint") if "format_hint" in sources.columns else F.lit(None).cast("string")
    ext = extension_format(uri)
    h = head(c)
    start = F.lower(F.regexp_replace(F.decode(F.substring(h, 1, 1024), "ISO-8859-1"), r"\A[\s\x0b]+", ""))
    html = F.startswith(start, F.lit("<!doctype html")) | F.startswith(start, F.lit("<html"))
    webp = _begins(c, "52494646") & (F.substring(c, 9, 4) == F.unhex(F.lit("57454250")))
    by_magic = F.coalesce(*[F.when(_begins(c, m), F.lit(fmt)) for m, fmt in MAGIC], F.when(webp, F.lit("image")))
    zipped = _begins(c, "504B0304")
    native = F.coalesce(hint, by_magic, F.when(zipped, F.lit("zip")), F.when(html, F.lit("html")), ext, F.when(looks_like_text(c), F.lit("txt")), F.lit("unknown"))
    archive = F.col("format") == "zip"
    member = F.coalesce(_office(F.when(archive, c)), ext, F.lit("unknown"))
    return sources.withColumn("format", native).withColumn("format", F.when(archive, member).otherwise(F.col("format")))


def canonical_extension(fmt: Column, uri: Column) -> Column:
    """Of the detected format; of an image or unknown format, the uri's own."""
    known = F.coalesce(*[F.when(fmt == f, F.lit(ext)) for f, ext in CANONICAL.items()])
    return F.coalesce(known, F.lower(F.regexp_extract(F.coalesce(uri, F.lit("")), r"(\.[^./\\]+)\z", 1)))
