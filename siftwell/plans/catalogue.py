"""Registered queries of the operators and, where SQL can express them, their oracle.

Every query runs over its whole tables and whole texts: searches ask every
benchmark item, and searches by vector every one whose id is divisible by 100.
The oracle builds its inputs from the same tables: pages and windows by
recursion, searches by aggregation.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import text as tx
from siftwell.operators import chunking, encode, enrich, generate, index, metrics, refine, retrieve, search
from siftwell.operators.filters import matching
from siftwell.operators.store import latest, stored
from siftwell.plans import files, pipeline, trials
from siftwell.plans.space import SearchSpace, choice
from siftwell.sources import blobs, detect, html, ocr, pages, parsers, pdf
from siftwell.sources.folders import shared_folder

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"


def tok(column: str) -> str:
    return TOK.format(column)


def query(sql: str | None = None):
    """Registers a query under its name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; a file of one row group is dealt out, since its scan is one task."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    files = len(df.inputFiles())
    return df if files >= cores else df.repartition(cores)


# --- derived inputs, as DataFrames ------------------------------------------------------------------------------------


def _documents(spark, sf_dir) -> DataFrame:
    """Assembled plain texts with their language and source as metadata."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("metadata"))
    return pages.assembled(docs)


def _chunks(spark, sf_dir, size=1600, overlap=200) -> DataFrame:
    return chunking.FixedChunker(chunk_chars=size, overlap_chars=overlap).chunk(_documents(spark, sf_dir))


def _markdown(spark, sf_dir) -> DataFrame:
    """Texts of which every fifth line is a heading after an empty line."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 5 == 0, F.concat(F.lit("\n## "), x)).otherwise(x))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("markdown"))


def _questions(spark, sf_dir) -> DataFrame:
    """Every benchmark item with its whole text."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


_CORPORA: dict[tuple[str, str], index.Corpus] = {}


def corpus(spark, sf_dir) -> index.Corpus:
    """The chunks of all documents and their lexical index, made once a session and read by every search."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CORPORA:
        made = index.Corpus(index.TableStore(spark, f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"), [index.LexicalRepresentation()])
        made.add(_chunks(spark, sf_dir))
        _CORPORA[key] = made
    return _CORPORA[key]


def _bm25(spark, sf_dir, k=10, b=0.75, filters=None) -> DataFrame:
    """BM25 of every item from the stored index."""
    return index.LexicalRepresentation(lexical=corpus(spark, sf_dir).representation("lexical").index, b=b).search(corpus(spark, sf_dir), _questions(spark, sf_dir), k, filters)


def _shown(rankings: DataFrame) -> DataFrame:
    return rankings.select("qid", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


# --- derived inputs, as SQL -----------------------------------------------------------------------------------------------

_NL = "chr(10)"
PAGES_SQL = f"""
  pg(doc_id, number, md, rest) AS (
    SELECT doc_id, 0, '', text FROM documents
    UNION ALL
    SELECT doc_id, number + 1, left(rest, cut), substr(rest, cut + 1) FROM (
      SELECT *, CASE WHEN length(rest) < 8000 THEN length(rest) WHEN strpos(reverse(left(rest, 8000)), {_NL}) > 0 THEN 8001 - strpos(reverse(left(rest, 8000)), {_NL}) ELSE 8000 END AS cut
      FROM pg WHERE length(rest) >= 8000 OR regexp_matches(rest, '\\S'))),
  page AS (SELECT doc_id, number, md, coalesce(sum(length(md) + 2) OVER (PARTITION BY doc_id ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS p_start FROM pg WHERE number > 0),
  doc AS (SELECT d.doc_id, coalesce(m.markdown, '') AS markdown, d.lang FROM documents d LEFT JOIN (SELECT doc_id, string_agg(md, {_NL} || {_NL} ORDER BY number) AS markdown FROM page GROUP BY doc_id) m USING (doc_id))"""
MD_SQL = f"""
  doc AS (SELECT doc_id, array_to_string(list_transform(string_split(text, {_NL}), lambda x, i: CASE WHEN (i - 1) % 5 = 0 THEN {_NL} || '## ' || x ELSE x END), {_NL}) AS markdown FROM documents)"""


def spans_sql(name: str, source: str, size: int, overlap: int) -> str:
    """Windows of source(doc_id, part, lo, hi, markdown): name(doc_id, part, pos, s, e)."""
    half, rest = size // 2, size - size // 2
    window = f"substr(markdown, s1 + {half} + 1, {rest})"
    return f"""
  {name}_w(doc_id, part, lo, hi, markdown, pos, s, e) AS (
    SELECT doc_id, part, lo, hi, markdown, -1, lo, lo FROM {source} WHERE hi > lo
    UNION ALL
    SELECT doc_id, part, lo, hi, markdown, pos + 1, s1, CASE
      WHEN s1 + {size} >= hi THEN hi
      WHEN strpos(reverse({window}), {_NL} || {_NL}) > 0 THEN s1 + {size} + 1 - strpos(reverse({window}), {_NL} || {_NL})
      WHEN strpos(reverse({window}), {_NL}) > 0 THEN s1 + {size} + 1 - strpos(reverse({window}), {_NL})
      ELSE s1 + {size} END
    FROM (SELECT *, CASE WHEN pos = -1 THEN lo WHEN e - {overlap} > s THEN e - {overlap} ELSE e END AS s1 FROM {name}_w WHERE pos = -1 OR e < hi)),
  {name} AS (SELECT doc_id, part, pos, s, e, substr(markdown, s + 1, e - s) AS text FROM {name}_w WHERE pos >= 0)"""


def chunks_sql(size: int = 1600, overlap: int = 200, base: str = PAGES_SQL) -> str:
    """CTEs up to chunk(id, doc_id, idx, s, e, text)."""
    return f"""WITH RECURSIVE {base},
  whole AS (SELECT doc_id, 0 AS part, 0 AS lo, length(markdown) AS hi, markdown FROM doc),
  {spans_sql('span', 'whole', size, overlap)},
  chunk AS (SELECT doc_id || ':' || idx AS id, doc_id, idx, s, e, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY part, pos) - 1 AS idx FROM span WHERE regexp_matches(text, '\\S')))"""


def bm25_sql(name: str, b: float = 0.75, where: str = "", k: int = 10, asked: str = "SELECT item_id AS qid, text FROM benchmark") -> str:
    """CTEs up to name(qid, chunk_id, score, rank) over chunk."""
    return f"""
  {name}_q AS ({asked}),
  {name}_w AS (SELECT id, doc_id, {tok('text')} AS t FROM chunk),
  {name}_s AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS a FROM {name}_w),
  {name}_t AS (SELECT DISTINCT qid, unnest({tok('text')}) AS term FROM {name}_q),
  {name}_f AS (SELECT id, doc_id, term, l, count(*) AS c FROM (SELECT id, doc_id, len(t) AS l, unnest(t) AS term FROM {name}_w) WHERE term IN (SELECT term FROM {name}_t) GROUP BY ALL),
  {name}_d AS (SELECT term, count(*) AS d FROM {name}_f GROUP BY term),
  {name}_p AS (
    SELECT qid, id AS chunk_id, sum(ln(1 + (n - d + 0.5) / (d + 0.5)) * c * 2.5 / (c + 1.5 * ({1 - b} + {b} * l / a))) AS score
    FROM {name}_f JOIN {name}_d USING (term) JOIN {name}_t USING (term), {name}_s {where} GROUP BY qid, id),
  {name} AS (SELECT * FROM (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id DESC) AS rank FROM {name}_p) WHERE rank <= {k})"""


SHOWN = "SELECT qid, chunk_id, round(score, 6) AS score, rank FROM {}"


def rrf_sql(name: str, parts: list[tuple[str, float]], k: int = 10) -> str:
    union = " UNION ALL ".join(f"SELECT qid, chunk_id, {w} / (60.0 + rank) AS part FROM {r}" for r, w in parts)
    return f"""
  {name}_u AS ({union}),
  {name}_p AS (SELECT qid, chunk_id, sum(part) AS score FROM {name}_u GROUP BY ALL),
  {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id DESC) AS rank FROM {name}_p) WHERE rank <= {k})"""


# --- sources ------------------------------------------------------------------------------------------------------------


@query("SELECT page_id, sha256(html) AS doc_hash, length(url)::BIGINT AS uri_chars FROM pages")
def content_hash(spark, sf_dir):
    df = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("uri"), F.col("html").cast("binary").alias("content"))
    return blobs.with_doc_id(df).select("page_id", F.col("doc_id").alias("doc_hash"), F.length("uri").cast("long").alias("uri_chars"))


@query("SELECT page_id, hex(encode(left(html, 16))) AS head FROM pages")
def head_bytes(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.hex(detect.head(F.col("html").cast("binary"), 16)).alias("head"))


def _zip(member: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(member, "x")
    return out.getvalue()


#: (file name's end, hint, first bytes, detected format, canonical extension) of made-up files; None takes the page itself
_KINDS = (
    (".html", None, None, "html", ".html"), (".bin", None, b"%PDF-1.7", "pdf", ".pdf"), (".txt", None, b"GIF89a", "image", ".txt"), (".md", None, b"plain", "md", ".md"), ("", None, b"plain", "txt", ".txt"),
    (".PNG", None, b"plain", "image", ".png"), (".xyz", None, b"  <HTML>", "html", ".html"), (".dat", None, bytes.fromhex("89504E470D0A1A0A"), "image", ".dat"), (".dat", None, bytes.fromhex("FFD8FF"), "image", ".dat"),
    (".tif", None, bytes.fromhex("49492A00"), "image", ".tif"), (".dat", None, b"RIFF0000WEBP", "image", ".dat"), (".dat", "md", b"%PDF-1.7", "md", ".md"), (".dat", None, b"\x00\xff", "unknown", ".dat"),
)
#: archives stand alone: nothing may follow their directory
_ARCHIVES = (("word/document.xml", "docx", ".docx"), ("ppt/x", "pptx", ".pptx"), ("xl/x", "xlsx", ".xlsx"), ("other", "unknown", ".zip"))
_DETECTED = ", ".join(f"({k}, '{fmt}', '{ext}')" for k, (fmt, ext) in enumerate([*(x[3:] for x in _KINDS), *(x[1:] for x in _ARCHIVES)]))


@query(f"SELECT page_id, kind::BIGINT AS kind, format, extension FROM pages, (VALUES {_DETECTED}) k(kind, format, extension)")
def detect_format(spark, sf_dir):
    """Every page as files of all kinds: by hint, signature, archive member, markup, name and text."""
    rows = [(k, ext, hint, None if head is None else bytearray(head), False) for k, (ext, hint, head, *_) in enumerate(_KINDS)]
    rows += [(len(_KINDS) + k, ".zip", None, bytearray(_zip(member)), True) for k, (member, *_) in enumerate(_ARCHIVES)]
    kinds = spark.createDataFrame(rows, "kind long, end string, format_hint string, head binary, alone boolean")
    files = table(spark, sf_dir, "pages").crossJoin(F.broadcast(kinds))
    tail = F.when(F.col("alone"), F.lit("")).otherwise(F.concat(F.lit("\n"), "page_id")).cast("binary")
    files = files.select("page_id", "kind", F.concat(F.lit("file"), "end").alias("uri"), "format_hint", F.when(F.col("head").isNull(), F.col("html").cast("binary")).otherwise(F.concat("head", tail)).alias("content"))
    return detect.detect_format(files).select("page_id", "kind", "format", detect.canonical_extension(F.col("format"), F.col("uri")).alias("extension"))


@query(f"WITH RECURSIVE {PAGES_SQL} SELECT doc_id, number::BIGINT AS number, length(md)::BIGINT AS n_chars, sha256(md) AS page_hash FROM page")
def plain_text_pages(spark, sf_dir):
    p = pages.plain_text_pages(table(spark, sf_dir, "documents"))
    return p.select("doc_id", F.col("number").cast("long").alias("number"), F.length("markdown").cast("long").alias("n_chars"), F.sha2("markdown", 256).alias("page_hash"))


_ASSEMBLED = f"""WITH RECURSIVE {PAGES_SQL}
SELECT doc_id, count(*)::BIGINT AS page_count, sha256(any_value(markdown)) AS markdown_hash, string_agg(p_start || '-' || (p_start + length(md)), ',' ORDER BY number) AS spans
FROM page JOIN doc USING (doc_id) GROUP BY doc_id"""


def _spans_text(df: DataFrame) -> DataFrame:
    spans = F.array_join(F.transform("page_spans", lambda p: F.concat(p["start"].cast("string"), F.lit("-"), p["end"].cast("string"))), ",")
    return df.where("page_count > 0").select("doc_id", F.col("page_count").cast("long").alias("page_count"), F.sha2("markdown", 256).alias("markdown_hash"), spans.alias("spans"))


@query(_ASSEMBLED)
def page_assembly(spark, sf_dir):
    return _spans_text(pages.assembled(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query(_ASSEMBLED)
def page_assembly_from_rows(spark, sf_dir):
    return _spans_text(pages.assemble(pages.plain_text_pages(table(spark, sf_dir, "documents"))))


@query(f"""
WITH lines AS (SELECT doc_id, unnest(string_split(text, {_NL})) AS line, generate_subscripts(string_split(text, {_NL}), 1) AS page FROM documents),
kinds AS (SELECT doc_id, page, CASE WHEN length(line) < 32 THEN 'ocr' ELSE 'text' END AS kind FROM lines),
islands AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) - row_number() OVER (PARTITION BY doc_id, kind ORDER BY page) AS island FROM kinds)
SELECT doc_id, kind, min(page)::BIGINT AS first_page, max(page)::BIGINT AS last_page FROM islands GROUP BY doc_id, kind, island""")
def ocr_segment_plan(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    plan = ocr.segment_plan(lines.select("doc_id", (F.col("p") + 1).alias("page"), F.length("line").alias("chars")))
    return plan.select("doc_id", "kind", F.col("start").cast("long").alias("first_page"), F.col("end").cast("long").alias("last_page"))


@query(f"""
WITH n AS (SELECT doc_id, len(string_split(text, {_NL})) AS pages FROM documents)
SELECT doc_id, unnest(range(1, pages + 1, 8))::BIGINT AS first_page, least(unnest(range(1, pages + 1, 8)) + 7, pages)::BIGINT AS last_page FROM n""")
def page_windows(spark, sf_dir):
    n = table(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("pages"))
    return n.select("doc_id", F.explode(ocr.page_windows(F.col("pages"))).alias("w")).select("doc_id", F.col("w.start").cast("long").alias("first_page"), F.col("w.end").cast("long").alias("last_page"))


@query()
def html_to_markdown(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.html_markdown(F.col("html")).alias("markdown"))


@query("SELECT page_id, 'data:text/html;base64,' || base64(encode(html)) AS url FROM pages")
def data_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(tx.data_url(F.lit("text/html"), F.col("html").cast("binary")), r"\s", "").alias("url"))


@query("SELECT sha256(text) AS doc_id, 'doc-' || min(doc_id) || '.txt' AS source_uri FROM documents GROUP BY 1")
def catalog_first_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("doc_id"), F.concat(F.lit("doc-"), "doc_id", F.lit(".txt")).alias("source_uri"), F.col("doc_id").alias("seq"))
    return blobs.first_wins(rows, "doc_id").select("doc_id", "source_uri")


@query("SELECT DISTINCT sha256(text) AS doc_hash FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)")
def raw_capture_missing(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("doc_hash"), "doc_id")
    return blobs.missing(rows.select("doc_hash").distinct(), rows.where("doc_id % 3 = 0"), ["doc_hash"])


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def upsert_latest(spark, sf_dir):
    return index.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@query("""
WITH now AS (SELECT DISTINCT sha256(text) AS text_hash FROM documents), old AS (SELECT DISTINCT sha256(text) AS text_hash FROM documents WHERE lang = 'en')
SELECT text_hash, text_hash IN (SELECT text_hash FROM old) AS hit FROM now""")
def embedding_cache_hits(spark, sf_dir):
    cache = encode.EmbeddingCache(encode.HashingEmbedder(dimensions=8), f"{shared_folder(spark)}/embeddings-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents").select("text", "lang")
    cache.embed(docs.where("lang = 'en'"))
    before = cache.stored(spark, "passages").select("text_hash").withColumn("hit", F.lit(True))
    found = before.join(docs.select(F.sha2("text", 256).alias("text_hash")).distinct(), "text_hash", "right")
    return found.select("text_hash", F.coalesce("hit", F.lit(False)).alias("hit"))


@query("SELECT conv_id, turn, sha256('judge' || chr(0) || role || chr(0) || text) AS key FROM conversations")
def judge_cache_key(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("question"), F.col("text").alias("answer"))
    return asked.select("conv_id", "turn", metrics.judge_key("judge").alias("key"))


@query("""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 3 WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS version, text, lang FROM documents)
SELECT doc_id::VARCHAR AS id, 'v' || version || ' ' || text AS text, (CASE WHEN doc_id % 5 = 0 THEN -1 ELSE version END)::DOUBLE AS first FROM d""")
def store_upserts(spark, sf_dir):
    """Chunks written three times, the last time by a store that was opened again, and a refreshed space."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path, spec = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", index.VectorSpec("v", "dense", 2)

    def version(n, rows):
        chunk = rows.select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit(f"v{n} "), "text").alias("text"), F.lit(0).alias("index"))
        return chunk.withColumn("vector", F.array(F.lit(float(n)), F.lit(1.0)))

    store = index.TableStore(spark, path)
    store.ensure_schema([spec])
    store.upsert(version(1, docs), {"v": "vector"})
    store.upsert(version(2, docs.where("doc_id % 3 = 0")), {"v": "vector"})
    store = index.TableStore(spark, path)
    store.upsert(version(3, docs.where("doc_id % 7 = 0")), {"v": "vector"})
    store.update_vectors("v", docs.where("doc_id % 5 = 0").select(F.col("doc_id").cast("string").alias("id"), F.array(F.lit(-1.0), F.lit(0.0)).alias("vector")))
    return store.chunks().join(store.space("v"), "id").select("id", "text", F.col("vector")[0].alias("first"))


@query(f"{chunks_sql()} SELECT id, lang FROM chunk JOIN doc USING (doc_id) WHERE lang = 'de' ORDER BY doc_id::VARCHAR, idx, id LIMIT 50")
def store_fetch(spark, sf_dir):
    return corpus(spark, sf_dir).fetch({"lang": "de"}, 50).select("id", F.col("metadata")["lang"].alias("lang"))


@query("""
WITH n AS (SELECT doc_id, len(string_split(text, chr(10))) AS pages FROM documents)
SELECT policy, doc_id, kind, 1::BIGINT AS first_page, pages::BIGINT AS last_page FROM n, (VALUES ('force', 'ocr'), ('never', 'text'), ('no engine', 'text')) p(policy, kind)""")
def ocr_policies(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).select("doc_id", (F.col("p") + 1).alias("page"), F.length("line").alias("chars"))
    ways = (("force", ocr.OcrPolicy.FORCE, True), ("never", ocr.OcrPolicy.NEVER, True), ("no engine", ocr.OcrPolicy.AUTO, False))
    plans = [ocr.segment_plan(lines, policy=policy, engine=engine).withColumn("policy", F.lit(name)) for name, policy, engine in ways]
    return reduce(DataFrame.unionByName, plans).select("policy", "doc_id", "kind", F.col("start").cast("long").alias("first_page"), F.col("end").cast("long").alias("last_page"))


def _files(spark, sf_dir) -> DataFrame:
    """Documents as files, every second one markdown."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d-"), "doc_id", F.when(F.col("doc_id") % 2 == 0, ".md").otherwise(".txt")).alias("uri"), F.col("text").cast("binary").alias("content"))
    return docs.withColumn("doc_id", F.col("uri"))


def _web(spark, sf_dir) -> DataFrame:
    """Documents as web pages of a heading and a paragraph or an item for each line, without a name that tells what they are."""
    low = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.transform(F.split(low, "\n"), lambda x, i: F.when(i == 0, F.concat(F.lit("<h2>"), x, F.lit("</h2>"))).when(i % 2 == 0, F.concat(F.lit("<p>"), x, F.lit("</p>"))).otherwise(F.concat(F.lit("<li>"), x, F.lit("</li>"))))
    page = F.concat(F.lit("<!DOCTYPE html><html><head><title>t</title><script>var x = 1;</script></head><body><nav>menu</nav>"), F.array_join(lines, ""), F.lit("</body></html>"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("w-"), "doc_id").alias("uri"), page.cast("binary").alias("content"))


@query(f"""WITH RECURSIVE {PAGES_SQL}
SELECT 'd-' || d.doc_id || CASE WHEN d.doc_id % 2 = 0 THEN '.md' ELSE '.txt' END AS doc_id, count(p.number)::BIGINT AS page_count, sha256(any_value(d.markdown)) AS markdown_hash FROM doc d LEFT JOIN page p USING (doc_id) GROUP BY d.doc_id""")
def parse_auto(spark, sf_dir):
    """Files by the parser of their format, through the parse cache: the second parse reads what the first has written."""
    step = pipeline.IndexingPipeline(parsers.AutoParser(), chunking.FixedChunker(), cache=f"{shared_folder(spark)}/parsed-{uuid.uuid4().hex}")
    files = detect.detect_format(_files(spark, sf_dir))
    path = f"{step.cache}/parsed"
    for _ in range(2):
        found = blobs.through_cache(files, spark, path, ["doc_id"], step.parser.parse)
    return found.select("doc_id", F.col("page_count").cast("long").alias("page_count"), F.sha2("markdown", 256).alias("markdown_hash"))


@query(f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, {_NL})) AS line, generate_subscripts(string_split(text, {_NL}), 1) AS i FROM documents),
  c AS (SELECT doc_id, i, trim(regexp_replace(line, '[\\s\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g'), ' ') AS line FROM l),
  m AS (SELECT doc_id, string_agg(CASE WHEN i = 1 THEN '## ' WHEN i % 2 = 0 THEN '- ' ELSE '' END || line, {_NL} || {_NL} ORDER BY i) AS markdown FROM c WHERE line <> '' GROUP BY doc_id)
SELECT doc_id, CASE WHEN markdown IS NULL THEN 0 ELSE 1 END::BIGINT AS page_count, sha256(coalesce(markdown, '')) AS markdown_hash FROM documents LEFT JOIN m USING (doc_id)""")
def parse_web(spark, sf_dir):
    """Web pages by their markup, to markdown with headings and items."""
    found = parsers.AutoParser().parse(detect.detect_format(_web(spark, sf_dir)))
    return found.select("doc_id", F.col("page_count").cast("long").alias("page_count"), F.sha2("markdown", 256).alias("markdown_hash"))


@query("SELECT doc_id, 1::BIGINT AS ocr_pages, 'image/png ' || length(text)::VARCHAR || ' ' || text AS markdown FROM documents")
def parse_images(spark, sf_dir):
    """Documents as images, by a stand-in for an engine that reads what follows their signature."""
    files = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("i-"), "doc_id").alias("uri"), F.concat(F.unhex(F.lit("89504E470D0A1A0A")), F.col("text").cast("binary")).alias("content"))
    engine = ocr.CallableOcr(lambda image, mime: f"{mime} {len(image[8:].decode())} {image[8:].decode()}")
    return parsers.AutoParser(engine=engine).parse(detect.detect_format(files)).select("doc_id", F.col("ocr_pages").cast("long").alias("ocr_pages"), "markdown")


@query(f"WITH RECURSIVE {PAGES_SQL} SELECT doc_id, number::BIGINT AS number, sha256(md) AS markdown_hash FROM page")
def page_disassembly(spark, sf_dir):
    """The pages of assembled texts, taken from them by their spans."""
    back = pages.disassemble(_documents(spark, sf_dir))
    return back.select("doc_id", F.col("number").cast("long").alias("number"), F.sha2("markdown", 256).alias("markdown_hash"))


_LINES = f"l AS (SELECT doc_id, unnest(string_split(text, {_NL})) AS line, generate_subscripts(string_split(text, {_NL}), 1) AS i FROM documents)"


@query(f"""WITH {_LINES},
  c AS (SELECT doc_id, i, trim(line, ' ' || chr(9) || chr(13)) AS line, CASE doc_id % 3 WHEN 0 THEN (i - 1) // 7 ELSE (i - 1) // 5 END AS part, i = 1 OR (doc_id % 3 = 1 AND (i - 1) % 5 = 0) AS head FROM l),
  prose AS (SELECT doc_id, string_agg(CASE WHEN head THEN '# ' ELSE '' END || line, {_NL} || {_NL} ORDER BY i) AS markdown, count(DISTINCT part) AS pages FROM c WHERE doc_id % 3 < 2 AND line <> '' GROUP BY doc_id),
  cells AS (SELECT doc_id, i, '| ' || i || ' | ' || replace(trim(regexp_replace(line, '[ \t\r]+', ' ', 'g'), ' '), '|', chr(92) || '|') || ' |' AS row FROM l WHERE doc_id % 3 = 2),
  sheets AS (SELECT doc_id, '## S' || {_NL} || {_NL} || string_agg(row || CASE WHEN i = 1 THEN {_NL} || '| --- | --- |' ELSE '' END, {_NL} ORDER BY i) AS markdown, 1 AS pages FROM cells GROUP BY doc_id),
  every AS (SELECT * FROM prose UNION ALL SELECT * FROM sheets)
SELECT doc_id, (['docx', 'pptx', 'xlsx'])[doc_id % 3 + 1] AS format, coalesce(pages, 0)::BIGINT AS page_count, sha256(coalesce(markdown, '')) AS markdown_hash FROM documents LEFT JOIN every USING (doc_id)""")
def office_markdown(spark, sf_dir):
    """Documents as office archives, detected by their members and read without a converter."""
    found = detect.detect_format(files.office_files(table(spark, sf_dir, "documents")))
    read = parsers.AutoParser().parse(found).select("doc_id", F.col("page_count").cast("long").alias("page_count"), F.sha2("markdown", 256).alias("markdown_hash"))
    return read.join(found.select("doc_id", "format"), "doc_id")


_PDF_PAGES = f"""{_LINES},
  g AS (SELECT doc_id, (i - 1) // 12 + 1 AS page, sum(length(line)) AS n, trim(string_agg(line, {_NL} ORDER BY i), {_NL}) AS t FROM l GROUP BY ALL),
  p AS (SELECT doc_id, page, CASE WHEN (doc_id + page) % 5 = 0 THEN 0 ELSE n END AS chars, CASE WHEN (doc_id + page) % 5 = 0 THEN '' ELSE t END AS text FROM g)"""


@query(f"WITH {_PDF_PAGES} SELECT doc_id, page::BIGINT AS page, chars::BIGINT AS chars, sha256(text) AS text_hash FROM p")
def pdf_text_layer(spark, sf_dir):
    """Characters and text of each page of PDF files made of the documents, scans among them."""
    layer = pdf.text_layer(files.pdf_files(table(spark, sf_dir, "documents")))
    return layer.select("doc_id", F.col("page").cast("long").alias("page"), F.col("chars").cast("long").alias("chars"), F.sha2("text", 256).alias("text_hash"))


@query(f"""WITH {_PDF_PAGES}, r AS (SELECT doc_id, page, chars < 32 AS ocr, CASE WHEN chars < 32 THEN 'scan ' || page ELSE text END AS text FROM p)
SELECT doc_id, count(*)::BIGINT AS page_count, count(*) FILTER (ocr)::BIGINT AS ocr_pages, sha256(string_agg(text, {_NL} || {_NL} ORDER BY page)) AS markdown_hash FROM r GROUP BY doc_id""")
def pdf_routed(spark, sf_dir):
    """The same files: pages with a text layer by it, the others by an engine, in windows."""
    reader = parsers.AutoParser(render=lambda data, number: (str(number).encode(), "image/png"), engine=ocr.CallableOcr(lambda image, mime: f"scan {image.decode()}"))
    read = reader.parse(detect.detect_format(files.pdf_files(table(spark, sf_dir, "documents"))))
    return read.select("doc_id", F.col("page_count").cast("long").alias("page_count"), F.col("ocr_pages").cast("long").alias("ocr_pages"), F.sha2("markdown", 256).alias("markdown_hash"))


# --- text and chunks ------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct FROM (SELECT doc_id, {tok('text')} AS t FROM documents)")
def tokenize_counts(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", tx.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query(f"SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest({tok('text')}) AS term FROM documents) GROUP BY ALL")
def term_postings(spark, sf_dir):
    return search.postings(table(spark, sf_dir, "documents"), key="doc_id").select("doc_id", "term", F.col("tf").cast("long").alias("tf"))


@query(f"""
WITH f AS (SELECT DISTINCT doc_id, unnest({tok('text')}) AS term FROM documents), n AS (SELECT count(*)::DOUBLE AS n FROM documents)
SELECT term, count(*)::BIGINT AS df, round(ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 9) AS idf FROM f, n GROUP BY term""")
def bm25_df_idf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    n = docs.agg(F.count("*").cast("double").alias("n"))
    df = docs.select(F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.round(search.idf(F.col("n"), F.col("df")), 9).alias("idf"))


@query(f"SELECT count(*)::BIGINT AS n, round(avg(len({tok('text')})), 6) AS avg_len, max(len({tok('text')}))::BIGINT AS max_len FROM documents")
def doc_length_stats(spark, sf_dir):
    size = F.size(tx.tokens(F.col("text")))
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("n"), F.round(F.avg(size), 6).alias("avg_len"), F.max(size).cast("long").alias("max_len"))


_CHUNK_ROWS = "SELECT id, idx::BIGINT AS idx, s::BIGINT AS char_start, e::BIGINT AS char_end, text FROM chunk"


def _chunk_rows(chunks: DataFrame) -> DataFrame:
    return chunks.select("id", F.col("index").cast("long").alias("idx"), F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"), "text")


@query(f"{chunks_sql()} {_CHUNK_ROWS}")
def chunk_fixed(spark, sf_dir):
    return _chunk_rows(_chunks(spark, sf_dir))


@query(f"{chunks_sql(700, 0)} {_CHUNK_ROWS}")
def chunk_fixed_overlap0(spark, sf_dir):
    return _chunk_rows(_chunks(spark, sf_dir, 700, 0))


@query(f"""{chunks_sql()}
SELECT id, min(number)::BIGINT AS page_start, max(number)::BIGINT AS page_end FROM chunk c LEFT JOIN page p ON p.doc_id = c.doc_id AND p.p_start < c.e AND p.p_start + length(p.md) > c.s GROUP BY id""")
def chunk_page_provenance(spark, sf_dir):
    return _chunks(spark, sf_dir).select("id", F.col("page_start").cast("long").alias("page_start"), F.col("page_end").cast("long").alias("page_end"))


_SECTIONS = f"""
  line AS (SELECT doc_id, markdown, unnest(string_split(markdown, {_NL})) AS line, generate_subscripts(string_split(markdown, {_NL}), 1) AS n FROM doc),
  placed AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM line),
  cuts AS (SELECT doc_id, 0::BIGINT AS off FROM doc UNION SELECT doc_id, off FROM placed WHERE off > 0 AND regexp_matches(line, '^ {{0,3}}#{{1,6}}\\s')),
  sect AS (SELECT doc_id, (row_number() OVER w)::INT AS part, off AS lo, coalesce(lead(off) OVER w, length(markdown)) AS hi, markdown FROM cuts JOIN doc USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY off))"""


@query(f"""WITH RECURSIVE {MD_SQL}, {_SECTIONS}
SELECT doc_id || ':' || (row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1) AS id, lo::BIGINT AS char_start, hi::BIGINT AS char_end FROM sect WHERE regexp_matches(substr(markdown, lo + 1, hi - lo), '\\S')""")
def chunk_markdown_sections(spark, sf_dir):
    c = chunking.MarkdownChunker().chunk(_markdown(spark, sf_dir))
    return c.select("id", F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"))


@query(f"""WITH RECURSIVE {MD_SQL}, {_SECTIONS}, {spans_sql('long', '(SELECT * FROM sect WHERE hi - lo > 400)', 400, 50)},
  every AS (SELECT doc_id, part, pos, s, e FROM long UNION ALL SELECT doc_id, part, 0, lo, hi FROM sect WHERE hi - lo BETWEEN 1 AND 400),
  kept AS (SELECT every.*, substr(markdown, s + 1, e - s) AS text FROM every JOIN doc USING (doc_id))
SELECT doc_id || ':' || (row_number() OVER (PARTITION BY doc_id ORDER BY part, pos) - 1) AS id, s::BIGINT AS char_start, e::BIGINT AS char_end, text FROM kept WHERE regexp_matches(text, '\\S')""")
def chunk_markdown_fixed(spark, sf_dir):
    c = chunking.MarkdownFixedChunker(max_chars=400, overlap_chars=50).chunk(_markdown(spark, sf_dir))
    return c.select("id", F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"), "text")


_HEADED = f"""{chunks_sql(400, 0, MD_SQL)},
  line AS (SELECT doc_id, unnest(string_split(markdown, {_NL})) AS line, generate_subscripts(string_split(markdown, {_NL}), 1) AS n FROM doc),
  head AS (SELECT * FROM (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM line) WHERE regexp_matches(line, '^ {{0,3}}#{{1,6}}\\s')),
  headed AS (
    SELECT id, c.doc_id, CASE WHEN line IS NULL OR starts_with(ltrim(text, ' ' || {_NL}), line) THEN text ELSE line || {_NL} || {_NL} || text END AS text
    FROM chunk c ASOF LEFT JOIN head h ON c.doc_id = h.doc_id AND h.off <= c.s)"""


@query(f"{_HEADED} SELECT id, text FROM headed")
def enrich_heading(spark, sf_dir):
    docs = _markdown(spark, sf_dir)
    return enrich.HeadingEnricher().enrich(chunking.FixedChunker(chunk_chars=400, overlap_chars=0).chunk(docs), docs).select("id", "text")


@query(f"{chunks_sql()} SELECT id, lang FROM chunk JOIN doc USING (doc_id) WHERE lang IN ('de', 'fr') AND idx = 0")
def filter_metadata(spark, sf_dir):
    return matching(_chunks(spark, sf_dir), {"lang": ["de", "fr"], "index": 0}).select("id", F.col("metadata")["lang"].alias("lang"))


@query(f"""{chunks_sql()} SELECT id, text FROM chunk UNION ALL SELECT id || '#aug0', 'About ' || text FROM chunk WHERE idx = 0""")
def enrich_synthetic(spark, sf_dir):
    # written once: the chunks stand in three places of the plan, each of which would cut the texts again
    chunks = stored(_chunks(spark, sf_dir))
    return enrich.synthetic(chunks, chunks.where("index = 0").select("id", F.concat(F.lit("About "), "text").alias("text"))).select("id", "text")


@query(f"""{chunks_sql()}
SELECT id, (length(text) + least(length(markdown), 100) + 2)::VARCHAR || ' characters' || {_NL} || {_NL} || text AS text FROM chunk JOIN doc USING (doc_id)""")
def enrich_contextual(spark, sf_dir):
    """A model that counts the characters of its prompt, less what the prompt always has."""
    empty = len("<document>\n\n</document>\n<chunk>\n\n</chunk>\nSay in one sentence what this chunk is about within the document.") - 2
    docs = _documents(spark, sf_dir)
    chunks = chunking.FixedChunker().chunk(docs)
    return enrich.ContextualEnricher(lambda prompt: f" {len(prompt) - empty} characters", max_document_chars=100).enrich(chunks, docs).select("id", "text")


@query(f"{_HEADED} SELECT id, (length(text) + least(length(markdown), 100) + 2)::VARCHAR || ' characters' || {_NL} || {_NL} || text AS text FROM headed JOIN doc USING (doc_id)")
def enricher_chain(spark, sf_dir):
    """Headings, then a stand-in for a model that counts the characters of its prompt, the heading among them."""
    empty = len("<document>\n\n</document>\n<chunk>\n\n</chunk>\nSay in one sentence what this chunk is about within the document.") - 2
    docs = _markdown(spark, sf_dir)
    chain = [enrich.HeadingEnricher(), enrich.ContextualEnricher(lambda prompt: f" {len(prompt) - empty} characters", max_document_chars=100)]
    return enrich.enrich(chunking.FixedChunker(chunk_chars=400, overlap_chars=0).chunk(docs), docs, chain).select("id", "text")


# --- encoders and search ----------------------------------------------------------------------------------------------------


@query()
def embed_hashing(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", encode.HashingEmbedder().passage(F.col("text")).alias("vector"))


@query("""
WITH q AS (SELECT vec_id AS qid, embedding AS qv FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT qid, vec_id::VARCHAR AS chunk_id, list_cosine_similarity(qv::DOUBLE[], embedding::DOUBLE[]) AS score FROM q, embeddings)
SELECT qid, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id DESC) AS rank FROM s) WHERE rank <= 10""")
def search_dense_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "vec_id")
    return _shown(search.dense_search(v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "vector"), v.select("id", "vector"), 10))


@query("""
WITH q AS (SELECT vec_id AS qid, embedding AS qv FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT qid, vec_id::VARCHAR AS chunk_id, list_cosine_similarity(qv::DOUBLE[], embedding::DOUBLE[]) AS score FROM q, embeddings WHERE label IN (1, 3))
SELECT qid, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id DESC) AS rank FROM s) WHERE rank <= 10""")
def search_dense_filtered(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "vec_id", "label")
    return _shown(search.dense_search(v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "vector"), v, 10, filters={"label": [1, 3]}))


@query("""
WITH c AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
q AS (SELECT vec_id AS qid, i, v AS qv FROM c WHERE vec_id % 100 = 0 AND v > 0), d AS (SELECT vec_id, i, v FROM c WHERE v > 0),
hit AS (SELECT qid, vec_id, sum(v * qv) AS score FROM q JOIN d USING (i) GROUP BY ALL),
s AS (SELECT qid, e.vec_id::VARCHAR AS chunk_id, coalesce(score, 0) AS score FROM (SELECT vec_id AS qid FROM embeddings WHERE vec_id % 100 = 0) JOIN embeddings e ON true LEFT JOIN hit USING (qid, vec_id))
SELECT qid, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id DESC) AS rank FROM s) WHERE rank <= 10""")
def search_sparse_dot(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    kept = F.filter(F.transform("v", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda t: t["x"] > 0)
    sparse = F.struct(F.transform(kept, lambda t: t["i"]).alias("indices"), F.transform(kept, lambda t: t["x"]).alias("values"))
    rows = e.select(F.col("vec_id").cast("string").alias("id"), "vec_id", sparse.alias("sparse"))
    return _shown(search.sparse_search(rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "sparse"), rows, 10))


@query(f"{chunks_sql()}, {bm25_sql('r')} {SHOWN.format('r')}")
def search_bm25_topk(spark, sf_dir):
    return _shown(_bm25(spark, sf_dir))


@query(f"{chunks_sql()}, {bm25_sql('r', where='WHERE doc_id IN (SELECT doc_id FROM doc WHERE lang = $$en$$)')} {SHOWN.format('r')}")
def search_bm25_filtered(spark, sf_dir):
    return _shown(_bm25(spark, sf_dir, filters={"lang": "en"}))


_TWO = f"{chunks_sql()}, {bm25_sql('a', k=60)}, {bm25_sql('z', b=0.0, k=60)}"


def _two(spark, sf_dir):
    return [("a", _bm25(spark, sf_dir, 60)), ("z", _bm25(spark, sf_dir, 60, b=0.0))]


@query(f"{_TWO}, {rrf_sql('f', [('a', 1.0), ('z', 1.0)])} {SHOWN.format('f')}")
def fuse_rrf(spark, sf_dir):
    return _shown(search.fuse(_two(spark, sf_dir), 10))


@query(f"{_TWO}, {rrf_sql('f', [('a', 2.0), ('z', 0.5)])} {SHOWN.format('f')}")
def fuse_rrf_weighted(spark, sf_dir):
    return _shown(search.fuse(_two(spark, sf_dir), 10, weights=[2.0, 0.5]))


@query(f"{_TWO}, {rrf_sql('f', [('a', 1.0), ('z', 1.0)])} SELECT f.qid, f.chunk_id, a.rank AS a_rank, z.rank AS z_rank FROM f LEFT JOIN a USING (qid, chunk_id) LEFT JOIN z USING (qid, chunk_id)")
def fuse_rrf_sources(spark, sf_dir):
    f = search.fuse(_two(spark, sf_dir), 10)
    return f.select("qid", "chunk_id", *[F.try_element_at("sources", F.lit(x)).cast("long").alias(f"{x}_rank") for x in ("a", "z")])


@query(f"{chunks_sql()}, {bm25_sql('a', k=10)}, {bm25_sql('y', k=10, asked='SELECT item_id AS qid, left(text, 40) AS text FROM benchmark')}, {bm25_sql('z', k=10, asked='SELECT item_id AS qid, right(text, 40) AS text FROM benchmark')}, {rrf_sql('f', [('a', 1.0), ('y', 1.0), ('z', 1.0)])} {SHOWN.format('f')}")
def multi_query_fusion(spark, sf_dir):
    """Every item and two wordings that a model, here its first and last forty characters, gives."""

    def phrasings(prompt: str) -> str:
        question = prompt.rsplit("Question: ", 1)[-1]
        return question[:40] + "\n" + question[-40:]

    inner = retrieve.IndexRetriever(corpus(spark, sf_dir))
    found = retrieve.MultiQueryRetriever(inner, phrasings, n=2).retrieve(_questions(spark, sf_dir).withColumn("text", F.regexp_replace("text", r"\R", " ")), 10)
    return _shown(found)


@query(f"""{chunks_sql()}, {bm25_sql('a', k=60)}, {rrf_sql('f', [('a', 1.0), ('a', 1.0)])}
SELECT f.qid, f.chunk_id, round(f.score, 6) AS score, f.rank, a.rank AS first_rank, a.rank AS second_rank FROM f JOIN a USING (qid, chunk_id)""")
def search_fusion_retriever(spark, sf_dir):
    """The same space twice: sources with one name are told apart."""
    both = [retrieve.IndexRetriever(corpus(spark, sf_dir)) for _ in range(2)]
    found = retrieve.FusionRetriever(both).retrieve(_questions(spark, sf_dir), 10)
    names = search.source_labels([r.label for r in both])
    ranks = [F.try_element_at("sources", F.lit(n)).cast("long").alias(c) for n, c in zip(names, ("first_rank", "second_rank"), strict=True)]
    return found.select("qid", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"), *ranks)


# --- refinement and generation --------------------------------------------------------------------------------------------------


def _candidates(spark, sf_dir, k=10):
    chunks = corpus(spark, sf_dir).store.chunks()
    return refine.candidates(_bm25(spark, sf_dir, k), chunks), chunks


_WORDS = f"list_distinct({tok('{}')})"
_JACCARD = "CASE WHEN len(qw) = 0 OR len(cw) = 0 THEN 0.0 ELSE len(list_intersect(qw, cw)) / len(list_distinct(list_concat(qw, cw))) END"


@query(f"""{chunks_sql()}, {bm25_sql('r')},
  w AS (SELECT r.qid, chunk_id, list_distinct({tok('q.text')}) AS qw, list_distinct({tok('c.text')}) AS cw FROM r JOIN chunk c ON c.id = chunk_id JOIN r_q q ON q.qid = r.qid),
  j AS (SELECT qid, chunk_id, {_JACCARD} AS score FROM w)
SELECT qid, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id DESC) AS rank FROM j""")
def refine_keyword_jaccard(spark, sf_dir):
    rows, chunks = _candidates(spark, sf_dir)
    return _shown(refine.KeywordRefiner().refine(rows, _questions(spark, sf_dir), chunks).withColumn("rank", F.col("pos")))


@query(f"""{chunks_sql()}, {bm25_sql('r')} SELECT qid, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM r WHERE score >= 12.0""")
def refine_threshold(spark, sf_dir):
    rows, chunks = _candidates(spark, sf_dir)
    return _shown(refine.ScoreThreshold(min_score=12.0).refine(rows, _questions(spark, sf_dir), chunks).withColumn("rank", F.col("pos")))


@query(f"""{chunks_sql()}, {bm25_sql('r')},
  w AS (SELECT r.qid, chunk_id, list_distinct({tok('q.text')}) AS qw, list_distinct({tok('c.text')}) AS cw FROM r JOIN chunk c ON c.id = chunk_id JOIN r_q q ON q.qid = r.qid WHERE score >= 12.0),
  j AS (SELECT qid, chunk_id, {_JACCARD} AS score FROM w)
SELECT * FROM (SELECT qid, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id DESC) AS rank FROM j) WHERE rank <= 3""")
def refiner_chain(spark, sf_dir):
    """A threshold, then a reranking, then the first three."""
    rows, chunks = _candidates(spark, sf_dir)
    return _shown(refine.refine(rows, _questions(spark, sf_dir), chunks, [refine.ScoreThreshold(min_score=12.0), refine.KeywordRefiner()], 3).withColumn("rank", F.col("pos")))


@query(f"""{chunks_sql()}, {bm25_sql('r', k=5)},
  g AS (SELECT r.qid, r.chunk_id, r.rank, a.doc_id, min(n.s) AS s, max(n.e) AS e FROM r JOIN chunk a ON a.id = r.chunk_id JOIN chunk n ON n.doc_id = a.doc_id AND n.idx BETWEEN a.idx - 1 AND a.idx + 1 GROUP BY ALL)
SELECT qid, chunk_id, rank, s::BIGINT AS char_start, e::BIGINT AS char_end, substr(markdown, s + 1, e - s) AS text FROM g JOIN doc USING (doc_id)""")
def refine_neighbor_merge(spark, sf_dir):
    rows, chunks = _candidates(spark, sf_dir, 5)
    out = refine.NeighborExpander().refine(rows, _questions(spark, sf_dir), chunks)
    return out.select("qid", "chunk_id", F.col("pos").cast("long").alias("rank"), F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"), "text")


@query(f"""{chunks_sql()}, {bm25_sql('r')},
  l AS (SELECT r.qid, chunk_id, -abs(length(q.text) - length(c.text))::DOUBLE AS score FROM r JOIN chunk c ON c.id = chunk_id JOIN r_q q ON q.qid = r.qid)
SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id DESC) AS rank FROM l""")
def refine_cross_encoder(spark, sf_dir):
    """A model that likes passages as long as the question."""
    rows, chunks = _candidates(spark, sf_dir)
    by_length = refine.CrossEncoderReranker(lambda pairs: [-abs(len(q) - len(t)) for q, t in pairs])
    return _shown(by_length.refine(rows, _questions(spark, sf_dir), chunks).withColumn("rank", F.col("pos")))


_PACKED = f"""{chunks_sql()}, {bm25_sql('r', k=8)},
  b AS (SELECT qid, chunk_id, rank, text, '[' || rank || '] ' || text AS block FROM r JOIN chunk ON id = chunk_id),
  u AS (SELECT *, sum(length(block) + CASE WHEN rank > 1 THEN 2 ELSE 0 END) OVER (PARTITION BY qid ORDER BY rank) AS used FROM b),
  packed AS (SELECT * FROM u WHERE rank = 1 OR used <= 4000)"""


@query(f"{_PACKED} SELECT qid, string_agg(block, {_NL} || {_NL} ORDER BY rank) AS prompt_block, string_agg(chunk_id, ',' ORDER BY rank) AS cited FROM packed GROUP BY qid")
def pack_context(spark, sf_dir):
    rows, _ = _candidates(spark, sf_dir, 8)
    c = generate.contexts(generate.pack(rows, 4000))
    return c.select("qid", "prompt_block", F.array_join(F.transform("citations", lambda x: x["chunk_id"]), ",").alias("cited"))


@query(f"""{_PACKED},
  a AS (SELECT qid, count(*) AS n, qid % 4 AS m FROM packed GROUP BY qid)
SELECT a.qid, string_agg(rank::VARCHAR, ',' ORDER BY rank) AS markers FROM a JOIN packed p ON p.qid = a.qid AND (m < 1 OR m > n OR rank = m) GROUP BY a.qid""")
def resolve_citations(spark, sf_dir):
    rows, _ = _candidates(spark, sf_dir, 8)
    answers = generate.contexts(generate.pack(rows, 4000)).withColumn("text", F.concat(F.lit("as said in ["), (F.col("qid") % 4).cast("string"), F.lit("], and so on")))
    return generate.resolve_citations(answers).select("qid", F.array_join(F.transform("citations", lambda c: c["marker"].cast("string")), ",").alias("markers"))


@query(f"""{_PACKED}
SELECT q.qid, coalesce(p.text || ' [1]', 'I don''t have enough context to answer that.') AS answer, p.chunk_id AS cited FROM r_q q LEFT JOIN packed p ON p.qid = q.qid AND p.rank = 1""")
def extractive_answer(spark, sf_dir):
    rows, _ = _candidates(spark, sf_dir, 8)
    out = generate.ExtractiveGenerator().generate(_questions(spark, sf_dir), rows)
    return out.select("qid", F.col("text").alias("answer"), F.try_element_at("citations", F.lit(1))["chunk_id"].alias("cited"))


@query()
def rag_answers(spark, sf_dir):
    """Fixed chunks in a dense and a lexical space, fused, reranked by keywords, packed and answered."""
    corpus = index.Corpus(index.TableStore(spark), [index.DenseRepresentation(encode.HashingEmbedder()), index.LexicalRepresentation()])
    rag = pipeline.RagPipeline(corpus, chunker=chunking.FixedChunker(), refiners=[refine.KeywordRefiner()])
    rag.index_documents(_documents(spark, sf_dir))
    out = rag.ask(_questions(spark, sf_dir))
    return out.select("qid", F.col("text").alias("answer"), F.transform("citations", lambda c: c["chunk_id"]).alias("cited"))


class _Lengths(encode.Embedder):
    """Words by their length: a dense space that SQL can compute."""

    name, dimensions = "lengths", 16

    def passage(self, text):
        @F.arrow_udf("array<double>")
        def count(texts: pa.Array) -> pa.Array:
            words, row = tx.split_words(texts)
            size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
            found = np.bincount(row * 16 + size % 16, minlength=len(texts) * 16).astype(np.float64)
            return pa.ListArray.from_arrays(pa.array(np.arange(0, len(found) + 1, 16, dtype=np.int32)), pa.array(found))

        return count(tx.lowered(text))


class _Initials(encode.CountedWords):
    """Words by their first letter and length: a sparse space that SQL can compute."""

    name = "initials"

    def indices(self, words):
        return [ord(w[0]) * 32 + len(w) % 32 for w in words]


def _spaces_sql(name: str, key: str, score: str, weigh: bool = False) -> str:
    """CTEs up to name(qid, chunk_id, score, rank), 60 deep, over chunk: inner products of counted keys of words."""
    weight = f"* ln(1 + ({name}_n.n - coalesce(d, 0) + 0.5) / (coalesce(d, 0) + 0.5))" if weigh else ""
    return f"""
  {name}_c AS (SELECT id, {key} AS k, count(*)::DOUBLE AS v FROM (SELECT id, unnest({tok('text')}) AS t FROM chunk) GROUP BY ALL),
  {name}_d AS (SELECT k, count(*) AS d FROM {name}_c GROUP BY k), {name}_n AS (SELECT count(*)::DOUBLE AS n FROM chunk),
  {name}_q AS (SELECT qid, k, v {weight} AS v FROM (SELECT item_id AS qid, {key} AS k, count(*)::DOUBLE AS v FROM (SELECT item_id, unnest({tok('text')}) AS t FROM benchmark) GROUP BY ALL) LEFT JOIN {name}_d USING (k), {name}_n),
  {name}_l AS (SELECT id, sqrt(sum(v * v)) AS l FROM {name}_c GROUP BY id), {name}_m AS (SELECT qid, sqrt(sum(v * v)) AS m FROM {name}_q GROUP BY qid),
  {name}_p AS (SELECT qid, id, sum(c.v * q.v) AS dot FROM {name}_c c JOIN {name}_q q USING (k) GROUP BY ALL),
  {name}_e AS (SELECT b.item_id AS qid, c.id AS chunk_id, coalesce({score}, 0) AS score FROM benchmark b JOIN chunk c ON true LEFT JOIN {name}_p p ON p.qid = b.item_id AND p.id = c.id LEFT JOIN {name}_l l ON l.id = c.id LEFT JOIN {name}_m m ON m.qid = b.item_id),
  {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id DESC) AS rank FROM {name}_e) WHERE rank <= 60)"""


_INITIALS = "unicode(t) * 32 + length(t) % 32"


@query(f"""{chunks_sql()}, {bm25_sql('lex', k=60)}, {_spaces_sql('den', 'length(t) % 16', 'dot / (l * m)')}, {_spaces_sql('spa', _INITIALS, 'dot')}, {rrf_sql('f', [('den', 1.0), ('spa', 1.0), ('lex', 1.0)])} {SHOWN.format('f')}""")
def search_hybrid(spark, sf_dir):
    """A dense, a sparse and a lexical space of one corpus, fused."""
    corpus = index.Corpus(index.TableStore(spark), [index.DenseRepresentation(_Lengths()), index.SparseRepresentation(_Initials()), index.LexicalRepresentation()])
    corpus.add(_chunks(spark, sf_dir))
    return _shown(retrieve.HybridRetriever(corpus).retrieve(_questions(spark, sf_dir), 10))


@query(f"{chunks_sql()}, {bm25_sql('r')} {SHOWN.format('r')}")
def search_reopened(spark, sf_dir):
    """An index that took three batches, of which the last replaces chunks with what they were, opened again and compacted."""
    path, rows = f"{shared_folder(spark)}/lexical-{uuid.uuid4().hex}", _chunks(spark, sf_dir)
    first = index.LexicalIndex(spark, path)
    first.add(rows.where("doc_id % 3 < 2"))
    first.add(rows.where("doc_id % 3 = 2"))
    again = index.LexicalIndex(spark, path)
    again.add(rows.where("doc_id % 3 = 1"))
    index.LexicalIndex(spark, path).compact()
    return _shown(index.LexicalIndex(spark, path).search(_questions(spark, sf_dir), 10))


@query(f"{chunks_sql()}, {_spaces_sql('spa', _INITIALS, 'dot', weigh=True)} {SHOWN.format('spa')} WHERE rank <= 10")
def search_sparse_idf(spark, sf_dir):
    """A sparse space whose queries are weighed by what is stored; a third of the chunks is added in a second batch, and another third a second time."""
    corpus = index.Corpus(index.TableStore(spark), [index.SparseRepresentation(_Initials(), idf=True)])
    rows = _chunks(spark, sf_dir)
    corpus.add(rows.where("doc_id % 3 < 2"))
    corpus.add(rows.where("doc_id % 3 > 0"))
    return _shown(corpus.search("sparse", _questions(spark, sf_dir), 10))


_EVERY_SECOND = "SELECT item_id AS qid, array_to_string(list_filter(string_split(text, ' '), lambda x, i: i % 2 = 1), ' ') AS text FROM benchmark"


@query(f"{chunks_sql()}, {bm25_sql('r', asked=_EVERY_SECOND)} {SHOWN.format('r')}")
def search_hyde(spark, sf_dir):
    """The stored index is searched by what a stand-in for a model says: every second word of the question."""
    said = retrieve.HydeRetriever(retrieve.IndexRetriever(corpus(spark, sf_dir)), lambda prompt: " ".join(prompt.split("Question: ", 1)[1].split(" ")[::2]))
    return _shown(said.retrieve(_questions(spark, sf_dir), 10))


# --- evaluation -----------------------------------------------------------------------------------------------------------------

_IR_PARTS = """
  n AS (SELECT qid, count(*) AS n FROM truth GROUP BY qid),
  h AS (SELECT t.qid, min(rank) AS first, sum((rank <= 5)::INT) AS h5, sum((rank <= 10)::INT) AS h10, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM truth t JOIN found f ON f.qid = t.qid AND f.item = t.item GROUP BY t.qid)"""
_IR_SELECT = """
SELECT qid, round(coalesce(h5, 0) / n, 9) AS recall5, round(coalesce(h10, 0) / n, 9) AS recall10, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 9) AS ndcg10, round(coalesce(1 / first, 0), 9) AS mrr
FROM n LEFT JOIN h USING (qid)"""
_IR = _IR_PARTS + _IR_SELECT


def _ir(rows: DataFrame) -> DataFrame:
    return rows.select("qid", *[F.round(F.col(f"`{m}`"), 9).alias(n) for m, n in (("recall@5", "recall5"), ("recall@10", "recall10"), ("ndcg@10", "ndcg10"), ("mrr", "mrr"))])


#: words of an item that a relevant text has in a row; a shorter item counts as a whole
PASSAGE_WORDS = 10


def _passages(spark, sf_dir, texts, key):
    """(qid, key) of each row of texts (key, text) with PASSAGE_WORDS consecutive words of an item."""
    items = _questions(spark, sf_dir).select("qid", tx.tokens(F.col("text")).alias("w")).where(F.size("w") > 0).withColumn("n", F.least(F.size("w"), F.lit(PASSAGE_WORDS)))
    wanted = items.select("qid", "n", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda at: F.slice("w", at, F.col("n"))))).alias("run"))
    held = [metrics.Passages(part.toArrow()) for part in search.query_blocks(wanted.select("qid", "n", "run"))]
    return reduce(DataFrame.unionByName, [metrics.passages(texts, key, block) for block in held])


def passages_sql(source: str) -> str:
    """CTEs up to truth(qid, item) over source(id, text)."""
    return f"""
  items AS (SELECT item_id AS qid, {tok('text')} AS w, least(len({tok('text')}), {PASSAGE_WORDS}) AS n FROM benchmark WHERE len({tok('text')}) > 0),
  runs AS (SELECT DISTINCT qid, n, array_to_string(w[k:k + n - 1], ' ') AS run FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM items)),
  held AS (SELECT id, n, array_to_string(w[k:k + n - 1], ' ') AS run FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM (SELECT id, {tok('text')} AS w FROM {source}), (SELECT DISTINCT n FROM runs) WHERE len(w) >= n)),
  truth AS (SELECT DISTINCT qid, id AS item FROM held JOIN runs USING (n, run))"""


def _passage_chunks(spark, sf_dir):
    return _passages(spark, sf_dir, corpus(spark, sf_dir).store.chunks(), "id").withColumnRenamed("id", "chunk_id")


def _passage_documents(spark, sf_dir):
    return _passages(spark, sf_dir, table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text"), "doc_id")


_DOC_TRUTH = f"""
  found AS (SELECT qid, doc_id::VARCHAR AS item, row_number() OVER (PARTITION BY qid ORDER BY min(rank)) AS rank FROM r JOIN chunk ON id = chunk_id GROUP BY qid, doc_id),
  {passages_sql('(SELECT doc_id::VARCHAR AS id, text FROM documents)')}"""


@query(f"""{chunks_sql()}, {bm25_sql('r', k=50)},
  found AS (SELECT qid, chunk_id AS item, rank FROM r), {passages_sql('chunk')},{_IR}""")
def ir_chunk_level(spark, sf_dir):
    return _ir(metrics.ir_metrics(_bm25(spark, sf_dir, 50), _passage_chunks(spark, sf_dir), item="chunk_id"))


@query(f"{chunks_sql()}, {bm25_sql('r', k=50)}, {_DOC_TRUTH},{_IR}")
def ir_doc_level(spark, sf_dir):
    return _ir(metrics.ir_metrics(metrics.by_document(_bm25(spark, sf_dir, 50), corpus(spark, sf_dir).store.chunks()), _passage_documents(spark, sf_dir)))


@query(f"""{chunks_sql()}, {bm25_sql('r', k=50)}, {_DOC_TRUTH}, {_IR_PARTS}
SELECT round(avg(recall5), 6) AS recall5, round(avg(recall10), 6) AS recall10, round(avg(ndcg10), 6) AS ndcg10, round(avg(mrr), 6) AS mrr FROM ({_IR_SELECT.replace(', 9)', ', 15)')})""")
def ir_evaluator(spark, sf_dir):
    """The retrieval evaluator and the mean of its metrics, over items that some document has a passage of."""
    truth = _passage_documents(spark, sf_dir).groupBy("qid").agg(F.sort_array(F.collect_list("doc_id")).alias("relevant_doc_ids"))
    samples = _questions(spark, sf_dir).join(truth, "qid", "left").withColumn("relevant_chunk_ids", F.lit(None).cast("array<string>"))
    judge = metrics.RetrievalEvaluator(k_values=(5, 10))
    scores = judge.evaluate(samples, _bm25(spark, sf_dir, 50), corpus(spark, sf_dir).store.chunks())
    means = metrics.aggregate(scores, judge.metrics())
    return means.select(F.round("`recall@5`", 6).alias("recall5"), F.round("`recall@10`", 6).alias("recall10"), F.round("`ndcg@10`", 6).alias("ndcg10"), F.round("mrr", 6).alias("mrr"))


_PAIRS = "pairs AS (SELECT a.conv_id, a.turn, a.text AS answer, b.text AS reference FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"


def _pairs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.col("text").alias("answer")).join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reference")), ["conv_id", "turn"])


@query(f"""WITH {_PAIRS},
  k AS (SELECT conv_id, turn, {tok('answer')} AS a, {tok('reference')} AS r FROM pairs),
  ca AS (SELECT conv_id, turn, t, count(*) AS x FROM (SELECT conv_id, turn, unnest(a) AS t FROM k) GROUP BY ALL), cr AS (SELECT conv_id, turn, t, count(*) AS y FROM (SELECT conv_id, turn, unnest(r) AS t FROM k) GROUP BY ALL),
  o AS (SELECT conv_id, turn, sum(least(x, y)) AS c FROM ca JOIN cr USING (conv_id, turn, t) GROUP BY ALL)
SELECT conv_id, turn, round(CASE WHEN len(a) = 0 AND len(r) = 0 THEN 1.0 WHEN len(a) = 0 OR len(r) = 0 THEN 0.0 ELSE 2.0 * coalesce(c, 0) / (len(a) + len(r)) END, 9) AS token_f1,
  (array_to_string(a, ' ') = array_to_string(r, ' '))::INT::DOUBLE AS exact_match FROM k LEFT JOIN o USING (conv_id, turn)""")
def answer_match(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    return pairs.select("conv_id", "turn", F.round(metrics.token_f1(F.col("answer"), F.col("reference")), 9).alias("token_f1"), metrics.exact_match(F.col("answer"), F.col("reference")).alias("exact_match"))


@query("SELECT round(avg(CASE WHEN event_type = 'click' THEN value END), 6) AS click, round(avg(CASE WHEN event_type = 'purchase' THEN value END), 6) AS purchase, round(avg(value), 6) AS \"any\" FROM events")
def metric_means(spark, sf_dir):
    """Means of metrics that not every sample has."""
    e = table(spark, sf_dir, "events")
    scores = e.select(*[F.when(F.col("event_type") == k, F.col("value")).alias(k) for k in ("click", "purchase")], F.col("value").alias("any"))
    return metrics.aggregate(scores, ["click", "purchase", "any"]).select(*[F.round(k, 6).alias(k) for k in ("click", "purchase", "any")])


@query(f"""WITH {_PAIRS},
  k AS (SELECT conv_id, turn, {tok("regexp_replace(answer, '\\[\\d+\\]', ' ', 'g')")} AS a, {tok('reference')} AS r FROM pairs WHERE reference <> ''),
  ca AS (SELECT conv_id, turn, t, count(*) AS x FROM (SELECT conv_id, turn, unnest(a) AS t FROM k) GROUP BY ALL), cr AS (SELECT conv_id, turn, t, count(*) AS y FROM (SELECT conv_id, turn, unnest(r) AS t FROM k) GROUP BY ALL),
  o AS (SELECT conv_id, turn, sum(least(x, y)) AS c FROM ca JOIN cr USING (conv_id, turn, t) GROUP BY ALL)
SELECT round(avg(CASE WHEN len(a) = 0 AND len(r) = 0 THEN 1.0 WHEN len(a) = 0 OR len(r) = 0 THEN 0.0 ELSE 2.0 * coalesce(c, 0) / (len(a) + len(r)) END), 6) AS token_f1, round(avg((array_to_string(a, ' ') = array_to_string(r, ' '))::INT::DOUBLE), 6) AS exact_match
FROM k LEFT JOIN o USING (conv_id, turn)""")
def answer_evaluator(spark, sf_dir):
    pairs = _pairs(spark, sf_dir).withColumn("qid", F.struct("conv_id", "turn"))
    samples, answers = pairs.select("qid", F.col("reference").alias("reference_answer")), pairs.select("qid", F.concat("answer", F.lit(" [1]")).alias("text"))
    judge = metrics.AnswerMatchEvaluator()
    means = metrics.aggregate(judge.evaluate(samples, answers, answers, answers), judge.metrics())
    return means.select(*[F.round(m, 6).alias(m) for m in judge.metrics()])


@query(f"""WITH {_PAIRS}
SELECT round(avg(length(answer) % 7 / 6), 6) AS faithfulness, round(avg(CASE WHEN length(answer) % 2 = 0 THEN 1.0 END), 6) AS answer_relevancy, round(avg(1.0), 6) AS context_precision, NULL::DOUBLE AS context_recall FROM pairs""")
def judge_evaluator(spark, sf_dir):
    """A judge that looks at lengths; what it leaves out joins no mean."""

    def judge(rows):
        return [{"faithfulness": len(r["answer"]) % 7 / 6, "answer_relevancy": None if len(r["answer"]) % 2 else 1.0, "context_precision": float(len(r["contexts"]))} for r in rows]

    pairs = _pairs(spark, sf_dir).withColumn("qid", F.struct("conv_id", "turn")).withColumn("cid", F.concat_ws(":", "conv_id", "turn"))
    samples, answers = pairs.select("qid", F.concat("cid", F.lit("?")).alias("text"), F.col("reference").alias("reference_answer")), pairs.select("qid", F.col("answer").alias("text"))
    said = metrics.JudgeEvaluator(judge, model="lengths").evaluate(samples, pairs.select("qid", F.col("cid").alias("chunk_id"), F.lit(1).alias("rank")), pairs.select(F.col("cid").alias("id"), F.col("answer").alias("text")), answers)
    return metrics.aggregate(said, metrics.JUDGED).select(*[F.round(m, 6).alias(m) for m in metrics.JUDGED])


# --- trials ---------------------------------------------------------------------------------------------------------------------------


def _trace(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("trial_id"), F.element_at(F.array(*map(F.lit, ("parse", "chunk", "enrich", "retrieve", "generate"))), (F.col("event_id") % 5 + 1).cast("int")).alias("stage"), F.col("value").alias("duration_ms"), (F.col("event_id") % 2 == 0).alias("cache_hit"), F.create_map("event_type", F.col("event_id").cast("double")).alias("usage"))


_TRACE = "t AS (SELECT user_id::VARCHAR AS trial_id, (['parse', 'chunk', 'enrich', 'retrieve', 'generate'])[event_id % 5 + 1] AS stage, value AS duration_ms, event_id % 2 = 0 AS cache_hit, event_type, event_id FROM events)"


@query(f"""WITH {_TRACE} SELECT trial_id, round(sum(duration_ms), 6) AS latency_ms, round(sum(CASE WHEN stage IN ('parse', 'chunk', 'enrich') THEN duration_ms ELSE 0 END), 6) AS index_ms,
  round(sum(CASE WHEN stage IN ('retrieve', 'generate') THEN duration_ms ELSE 0 END), 6) AS query_ms, count(*) AS events FROM t GROUP BY trial_id""")
def cost_rollup(spark, sf_dir):
    return trials.cost_rollup(_trace(spark, sf_dir)).select("trial_id", *[F.round(c, 6).alias(c) for c in ("latency_ms", "index_ms", "query_ms")], "events")


@query(f"WITH {_TRACE} SELECT trial_id, stage, round(sum(duration_ms), 6) AS duration_ms, bool_and(cache_hit) AS cache_hit, count(*) AS events FROM t GROUP BY ALL")
def stage_cost(spark, sf_dir):
    return trials.stage_cost(_trace(spark, sf_dir)).withColumn("duration_ms", F.round("duration_ms", 6))


@query(f"WITH {_TRACE} SELECT trial_id, round(sum(CASE event_type WHEN 'click' THEN event_id * 0.5 WHEN 'purchase' THEN event_id * 2.0 END)::DOUBLE, 6) AS api_usd FROM t GROUP BY trial_id")
def usage_cost(spark, sf_dir):
    return trials.usage_cost(_trace(spark, sf_dir), {"click": 0.5, "purchase": 2.0}).select("trial_id", F.round("api_usd", 6).alias("api_usd"))


@query("SELECT trial_id, round(value, 6) AS value FROM (SELECT user_id::VARCHAR AS trial_id, avg(value) AS value FROM events GROUP BY 1 HAVING count(value) > 0 ORDER BY value DESC, trial_id LIMIT 10)")
def trial_leaderboard(spark, sf_dir):
    t = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("trial_id")).agg(F.avg("value").alias("v")).withColumn("metrics", F.create_map(F.lit("quality"), "v"))
    return trials.top(t, "quality", 10).select("trial_id", F.round("value", 6).alias("value"))


@query("""
WITH t AS (SELECT user_id, event_type, avg(value) AS metric, count(*)::DOUBLE AS cost, user_id % 3 AS third FROM events GROUP BY ALL), a AS (SELECT avg(metric) AS q, avg(cost) AS c FROM t WHERE metric IS NOT NULL),
o AS (SELECT 'event_type' AS stage, event_type AS option, metric, cost FROM t WHERE metric IS NOT NULL UNION ALL SELECT 'third', third::VARCHAR, metric, cost FROM t WHERE metric IS NOT NULL)
SELECT stage, option, count(*) AS trials, round(avg(metric) - any_value(q), 6) AS quality, round(avg(cost) - any_value(c), 6) AS cost FROM o, a GROUP BY stage, option""")
def trial_marginal(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("metric"), F.count("*").cast("double").alias("cost")).withColumn("third", F.col("user_id") % 3)
    return trials.marginals(rows, ["event_type", "third"]).select("stage", "option", "trials", F.round("quality", 6).alias("quality"), F.round("cost", 6).alias("cost"))


@query("""
WITH z AS (SELECT DISTINCT (n_chars // 4000 + 1) * 400 AS c FROM documents)
SELECT (row_number() OVER (ORDER BY c, o, k))::BIGINT - 1 AS position, c::BIGINT AS chunk_chars, o::BIGINT AS overlap_chars, k AS refiner, (SELECT count(*) FROM documents WHERE n_chars > c)::BIGINT AS longer
FROM z, (VALUES (0), (50)) b(o), (VALUES ('keyword'), ('none')) d(k)""")
def search_space_grid(spark, sf_dir):
    """The specs of a space whose chunk sizes are those that the documents' lengths suggest, and how many documents each cuts."""
    docs = table(spark, sf_dir, "documents").select("n_chars")
    sizes = sorted(r.c for r in docs.select(F.expr("(n_chars div 4000 + 1) * 400").alias("c")).distinct().collect())
    space = SearchSpace(refine=[[choice("keyword")], []], chunker=[choice("fixed", chunk_chars=sizes, overlap_chars=[0, 50])])
    specs = [(i, s["chunker"]["params"]["chunk_chars"], s["chunker"]["params"]["overlap_chars"], s["refine"][0]["name"] if s["refine"] else "none") for i, s in enumerate(space.expand())]
    longer = docs.agg(*[F.count_if(F.col("n_chars") > c).alias(str(c)) for c in sizes]).select(F.explode(F.array(*[F.struct(F.lit(c).cast("long").alias("chunk_chars"), F.col(str(c)).alias("longer")) for c in sizes])).alias("x")).select("x.*")
    return spark.createDataFrame(specs, "position long, chunk_chars long, overlap_chars long, refiner string").join(F.broadcast(longer), "chunk_chars")


_LOGGED = """
WITH t AS (SELECT user_id, event_id, value FROM events WHERE value IS NOT NULL), u AS (SELECT user_id::VARCHAR AS trial_id, arg_max(value, event_id) AS q FROM t GROUP BY user_id)"""


def _log(spark, sf_dir) -> DataFrame:
    """Every event as a record of its user's trial, with its number as the sequence, as lines of a log of many writers."""
    e = table(spark, sf_dir, "events").where("value is not null")
    return e.select(F.to_json(F.struct(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("trial_id"), F.struct(F.struct(F.lit("fixed").alias("name"), F.struct(F.col("event_type").alias("size")).alias("config")).alias("chunker")).alias("pipeline_spec"), F.create_map(F.lit("q"), "value").alias("metrics"))).alias("value"))


@query(f"{_LOGGED} SELECT count(*)::BIGINT AS trials, round(avg(q), 6) AS mean_q, round(max(q), 6) AS best_q FROM u")
def trial_sql(spark, sf_dir):
    """SQL over a log of trials, of whose records the last one counts."""
    path = f"{shared_folder(spark)}/trials-{uuid.uuid4().hex}"
    _log(spark, sf_dir).write.text(path)
    return trials.SharedTrialLog(spark, path).query(spark, "SELECT count(*) AS trials, round(avg(metrics['q']), 6) AS mean_q, round(max(metrics['q']), 6) AS best_q FROM trials")


@query("""
WITH t AS (SELECT user_id, arg_max(value, event_id) AS q, arg_max(event_type, event_id) AS size FROM events WHERE value IS NOT NULL GROUP BY user_id)
SELECT 'chunker' AS stage, 'fixed(size=' || size || ')' AS option, count(*) AS trials, round(avg(q) - (SELECT avg(q) FROM t), 6) AS quality FROM t GROUP BY size""")
def trial_options(spark, sf_dir):
    board = trials.Leaderboard(latest(trials.parsed(_log(spark, sf_dir)), "trial_id", "line"))
    return board.marginals("chunker", by="q").select("stage", "option", "trials", F.round("quality", 6).alias("quality"))


@query(f"""WITH {_TRACE}, m AS (SELECT trial_id, stage, sum(duration_ms) AS ms, bool_and(cache_hit) AS hit FROM t GROUP BY ALL)
SELECT trial_id, round(sum(ms), 6) AS latency_ms, round(sum(CASE WHEN stage = 'parse' THEN ms END), 6) AS parse_ms, bool_or(hit AND stage = 'parse') AS parse_hit FROM m GROUP BY trial_id""")
def trial_costs(spark, sf_dir):
    c = trials.trial_costs(_trace(spark, sf_dir))
    return c.select("trial_id", F.round(F.col("cost")["latency_ms"], 6).alias("latency_ms"), F.round(F.try_element_at("cost", F.lit("latency_ms.parse")), 6).alias("parse_ms"), F.coalesce(F.try_element_at("cache_hits", F.lit("parse")), F.lit(False)).alias("parse_hit"))
