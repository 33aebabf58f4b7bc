"""The queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import bpe, chat_format, decontaminate, fill_middle, html_extract, language, lm_score, merkle, minhash, ngram_join, quality, simhash, url_filter

#: the vocabulary that op7 encodes with; its file's path is a parameter of the operator
TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.repaired(_table(spark, sf_dir, "conversations"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_table(spark, sf_dir, "documents"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest, and the roots that follow when half of the texts lose their line feeds."""
    docs = _table(spark, sf_dir, "documents").select(*merkle.FIELDS)
    other = [F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in merkle.FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, merkle.leaf(other))
    rows = merkle.manifest(docs.withColumn("tampered", tampered), carried=("tampered",))
    told = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256"), merkle.folded(F.coalesce("tampered", "leaf"), F.col("proof")).alias("folded_root"))
    return told.select("*", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_middle.transformed(_table(spark, sf_dir, "documents"))
    text = fill_middle.restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


def url_redirect_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8 over all pages, of which every second and third gets a canonical or a refresh link to the page before it."""
    pages = _table(spark, sf_dir, "pages")
    before = pages.select((F.col("page_id") + 1).alias("page_id"), F.col("url").alias("target"))
    link = F.when(F.col("page_id") % 3 == 1, F.concat(F.lit('<link rel="canonical" href="'), "target", F.lit('">'))).when(F.col("page_id") % 3 == 2, F.concat(F.lit('<meta http-equiv="refresh" content="0; url='), "target", F.lit('">')))
    return url_filter.judge(pages.join(before, "page_id", "left").withColumn("html", F.concat(F.coalesce(link, F.lit("")), "html")))


#: relative links of the kinds that a url may be written in
_RELATIVE = "CASE page_id % 6 WHEN 0 THEN '../de/1' WHEN 1 THEN '?v=2' WHEN 2 THEN '#x' WHEN 3 THEN concat('./x/../', page_id) WHEN 4 THEN '//Example.org/en/1' ELSE 'mailto:a@b.com' END"


def url_relative_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8 over all pages, each with a relative link and every seventh with a base of its own."""
    pages = _table(spark, sf_dir, "pages")
    base = F.expr("""CASE WHEN page_id % 7 = 0 THEN '<base href="/fr/../de/">' ELSE '' END""")
    return url_filter.judge(pages.withColumn("html", F.concat(base, F.lit('<link rel="canonical" href="'), F.expr(_RELATIVE), F.lit('">'), "html")))


def page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10 over all pages without their article marks, so that differencing decides on every line."""
    pages = _table(spark, sf_dir, "pages")
    return html_extract.extract(pages.withColumn("html", F.regexp_replace("html", r"(?i)<(/?)(?:article|main)\b", "<$1div")))


def fingerprint_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of equal fingerprints within six bits of a document whose id is divisible by 100."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    prints = simhash.fingerprints(docs, ["doc_id"])
    return simhash.within(prints, prints.where("doc_id % 100 = 0"), 6)


QUERIES = {
    f.__name__: f
    for f in (op1_ngram_join, op2_language_id, op3_quality, op4_chat_format, op5_decontaminate, op6_simhash, op7_bpe, op8_url_filter, op9_lm_score, op10_html_extract, op11_merkle, op12_minhash, op13_fill_middle, url_redirect_classes, url_relative_classes, page_differencing, fingerprint_classes)
}
_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _near_sql(k: int, more: str = "") -> str:
    """Components of the documents that link by k-word shingles at 0.8."""
    return f"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x20\x09-\x0D]+') AS t FROM documents),
    k AS (SELECT doc_id, t, unnest(range(1, CASE WHEN len(t) >= {k} THEN len(t) - {k - 2} WHEN len(t) > 0 THEN 2 ELSE 1 END)) AS k FROM w),
    s AS (SELECT DISTINCT doc_id, array_to_string(t[k:k + {k - 1}], ' ') AS g FROM k),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * o >= 80 * (nx.n + ny.n - o)),
    ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
    reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, y FROM reach r JOIN ways ON r.other = x)
    SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other)::BIGINT AS component_id{more} FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id"""


def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    bits = f"list_transform(range(8 * length({text})), lambda j: CASE WHEN j % 8 = 0 THEN ascii(substr({text}, (j // 8 + 1)::INT, 1)) ELSE 0 END::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384)))"


def _leaf_sql(text: str) -> str:
    told = lambda c: f"coalesce(strlen({c}) || ':' || {c}, '-')"
    return f"sha256({' || '.join([told('doc_id::VARCHAR'), told('source'), told('lang'), told('n_chars::VARCHAR'), told(text)])})"


_MERKLE_SQL = f"""
    WITH RECURSIVE docs AS (
      SELECT doc_id, source, {_leaf_sql("text")} AS leaf, CASE WHEN {_crc32_sql("doc_id::VARCHAR")} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} END AS other FROM documents),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM docs),
    nodes(source, level, place, digest, n) AS (
      SELECT source, 0, place, leaf, n FROM ranked
      UNION ALL SELECT source, level + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (n + 2) // 3 FROM nodes WHERE n > 1 GROUP BY source, level, n, place // 3),
    subroots AS (SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1),
    tops(level, place, digest, n) AS (
      SELECT 0, place, subroot, n FROM subroots
      UNION ALL SELECT level + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (n + 2) // 3 FROM tops WHERE n > 1 GROUP BY level, n, place // 3),
    low AS (
      SELECT source, level, place, n, coalesce(lag(digest, 2) OVER w, '') || coalesce(lag(digest) OVER w, '') AS before, coalesce(lead(digest) OVER w, '') || coalesce(lead(digest, 2) OVER w, '') AS after
      FROM nodes WINDOW w AS (PARTITION BY source, level, place // 3 ORDER BY place)),
    high AS (
      SELECT level, place, n, coalesce(lag(digest, 2) OVER w, '') || coalesce(lag(digest) OVER w, '') AS before, coalesce(lead(digest) OVER w, '') || coalesce(lead(digest, 2) OVER w, '') AS after
      FROM tops WINDOW w AS (PARTITION BY level, place // 3 ORDER BY place)),
    up(source, leaf_place, level, place, own, told) AS (
      SELECT source, place, 0, place, coalesce(other, leaf), '' FROM ranked
      UNION ALL SELECT u.source, leaf_place, u.level + 1, u.place // 3, sha256(before || own || after), told || before || after
      FROM up u JOIN low l ON l.source IS NOT DISTINCT FROM u.source AND l.level = u.level AND l.place = u.place AND l.n > 1),
    inside AS (SELECT source, leaf_place, arg_max(own, level) AS own, arg_max(told, level) AS told FROM up GROUP BY source, leaf_place),
    over(source, leaf_place, level, place, own, told) AS (
      SELECT i.source, leaf_place, 0, s.place, own, told FROM inside i JOIN subroots s ON s.source IS NOT DISTINCT FROM i.source
      UNION ALL SELECT o.source, leaf_place, o.level + 1, o.place // 3, sha256(before || own || after), told || before || after
      FROM over o JOIN high h ON h.level = o.level AND h.place = o.place AND h.n > 1),
    proved AS (SELECT source, leaf_place, arg_max(own, level) AS folded_root, sha256(arg_max(told, level)) AS proof_sha256 FROM over GROUP BY source, leaf_place)
    SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
    FROM ranked r JOIN proved p ON p.source IS NOT DISTINCT FROM r.source AND p.leaf_place = r.place
    JOIN subroots s ON s.source IS NOT DISTINCT FROM r.source, (SELECT digest AS root FROM tops WHERE n = 1)"""

_FILL_SQL = """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
    h AS (SELECT doc_id, t, n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
    c AS (
      SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
    p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
      sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256, sha256(t) AS restored_sha256
    FROM p"""

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_join": _near_sql(5),
    "op11_merkle": _MERKLE_SQL,
    "op12_minhash": _near_sql(4, ", doc_id = min(other) AS kept"),
    "op13_fill_middle": _FILL_SQL,
    "op5_decontaminate": f"""
    WITH d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM documents),
    i AS (SELECT item_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM benchmark WHERE item_id IS NOT NULL),
    k AS (SELECT item_id, t, least(len(t), 10) AS size, unnest(range(1, len(t) - least(len(t), 10) + 2)) AS k FROM i WHERE len(t) > 0),
    win AS (SELECT DISTINCT item_id, size, array_to_string(t[k:k + size - 1], ' ') AS g FROM k),
    places AS (SELECT doc_id, t, size, unnest(range(1, len(t) - size + 2)) AS p FROM d, (SELECT DISTINCT size FROM win) WHERE len(t) >= size),
    hits AS (SELECT doc_id, p, places.size AS size, item_id FROM places JOIN win ON win.size = places.size AND win.g = array_to_string(t[p:p + places.size - 1], ' ')),
    covered AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM hits) GROUP BY doc_id),
    named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
    SELECT doc_id, len(t)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(m.n, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
    FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN named m USING (doc_id)""",
    "op8_url_filter": url_filter.oracle_sql(),
    "url_redirect_classes": url_filter.oracle_sql(
        pages="linked",
        before="""linked AS (
      SELECT p.page_id, p.url, CASE p.page_id % 3 WHEN 1 THEN '<link rel="canonical" href="' || t.url || '">' WHEN 2 THEN '<meta http-equiv="refresh" content="0; url=' || t.url || '">' ELSE '' END || p.html AS html
      FROM pages p LEFT JOIN pages t ON t.page_id = p.page_id - 1),""",
    ),
    "url_relative_classes": url_filter.oracle_sql(
        pages="linked",
        before=f"""linked AS (
      SELECT page_id, url, CASE WHEN page_id % 7 = 0 THEN '<base href="/fr/../de/">' ELSE '' END || '<link rel="canonical" href="' || {_RELATIVE} || '">' || html AS html FROM pages),""",
    ),
}
