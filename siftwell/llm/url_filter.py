"""URL filters with redirect equivalence.

A rule (verdict, host, path) fits the urls of its host and all subdomains whose
path starts with its path; the longest rule that fits decides, and between
equally long ones allow does.  A url that no rule fits takes the decision of its
equivalence class: connected components over redirect (meta refresh) and
canonical-link edges; it is blocked if any member of its class is blocked by a
rule, and allowed otherwise.  An explicit allow always stands.

Hosts and paths are parsed and rules matched natively; up to INLINE rules are
part of the plan, more are joined on the suffixes of the host.  Components are
found by distributed star contraction and never collected.

A link is resolved as RFC 3986 does, against the page's url or its <base href>:
dot segments are removed, a reference without a path stays on the page, and one
of another kind, such as mailto:, is none.  The node of a url is its host and its
path without dot segments, / where it is empty; queries and fragments are not
part of it.  Rules see a page's path as it is and a target's as it was resolved.

Defined results: a null url, or one without ://, has an empty host and path, no
rule, no class and is allowed; null html has no edges; html of any length is
searched whole; repeated rows repeat their result; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.shared import Scratch, connected_components, salted_join

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
INLINE = 200
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ://, or null."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"\A([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def _best_inline(host: Column, path: Column, rules) -> Column:
    """struct(size, allow, verdict, rule, ...) of the winning rule, or null."""
    table = F.array(*[F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(int(v == "allow")).alias("allow"), F.lit(v).alias("verdict"), F.lit(h + p).alias("rule"), F.lit(h).alias("h"), F.lit("." + h).alias("sub"), F.lit(p).alias("p")) for v, h, p in rules])
    return F.array_max(F.filter(table, lambda r: ((host == r["h"]) | F.endswith(host, r["sub"])) & F.startswith(path, r["p"])))


def _best_joined(pages: DataFrame, rules) -> DataFrame:
    """pages with best, by a join of host suffixes with the rules' hosts."""
    table = pages.sparkSession.createDataFrame([(h, p, v, len(h) + len(p), int(v == "allow")) for v, h, p in rules], "rule_host string, rule_path string, verdict string, size int, allow int")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    places = pages.select("host", "path").distinct().where("host <> ''")
    hit = places.withColumn("rule_host", F.explode(suffixes)).join(table, "rule_host").where("startswith(path, rule_path)")
    best = hit.groupBy("host", "path").agg(F.max(F.struct("size", "allow", "verdict", F.concat("rule_host", "rule_path").alias("rule"))).alias("best"))
    return pages.join(best, ["host", "path"], "left")


_ABSOLUTE, _OTHER = r"\A[A-Za-z][A-Za-z0-9+.\-]*://", r"\A[A-Za-z][A-Za-z0-9+.\-]*:"


def clean_path(path: Column) -> Column:
    """path without dot segments; / if it is empty."""
    segments = F.split(F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)), "/", -1)
    ends = F.element_at(segments, -1).isin(".", "..")
    held = F.aggregate(
        F.slice(segments, 2, F.size(segments)),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == ".", acc).otherwise(F.concat(acc, F.array(s))),
    )
    cleaned = F.concat(F.lit("/"), F.array_join(F.when(ends, F.concat(held, F.array(F.lit("")))).otherwise(held), "/"))
    return F.when(F.instr(path, "/.") > 0, cleaned).when(path == "", F.lit("/")).otherwise(path)


def resolved(host: Column, path: Column, ref: Column) -> Column:
    """struct(host, path) of a reference on the page at host and path; null if it leads to no url with a host."""
    absolute = F.when(ref.rlike(_ABSOLUTE), ref).when(ref.startswith("//"), F.concat(F.lit("x:"), ref))
    own = F.regexp_extract(ref, r"\A([^?#]*)", 1)
    merged = F.when(own == "", path).when(own.startswith("/"), own).otherwise(F.concat(F.regexp_replace(F.when(path == "", "/").otherwise(path), r"[^/]*\z", ""), own))
    there = F.struct(host_of(absolute).alias("host"), clean_path(path_of(absolute)).alias("path"))
    return F.when(absolute.isNotNull(), there).when(~ref.rlike(_OTHER), F.struct(host.alias("host"), clean_path(merged).alias("path")))


def node_name(host: Column, path: Column) -> Column:
    """What a url is called in its class; null without a host."""
    return F.when(host != "", F.concat(host, clean_path(path)))


def links(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): node names of each page (host, path, html) with a refresh or canonical link, and of its target."""
    head = F.coalesce(F.col("html").cast("string"), F.lit(""))
    tags = F.regexp_extract_all(head, F.lit(r"""(?is)<(?:link\b[^>]*\brel\s*=\s*["']?[^"'>]*\bcanonical\b|meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b|link\b[^>]*\bhref\s*=[^>]*\bcanonical\b)[^>]*>"""), F.lit(0))
    quoted = r"""(?is)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    refresh = r"""(?is)\burl\s*=\s*['"]?([^"'>\s;]+)"""
    href = lambda tag: F.trim(F.replace(F.concat(*[F.regexp_extract(tag, quoted, k) for k in (1, 2, 3)]), F.lit("&amp;"), F.lit("&")))
    base = href(F.regexp_extract(head, r"(?is)<base\b[^>]*\bhref\b[^>]*>", 0))
    tag = pages.where((F.col("host") != "") & F.lower(head).rlike("canonical|http-equiv")).select("host", "path", base.alias("base"), F.explode(tags).alias("tag"))
    target = F.when(F.lower("tag").startswith("<meta"), F.trim(F.replace(F.regexp_extract("tag", refresh, 1), F.lit("&amp;"), F.lit("&")))).otherwise(href(F.col("tag")))
    # written after each step, so that its expressions are not repeated in each of those of the next
    found = scratch.keep(tag.select("host", "path", "base", target.alias("href")), "links").where("href <> ''")
    seen = F.coalesce(resolved(F.col("host"), F.col("path"), F.col("base")), F.struct("host", "path"))
    found = scratch.keep(found.select("host", "path", "href", seen.alias("seen")), "seen")
    found = scratch.keep(found.select("host", "path", resolved(F.col("seen.host"), F.col("seen.path"), F.col("href")).alias("to")), "urls")
    edges = found.select(node_name(F.col("host"), F.col("path")).alias("a"), node_name(F.col("to.host"), F.col("to.path")).alias("b"))
    return edges.where("a <> b").distinct()


def judge(pages: DataFrame, rules=RULES, inline: int = INLINE) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row of pages (page_id, url, html)."""
    scratch = Scratch(pages.sparkSession)
    url = F.col("url").cast("string")
    base = pages.select("page_id", "html", host_of(url).alias("host"), path_of(url).alias("path"))
    thin = scratch.keep(base.select("page_id", "host", "path"), "thin")
    if not rules:
        rated = thin.withColumn("best", F.lit(None).cast("struct<size:int,allow:int,verdict:string,rule:string>"))
    else:
        rated = thin.withColumn("best", _best_inline(F.col("host"), F.col("path"), rules)) if len(rules) <= inline else _best_joined(thin, rules)
    rated = rated.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("ruled"))
    edges = scratch.keep(links(base, scratch), "edges")
    if edges.limit(1).count() == 0:
        return rated.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"))
    # 128 bits: no two of a web of urls are taken for one
    node = lambda c: F.md5(F.encode(c, "UTF-8"))
    classes = scratch.keep(connected_components(edges.select(node(F.col("a")).alias("u"), node(F.col("b")).alias("v")), scratch, "classes", kind="string"), "classed").select(F.col("id").alias("node"), "component")
    # targets that are not pages count too: a rule may block them
    names = edges.select(F.col("a").alias("name")).unionByName(edges.select(F.col("b").alias("name"))).distinct()
    places = names.select(node(F.col("name")).alias("node"), F.regexp_extract("name", r"\A([^/]*)", 1).alias("host"), F.regexp_extract("name", r"\A[^/]*(.*)", 1).alias("path"))
    places = places.withColumn("best", _best_inline(F.col("host"), F.col("path"), rules)) if rules and len(rules) <= inline else _best_joined(places, rules) if rules else places.withColumn("best", F.lit(None).cast("struct<verdict:string>"))
    named = rated.withColumn("node", node(node_name(F.col("host"), F.col("path"))))
    # a page's own path may have dot segments, by which its rule may differ from that of its node
    block = places.where("best.verdict = 'block'").select("node").unionByName(named.where("ruled = 'block'").select("node"))
    blocked = scratch.keep(classes.join(block.distinct(), "node").select("component").distinct(), "blocked")
    aliases = scratch.keep(salted_join(classes, blocked, ["component"], "node").select("node", F.lit("block").alias("told")), "aliases")
    # many pages may have one url
    out = salted_join(named, aliases, ["node"], "page_id", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", "told", F.lit("allow")).alias("verdict"))


def _clean_sql(path: str) -> str:
    """clean_path in DuckDB, for a column."""
    segments = f"string_split(CASE WHEN starts_with({path}, '/') THEN {path} ELSE '/' || {path} END, '/')"
    held = f"list_reduce(list_transform({segments}[2:], lambda s: [s]), lambda acc, s: CASE s[1] WHEN '..' THEN acc[1:len(acc) - 1] WHEN '.' THEN acc ELSE acc || s END, []::VARCHAR[])"
    return f"CASE WHEN {path} = '' THEN '/' ELSE '/' || array_to_string({held} || CASE WHEN {segments}[-1] IN ('.', '..') THEN [''] ELSE [] END, '/') END"


def _resolved_sql(ref: str, host: str, path: str) -> tuple[str, str]:
    """Host and path, with its dot segments, of a reference in DuckDB."""
    own = f"regexp_extract({ref}, '^([^?#]*)', 1)"
    absolute = f"regexp_matches({ref}, '^([A-Za-z][A-Za-z0-9+.-]*:)?//')"
    there = f"CASE WHEN {absolute} THEN translate(regexp_extract({ref}, '//([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') WHEN NOT regexp_matches({ref}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {host} END"
    at = f"CASE WHEN {absolute} THEN regexp_extract({ref}, '//[^/?#]*([^?#]*)', 1) WHEN {own} = '' THEN {path} WHEN starts_with({own}, '/') THEN {own} ELSE regexp_extract(CASE {path} WHEN '' THEN '/' ELSE {path} END, '^(.*/)', 1) || {own} END"
    return there, at


def oracle_sql(rules=RULES, pages: str = "pages", before: str = "") -> str:
    """The same in DuckDB; blocks spread by reachability.  before: CTEs that pages may need."""
    rule_rows = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    href = """(?is)\\b(?:href|url)\\s*=\\s*["'']?([^"''>\\s;]+)"""
    base_host, base_path = _resolved_sql("base", "host", "path")
    to_host, to_path = _resolved_sql("href", "seen_host", "seen_path")
    fits = "(b.host = h OR ends_with(b.host, '.' || h)) AND starts_with(b.path, p)"
    return f"""
    WITH RECURSIVE {before} rules(v, h, p) AS (VALUES {rule_rows}),
    base AS (
      SELECT page_id, coalesce(html, '') AS html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM {pages}),
    placed AS (
      SELECT page_id, html, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
        coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM base),
    places AS (SELECT DISTINCT host, path FROM placed),
    best AS (
      SELECT host, path, arg_max(h || p, length(h || p) * 2 + (v = 'allow')::INT) AS rule, arg_max(v, length(h || p) * 2 + (v = 'allow')::INT) AS ruled
      FROM places b, rules WHERE {fits} GROUP BY host, path),
    tags AS (
      SELECT host, path, regexp_extract(regexp_extract(html, '(?is)<base[^>]*href[^>]*>'), '{href}', 1) AS base,
        regexp_extract(unnest(regexp_extract_all(html, '(?is)<link[^>]*canonical[^>]*>|<meta[^>]*http-equiv[^>]*refresh[^>]*>')), '{href}', 1) AS href
      FROM placed WHERE host <> '' AND (html ILIKE '%canonical%' OR html ILIKE '%http-equiv%')),
    seen AS (SELECT host, path, href, coalesce({base_host}, host) AS seen_host, {base_path} AS seen_raw FROM tags WHERE href <> ''),
    from_base AS (SELECT host, path, href, seen_host, {_clean_sql("seen_raw")} AS seen_path FROM seen),
    targets AS (SELECT host, path, {to_host} AS to_host, {to_path} AS to_raw FROM from_base),
    edges AS (SELECT host || {_clean_sql("path")} AS a, to_host || {_clean_sql("to_raw")} AS b, to_host, {_clean_sql("to_raw")} AS to_path FROM targets WHERE to_host <> ''),
    both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
    aimed AS (SELECT b.name, arg_max(v, length(h || p) * 2 + (v = 'allow')::INT) AS ruled FROM (SELECT DISTINCT b AS name, to_host AS host, to_path AS path FROM edges) b, rules WHERE {fits} GROUP BY b.name),
    named AS (SELECT page_id, host, path, CASE WHEN host <> '' THEN host || {_clean_sql("path")} END AS name FROM placed),
    reach(node) AS (SELECT n.name FROM named n JOIN best USING (host, path) WHERE ruled = 'block' UNION SELECT name FROM aimed WHERE ruled = 'block' UNION SELECT b FROM reach JOIN both_ways ON a = node)
    SELECT n.page_id, n.host, n.path, r.rule, coalesce(r.ruled, CASE WHEN n.name IN (SELECT node FROM reach WHERE node IS NOT NULL) THEN 'block' END, 'allow') AS verdict
    FROM named n LEFT JOIN best r USING (host, path)"""
