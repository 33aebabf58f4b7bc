import re

import duckdb
import pytest

from siftwell.llm import queries
from siftwell.llm import url_filter as uf


def plain(url):
    rest = url[url.find("://") + 3 :] if url and "://" in url else None
    if rest is None:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule_of(host, path):
    fits = [(len(h) + len(p), v == "allow", v, h + p) for v, h, p in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, None)


def test_pages_without_links_follow_the_rules(sf01):
    got = {r.page_id: tuple(r)[1:] for r in uf.judge(sf01("pages")).collect()}
    for r in sf01("pages").select("page_id", "url").collect():
        host, path = plain(r.url)
        verdict, rule = rule_of(host, path)
        assert got[r.page_id] == (host, path, rule, verdict or "allow")


ROWS = [
    (1, "http://A.de/x", '<head><link rel="canonical" href="http://spam.com/de/1"></head>'), (2, "http://spam.com/de/1", None), (3, "http://q.org/", '<meta http-equiv="refresh" content="0; url=http://a.de/x">'),
    (4, "http://b.net/y", "<LINK href=/z rel=canonical>"), (5, None, None), (6, "http://b.net/z?q", "x"), (7, "http://c.net/", "<link rel=canonical href='http://a.de/x?utm=1'>"), (8, "no scheme", "<link rel=canonical href=//spam.com/de/1>"),
    (9, "http://d.net/a/b", '<link rel="canonical" href="c">'), (10, "http://d.net/a/c", '<link rel="canonical" href="http://unseen.com/de/9">'), (10, "http://d.net/a/c", "again"), (11, "http://x.org?y", ""), (12, "ftp://u@H.com:80/fr/#z", None), (13, "http://com/fr/", None),
]


@pytest.mark.parametrize("inline", [200, 0])
def test_aliases_of_blocked_urls_are_blocked_unless_allowed(spark, inline):
    df = spark.createDataFrame([(*r, "h", "p") for r in ROWS], "page_id long, url string, html string, host string, path string")
    rows = uf.judge(df, inline=inline).collect()
    assert len(rows) == len(ROWS)
    verdicts = {r.page_id: r.verdict for r in rows}
    assert verdicts == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "block", 8: "allow", 9: "block", 10: "block", 11: "allow", 12: "allow", 13: "allow"}
    by = {r.page_id: r for r in rows}
    assert (by[12].host, by[12].path, by[12].rule) == ("u@h.com:80", "/fr/", None) and by[13].rule == "com/fr/" and (by[11].host, by[11].path, by[11].rule) == ("x.org", "", None)
    assert uf.judge(df.limit(0)).collect() == []


def test_oracle(spark, tmp_path):
    rows = [r for r in ROWS if r[0] in (1, 2, 3, 5, 7, 11, 12, 13)]
    con = duckdb.connect()
    con.execute("create table pages(page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", rows)
    got = sorted(map(tuple, uf.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()))
    assert got == sorted(con.sql(uf.oracle_sql()).fetchall())


def test_classes_of_invented_redirects(spark, sf01):
    con = duckdb.connect()
    con.execute("create view pages as select * from '/root/testdata/sf0.01/pages.parquet'")
    got = sorted(map(repr, map(tuple, queries.url_redirect_classes(spark, "/root/testdata/sf0.01").collect())))
    assert got == sorted(map(repr, con.sql(queries.ORACLE_SQL["url_redirect_classes"]).fetchall()))
    plain = {r.page_id: r.verdict for r in uf.judge(sf01("pages")).collect()}
    changed = sum(f"'{v}')" not in x for x, v in zip(sorted(got), [plain[int(re.match(r"\((\d+)", x)[1])] for x in sorted(got)], strict=True))
    assert changed > 0


def test_very_long_html(spark):
    page = "<p>x</p>" * 200_000 + '<link rel="canonical" href="http://spam.com/de/1">' + "<p>y</p>" * 200_000
    df = spark.createDataFrame([(1, "http://a.de/x", page), (2, "http://a.de/y", "z" * 10**6)], "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in uf.judge(df).collect()} == {1: "block", 2: "allow"}


def test_longest_rule_wins_and_allow_wins_ties(spark):
    rules = [("block", "a.com", "/x"), ("allow", "a.com", "/x"), ("block", "a.com", "/x/y"), ("allow", "s.a.com", "/x/y")]
    df = spark.createDataFrame([(1, "http://a.com/x"), (2, "http://a.com/x/y"), (3, "http://s.a.com/x/y"), (4, "http://ba.com/x")], "page_id long, url string")
    df = df.selectExpr("*", "cast(null as string) html")
    for inline in (200, 0):
        assert {r.page_id: (r.verdict, r.rule) for r in uf.judge(df, rules, inline).collect()} == {1: ("allow", "a.com/x"), 2: ("block", "a.com/x/y"), 3: ("allow", "s.a.com/x/y"), 4: ("allow", None)}


def test_references_are_resolved_as_rfc_3986_does(spark):
    from pyspark.sql import functions as F

    cases = [
        ("a.net", "", "x.html", "a.net", "/x.html"), ("b.net", "/d/e", "../q", "b.net", "/q"), ("b.net", "/d/p", "?v=1", "b.net", "/d/p"), ("b.net", "/d/p", "#x", "b.net", "/d/p"), ("b.net", "/d/p", "", "b.net", "/d/p"), ("b.net", "", "?v", "b.net", "/"),
        ("b.net", "/d/p", "./", "b.net", "/d/"), ("b.net", "/d/p", "..", "b.net", "/"), ("b.net", "/d/p", "../../../g", "b.net", "/g"), ("b.net", "/d/p", "/a/./b/../c", "b.net", "/a/c"), ("b.net", "/d/p", "//H.com", "h.com", "/"), ("b.net", "/d/p", "HTTPS://H.com/a/..", "h.com", "/"),
        ("b.net", "/d/p", "g?u=http://x.y/", "b.net", "/d/g"), ("b.net", "/d/p", "mailto:a@b", None, None), ("b.net", "/d/p", "g/...", "b.net", "/d/g/..."), ("b.net", "/d//p", "../g", "b.net", "/d/g"),
    ]
    df = spark.createDataFrame([c[:3] for c in cases], "host string, path string, ref string")
    got = [tuple(r) for r in df.select("host", "path", "ref", uf.resolved(F.col("host"), F.col("path"), F.col("ref")).alias("r")).select("host", "path", "ref", "r.host", "r.path").collect()]
    assert got == cases


def test_relative_links_join_the_right_pages(spark):
    rows = [
        (1, "http://a.net", '<link rel=canonical href="x.html">'), (2, "http://a.net/x.html", None), (3, "http://a.netx.html/", None), (4, "http://b.net/d/e", '<meta http-equiv=refresh content="0;url=../q">'), (5, "http://b.net/q", None),
        (6, "http://c.net/d/p", '<link rel=canonical href="?v=1">'), (7, "http://c.net/d/", None), (8, "http://c.net/d/r", '<link rel=canonical href="#x">'), (9, "http://e.net/1/2", '<base href="//b.net/z/"><link rel="canonical" href="../q">'),
        (10, "http://f.net/", "<link rel=canonical href='mailto:x@b.net'>"), (11, "http://b.net/d/../q", None), (12, "http://g.net/a/../b", "<link rel=canonical href=/c>"), (13, "http://g.net/c", None),
    ]
    rules = [("block", "a.net", "/x"), ("block", "b.net", "/q"), ("block", "c.net", "/d/r"), ("block", "g.net", "/a")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    verdicts = {r.page_id: r.verdict for r in uf.judge(df, rules).collect()}
    blocked = {1, 2, 4, 5, 8, 9, 11, 12, 13}
    assert {k for k, v in verdicts.items() if v == "block"} == blocked
    con = duckdb.connect()
    con.execute("create table pages(page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", rows)
    assert sorted(map(repr, map(tuple, uf.judge(df, rules).collect()))) == sorted(map(repr, con.sql(uf.oracle_sql(rules)).fetchall()))


def test_relative_classes(spark):
    con = duckdb.connect()
    con.execute("create view pages as select * from '/root/testdata/sf0.001/pages.parquet'")
    got = sorted(map(repr, map(tuple, queries.url_relative_classes(spark, "/root/testdata/sf0.001").collect())))
    assert got == sorted(map(repr, con.sql(queries.ORACLE_SQL["url_relative_classes"]).fetchall())) and sum("'block'" in x for x in got) > 5
