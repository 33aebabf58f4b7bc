import html
import os
import random
import re

import pytest

from siftwell.llm import html_extract as hx


def test_generated_pages(sf01):
    rows = hx.extract(sf01("pages")).collect()
    source = {r.page_id: r.html for r in sf01("pages").collect()}
    assert len(rows) == len(source)
    for r in rows:
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", source[r.page_id], re.S)[1]
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", article)).split()) and r.n_chars == len(r.text)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain", "plain"), ("<p>a<b>b</b>c<p>d", "abc d"), ("<article>x<script>if (a<b) '</p>'</script><style>p{}</style>y</article>z", "xy"),
        ("<header><h1>Site</h1></header><nav>m</nav><main><header><h1>Title</h1></header><p>A &amp; B&nbsp;&#67;</p><aside>s</aside><form><input><p>f</p></form><!-- <p>no</p> --><div class='ad'>buy</div></main><footer>c</footer>", "Title A & B C"),
        ("<article><p>one<div class=\"post-comments\"><p>two</p></div><p id=cookie-notice>x</p><p>three</article><div id=comments>four</div>", "one three"),
        ("<article><p>cut off <a hre", "cut off"), ("<article>1 < 2 and a&lt;b</article>", "1 < 2 and a<b"), ("<article><p class=readable>kept</p><p class=loading>kept too</p></article>", "kept kept too"),
        ("<ARTICLE><H1>T</H1>\n<UL><LI>a\n  b<LI>c</UL></ARTICLE>", "T a b c"), ("<article><textarea>no</textarea><noscript>no</noscript><p hidden>no</p><p style='display: none'>no</p>yes</article>", "yes"),
        ("<div><p>a</span></p></div><p>b", "a b"), ("<article><p data-id='ad' title='class=ad hidden'>kept</p><p class=\"x AD\">no</p></article>", "kept"), ("<article><table><tr><td>a<td>b</table>c<br>d<br/>e</article>", "a b c d e"),
    ],
)
def test_pages(page, text):
    assert " ".join(hx.lines(page or "")[0]) == text


def test_undecided_lines_shared_with_the_nearest_page_go(spark):
    page = lambda *lines: "<body>" + "".join(f"<div>{x}</div>" for x in lines) + "</body>"
    rows = [
        (1, "http://h/a/1", page("Site", "one", "Legal")), (2, "http://h/a/2", page("Site", "two", "Legal")), (3, "http://h/z/1", page("Other", "three", "End")), (4, "http://h/z/2", page("Other", "four", "End")),
        (5, "http://alone/", page("Site", "five")), (6, None, page("six")), (7, "http://h/a/3", "<article><p>Site</p></article>"), (7, "http://h/a/3", "<article><p>Site</p></article>"), (8, "http://h/a/9", None),
    ]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, lines int")
    got = sorted((r.page_id, r.text, r.n_chars) for r in hx.extract(df).collect())
    assert [(i, t) for i, t, _ in got] == [(1, "one"), (2, "two"), (3, "three"), (4, "four"), (5, "Site five"), (6, "six"), (7, "Site"), (7, "Site"), (8, "")]
    assert hx.extract(df.limit(0)).collect() == []


def test_copies_of_an_undecided_page_keep_its_text(spark):
    page = lambda *lines: "<body>" + "".join(f"<div>{x}</div>" for x in lines) + "</body>"
    one, two, lone = page("Site", "one", "Legal"), page("Site", "two", "Legal"), page("Site", "alone")
    rows = [
        (1, "http://h/a/1", one), (2, "http://h/a/1?q=2", one), (3, "https://h/a/1", one), (1, "http://h/a/1", one), (4, "http://h/a/2", two), (5, "http://h/m/1", one),
        (6, "http://x/1", lone), (7, "http://x/1?p", lone), (8, None, one), (9, None, one), (10, "http://z/1", None), (11, "http://z/2", None),
    ]
    got = sorted((r.page_id, r.text) for r in hx.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == [(1, "one"), (1, "one"), (2, "one"), (3, "one"), (4, "two"), (5, "one"), (6, "Site alone"), (7, "Site alone"), (8, "Site one Legal"), (9, "Site one Legal"), (10, ""), (11, "")]


def longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@pytest.mark.parametrize("partitions", ["1", "5", "40"])
def test_differencing_of_a_large_host_by_brute_force(spark, sf01, partitions):
    pages = [(r.page_id, "http://one.host/" + r.url.split("/", 3)[-1] if r.page_id % 3 else r.url, re.sub(r"(?i)<(/?)(?:article|main)\b", r"<\1div", r.html)) for r in sf01("pages").collect()]
    pages += [(10**6 + i, u, h) for i, u, h in pages[:20]]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r.page_id: r.text for r in hx.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    hosts = {}
    for i, u, h in pages:
        host, _, rest = u.split("://", 1)[1].partition("/")
        hosts.setdefault(host.lower(), {}).setdefault(tuple(hx.lines(h)[0]), []).append((re.split(r"[?#]", "/" + rest)[0], i))
    compared = 0
    for distinct in hosts.values():
        row = sorted((min(at), own, at) for own, at in distinct.items())
        for k, ((path, _), own, at) in enumerate(row):
            near = [len(os.path.commonprefix([path, row[j][0][0]])) if 0 <= j < len(row) else -1 for j in (k - 1, k + 1)]
            other = row[k - 1][1] if near[0] >= near[1] and near[0] >= 0 else row[k + 1][1] if near[1] >= 0 else ()
            kept = [x for j, x in enumerate(own) if j not in hx.common(list(own), list(other))]
            assert len(own) - len(kept) == longest(own, other)
            compared += len(own) > len(kept)
            assert {got[i] for _, i in at} == {" ".join(kept)}
    assert compared


def test_common_is_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(1500):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(12))] for _ in range(2))
        taken = [a[i] for i in sorted(hx.common(a, b))]
        rest = iter(b)
        assert len(taken) == longest(a, b) and all(x in rest for x in taken)


def test_a_very_long_page():
    page = "<article>" + "<p>some text here</p>" * 50_000 + "</article>"
    assert len(hx.lines(page)[0]) == 50_000
    a, b = [1, 2] * 10_000 + list(range(5)), [2, 1] * 9_000 + [7, 3]
    assert len(hx.common(a, b)) == 18_001


def test_articles_are_differenced_and_their_own_lines_put_back(spark):
    """Pages that mark an article went past differencing; a notice of no known name inside it stayed."""
    page = lambda title, *more: f"<article><h1>{title}</h1><p>text of {title}</p><p>and more of it</p>{''.join(more)}<p>Licence</p></article>"
    notice, own = "<div class='k7'><p>Read on</p><ul><li>our stories</li></ul></div>", "<div id=q><p>Licence</p><p>only here</p></div>"
    rows = [
        (1, "http://h/a/1", page("one", notice)), (2, "http://h/a/2", page("two", notice, own)), (3, "http://h/a/3", page("three", own.replace("here", "there"))), (4, "http://alone/", page("four", notice)), (5, None, page("five", notice)),
        (6, "http://c/1", "<main><div class=x><p>same</p><p>same too</p></div><h1>A</h1></main>"), (7, "http://c/2", "<main><div class=x><p>same</p><p>same too</p></div><h1>B</h1></main>"),
        (8, "http://d/1", "<main><p>a</p><p>b</p><div class=x>c</div></main>"), (9, "http://d/2", "<main><p>a</p><p>b</p><div class=x>c</div><p>longer</p></main>"),
        (10, "http://h/a/4", "<div>Licence</div><div>open</div>"), (11, "http://h/a/1?q", page("one", notice)), (11, "http://h/a/1?q", page("one", notice)), (12, "http://h/a/12", page("one", "<div><p>Read on</p><ul><li>our stories</li></ul></div>")),
    ]
    article = lambda title, more="": f"{title} text of {title} and more of it {more}Licence"
    want = [
        (1, article("one")), (2, article("two", "Licence only here ")), (3, article("three", "Licence only there ")), (4, article("four", "Read on our stories ")), (5, article("five", "Read on our stories ")),
        (6, "same same too A"), (7, "same same too B"), (8, "a b c"), (9, "a b longer"), (10, "Licence open"), (11, article("one")), (11, article("one")), (12, article("one", "Read on our stories ")),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for few in (hx.BROADCAST_PAGES, 0):
        before, hx.BROADCAST_PAGES = hx.BROADCAST_PAGES, few
        try:
            assert sorted((r.page_id, r.text) for r in hx.extract(df).collect()) == want
        finally:
            hx.BROADCAST_PAGES = before


def test_every_page_meets_its_neighbour(spark, sf01):
    """No page was paired where each marked its article; now all with a host are, by the lines of their articles."""
    kept = []
    inner = hx._differenced
    hx._differenced = lambda *given: kept.append(inner(*given)) or kept[-1]
    try:
        hx.extract(sf01("pages"))
    finally:
        hx._differenced = inner
    rows = kept[0].where("sure").collect()
    assert sum(1 for r in rows) >= 240 and any(not all(r.keep) for r in rows)
