"""HTML extraction by nearest-url page differencing.

A page is cut into text lines at block elements.  What the markup itself names
as no part of an article (menus, page headers, footers, sidebars, notices,
adverts, forms, scripts, styles, comments) is left out.  Pages of one host are
paired by url path, their lines aligned by longest common subsequence, and
shared lines deleted.  Pages of a host with the same lines (mirrors, other
query strings, repeated rows) are one page at the first of their paths, and all
get its text.

Lines of a page with an article or main element are those inside it, and such
pages are paired with each other.  Real articles share lines (licences,
repeated sentences), so a check of what was deleted follows there: the markup
must set it apart.  A shared line goes only with its block, an element with a
class or an id inside the article, all of whose lines are shared and which
holds less than half of the article's; others are put back, and so is
everything where a page has no line of its own (a copy).

Pages are paired by their line hashes.  Defined results: null
html is empty; a page alone on its host keeps its undecided lines; a page whose
two neighbours share as much of its path is paired with the one before it;
cut-off tags and references are text up to where they break; html of any length
is read whole, and differencing takes memory of its lines' number to the power
1.5, in bits; repeated rows repeat their result; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import os
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from siftwell.llm.shared import Scratch, salted_join, spread
from siftwell.llm.url_filter import host_of, path_of

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|math|iframe|object|textarea|select|title|canvas|audio|video)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:/>|>.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<(?P<end>/)?(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(?P<loose>/)?(?P<loose_name>[a-zA-Z][a-zA-Z0-9:-]*)[^<>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z0-9]+")
#: fixed values: elements and names that markup gives to what is no part of an article
_DROP = frozenset("nav footer aside form button dialog menu label input fieldset datalist".split())
_NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promos promotion banner banners nav navbar navigation menu menus "
    "breadcrumb breadcrumbs sidebar sidebars footer footers masthead comment comments disqus replies respond cookie cookies consent gdpr notice notices popup popups modal "
    "overlay newsletter subscribe subscription signup share sharing social related recommended recommendations widget widgets toolbar pagination pager login search skip".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
_BLOCK = frozenset(
    "address article blockquote body br caption center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html li main ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = _BLOCK - {"br"}
#: elements that hold others and, with a class or an id, set a part of an article apart
_HOLDS = frozenset("details div dl figure ol section table ul".split())


def _noise(name: str, attrs: str, inside: bool) -> bool:
    if name in _DROP or (name == "header" and not inside):
        return True
    if not attrs or name in ("html", "body", "main"):
        return False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden":
            return True
        if key == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if key == "role" and value.strip() in _ROLES:
            return True
        if key in ("class", "id"):
            words = set(_WORD.findall(value))
            if words & _NAMED or (words & {"header", "headers"} and not inside):
                return True
    return False


def lines(page: str) -> tuple[list[str], bool]:
    """Text lines of a page's article, and whether the markup marks the article."""
    return placed_lines(page)[:2]


def placed_lines(page: str) -> tuple[list[str], bool, list[int]]:
    """lines, and the innermost block of the article in which each of them stands; -1 outside all."""
    inside_article: list[str] = []
    blocks: list[int] = []
    anywhere: list[str] = []
    stack: list[tuple[str, bool, bool, int]] = []  # name, dropped from here on, article from here on, block
    text: list[str] = []

    def dropped() -> bool:
        return bool(stack) and stack[-1][1]

    def inside() -> bool:
        return bool(stack) and stack[-1][2]

    def flush():
        if text:
            line = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if line:
                anywhere.append(line)
                if inside():
                    inside_article.append(line)
                    blocks.append(stack[-1][3])

    def add(part: str):
        if part and not dropped():
            text.append(part)

    at, seen, named = 0, False, 0
    for m in _TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            add(m["cdata"])
            continue
        name = (m["name"] or m["loose_name"] or "").lower()
        if not name:
            continue
        if name in _BLOCK or name in _DROP:
            flush()
        if m["end"] or m["loose"]:
            # an end tag closes its element and whatever is open inside, but never an enclosing container by a stray inline tag
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
                if name not in _BLOCK and name not in _DROP and stack[k][0] in _BLOCK:
                    break
        elif name not in _VOID and not (m["attrs"] or "").endswith("/"):
            if name in _CLOSES_P:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        del stack[k:]
                        break
                    if stack[k][0] in _BLOCK:
                        break
            drop = dropped() or _noise(name, m["attrs"] or "", inside())
            article = inside() or (name in ("article", "main") and not drop)
            seen = seen or (article and not drop)
            block = stack[-1][3] if stack else -1
            if inside() and name in _HOLDS and any(a[1].lower() in ("class", "id") for a in _ATTR.finditer(m["attrs"] or "")):
                block, named = named, named + 1
            stack.append((name, drop, article, block))
    add(page[at:])
    flush()
    return (inside_article, True, blocks) if seen else (anywhere, False, [-1] * len(anywhere))


def common(a: list[int], b: list[int]) -> set[int]:
    """Positions in a of a longest common subsequence with b, by rows of bits.

    Rows are kept at the square root of them and made again between two, so
    memory is len(a) ** 0.5 * len(b) bits.
    """
    match: dict[int, int] = {}
    for j, x in enumerate(b):
        match[x] = match.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    step, kept = max(1, math.isqrt(len(a))), []

    def below(v: int, x: int) -> int:
        u = v & match.get(x, 0)
        return ((v + u) | (v - u)) & full

    v = full
    for i, x in enumerate(a):
        if i % step == 0:
            kept.append(v)
        v = below(v, x)
    out, j, after = set(), len(b), v
    for k in range(len(kept) - 1, -1, -1):
        part, rows = a[k * step : (k + 1) * step], [kept[k]]
        for x in part[:-1]:
            rows.append(below(rows[-1], x))
        for i in range(len(part) - 1, -1, -1):
            # zero bits of a row count the matches so far; the row where the count of b[:j] falls holds a match
            mask = (1 << j) - 1
            if (~after & mask).bit_count() > (~rows[i] & mask).bit_count():
                out.add(k * step + i)
                hits, want = match[part[i]] & mask, (~after & mask).bit_count() - 1
                while hits:
                    at = hits.bit_length() - 1
                    if (~rows[i] & ((1 << at) - 1)).bit_count() == want:
                        j = at
                        break
                    hits &= (1 << at) - 1
            after = rows[i]
    return out


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages (page_id, url, html)."""
    scratch = Scratch(pages.sparkSession)
    base = spread(pages.select("page_id", "url", F.col("html").cast("string").alias("html")))

    def parse(batches):
        for batch in batches:
            texts, sure, hashes, places = [], [], [], []
            for page in batch["html"]:
                found, marked, blocks = placed_lines(page.as_py() or "")
                texts.append(found)
                sure.append(marked)
                hashes.append([xxhash.xxh3_64_intdigest(x.encode()) >> 1 for x in found])
                places.append(blocks)
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.list_(pa.string())), pa.array(sure, pa.bool_()), pa.array(hashes, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))], names=["page_id", "url", "lines", "sure", "hashes", "blocks"])

    id_type, url_type = base.schema["page_id"].dataType.simpleString(), base.schema["url"].dataType.simpleString()
    cut = scratch.keep(base.mapInArrow(parse, f"page_id {id_type}, url {url_type}, lines array<string>, sure boolean, hashes array<long>, blocks array<int>"), "lines")
    url = F.col("url").cast("string")
    placed = cut.withColumn("host", host_of(url)).withColumn("path", path_of(url))
    kept = _differenced(placed, scratch)
    open_ = salted_join(placed.where("not sure"), kept.where("not sure").drop("sure"), ["host", "hashes"], "page_id", "left")
    return _texts(open_).unionByName(_texts(_checked(placed.where("sure"), kept.where("sure").drop("sure"), scratch))).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def _texts(rows: DataFrame) -> DataFrame:
    keep = F.when(F.col("keep").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x, k: F.get("keep", k)))
    return rows.select("page_id", "url", F.array_join(keep, " ").alias("text"))


def confirmed(keep: list[bool], blocks: list[int]) -> list[bool]:
    """keep of an article's lines, with those put back that no block of template sets apart."""
    if not any(keep):
        return [True] * len(keep)
    size, own = Counter(blocks), {b for b, k in zip(blocks, keep, strict=True) if k}
    return [k or b < 0 or b in own or 2 * size[b] >= len(blocks) for k, b in zip(keep, blocks, strict=True)]


def _checked(marked: DataFrame, kept: DataFrame, scratch: Scratch) -> DataFrame:
    """Pages that mark an article with keep, where lines of theirs go.

    The check takes hashes and blocks alone; only pages with a block and a
    shared line can lose any, and no text is shuffled while their kinds are few.
    """

    @F.arrow_udf("array<boolean>")
    def confirm(keep: pa.Array, blocks: pa.Array) -> pa.Array:
        return pa.array([confirmed(k, b) for k, b in zip(keep.to_pylist(), blocks.to_pylist(), strict=True)], pa.list_(pa.bool_()))

    asked = marked.where(F.exists("blocks", lambda b: b >= 0)).select("host", "hashes", "blocks").distinct()
    found = salted_join(asked, kept.where(F.exists("keep", lambda k: ~k)), ["host", "hashes"], "blocks")
    gone = scratch.keep(found.select("host", "hashes", "blocks", confirm("keep", "blocks").alias("keep")).where(F.exists("keep", lambda k: ~k)), "gone")
    keys, n = ["host", "hashes", "blocks"], gone.count()
    if n == 0:
        return marked.withColumn("keep", F.lit(None).cast("array<boolean>"))
    return marked.join(F.broadcast(gone), keys, "left") if n <= BROADCAST_PAGES else salted_join(marked, gone, keys, "page_id", "left")


#: kinds of pages that lose lines of an article, which go with a broadcast
BROADCAST_PAGES = 100_000
_PLACE = ("sure", "host", "path", "page_id", "tie")


def _keep(own: dict, back: dict | None, ahead: dict | None) -> list[bool]:
    """Which lines of a page stay beside the nearer of its neighbours; the one before wins a tie."""

    def near(other):
        if other is None or other["host"] != own["host"] or other["sure"] != own["sure"]:
            return -1
        return len(os.path.commonprefix([own["path"], other["path"]]))

    other = back if near(back) >= near(ahead) else ahead
    shared = common(own["hashes"], other["hashes"]) if near(other) >= 0 else set()
    return [k not in shared for k in range(len(own["hashes"]))]


def _differenced(placed: DataFrame, scratch: Scratch) -> DataFrame:
    """(sure, host, hashes, keep): which lines of each page are not shared with the page of the nearest url path on its host.

    Pages are dealt by ranges of (sure, host, path), so a host of any size is
    many tasks; the first and the last page of each range meet their neighbours
    in one small task, two rows for each range.
    """
    # copies are one page, so that a page never meets its own lines
    distinct = placed.where("host <> ''").groupBy("sure", "host", "hashes").agg(F.min(F.struct("path", "page_id")).alias("at")).select("sure", "host", "at.path", "at.page_id", F.xxhash64("hashes").alias("tie"), "hashes")
    n = max(2, int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    id_type = placed.schema["page_id"].dataType
    fields = f"sure: boolean, host: string, path: string, page_id: {id_type.simpleString()}, tie: long, hashes: array<long>"
    schema = f"{fields}, keep: array<boolean>, first: boolean, last: boolean, back: struct<{fields}>, ahead: struct<{fields}>"

    def ranges(batches):
        """Pages between others of their range are done; its ends go on with the neighbour that they know."""
        rows = (row for batch in batches for row in batch.to_pylist())
        back, own, out = None, next(rows, None), []
        while own is not None:
            ahead = next(rows, None)
            inner = back is not None and ahead is not None
            out.append(own | {"keep": _keep(own, back, ahead) if inner else None, "first": back is None, "last": ahead is None, "back": None if inner else back, "ahead": None if inner else ahead})
            if len(out) == 1000 or ahead is None:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
            back, own = own, ahead

    def ends(batches):
        rows = (row for batch in batches for row in batch.to_pylist())
        before, own = None, next(rows, None)
        while own is not None:
            after = next(rows, None)
            yield pa.RecordBatch.from_pylist([{"sure": own["sure"], "host": own["host"], "hashes": own["hashes"], "keep": _keep(own, before if own["first"] else own["back"], after if own["last"] else own["ahead"])}], kept)
            before, own = own, after

    kept = pa.schema([("sure", pa.bool_()), ("host", pa.string()), ("hashes", pa.list_(pa.int64())), ("keep", pa.list_(pa.bool_()))])
    page = [("sure", pa.bool_()), ("host", pa.string()), ("path", pa.string()), ("page_id", to_arrow_type(id_type)), ("tie", pa.int64()), ("hashes", pa.list_(pa.int64()))]
    arrow = pa.schema([*page, ("keep", pa.list_(pa.bool_())), ("first", pa.bool_()), ("last", pa.bool_()), ("back", pa.struct(page)), ("ahead", pa.struct(page))])
    dealt = scratch.keep(distinct.repartitionByRange(n, *_PLACE).sortWithinPartitions(*_PLACE).mapInArrow(ranges, schema), "ranges")
    inner = dealt.where("not first and not last").select("sure", "host", "hashes", "keep")
    outer = dealt.where("first or last").repartition(1).sortWithinPartitions(*_PLACE).mapInArrow(ends, "sure boolean, host string, hashes array<long>, keep array<boolean>")
    return inner.unionByName(outer)
