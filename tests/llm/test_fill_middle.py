import hashlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwell.llm import fill_middle as fm
from siftwell.llm import queries


def plain(doc_id, text, seed=1):
    """The definition, over Python strings."""
    text, h = text or "", hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_against_the_definition(spark, odd_docs, no_docs):
    marked = [(20, "a <P> b"), (21, "<<S>>"), (22, "x<M"), (23, "<"), (24, "🎉"), (25, "a\u0000b")]
    docs = odd_docs.select("doc_id", "text", "terms", "score").unionByName(spark.createDataFrame(marked, "doc_id long, text string"), allowMissingColumns=True).unionByName(spark.range(100, 400).selectExpr("id as doc_id", "concat('word ', id, '\nünd 東京 🎉>')  as text"), allowMissingColumns=True)
    got = fm.transformed(docs).withColumn("back", fm.restored(F.col("output"), F.col("form"))).collect()
    want = [(r.doc_id, *plain(r.doc_id, r.text), r.text or "") for r in docs.collect()]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fm.transformed(no_docs).collect() == []


@given(st.text(alphabet=st.sampled_from("ab \n1.ü東🎉"), max_size=30), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1), st.sampled_from(fm.UNITS))
@settings(max_examples=200, deadline=None)
def test_pieces_are_whole_units(text, first, second, units):
    n, pieces = fm.cut(text, units, first, second)
    assert "".join(pieces) == text
    at = set(fm.boundaries(np.frombuffer(text.encode("utf-32-le"), "<u4"), units).tolist())
    assert len(pieces[0]) in at and len(pieces[0] + pieces[1]) in at
    if units == "chars":
        assert n == len(text)
    if units == "lines":
        assert n == len(text.split("\n")) - (text.endswith("\n") or not text)


def test_words_and_rates(spark):
    assert fm.cut("ab  c.d", "words", 1, 3) == (5, ["ab", "  c", ".d"])
    docs = spark.range(2000).selectExpr("id as doc_id", "concat('text number ', id) as text")
    forms = {r.form: r["count"] for r in fm.transformed(docs, units="words", seed=7, percent=50, spm_percent=50).groupBy("form").count().collect()}
    assert 900 < forms["plain"] < 1100 and 400 < forms["psm"] < 600 and 400 < forms["spm"] < 600
    whole = fm.transformed(docs, percent=100, marks=("[|p", "[|s", "[|m"), units="lines")
    assert whole.where(fm.restored(F.col("output"), F.col("form"), ("[|p", "[|s", "[|m")) != F.concat(F.lit("text number "), "doc_id")).count() == 0
    with pytest.raises(ValueError, match="units"):
        fm.transformed(docs, units="bytes")


def test_query_and_sql(spark):
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = con.sql(queries.ORACLE_SQL["op13_fill_middle"])
    got = queries.op13_fill_middle(spark, "/root/testdata/sf0.001").select(want.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall())) and len(got) == 200
