import hashlib
import zlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwell.llm import merkle, queries


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climbed(digests):
    """The root of a tree, and of each leaf its siblings' text and its runs."""
    proofs, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for i, a in enumerate(at):
            run = a - a % 3
            proofs[i].append((level[run:a], level[a + 1 : run + 3]))
            at[i] = a // 3
        level = [H(*level[i : i + 3]) for i in range(0, len(level), 3)]
    return level[0], proofs


def fold(own, proof):
    for before, after in proof:
        own = H(*before, own, *after)
    return own


def plain(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of rows in the order of merkle.FIELDS."""
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))):
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climbed([leaf_of(r) for r in groups[s]]) for s in names}
    root, tops = climbed([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, tops, strict=True):
        for r, proof in zip(groups[s], trees[s][1], strict=True):
            whole = proof + top
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            start = leaf_of([*r[:4], r[4].replace("\n", "")]) if tampered else leaf_of(r)
            told = fold(start, whole)
            out.append((r[0], leaf_of(r), trees[s][0], root, H(*[d for a, b in whole for d in (*a, *b)]), told, told == root))
    return out


@pytest.mark.parametrize("subtree_height", [1, 2, 3, 5])
@given(n=st.integers(1, 300))
@settings(max_examples=25, deadline=None)
def test_traversal(n, subtree_height):
    leaves = [H(str(i)) for i in range(n)]
    root, proofs = climbed(leaves)
    held = merkle.Traversal(leaves, merkle.height_of(n), subtree_height)
    assert held.root == root
    assert [["".join(a) + "." + "".join(b) for a, b in p] for p in proofs] == [list(p) for p in held.paths()]


@pytest.mark.parametrize(("block_height", "subtree_height"), [(1, 1), (2, 2), (6, 2)])
def test_against_the_definition(spark, odd_docs, no_docs, tmp_path, block_height, subtree_height):
    rows = [(i, f"s{i % 5}" if i % 3 else "hot", None if i % 7 else "en", i, f"line {i}\nnext\n" if i % 4 else "no feed") for i in range(1, 150)]
    rows += [(1, None, None, None, None), (None, None, "x", 3, "a\nb"), (None, None, "x", 3, "a\nb"), (5, "", "x", 3, ""), (200, "é", "x", 3, "東\n京"), (201, "z", None, None, "alone")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, grp string, place int").repartition(5)
    kept = merkle.FIELDS
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, merkle.leaf([F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in kept]))
    got = merkle.manifest(docs.withColumn("place", tampered), carried=("place",), block_height=block_height, subtree_height=subtree_height).toDF("doc_id", "source", "at", "leaf", "subroot", "root", "proof", "tampered")
    got = got.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256), merkle.folded(F.coalesce("tampered", "leaf"), F.col("proof")).alias("f")).withColumn("v", F.col("f") == F.col("root")).collect()
    want = plain(rows)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert {r[-1] for r in want} == {True, False}
    assert merkle.manifest(no_docs, block_height=block_height).collect() == []


def test_odd_rows(spark, odd_docs, tmp_path):
    odd_docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_merkle(spark, str(tmp_path)).collect()
    want = plain([(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in odd_docs.collect()])
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_places_are_consecutive_over_many_tasks(spark):
    docs = spark.range(5000).selectExpr("id * 7 as doc_id", "if(id % 3 = 0, 'hot', concat('s', id % 40)) source", "null as lang", "id as n_chars", "concat('t', id) as text")
    rows = merkle.manifest(docs, block_height=3).select("source", "doc_id", "place", "proof", "leaf", "root").where(merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")).collect()
    assert len(rows) == 5000
    by = {}
    for r in sorted(rows, key=lambda r: (r.source, r.doc_id)):
        by.setdefault(r.source, []).append(r.place)
    assert all(p == list(range(len(p))) for p in by.values())


def test_query_and_sql(spark):
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = con.sql(queries.ORACLE_SQL["op11_merkle"])
    got = queries.op11_merkle(spark, "/root/testdata/sf0.001").select(want.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall())) and len(got) == 200
