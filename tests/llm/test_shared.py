import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwell.llm import bytewords as bw
from siftwell.llm import shared


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \t\n\x0b1-é日🎉", max_size=30)), max_size=8))
def test_words_are_those_of_the_patterns(rows):
    data, off = bw.text_buffer(pa.array(rows, pa.string()))
    for inside, pattern in ((bw.NOT_SPACE, r"[^\x20\x09-\x0D]+"), (bw.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        low = [re.sub("[A-Z]", lambda m: m[0].lower(), r or "") for r in rows]
        starts, ends, first = bw.split(data, off, inside)
        got = [[bytes(data[starts[k] : ends[k]]).decode().translate({i: i + 32 for i in range(65, 91)}) for k in range(first[i], first[i + 1])] for i in range(len(rows))]
        assert got == [re.findall(pattern, r) for r in low]


def test_equal_words_hash_equally_wherever_they_stand():
    data, off = bw.text_buffer(pa.array(["a bc Abc abc", "abc " * 70_000, "bc" * 200_000]))
    w, first = bw.words(data, off, bw.NOT_SPACE)
    assert w[2] == w[3] and len(set(w[first[1] : first[2]].tolist())) == 1 and w[4] == w[3]
    assert len(set(w[:4].tolist())) == 3 and w[-1] not in w[:-1]


def test_packed_arrays_come_back():
    values = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 5000).astype(np.uint64))
    assert (shared.unpack_sorted(shared.pack_sorted(values)) == values).all()
    assert (shared.unpack(shared.pack(values[::-1])) == values[::-1]).all()
    assert len(shared.unpack(shared.pack(np.zeros(0, np.uint64)))) == 0


@pytest.mark.parametrize("hub_rows", [1 << 16, 20])
def test_components(spark, monkeypatch, hub_rows):
    monkeypatch.setattr(shared, "HUB_ROWS", hub_rows)
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(90)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(300)]
    got = {r.id: r.component for r in shared.connected_components(spark.createDataFrame(edges, "u long, v long").repartition(7), shared.Scratch(spark)).collect()}
    forest = shared.Forest()
    for u, v in edges:
        forest.join(u, v)
    assert got == {x: forest.find(x) for e in edges if e[0] != e[1] for x in e}
    assert shared.connected_components(spark.createDataFrame([], "u long, v long"), shared.Scratch(spark)).count() == 0


def test_blocks_hold_every_row(odd_docs, odd_rows, spark):
    blocks = shared.Scratch(spark).keep(shared.pack_blocks(odd_docs, 1000), "b").collect()
    rows = [r for b in blocks for r in shared.open_block(bytes(b.payload)).to_pylist()]
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in rows))) == sorted(map(repr, odd_rows))


def test_blocks_of_coalesced_partitions_have_numbers_of_their_own(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "repeat(cast(id as string), 20) as text").repartition(64)
    packed = shared.pack_blocks(docs, 1000).coalesce(5)
    rows = shared.Scratch(spark).keep(packed, "b").collect()
    assert len({r.block for r in rows}) == len(rows) >= 64
    assert sorted(x for r in rows for x in shared.open_block(bytes(r.payload))["doc_id"].to_pylist()) == list(range(4000))
