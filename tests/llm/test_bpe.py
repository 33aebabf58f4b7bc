import hashlib
import json
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siftwell.llm import bpe

from .conftest import ids

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    return Tokenizer.from_file(PATH), bpe.Codec(PATH)


def same(both, texts):
    library, codec = both
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert codec.encode_batch(texts) == want
    assert [codec.decode(x) for x in want] == [library.decode(x, skip_special_tokens=False) for x in want] == texts


def test_documents(both, sf001):
    same(both, [r.text for r in sf001("documents").collect()])
    assert both[1].failed < both[1].proposed


def test_hard_texts(both):
    same(both, ["", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "  \n\n  x", "日本語 🎉👩‍👩‍👧", "a" * 5000, " " * 3000, "\x00\x01\x1c\x85x", "it's we'LL I'd", "१२३ ½", "don’t", "ab" * 40_000])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), min_size=1, max_size=5))
def test_any_text(both, texts):
    same(both, texts)


def test_any_ids_decode_as_the_library_does(both):
    library, codec = both
    rng = random.Random(1)
    for _ in range(300):
        some = [rng.randrange(50257) for _ in range(12)]
        assert codec.decode(some) == library.decode(some, skip_special_tokens=False)


def test_merge_is_exact_for_every_greedy_failure(both):
    library, codec = both
    words = ["".join(random.Random(k).choice("etaoinshrdlu") for _ in range(12)) for k in range(400)]
    assert [list(codec.merge(w.encode())) for w in words] == [e.ids for e in library.encode_batch(words, add_special_tokens=False)]


def test_files_that_need_more_are_refused(tmp_path):
    with open(PATH, encoding="utf-8") as f:
        file = json.load(f)
    changes = {"normalizer": {"type": "NFC"}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}, "decoder": None, "model": file["model"] | {"unk_token": "?"}, "added_tokens": [file["added_tokens"][0] | {"lstrip": True}]}
    assert bpe.unmet(file) == []
    for k, v in changes.items():
        (tmp_path / "t.json").write_text(json.dumps(file | {k: v}))
        with pytest.raises(ValueError):
            bpe.Codec(str(tmp_path / "t.json"))


def test_query(odd_docs, odd_rows, no_docs, both):
    got = bpe.round_trip(odd_docs, PATH).collect()
    assert ids(got) == sorted((i for i, _ in odd_rows), key=lambda x: (x is None, x))
    text = dict(odd_rows)
    for r in got:
        want = both[0].encode(text[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest(), hashlib.sha256((text[r.doc_id] or "").encode()).hexdigest())
    assert bpe.round_trip(no_docs, PATH).collect() == []


def test_frames_come_back(odd_docs, odd_rows):
    back = bpe.decode(bpe.encode(odd_docs, PATH), PATH).collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in back))) == sorted(map(repr, ((i, t or "") for i, t in odd_rows)))
