"""Byte-level BPE against the tiktoken library; the perfect hash by its definition."""

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from spectraloom.llm import byte_bpe
from tests.llm.conftest import ODD

HELD = byte_bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=HELD.ranks, special_tokens={})


def coded(text):
    coder = byte_bpe.Coder(HELD)
    ids = coder.encode_all([text])[0]
    assert coder.decode(ids) == text.encode()
    return ids.tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs", "Cn"]), st.sampled_from("ab' \n\t ést1")),
               max_size=60))
def test_any_text_as_the_library(text):
    assert coded(text) == LIBRARY.encode_ordinary(text)


def test_every_code_point_splits_as_in_the_library():
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    coder = byte_bpe.Coder(HELD)
    texts = [f"a{c}a 1{c}1 .{c}.{c} {c}" for c in points]
    found = coder.encode_all(texts)
    differ = [c for c, t, ids in zip(points, texts, found) if ids.tolist() != LIBRARY.encode_ordinary(t)]
    assert differ == []


def test_documents_as_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = byte_bpe.encode_documents(docs, HELD).collect()
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert len(found) == len(texts)
    for r in found:
        assert r.ids == LIBRARY.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids)
        assert bytes(r.decoded) == texts[r.doc_id].encode()


def test_odd_documents(odd, none):
    found = byte_bpe.encode_documents(odd, HELD).collect()
    expected = sorted(((r[0], LIBRARY.encode_ordinary(r[1] or "")) for r in ODD), key=str)
    assert sorted(((r.doc_id, r.ids) for r in found), key=str) == expected
    assert all(bytes(r.decoded).decode() == LIBRARY.decode(r.ids) and r.n_tokens == len(r.ids) for r in found)
    assert byte_bpe.encode_documents(none, HELD).collect() == []


@pytest.mark.parametrize("size", [1, 2, 7, 50])
def test_cutting_a_text_changes_nothing(size, monkeypatch):
    monkeypatch.setattr(byte_bpe, "SLICE", size)
    for text in ("a  b\n\n c'll d  　x  ", " ", "   ", "don't  \n  stop " * 30, "漢字 " * 9, ODD[9][1][:3000]):
        assert coded(text) == LIBRARY.encode_ordinary(text)


def test_long_words_and_a_small_memory(monkeypatch):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghé漢"), int(n))) for n in [*rng.integers(1, 30, 400), 20_000]]
    coder = byte_bpe.Coder(HELD)
    coder.remembered.limit = 2000
    for part in (words, words[:100], words[50:150], words):
        text = " ".join(part)
        assert coder.encode_all([text])[0].tolist() == LIBRARY.encode_ordinary(text)
    assert coder.remembered.old


def test_what_is_used_stays_remembered(monkeypatch):
    coder = byte_bpe.Coder(HELD)
    coder.remembered.limit = 5000
    asked, resolve = [], coder.resolve
    monkeypatch.setattr(coder, "resolve", lambda pieces: asked.extend(pieces) or resolve(pieces))
    for i in range(100):
        coder.encode_all([f" qzxoften zq{i}x"])
        assert coder.remembered.size < 2 * 5000
    assert asked.count(" qzxoften") == 1 and len(coder.remembered.numbers) < 60


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 3000), st.integers(0, 2**32 - 1))
def test_the_hash_is_perfect_and_minimal(n, seed):
    keys = np.unique(np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64))
    found = byte_bpe.PerfectHash(keys)
    assert sorted(found.places(keys).tolist()) == list(range(len(keys)))
    others = found.places(keys ^ np.uint64(1 << 63))
    assert ((others >= -1) & (others < max(len(keys), 1))).all()


def test_the_first_tier_finds_tokens_only():
    coder = byte_bpe.Coder(HELD)
    tokens = list(HELD.ranks)
    assert coder.in_vocabulary(tokens).tolist() == list(HELD.ranks.values())
    others = [t + b"\xff\xfe" for t in tokens] + [b""]
    assert (coder.in_vocabulary(others) == [HELD.ranks.get(t, -1) for t in others]).all()
    with pytest.raises(ValueError):
        byte_bpe.Vocabulary({b"a": 0}, "x")
    with pytest.raises(ValueError):
        byte_bpe.PerfectHash(np.array([1, 1], np.uint64))
