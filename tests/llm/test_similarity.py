"""Jaccard join, embedding near-duplicates and fingerprints against brute force."""

import hashlib
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from pyspark.sql import functions as F

from spectraloom.llm import chunking, jaccard, multi_index
from spectraloom.llm.common import Scratch
from spectraloom.llm.graph import components
from tests.llm.conftest import ODD


def smallest(ids, links):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return set(zip(*[words[k:] for k in range(5)])) if len(words) >= 5 else {tuple(words)} if words else set()


def brute_components(texts):
    sets, found, by = {i: shingles(t) for i, t in texts.items()}, [], {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    for i, s in sets.items():
        for j, both in Counter(j for x in s for j in by[x] if j < i).items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                found.append((i, j))
    return {i: len(s) for i, s in sets.items()}, smallest(sets, found)


def test_jaccard_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sizes, groups = brute_components({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})
    found = jaccard.similar_documents(docs).collect()
    assert {r.doc_id: r.n_shingles for r in found} == sizes
    assert {r.doc_id: r.component_id for r in found} == groups


def test_jaccard_finds_chains_of_edits_at_every_size(spark):
    """Texts of 1 to 200 words, each changed step by step: links at and next to the threshold."""
    rng, rows, number = np.random.default_rng(1), {}, 0
    for n in [1, 4, 5, 6, 8, 9, 10, 12, 13, 14, 17, 18, 20, 24, 28, 40, 60, 100, 200]:
        words = [f"w{rng.integers(10**9)}" for _ in range(n)]
        for _ in range(8):
            rows[number] = " ".join(words)
            number += 1
            words = list(words)
            for _ in range(rng.integers(1, 3)):
                at = int(rng.integers(len(words)))
                words[at:at + int(rng.integers(2))] = [f"w{rng.integers(10**9)}"]
    sizes, groups = brute_components(rows)
    found = jaccard.similar_documents(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == {i: (sizes[i], groups[i]) for i in rows}


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 120), st.integers(0, 2**32 - 1))
def test_linked_sets_share_a_key(n, seed):
    rng = np.random.default_rng(seed)
    base = np.unique(rng.integers(0, 2**63, n * 3, dtype=np.uint64))
    a = base[:n]
    less = int(rng.integers(0, n // 5 + 1))
    more = int(rng.integers(0, n // 4 + 1))
    b = np.unique(np.concatenate([a[less:], base[n:n + more]]))
    both = len(np.intersect1d(a, b))
    if len(b) and 100 * both >= 80 * (len(a) + len(b) - both):
        assert len(np.intersect1d(jaccard.all_keys(a), jaccard.all_keys(b)))
        one, two = (jaccard.narrow_sketch(x).view(np.uint64) for x in (a, b))
        distance = sum(int(x).bit_count() for x in one ^ two)
        assert distance <= len(a) + len(b) - 2 * both


def test_long_texts_pass_the_sketches(spark):
    """Sets around the sizes at which sketches double, and where the first comparison changes its width."""
    rng, rows = np.random.default_rng(8), []
    for n in (380, 420, 990, 1100, 2000, 2300):
        words = [f"w{rng.integers(10**9)}" for _ in range(n)]
        rows += [" ".join(words), " ".join(words + [f"v{i}" for i in range(n // 5)]), " ".join(words[n // 8:])]
    texts = dict(enumerate(rows))
    sizes, groups = brute_components(texts)
    found = jaccard.similar_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == {i: (sizes[i], groups[i]) for i in texts}
    assert len(set(groups.values())) == 6


def test_jaccard_odd_rows(odd, none):
    rows = jaccard.similar_documents(odd).collect()
    assert len(rows) == len(ODD)
    found = {(r.doc_id, r.n_shingles): r.component_id for r in rows}
    assert found[2, 12] == 1 and found[3, 13] == 1 and found[8, 1] == 7 and found[5, 0] == 5 and found[6, 0] == 6
    assert all(r.component_id is None for r in rows if r.doc_id is None)
    assert jaccard.similar_documents(none).collect() == []


def test_members_meet_once_however_many_keys_they_share(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "EARLY", 4)
    rng = np.random.default_rng(5)
    held = {node: rng.choice(60, size=int(rng.integers(1, 40)), replace=False) for node in range(30)}
    part = spark.createDataFrame([(int(k) - 30, node, node // 2) for node, keys in held.items() for k in keys],
                                 "key long, node long, component long")
    classes = spark.createDataFrame([(node, 100, [0] * 16) for node in held], "node long, n long, sketch array<long>")
    found = [tuple(r) for r in jaccard.members(part, classes).collect()]
    together = {(a, b) for a, b in combinations(held, 2) if a // 2 != b // 2 and set(held[a]) & set(held[b])}
    assert set(found) == together
    shared = sum(len(set(held[a]) & set(held[b])) for a, b in together)
    assert len(found) < shared / 2
    many = [x for x in together if set(sorted(held[x[0]])[:4]) & set(sorted(held[x[1]])[:4])
            and min(set(held[x[0]]) & set(held[x[1]])) in sorted(held[x[0]])[:4]
            and min(set(held[x[0]]) & set(held[x[1]])) in sorted(held[x[1]])[:4]]
    assert many and all(found.count(x) == 1 for x in many)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (7, 7)]
    frame = spark.createDataFrame(edges, "a long, b long")
    found = {r.node: r.component for r in components(frame, Scratch(spark, "test")).collect()}
    assert found == {i: r for i, r in smallest({x for e in edges for x in e}, edges).items() if i != r}


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(1500, 16))
    copies = base[rng.integers(0, 40, 500)] + rng.normal(size=(500, 16)) * 0.18
    x = np.concatenate([base, copies, base[:30], base[:20] * 3]).astype(np.float32).astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = unit @ unit.T >= 0.95
    np.fill_diagonal(links, False)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = sorted(multi_index.near_vectors(frame).collect())
    mine = np.array([r.n_links for r in found])
    assert (mine <= links.sum(1)).all() and mine.sum() >= 0.95 * links.sum()
    if (mine == links.sum(1)).all():
        groups = smallest(range(len(x)), zip(*np.nonzero(np.triu(links))))
        assert [r.component_id for r in found] == [groups[i] for i in range(len(x))]
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_recall_on_the_given_table(spark):
    """The given vectors have no links of their own; each other one gets a copy with noise, at the threshold or above."""
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = sorted((r.vec_id, r.embedding) for r in frame.collect())
    x = np.array([v for _, v in rows], float)
    rng = np.random.default_rng(11)
    noise = rng.normal(size=x[::2].shape)
    noise *= rng.uniform(0.1, 0.33, (len(noise), 1)) * np.linalg.norm(x[::2], axis=1, keepdims=True) / np.linalg.norm(
        noise, axis=1, keepdims=True)
    x = np.concatenate([x, x[::2] + noise]).astype(np.float32).astype(float)
    links = x @ x.T >= 0.95 * np.outer(*[np.linalg.norm(x, axis=1)] * 2)
    np.fill_diagonal(links, False)
    both = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = sorted(multi_index.near_vectors(both).collect())
    mine = np.array([r.n_links for r in found])
    assert links.sum() > 1000 and (mine <= links.sum(1)).all() and mine.sum() >= 0.9 * links.sum()


def test_traversal_is_in_order_of_distance():
    rng = np.random.default_rng(3)
    grid = multi_index.Grid(rng.normal(size=(300, 8)), 6, rng)
    grid.visits = 36
    x = rng.normal(size=(5, 8))
    left = multi_index.distances(x[:, :4], grid.books[0])
    right = multi_index.distances(x[:, 4:], grid.books[1])
    for order, a, b in zip(grid.traverse(x), left, right):
        sums = [a[c // 6] + b[c % 6] for c in order]
        assert sorted(order) == list(range(36)) and sums == sorted(sums)


def test_blocks_of_any_size_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(50, 8)) + 3, np.ones((60, 8)) + rng.normal(size=(60, 8)) * 0.05])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    whole = sorted(multi_index.near_vectors(frame).collect())
    monkeypatch.setattr(multi_index, "MEMBERS", 7)
    monkeypatch.setattr(multi_index, "QUERIES", 11)
    assert sorted(multi_index.near_vectors(frame).collect()) == whole


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.01]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]),
            (7, [None, 1.0]), (8, [inf, 1.0]), (9, [1.0]), (None, [1.0, 0.0]), (10, [0.0, 1.0]), (11, [])]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows],
                                  "vec_id long, embedding array<float>, node string, copies int")
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in multi_index.near_vectors(frame).collect()}
    assert found[1] == (2, 1, True) and found[2] == (2, 1, False) and found[3] == (2, 1, False)
    assert all(found[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11)) and found[None][:2] == (0, None)
    assert multi_index.near_vectors(frame.where("false")).collect() == []
    assert [r.n_links for r in multi_index.near_vectors(frame.where("vec_id = 4")).collect()] == [0]


def test_fingerprints_of_edited_texts(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(chunking, "PARTITION_BYTES", 60_000)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    found = {r.doc_id: r for r in chunking.edited_documents(docs).collect()}
    assert len(found) == len(rows)
    for i, (ident, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)]
        cut = len(text) // 3
        edited = text[:len(text) - cut] + after[1][:cut]
        r = found[ident]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own = chunking.read(r.fingerprint)
        assert r.near_next == chunking.containment(own, chunking.read(found[after[0]].fingerprint))
        assert r.near_edited == chunking.containment(own, chunking.read(r.edited_fingerprint))
        assert len(text) < 500 or r.near_edited > 0.25
    assert {r.doc_id: r.fingerprint for r in chunking.fingerprints(docs).collect()} == {
        i: r.fingerprint for i, r in found.items()}


def test_chunks_move_with_the_text_and_keep_their_bounds():
    rng = np.random.default_rng(6)
    text = bytes(rng.integers(97, 123, 20_000).astype(np.uint8))
    gear = chunking.gear_table()

    def cut(data):
        (ends,) = chunking.boundaries(np.array([0, len(data)]), np.frombuffer(data, np.uint8), gear)
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    whole = cut(text)
    assert b"".join(whole) == text and all(chunking.LEAST <= len(x) <= chunking.MOST for x in whole[:-1])
    moved = cut(b"inserted" + text)
    assert len(set(whole) & set(moved)) >= len(set(whole)) - 5


def test_odd_fingerprints(odd, none):
    rows = chunking.edited_documents(odd).collect()
    assert len(rows) == len(ODD)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[5][0].fingerprint == "" and by[4][0].n_chars == 0 and by[5][0].near_edited == 1.0
    assert by[5][0].near_next == 1.0 and by[6][0].near_next == 0.0  # the next of 5 is 4, that of 6 is 5
    assert by[1][0].fingerprint == by[2][0].fingerprint and by[2][0].near_next in (0.0, 1.0)
    assert chunking.edited_documents(none).collect() == []
    one = chunking.edited_documents(odd.where("doc_id = 7")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


@pytest.mark.parametrize("pair", list(combinations(["", "abc", "abc def " * 50], 2)))
def test_containment_is_symmetric(pair):
    sets = []
    for x in pair:
        data = np.frombuffer(x.encode(), np.uint8)
        sets += chunking.chunk_sets(np.array([0, len(data)]), data, chunking.gear_table())
    assert chunking.containment(*sets) == chunking.containment(*sets[::-1])


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 99, 100])
def test_cuts_are_counted_in_two_steps(spark, n):
    rng = np.random.default_rng(n)
    cuts = sorted({int(c) for c in rng.integers(-50, 50, n)})
    frame = spark.range(-60, 60).withColumn("below", chunking.cuts_below(cuts, F.col("id")))
    assert all(r.below == sum(c < r.id for c in cuts) for r in frame.collect())
