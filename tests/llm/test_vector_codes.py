"""Vector codes against an exhaustive computation."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from spectraloom.llm import vector_codes
from spectraloom.llm.queries import op13_vector_codes

NAN, INF = float("nan"), float("inf")


def brute(rows):
    """rows: (vec_id, vector, label); plain loops over integers."""
    kept = [(i, v, lab) for i, v, lab in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return {}, ""
    length = max(1, -(-max(len(v) for _, v, _ in kept) // 16)) * 16
    x = {n: [int(np.floor(np.float64(np.float32(c)) * 256)) for c in v] + [0] * (length - len(v))
         for n, (_, v, _) in enumerate(kept)}
    w = length // 16
    first = sorted(x, key=lambda n: (kept[n][0] is None, kept[n][0] or 0, x[n]))[:64]
    books = [[x[n][p * w:(p + 1) * w] for n in first] for p in range(16)]

    def nearest(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), j) for j, e in enumerate(books[p]))

    for _ in range(2):
        members = defaultdict(list)
        for n in x:
            for p in range(16):
                part = x[n][p * w:(p + 1) * w]
                members[p, nearest(p, part)[1]].append(part)
        for (p, j), parts in members.items():
            books[p][j] = [sum(c) // len(parts) for c in zip(*parts)]
    found, by_label = [], defaultdict(int)
    for n, (ident, _, label) in enumerate(kept):
        best = [nearest(p, x[n][p * w:(p + 1) * w]) for p in range(16)]
        error = sum(d for d, _ in best)
        by_label[label] += error
        found.append((ident, "".join(f"{j:02x}" for _, j in best), error, label))
    flat = [str(c) for book in books for e in book for c in e]
    return (sorted([(i, code, e, by_label[lab]) for i, code, e, lab in found], key=str),
            hashlib.sha256(",".join(flat).encode()).hexdigest())


def coded(frame):
    rows, books = vector_codes.compress_vectors(frame)
    got = rows.select("ident", vector_codes.code_text("codes").alias("code"), "error", "label_error").collect()
    return sorted(map(tuple, got), key=str), books.digest() if books else ""


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows],
                                 "vec_id long, embedding array<float>, label int, v string, to_pivots int").repartition(3)


def test_codes_equal_an_exhaustive_search(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(c) for c in rng.normal(size=32)], int(i % 4) if i % 5 else None)
            for i in rng.permutation(300)]
    rows += [(900 + i, rows[i][1], 1) for i in range(20)]
    assert coded(frame_of(spark, rows)) == brute(rows)


def test_odd_vectors(spark):
    rng = np.random.default_rng(6)
    some = [(i, [float(c) for c in rng.integers(-3, 3, 16) / 256], None) for i in range(30)]
    odd = [(30, None, 1), (31, [NAN] * 16, 1), (32, [1.0, None], 2), (33, [INF] * 16, 1), (34, [], 2), (35, [0.5], 2),
           (None, some[0][1], 3), (2, some[5][1], 3), (2, some[4][1], 3), (36, [1.0] * 17, None)]
    for rows in (some + odd, odd, [(1, [], None)], some):
        assert coded(frame_of(spark, rows)) == brute(rows)
    empty = frame_of(spark, odd).where("vec_id < 0")
    assert coded(empty) == ([], "") and coded(frame_of(spark, odd[:4])) == ([], "")


def test_a_component_out_of_range_fails(spark):
    with pytest.raises(Exception, match="beyond"):
        coded(frame_of(spark, [(1, [1e30] * 16, 0)]))


def test_partitioning_does_not_matter(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    one, other = coded(frame.coalesce(1)), coded(frame.repartition(7))
    assert one == other and len(one[0]) == frame.count()


def test_query_columns(spark, sf_dir):
    rows = op13_vector_codes(spark, sf_dir)
    assert rows.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert rows.where("length(code) <> 32").count() == 0


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 40), st.integers(1, 12), st.integers(1, 6), st.sampled_from([2, 50, 1 << 24]),
       st.integers(0, 2**32 - 1))
def test_pruning_keeps_the_nearest(entries, width, pivots, large, seed):
    rng = np.random.default_rng(seed)
    book = rng.integers(-large, large, (entries, width))
    x = np.concatenate([rng.integers(-large, large, (60, width)), book])
    fixed = vector_codes.spread_out(book, pivots)
    far = vector_codes.pivot_distances(x, fixed).astype(np.float32)
    index, best, evaluated = vector_codes.nearest_entries(x, far, book, fixed)
    every = ((x[:, None] - book[None]) ** 2).sum(-1)
    assert (index == every.argmin(1)).all() and (best == every.min(1)).all()
    assert len(x) <= evaluated <= len(x) * entries


def test_most_entries_are_pruned():
    rng = np.random.default_rng(1)
    centres = rng.integers(-2000, 2000, (64, 4))
    x = centres[rng.integers(0, 64, 5000)] + rng.integers(-60, 60, (5000, 4))
    pivots = vector_codes.spread_out(centres, vector_codes.PIVOTS)
    far = vector_codes.pivot_distances(x, pivots).astype(np.float32)
    assert vector_codes.nearest_entries(x, far, centres, pivots)[2] < 0.1 * len(x) * 64
