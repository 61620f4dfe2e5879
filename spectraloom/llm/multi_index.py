"""Embedding near-duplicates by an inverted multi-index.

Method. Unit vectors are halved and every half has a codebook of its own (k-means); the pairs of codewords form a
product grid of cells. A query visits cells by the multi-sequence algorithm: a heap over the two sorted lists of
codeword distances yields cells in ascending order of their sum. How many cells it visits is calibrated: partners at
exactly the threshold are made for a sample of vectors, and the number is such that their cells are reached with the
target recall. Members of the visited cells are verified by the cosine in double precision.

Every vector is indexed and every vector is a query. A link counts for both ends also if only one of them visits the
other's cell.

Spark. Equal vectors are one node with a count. Cells are dealt by the first codeword: a query travels once per first
codeword that it visits, with the second codewords. Members and queries of a codeword are split in blocks of bounded
size, and every pair of blocks is one task's matrix product; a block returns counts and a spanning forest of its links,
never the pairs. The codebooks are fitted on the driver from a bounded sample (``SAMPLE`` vectors by hash of their
id); the grid grows with the table, so that a cell holds about ``CELL`` vectors.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and vectors whose length is not
the most frequent one, link with nothing and are their own component; so are rows with a null id (component null).
Equal vectors are linked. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spectraloom.llm.common import Scratch, small_side
from spectraloom.llm.graph import components

COSINE = 0.95
RECALL = 0.97
SAMPLE = 8192
CELL = 100
MEMBERS, QUERIES = 4096, 8192   # vectors of a block


def kmeans(x, k, rng, rounds=12):
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        empty = n == 0
        centres = sums / np.maximum(n, 1)[:, None]
        centres[empty] = x[rng.choice(len(x), int(empty.sum()))]
    return centres


def distances(x, centres):
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0)


def nearest(x, centres):
    return np.concatenate([distances(x[i:i + 4096], centres).argmin(1) for i in range(0, len(x), 4096)]) if len(
        x) else np.zeros(0, np.int64)


class Grid:
    """Two codebooks and the number of cells a query visits."""

    def __init__(self, x, k, rng, cosine=COSINE, recall=RECALL):
        half = x.shape[1] // 2
        self.half, self.k = half, k
        self.books = kmeans(x[:, :half], k, rng), kmeans(x[:, half:], k, rng)
        # partners at the threshold, in random directions
        some = x[rng.choice(len(x), min(400, len(x)), replace=False)]
        away = rng.normal(size=some.shape)
        away -= (away * some).sum(1, keepdims=True) * some
        away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)
        partners = self.cells(cosine * some + np.sqrt(1 - cosine * cosine) * away)
        self.visits = k * k
        ranks = []
        for order, cell in zip(self.traverse(some), partners.tolist()):
            ranks.append(order.index(cell) + 1 if cell in order else k * k)
        self.visits = int(np.quantile(ranks, recall, method="higher")) if ranks else 1

    def cells(self, x):
        return nearest(x[:, :self.half], self.books[0]) * self.k + nearest(x[:, self.half:], self.books[1])

    def traverse(self, x):
        """For each vector the visited cells, nearest first: the multi-sequence algorithm."""
        out = []
        for i in range(0, len(x), 2048):
            left = distances(x[i:i + 2048, :self.half], self.books[0])
            right = distances(x[i:i + 2048, self.half:], self.books[1])
            l_order, r_order = left.argsort(1, kind="stable"), right.argsort(1, kind="stable")
            left, right = np.take_along_axis(left, l_order, 1), np.take_along_axis(right, r_order, 1)
            for a, b, u, v in zip(left.tolist(), right.tolist(), l_order.tolist(), r_order.tolist()):
                out.append(self.sequence(a, b, u, v))
        return out

    def sequence(self, a, b, u, v):
        k, heap, found, reached = self.k, [(a[0] + b[0], 0, 0)], [], [0] * self.k
        while heap and len(found) < self.visits:
            _, i, j = heapq.heappop(heap)
            found.append(u[i] * k + v[j])
            reached[i] = j + 1
            # the next cell of this row, if the row above is as far; the next row, if this one is its first
            if j + 1 < k and (i == 0 or reached[i - 1] > j + 1):
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
            if i + 1 < k and reached[i + 1] == j:
                heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
        return found


def unit(column, dims):
    x = column.values.to_numpy(zero_copy_only=False).reshape(-1, dims) if isinstance(column, pa.ListArray) and (
        column.offset == 0) else np.array(column.to_pylist())
    x = np.asarray(x, np.float64).reshape(-1, dims)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


PLACED = "first int, query boolean, node long, copies long, vector array<double>, second array<int>"


def place(grid, dims):
    """Every vector as a member of its cell and as a query of the first codewords it visits."""
    def run(batches):
        held = grid.value
        for batch in batches:
            column = batch.column(2)
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                x = unit(pa.array(column.slice(i, 1024).to_pylist(), pa.list_(pa.float64())), dims)
                cells, orders = held.cells(x).tolist(), held.traverse(x)
                rows = []
                for row, (cell, order) in enumerate(zip(cells, orders)):
                    rows.append((cell // held.k, False, row, [cell % held.k]))
                    seconds = {}
                    for c in order:
                        seconds.setdefault(c // held.k, []).append(c % held.k)
                    rows += [(f, True, row, s) for f, s in seconds.items()]
                at = np.array([r[2] for r in rows])
                yield pa.RecordBatch.from_arrays([
                    pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows]),
                    part.column(0).take(pa.array(at)), part.column(1).take(pa.array(at)),
                    pa.array(list(x[at]), pa.list_(pa.float64())), pa.array([r[3] for r in rows], pa.list_(pa.int32()))],
                    ["first", "query", "node", "copies", "vector", "second"])
    return run


def forest(a, b):
    """Edges of a spanning forest of the links (a, b)."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(names)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i, j in zip(at[:len(a)].tolist(), at[len(a):].tolist()):
        x, y = root(i), root(j)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((names[i], names[j]))
    return out


def block_links(grid, dims, cosine):
    """Links between a block of members and a block of queries: counts per node, and a forest."""
    def run(group: pa.Table) -> pa.Table:
        held = grid.value
        query = group["query"].to_numpy()
        nodes, copies = group["node"].to_numpy(), group["copies"].to_numpy()
        x = group["vector"].combine_chunks().flatten().to_numpy().reshape(-1, dims)
        seconds = group["second"].combine_chunks()
        sizes, flat = seconds.value_lengths().to_numpy(), seconds.flatten().to_numpy()
        owner = np.repeat(np.arange(len(nodes)), sizes)
        is_query = query[owner]
        order = np.argsort(flat[is_query], kind="stable")
        q_cell, q_row = flat[is_query][order], owner[is_query][order]
        m_cell, m_row = flat[~is_query], owner[~is_query]
        order = np.argsort(m_cell, kind="stable")
        m_cell, m_row = m_cell[order], m_row[order]
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for cell in np.unique(m_cell).tolist():
            members = m_row[np.searchsorted(m_cell, cell):np.searchsorted(m_cell, cell, "right")]
            queries = q_row[np.searchsorted(q_cell, cell):np.searchsorted(q_cell, cell, "right")]
            for i in range(0, len(queries), 1024):
                some = queries[i:i + 1024]
                a, b = np.nonzero(x[some] @ x[members].T >= cosine)
                other = nodes[some[a]] != nodes[members[b]]
                left.append(some[a[other]])
                right.append(members[b[other]])
        left, right = np.concatenate(left), np.concatenate(right)
        links = np.bincount(left, copies[right], len(nodes)).astype(np.int64)
        if len(left):
            # does the member visit the query's cell too? then the other block counts its end
            ends = np.unique(right)
            visited = held.traverse(x[ends])
            rows = np.repeat(ends, [len(v) for v in visited])
            both = np.sort(rows.astype(np.int64) * held.k ** 2 + np.concatenate([np.array(v, np.int64) for v in visited]))
            starts = np.unique(left)
            cell_of = np.zeros(len(nodes), np.int64)
            cell_of[starts] = held.cells(x[starts])
            wanted = right.astype(np.int64) * held.k ** 2 + cell_of[left]
            spot = np.minimum(np.searchsorted(both, wanted), len(both) - 1)
            alone = both[spot] != wanted
            links += np.bincount(right[alone], copies[left[alone]], len(nodes)).astype(np.int64)
        some = np.flatnonzero(links)
        edges = forest(nodes[left], nodes[right]) if len(left) else []
        return pa.table({
            "node": pa.array([*nodes[some].tolist(), *[int(a) for a, _ in edges]], pa.int64()),
            "other": pa.array([*[None] * len(some), *[int(b) for _, b in edges]], pa.int64()),
            "links": pa.array([*links[some].tolist(), *[0] * len(edges)], pa.int64())})
    return run


def usable(column: str):
    finite = F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return F.col(column).isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(column, lambda v: v != 0)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE,
                 recall: float = RECALL, scratch: Scratch | None = None) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "multi-index")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    good = F.col("vec_id").isNotNull() & usable("vector")
    lengths = rows.where(good).groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    dims = lengths["dims"] if lengths else 0
    named = rows.select(
        "vec_id", "vector", F.when(good & (F.size("vector") == dims), F.struct(
            F.xxhash64("vector").alias("h"), F.xxhash64(F.lit(1), "vector").alias("g"))).alias("name"))
    nodes = scratch.keep(named.where("name is not null").groupBy("name").agg(
        F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
        .select("node", "copies", F.col("vector").cast("array<double>").alias("vector"), "name"), "nodes")
    count = nodes.count()
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("vector").toArrow()["vector"]
    sums, joined = None, None
    if count:
        x = unit(pa.array(sample.to_pylist(), pa.list_(pa.float64())), dims)
        k = int(max(1, min(round((count / CELL) ** 0.5), len(x) // 4 or 1)))
        grid = spark.sparkContext.broadcast(Grid(x, k, np.random.default_rng(5), cosine, recall))  # bounded by SAMPLE
        placed = scratch.keep(nodes.select("node", "copies", "vector").mapInArrow(place(grid, dims), PLACED), "placed")
        blocks = placed.groupBy("first").agg(
            F.ceil(F.count_if(~F.col("query")) / MEMBERS).cast("int").alias("m"),
            F.ceil(F.count_if("query") / QUERIES).cast("int").alias("q")).where("m > 0")
        placed = placed.join(F.broadcast(blocks), "first")  # at most a row per codeword
        own = F.pmod(F.xxhash64("node"), F.when(F.col("query"), F.col("q")).otherwise(F.col("m"))).cast("int")
        others = F.sequence(F.lit(0), F.when(F.col("query"), F.col("m")).otherwise(F.col("q")) - 1)
        dealt = placed.where("q > 0").withColumn("own", own).withColumn("across", F.explode(others)).select(
            "first", F.when(F.col("query"), F.col("across")).otherwise(F.col("own")).alias("member_block"),
            F.when(F.col("query"), F.col("own")).otherwise(F.col("across")).alias("query_block"),
            "query", "node", "copies", "vector", "second")
        found = scratch.keep(dealt.groupBy("first", "member_block", "query_block").applyInArrow(
            block_links(grid, dims, cosine), "node long, other long, links long"), "links")
        sums = found.where("links > 0").groupBy("node").agg(F.sum("links").alias("links"))
        joined = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")),
                            scratch)
    if count:
        classes = nodes.select("node", "copies", "name").join(sums, "node", "left").join(joined, "node", "left").select(
            "name", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "node").alias("component")).where(
            (F.col("n_links") > 0))
        classes = scratch.keep(classes, "classes")
        result = named.join(small_side(classes), "name", "left")
    else:
        result = named.withColumn("n_links", F.lit(0)).withColumn("component", F.lit(None).cast("long"))
    component = F.coalesce("component", "vec_id")
    return result.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                         component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
