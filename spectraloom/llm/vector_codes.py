"""Vector codes: integer product quantisation with exact nearest entries found through pivots.

Method. A component x becomes floor(256 * x), a vector is cut into equal parts, and each part position has a codebook
of integer entries, which starts as that part of the smallest ids. Each part position also has a few fixed pivots. The
distances of every part to its pivots are computed once and stored. In each round the pivots' distances to the current
entries are computed; by the triangle inequality the difference of the two is at most the distance from part to entry.
These lower bounds give the order in which entries are evaluated, and shut out all that cannot come near the best one
so far. What is evaluated is evaluated in integers, so the pruning changes no result: nearest by squared distance, ties
to the lower index. Each round replaces an entry by the floor of its parts' mean; unused entries stay.

Scale. No vector is moved: a round is one scan in which every task sums its parts per entry, and what travels is at most
one row per task, part position and entry. Codebooks and pivots are parts x entries x width numbers, of a size that does
not grow with the rows. The stored table (integers and pivot distances) is read once per round and written once. Errors
per label are summed before the shuffle; the sums meet the rows by a broadcast behind a row check, else by a join.

Defined cases: a vector that is null or holds null or non-finite components is dropped; vectors of unequal lengths
count as ended by zeros up to the longest, and up to a multiple of the number of parts (zeros add nothing to a
distance); with fewer rows than entries a codebook has as many entries as there are rows; equal ids are taken in the
order of their vectors, null ids come last; null labels are one label; an empty table gives an empty result; an integer
component beyond 2**24 fails the job, as sums of squares might not fit a long; other columns are dropped, whatever
their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spectraloom.llm.common import Scratch, release, small_side

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
PIVOTS = 4
LARGEST = 1 << 24
#: What a distance kept as a 32-bit float can be off, relative, with room to spare.
LOOSE = 2.0 ** -20


@dataclass(frozen=True)
class Codebooks:
    """Integer entries, (part, entry, position), and the fixed pivots of each part."""

    entries: np.ndarray
    pivots: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def integers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int) -> DataFrame:
    """(ident, label, v): kept rows as integers, all of one length that is a multiple of ``parts``."""
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    rows = vectors.select(F.col(f"`{id_col}`").alias("ident"), F.col(f"`{label_col}`").alias("label"),
                          F.col(f"`{vector_col}`").alias("v")).where(F.col("v").isNotNull() & finite)
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    width = max(1, -(-longest // parts)) * parts
    beyond = F.raise_error(F.lit(f"a component times {SCALE} is beyond {LARGEST}")).cast("int")
    scaled = F.transform("v", lambda x: F.floor(x.cast("double") * SCALE))
    checked = F.transform(scaled, lambda x: F.when(F.abs(x) <= LARGEST, x.cast("int")).otherwise(beyond))
    return rows.select("ident", "label", F.concat(
        checked, F.array_repeat(F.lit(0), F.lit(width) - F.size("v"))).alias("v"))


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return ((x - y) ** 2).sum(axis=-1)


def spread_out(entries: np.ndarray, count: int) -> np.ndarray:
    """Of one part's entries those that are far from each other: each next one has the largest distance to the others."""
    chosen = [0]
    nearest = squared(entries, entries[0])
    while len(chosen) < min(count, len(entries)):
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, squared(entries, entries[chosen[-1]]))
    return entries[chosen]


def pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(rows, pivots): distances of one part's rows to its pivots."""
    return np.sqrt(squared(x[:, None], pivots[None]).astype(np.float64))


def nearest_entries(x: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray):
    """Index and squared distance of each row's nearest entry, and how many distances were evaluated."""
    of_entries = pivot_distances(entries, pivots)
    bound = np.zeros((len(x), len(entries)))
    for p in range(len(pivots)):
        mine, theirs = to_pivots[:, p, None].astype(np.float64), of_entries[None, :, p]
        np.maximum(bound, np.abs(mine - theirs) - LOOSE * (mine + theirs), out=bound)
    bound *= bound
    here = np.arange(len(x))
    index = bound.argmin(axis=1)
    best = squared(x, entries[index])
    left = bound <= best[:, None]
    left[here, index] = False
    rows, candidates = np.nonzero(left)
    order = np.lexsort((bound[rows, candidates], rows))
    rows, candidates = rows[order], candidates[order]
    counts = np.bincount(rows, minlength=len(x))
    at, stop = np.cumsum(counts) - counts, np.cumsum(counts)
    active, evaluated = here[counts > 0], len(x)
    while len(active):  # the candidate with the next larger bound of every row that has one in reach
        entry = candidates[at[active]]
        reach = bound[active, entry] <= best[active]
        active, entry = active[reach], entry[reach]
        distance = squared(x[active], entries[entry])
        evaluated += len(active)
        better = (distance < best[active]) | ((distance == best[active]) & (entry < index[active]))
        best[active[better]], index[active[better]] = distance[better], entry[better]
        at[active] += 1
        active = active[at[active] < stop[active]]
    return index, best, evaluated


def blocks(batch: pa.RecordBatch, parts: int, rows: int = 2048):
    """(offset, parts as integers (row, part, position)) of a batch, some rows at a time."""
    column = batch.column("v")
    for a in range(0, len(batch), rows):
        some = column.slice(a, rows)
        yield a, some.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(some), parts, -1)


def with_pivot_distances(rows: DataFrame, books: Codebooks) -> DataFrame:
    """Adds ``to_pivots``: for every part the distances to its pivots, one after another."""
    parts = len(books.pivots)

    def run(batches):
        for batch in batches:
            for a, x in blocks(batch, parts):
                found = np.concatenate([pivot_distances(x[:, k], books.pivots[k]) for k in range(parts)], axis=1)
                offsets = np.arange(len(x) + 1, dtype=np.int32) * found.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(a, len(x)).columns,
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel().astype(np.float32)))],
                    names=[*batch.schema.names, "to_pivots"])
        release()

    return rows.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", to_pivots array<float>")


def assigned(batches, books: Codebooks):
    """(batch rows, parts, index, squared distance) of all rows, some at a time."""
    parts, pivots = books.pivots.shape[:2]
    for batch in batches:
        for a, x in blocks(batch, parts):
            some = batch.slice(a, len(x))
            far = some.column("to_pivots").flatten().to_numpy(zero_copy_only=False).reshape(len(x), parts, pivots)
            found = [nearest_entries(x[:, k], far[:, k], books.entries[k], books.pivots[k])[:2] for k in range(parts)]
            yield some, x, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def next_entries(rows: DataFrame, books: Codebooks) -> np.ndarray:
    """Entries replaced by the floor of their parts' mean."""
    parts, entries, width = books.entries.shape
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        held = sent.value
        counts = np.zeros(parts * entries, np.int64)
        sums = np.zeros((parts * entries, width), np.int64)
        for _, x, index, _ in assigned(batches, held):
            cell = index + np.arange(parts) * entries
            counts += np.bincount(cell.ravel(), minlength=len(counts))
            np.add.at(sums, cell.ravel(), x.reshape(-1, width))
        used = np.flatnonzero(counts)
        offsets = np.arange(len(used) + 1, dtype=np.int32) * width
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(counts[used]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(sums[used].ravel()))],
            names=["cell", "n", "sums"])
        release()

    total = (rows.mapInArrow(run, "cell long, n long, sums array<long>").groupBy("cell")
             .agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width)]).alias("sums")))
    new = books.entries.copy()
    for cell, n, sums in total.collect():  # one row per part and entry at most
        new[divmod(cell, entries)] = [s // n for s in sums]
    sent.unpersist()
    return new


def fit_codebooks(rows: DataFrame, scratch: Scratch, parts: int = PARTS, entries: int = ENTRIES,
                  rounds: int = ROUNDS) -> tuple[Codebooks, DataFrame] | None:
    """Codebooks after all rounds and the rows with their pivot distances; nothing for an empty table."""
    first = [r["v"] for r in rows.orderBy(F.asc_nulls_last("ident"), "v").limit(entries).collect()]
    if not first:
        return None
    start = np.array(first, np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)
    books = Codebooks(start, np.stack([spread_out(part, PIVOTS) for part in start]))
    rows = scratch.keep(with_pivot_distances(rows, books), "pivots")
    for _ in range(rounds):
        books = Codebooks(next_entries(rows, books), books.pivots)
    return books, rows


def assign(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(ident, label, codes, error): the nearest entry of every part and the sum of their squared distances."""
    sent = rows.sparkSession.sparkContext.broadcast(books)
    kinds = dict(rows.dtypes)

    def run(batches):
        for some, _, index, distance in assigned(batches, sent.value):
            offsets = np.arange(len(index) + 1, dtype=np.int32) * index.shape[1]
            yield pa.RecordBatch.from_arrays(
                [some.column("ident"), some.column("label"),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(index.ravel().astype(np.int32))),
                 pa.array(distance.sum(axis=1))], names=["ident", "label", "codes", "error"])
        release()

    return rows.mapInArrow(run, f"ident {kinds['ident']}, label {kinds['label']}, codes array<int>, error long")


def compress_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                     label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES,
                     rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """(ident, label, codes, error, label_error) of every kept row, and the codebooks."""
    scratch = Scratch(vectors.sparkSession, "codes")
    rows = integers(vectors, id_col, vector_col, label_col, parts)
    fitted = fit_codebooks(rows, scratch, parts, entries, rounds)
    if fitted is None:
        empty = rows.select("ident", "label", F.array().cast("array<int>").alias("codes"),
                            F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return empty, None
    books, rows = fitted
    coded = scratch.keep(assign(rows, books), "coded")
    sums = scratch.keep(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "labels")
    return coded.join(small_side(sums), F.col("label").eqNullSafe(F.col("of")), "left").drop("of"), books


def code_text(codes):
    """Two hex digits per part."""
    return F.array_join(F.transform(codes, lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")


def sql() -> str:
    """The same as DuckDB SQL over ``embeddings`` of one length, nearest entries by comparing with all."""
    def nearest(k: int) -> str:
        return f"""near{k} AS MATERIALIZED (SELECT vec_id, part, min(struct_pack(d := d, entry := entry)) AS best FROM (
    SELECT vec_id, part, entry, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM comps JOIN book{k} USING (part, pos)
    GROUP BY vec_id, part, entry) GROUP BY vec_id, part)"""

    steps = [f"""kept AS (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"""comps AS MATERIALIZED (SELECT vec_id, i // w AS part, i % w AS pos,
    CAST(floor(CAST(embedding[i + 1] AS DOUBLE) * {SCALE}) AS BIGINT) AS x
    FROM (SELECT vec_id, embedding, len(embedding) // {PARTS} AS w, unnest(range(len(embedding))) AS i FROM kept))""",
             f"""book0 AS MATERIALIZED (SELECT part, entry, pos, x AS c FROM comps JOIN
    (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {ENTRIES}) USING (vec_id))"""]
    for k in range(ROUNDS):
        steps += [nearest(k), f"""mean{k} AS (SELECT part, best.entry AS entry, pos,
    CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM near{k} JOIN comps USING (vec_id, part) GROUP BY ALL)""",
                  f"""book{k + 1} AS MATERIALIZED (SELECT part, entry, pos,
    CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c
    FROM book{k} LEFT JOIN mean{k} USING (part, entry, pos))"""]
    steps += [nearest(ROUNDS), f"""coded AS (SELECT vec_id, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code,
    CAST(sum(best.d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY vec_id)"""]
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM book{ROUNDS}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""
