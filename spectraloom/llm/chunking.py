"""Document fingerprints from content-defined chunks.

Method. A gear hash runs over the UTF-8 bytes: h = 2 h + G[byte] modulo 2**16, so it depends on the last 16 bytes
alone. A chunk ends where the hash's upper bits are zero. Chunking is normalised: up to the normal size more bits
are asked for than beyond it, and a chunk has at least ``LEAST`` and at most ``MOST`` bytes. As boundaries
follow the content, an insertion changes the chunks around it only. A fingerprint is the set of chunk digests with
the bytes behind each; likeness is containment weighted by length: the bytes that both share over the bytes of the
shorter one.

``with_next`` pairs every document with the next one in descending order of id by a range partition: cut points come
from a quantile sketch, every partition is sorted, and the first document of a partition also travels to the one
before. One shuffle of the text; nothing is gathered.

Defined cases: null text is empty; the fingerprint of an empty text is an empty string; two empty texts are alike (1),
an empty and another one are not (0). Null ids come after all others; equal ids are in the order of their text.
The next of the last document is the first one; a single document follows itself. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from spectraloom.llm.common import slices, text_bytes, total_bytes
from spectraloom.llm.textscan import byte_numbers

LEAST, NORMAL, MOST = 24, 64, 512
STRICT, LOOSE = 8, 5           # bits that must be zero before and beyond the normal size
PARTITION_BYTES = 16 << 20


def gear_hashes(data: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """The 16-bit gear hash after every byte, by doubling the window: 1, 2, 4, 8, 16 bytes."""
    h = gear[data]
    for width in (1, 2, 4, 8):
        older = np.zeros_like(h)
        older[width:] = h[:-width] << np.uint16(width) if len(h) > width else 0
        h = h + older
    return h


def gear_table() -> np.ndarray:
    return (byte_numbers(11) >> np.uint64(48)).astype(np.uint16)


def boundaries(offsets, data, gear):
    """For each row the ends of its chunks (positions in data)."""
    h = gear_hashes(data, gear)
    # a window of 16 bytes lies within the chunk, as a boundary is at least LEAST bytes after its start
    loose = np.flatnonzero((h >> np.uint16(16 - LOOSE)) == 0)
    strict = (h[loose] >> np.uint16(16 - STRICT)) == 0
    loose, strict = (loose + 1).tolist(), strict.tolist()
    total, at, out = len(loose), 0, []
    for start, stop in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        ends = []
        while start < stop:
            while at < total and loose[at] < start + LEAST:
                at += 1
            end = min(stop, start + MOST)
            k = at
            while k < total and loose[k] < end:
                if strict[k] or loose[k] >= start + NORMAL:
                    end = loose[k]
                    break
                k += 1
            at = k
            ends.append(end)
            start = end
        out.append(ends)
    return out


def chunk_sets(offsets, data, gear):
    """For each row a dict of chunk digest to bytes behind it."""
    raw, digest, sets = data.tobytes(), xxhash.xxh3_64_intdigest, []
    for start, ends in zip(offsets[:-1].tolist(), boundaries(offsets, data, gear)):
        found = {}
        for end in ends:
            name = digest(raw[start:end])
            found[name] = found.get(name, 0) + end - start
            start = end
        sets.append(found)
    return sets


def written(chunks: dict) -> str:
    return " ".join([f"{k:016x}:{n}" for k, n in sorted(chunks.items())])


def read(fingerprint: str) -> dict:
    return {int(k, 16): int(n) for k, _, n in (x.partition(":") for x in fingerprint.split())}


def containment(a: dict, b: dict) -> float:
    """Bytes of chunks that both have over the bytes of the shorter text."""
    if not a or not b:
        return 1.0 if not a and not b else 0.0
    less, more = (a, b) if len(a) <= len(b) else (b, a)
    both = sum([min(n, more[k]) for k, n in less.items() if k in more])
    return both / min(sum(a.values()), sum(b.values()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the fingerprint of every row, in place."""
    def run(batches):
        gear = gear_table()
        for batch in batches:
            offsets, data = text_bytes(batch.column(1))
            for a, b in slices(offsets):
                sets = chunk_sets(offsets[a:b + 1] - offsets[a], data[offsets[a]:offsets[b]], gear)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a),
                                                  pa.array([written(x) for x in sets], pa.string())],
                                                 ["doc_id", "fingerprint"])
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fingerprint string")


def cuts_below(cuts: list[int], value):
    """How many of the sorted cuts are below the value: first among every ``step``-th one, then among those between."""
    step = max(1, math.isqrt(len(cuts)))
    numbers = lambda some: F.array(*[F.lit(c) for c in some]).cast("array<bigint>")
    below = lambda some: F.size(F.filter(some, lambda c: c < value))
    groups = [cuts[i:i + step] for i in range(0, len(cuts), step)]
    whole = below(numbers([group[-1] for group in groups]))  # groups that are below as a whole
    group = F.coalesce(F.get(F.array(*[numbers(g) for g in [*groups, []]]), whole), numbers([]))
    return F.least(whole * step, F.lit(len(cuts))) + below(group)


def with_next(docs: DataFrame, run, schema: str) -> DataFrame:
    """``run(batches)`` over (part, guest, doc_id, text) rows: partitions in descending order of id, each followed
    by the first document of the next one (``guest``). A part is a partition of its own."""
    spark = docs.sparkSession
    parts = max(1, total_bytes(docs) // PARTITION_BYTES)
    ids = docs.select("doc_id").where("doc_id is not null")
    cuts = sorted(set(ids.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.2 / parts))) if (
        parts > 1) else []
    above = cuts_below([int(c) for c in cuts], F.col("doc_id"))
    placed = docs.withColumn("part", F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1))
                             .otherwise(F.lit(len(cuts)) - above).cast("int"))
    # the head of each partition: a row per partition
    heads = sorted((r["part"], r["head"]) for r in
                   placed.groupBy("part").agg(F.max("doc_id").alias("head")).collect())
    goes_to = [(head, heads[i - 1][0]) for i, (_, head) in enumerate(heads)]
    guests = spark.createDataFrame(goes_to, "head long, host int")
    first = placed.join(F.broadcast(guests), F.col("doc_id").eqNullSafe(F.col("head")))
    both = placed.withColumn("guest", F.lit(False)).select("part", "guest", "doc_id", "text").unionByName(
        first.select(F.col("host").alias("part"), F.lit(True).alias("guest"), "doc_id", "text"))
    return (both.repartitionById(len(cuts) + 2, "part").sortWithinPartitions("part", "guest", F.desc_nulls_last("doc_id"), "text")
            .mapInArrow(run, schema))


def edited_rows(batches):
    """Fingerprints of each text and of its edited text, and how alike they and the next text are."""
    gear = gear_table()

    def prints(texts):
        raw = [t.encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        return [s for a, b in slices(offsets) for s in
                chunk_sets(offsets[a:b + 1] - offsets[a], data[offsets[a]:offsets[b]], gear)]

    def finish(rows):
        """rows: (doc_id, text, next text, whether the next text is the following row's own)."""
        edited = []
        for _, text, after in rows:
            cut = len(text) // 3
            edited.append(text[:len(text) - cut] + after[:cut])
        own, others, following = prints([t for _, t, _ in rows]), prints(edited), prints([a for _, _, a in rows])
        return pa.RecordBatch.from_arrays([
            pa.array([i for i, _, _ in rows], kind), pa.array([len(t) for _, t, _ in rows], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
            pa.array([written(x) for x in own], pa.string()), pa.array([written(x) for x in others], pa.string()),
            pa.array([containment(x, y) for x, y in zip(own, others)]),
            pa.array([containment(x, y) for x, y in zip(own, following)])],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    before, waiting, held, kind = None, [], 0, None
    for batch in batches:
        kind = batch.column(2).type
        for part, guest, ident, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            text = text or ""
            if before is not None and before[0] == part:
                waiting.append((before[1], before[2], text))
                held += len(text)
            before = None if guest else (part, ident, text)  # of several guests the first counts
            if held > 1 << 20:
                yield finish(waiting)
                waiting, held = [], 0
    if waiting:
        yield finish(waiting)


def edited_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: n_chars, digest of the edited text, both fingerprints, near_edited and near_next.

    The edited text has its last third (of code points) replaced by the first as many of the next document.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return with_next(docs, edited_rows, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                        "edited_fingerprint string, near_edited double, near_next double")
