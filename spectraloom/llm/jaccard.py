"""N-gram Jaccard join: documents whose sets of five-word shingles have a similarity of 0.8 or more.

Method. A document's shingles are hashed into a parity sketch: every shingle flips one bit, so the Hamming distance
of two sketches never exceeds the size of the sets' symmetric difference. Two linked sets differ in at most
(a + b) * (1 - s) / (1 + s) elements. Per band of set sizes the sketch is cut into more blocks than that, so two
linked sets agree in a block (pigeonhole); blocks are the join keys. A block has 2**64 bits and is held as the XOR
of the mixed positions of its set bits. Candidates that share a key pass a second, narrow sketch and are then
verified on the whole sets, so the result is exact.

* Empty blocks would pair up everything and are no keys. Blocks are so many that a set normally keeps an agreeing
  block without its empty ones; a set for which this count fails is keyed again with other hashes (up to ``SEEDS``
  times, in the end with its empty blocks), so the guarantee never depends on chance.
* Sets of up to ``SMALL`` shingles are keyed by the XOR of the set without any of its 0, 1 or 2 elements instead.
* Equal sets are one node. Of the members of a key's group each is compared with the smallest first (of several
  keys, in the group it shares most keys with); only members that are then still in different components are
  compared with the other smallest and in the end with each other, so copies are never expanded into pairs.
* Keys travel packed (a sorted array per map task and bucket, each key once per node), buckets hold a bounded
  number of keys, and nothing of them comes to the driver.

Defined cases: words are runs other than space and \\x09-\\x0D, A-Z lower-cased. Null or empty text, or text
without words: an empty set that is linked with nothing. Fewer than five words: one shingle. A null ``doc_id`` is
not compared: its component is null. Repeated ids are compared text by text; the component is the smallest id.
Other columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from spectraloom.llm.common import Scratch, release, slices, small_side, text_bytes, total_bytes
from spectraloom.llm.graph import components
from spectraloom.llm.textscan import Words, mix

WORDS = 5
PERCENT = 80           # links need 100 * intersection >= PERCENT * union
SMALL = 14             # sets up to this size are keyed by deletions
FIRST, RATIO = 15, 1.6  # bands of set sizes: first size, upper over lower end
SEEDS = 4
NARROW = 16            # least 64-bit words of the sketch that filters candidates
EARLY = 16             # smallest keys of a node that tell whether a pair has met before
PACK = 500_000         # keys a map task gathers before it sends them
BUCKET_BYTES = 24 << 20  # text behind a bucket of keys


def shingle_sets(offsets, data, words, size=WORDS):
    """For each row the sorted distinct hashes of its shingles."""
    _, _, h, first = words.scan(offsets, data)
    n = len(h)
    if n >= size:
        joined = h[:n - size + 1].copy()
        for k in range(1, size):
            joined = mix(joined) + h[k:n - size + 1 + k]
        joined = mix(joined)
    sets = []
    for row in range(len(first) - 1):
        a, b = int(first[row]), int(first[row + 1])
        if b - a >= size:
            values = np.sort(joined[a:b - size + 1])
            sets.append(values[np.concatenate([[True], values[1:] != values[:-1]])])
        elif b > a:
            one = np.array([b - a], np.uint64)
            for k in range(a, b):
                one = mix(one) + h[k:k + 1]
            sets.append(mix(one ^ np.uint64(0x5555)))
        else:
            sets.append(h[:0])
    return sets


def node_ids(sets):
    """One 64-bit name per set, equal for equal sets; 0 for the empty set."""
    names = np.zeros(len(sets), np.uint64)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        sizes = np.array([len(sets[i]) for i in full])
        flat = np.concatenate([sets[i] for i in full])
        at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        total = np.add.reduceat(flat * flat, at)
        names[full] = mix(mix(np.bitwise_xor.reduceat(flat, at)) + total + sizes.astype(np.uint64)) | np.uint64(1)
    return names


def narrow_sketch(values):
    """Parity of the shingles per bit; ``NARROW`` 64-bit words, doubled until there is a bit for every shingle."""
    bits = 64 * NARROW
    while bits < len(values):
        bits *= 2
    bit = (values >> np.uint64(7)) & np.uint64(bits - 1)
    parity = np.bincount(bit.astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(parity, bitorder="little").view(np.int64)


def bands_of(n, percent=PERCENT):
    """The bands a set of n shingles is keyed in: its own, and those where it may be the smaller set of a pair."""
    low, largest = FIRST, n * 100 // percent
    while low <= largest:
        high = int(low * RATIO)
        if n <= high:
            yield low, high
        low = high + 1


def blocks_of(high, percent=PERCENT):
    most = 2 * high * (100 - percent) // (100 + percent)
    return most + 3 + most // 12


def deletion_keys(values, percent=PERCENT):
    """XOR of the set without every choice of elements that a linked set may lack."""
    n = len(values)
    whole = np.bitwise_xor.reduce(values)
    keys = [np.array([whole])]
    for k in range(1, n * (100 - percent) // 100 + 1):
        chosen = np.array(list(combinations(range(n), k)))
        keys.append(whole ^ np.bitwise_xor.reduce(values[chosen], axis=1))
    return mix(np.concatenate(keys) + np.uint64(1))


def block_keys(values, low, high, percent=PERCENT):
    """Keys of one set in one band."""
    n, blocks = len(values), blocks_of(high, percent)
    most = (n + min(high, n * 100 // percent)) * (100 - percent) // (100 + percent)
    out = []
    for seed in range(SEEDS):
        placed = values if seed == 0 else np.sort(mix(values + np.uint64(seed)))
        block = ((placed >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)  # ascending, as the values are
        at = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        parity = np.bitwise_xor.reduceat(mix(placed), at)
        name = block[at] + np.uint64((low << 36) + (seed << 32))
        set_bits = parity != 0
        out.append(mix(parity[set_bits] + mix(name[set_bits])))
        used = int(set_bits.sum())
        if used - most >= 1:  # blocks - empty blocks - blocks that may differ
            return out
    missing = np.setdiff1d(np.arange(blocks, dtype=np.uint64), block[at][set_bits])
    out.append(mix(mix(missing + np.uint64((low << 36) + (seed << 32)))))
    return out


def all_keys(values, percent=PERCENT):
    out = [deletion_keys(values, percent)] if len(values) <= SMALL else []
    for low, high in bands_of(len(values), percent):
        out += block_keys(values, low, high, percent)
    return np.concatenate(out)


def set_rows(batches):
    words = Words()
    for batch in batches:
        offsets, data = text_bytes(batch.column(1))
        sizes, names, sketches = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], []
        for a, b in slices(offsets):
            sets = shingle_sets(offsets[a:b + 1] - offsets[a], data[offsets[a]:offsets[b]], words)
            sizes.append(np.array([len(s) for s in sets], np.int64))
            names.append(node_ids(sets))
            sketches += [narrow_sketch(s) for s in sets]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(names).view(np.int64)),
             pa.array(sketches, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "node", "sketch"])


def packed_keys(buckets):
    def pack(names, keys):
        nodes, first = np.unique(np.array(names, np.uint64), return_index=True)
        keys = [keys[i] for i in first]
        owner = np.repeat(np.arange(len(nodes), dtype=np.uint32), [len(k) for k in keys])
        flat = np.concatenate(keys)
        bucket = (flat >> np.uint64(20)) % np.uint64(buckets)
        order = np.lexsort((flat, bucket))
        flat, owner, bucket = flat[order], owner[order], bucket[order].astype(np.int64)
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        rows = [(b, x, y) for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if y > x]
        here = [np.unique(owner[x:y], return_inverse=True) for _, x, y in rows]
        return pa.RecordBatch.from_arrays([
            pa.array([b for b, _, _ in rows], pa.int32()),
            pa.array([flat[x:y].tobytes() for _, x, y in rows], pa.binary()),
            pa.array([nodes[who].tobytes() for who, _ in here], pa.binary()),
            pa.array([at.astype(np.uint32 if len(who) > 65535 else np.uint16).tobytes() for who, at in here],
                     pa.binary()),
        ], ["bucket", "keys", "nodes", "owner"])

    def run(batches):
        words, names, keys, held = Words(), [], [], 0
        for batch in batches:
            offsets, data = text_bytes(batch.column(1))
            for a, b in slices(offsets):
                sets = shingle_sets(offsets[a:b + 1] - offsets[a], data[offsets[a]:offsets[b]], words)
                for name, values in zip(node_ids(sets), sets):
                    if len(values):
                        names.append(name)
                        keys.append(all_keys(values))
                        held += len(keys[-1])
                if held >= PACK:
                    yield pack(names, keys)
                    names, keys, held = [], [], 0
        if names:
            yield pack(names, keys)
    return run


def shared_keys(group: pa.Table) -> pa.Table:
    """Of one bucket: the keys that several nodes have, with these nodes and the smallest of them."""
    keys, nodes = [], []
    for k, n, o in zip(group["keys"], group["nodes"], group["owner"]):
        k, n = np.frombuffer(k.as_buffer(), np.uint64), np.frombuffer(n.as_buffer(), np.uint64)
        keys.append(k)
        nodes.append(n[np.frombuffer(o.as_buffer(), np.uint16 if len(n) <= 65535 else np.uint32)])
    keys, nodes = np.concatenate(keys), np.concatenate(nodes).view(np.int64)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    again = keys[1:] == keys[:-1]
    some = np.zeros(len(keys), bool)
    some[1:] |= again
    some[:-1] |= again
    keys, nodes = keys[some], nodes[order[some]]
    if len(keys):
        order = np.lexsort((nodes, keys))
        keys, nodes = keys[order], nodes[order]
        once = np.concatenate([[True], (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])])
        keys, nodes = keys[once], nodes[once]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(np.concatenate([at, [len(keys)]]))
        hub = np.repeat(nodes[at], size)
        shared = np.repeat(size, size) > 1
        keys, nodes, hub = keys[shared], nodes[shared], hub[shared]
    else:
        hub = nodes
    found = pa.table({"key": keys.view(np.int64), "node": nodes, "hub": hub})
    release()
    return found


def whole_sets(batches):
    words = Words()
    for batch in batches:
        offsets, data = text_bytes(batch.column(0))
        for a, b in slices(offsets):
            sets = shingle_sets(offsets[a:b + 1] - offsets[a], data[offsets[a]:offsets[b]], words)
            yield pa.RecordBatch.from_arrays([
                pa.array(node_ids(sets).view(np.int64)), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                ["node", "shingles"])


def near(a_n, b_n, percent=PERCENT):
    """Upper bound of the symmetric difference of two linked sets, or null where the sizes rule a link out."""
    total = F.col(a_n) + F.col(b_n)
    fits = (F.least(a_n, b_n) * 100) >= (F.greatest(a_n, b_n) * percent)
    return F.when(fits, F.floor(total * (100 - percent) / (100 + percent)))


def folded(sketch, width):
    """The sketch in ``width`` words: parities of bits that fall together are added up."""
    def one(i):
        return F.aggregate(F.sequence(i, F.size(sketch) - 1, width), F.lit(0).cast("long"),
                           lambda s, k: s.bitwiseXOR(F.get(sketch, k)))
    return F.when(F.size(sketch) == width, sketch).otherwise(F.transform(F.sequence(F.lit(0), width - 1), one))


def hamming(a, b):
    """Distance of two sketches; the longer one is folded."""
    width = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(folded(F.col(a), width), folded(F.col(b), width), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(pairs, F.lit(0), lambda s, x: s + x)


def side(table: DataFrame, name: str, *columns: str) -> DataFrame:
    return table.select(F.col("node").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns])


def by_sketch(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that the sizes and the sketches do not rule out."""
    return (pairs.join(side(classes, "a", "n", "sketch"), "a").join(side(classes, "b", "n", "sketch"), "b")
            .where(hamming("a_sketch", "b_sketch") <= near("a_n", "b_n")).select("a", "b"))


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, scratch: Scratch,
             percent: int = PERCENT) -> DataFrame:
    """Of pairs (a, b) of nodes those whose whole sets are similar enough; one document of each node is read again."""
    pairs = scratch.keep(pairs, "pairs")
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    asked = scratch.keep(classes.select("node", F.col("least").alias("doc_id")).join(asked, "node", "left_semi")
                         .select("doc_id"), "asked")
    sets = docs.join(small_side(asked), "doc_id", "left_semi").select("text").mapInArrow(
        whole_sets, "node long, shingles array<long>")
    both = F.size(F.array_intersect("a_shingles", "b_shingles"))
    union = F.size("a_shingles") + F.size("b_shingles") - both
    return scratch.keep(pairs.join(side(sets, "a", "shingles"), "a").join(side(sets, "b", "shingles"), "b")
                        .where(both * 100 >= union * percent).select("a", "b"), "links")


def still_apart(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """Pairs of nodes in different components."""
    label = {x: joined.select(F.col("node").alias(x), F.col("component").alias(f"{x}_component")) for x in "ab"}
    return (pairs.join(label["a"], "a", "left").join(label["b"], "b", "left")
            .where(F.coalesce("a_component", "a") != F.coalesce("b_component", "b")).select("a", "b"))


def members(part: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of nodes of a key's group that are in different components and that the sketches do not rule out.

    Near texts share many keys. A row names those of its node's ``EARLY`` smallest keys that come before its own; two
    rows with such a key in common have met there already. So a pair is found at its smallest common key, always.
    """
    rank = F.row_number().over(Window.partitionBy("node").orderBy("key"))
    early = (part.select("node", "key", rank.alias("rank")).where(F.col("rank") <= EARLY)
             .groupBy("node").agg(F.collect_list("key").alias("early")))
    part = (part.join(classes.select("node", "n", "sketch"), "node").join(early, "node")
            .withColumn("early", F.filter("early", lambda k: k < F.col("key"))))
    a, b = (part.select("key", *[F.col(c).alias(f"{x}_{c}") for c in ("node", "component", "n", "sketch", "early")])
            for x in "ab")
    return (a.join(b, (a.key == b.key) & (F.col("a_node") < F.col("b_node"))
                   & (F.col("a_component") != F.col("b_component"))
                   & ~F.arrays_overlap("a_early", "b_early")
                   & (hamming("a_sketch", "b_sketch") <= near("a_n", "b_n")))
            .select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))


def further(pairs, links, joined, docs, classes, scratch):
    """Links and components after the links among ``pairs`` are added."""
    more = verified(by_sketch(pairs, classes), docs, classes, scratch)
    if more.isEmpty():
        return links, joined
    links = links.unionByName(more)
    return links, components(links, scratch)


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      scratch: Scratch | None = None) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id`` and ``n_copies`` (documents with its set)."""
    scratch = scratch or Scratch(docs.sparkSession, "jaccard")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    buckets = max(1, total_bytes(docs) // BUCKET_BYTES)

    kind = dict(docs.dtypes)["doc_id"]
    rows = scratch.keep(docs.mapInArrow(set_rows, f"doc_id {kind}, n_shingles long, node long, sketch array<long>"),
                        "rows")
    classes = scratch.keep(rows.where("n_shingles > 0 and doc_id is not null").groupBy("node").agg(
        F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"),
        F.first("sketch").alias("sketch")), "classes")
    shared = scratch.keep(
        docs.where("doc_id is not null").select("doc_id", "text")
        .mapInArrow(packed_keys(buckets), "bucket int, keys binary, nodes binary, owner binary")
        .groupBy("bucket").applyInArrow(shared_keys, "key long, node long, hub long"), "shared")

    # first each node with the hub it shares most keys with, so that every set travels once; then its other hubs
    hubs = scratch.keep(shared.where("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("keys")), "hubs")
    best = hubs.groupBy("node").agg(F.max(F.struct("keys", "hub")).alias("x")).select(
        F.col("x.hub").alias("a"), F.col("node").alias("b"))
    links = verified(by_sketch(best, classes), docs, classes, scratch)
    joined = components(links, scratch)
    with_hub = hubs.select(F.col("hub").alias("a"), F.col("node").alias("b"))
    links, joined = further(still_apart(with_hub, joined), links, joined, docs, classes, scratch)

    # members of a key's group that are still apart are compared with each other
    part = shared.select("key", "node").join(joined, "node", "left").select(
        "key", "node", F.coalesce("component", "node").alias("component"))
    apart = part.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    part = scratch.keep(part.join(apart.select("key"), "key", "left_semi"), "apart")
    across = members(part, classes).distinct().join(with_hub, ["a", "b"], "left_anti")
    links, joined = further(across, links, joined, docs, classes, scratch)

    classes = classes.drop("n", "sketch").join(joined, "node", "left").select(
        "node", "copies", "least", F.coalesce("component", "node").alias("component"))
    smallest = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    names = scratch.keep(classes.join(smallest, "component").where("copies > 1 or component_id <> least")
                         .select("node", "copies", "component_id"), "names")
    return (rows.join(small_side(names), "node", "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
                    F.when(F.col("n_shingles") > 0, F.coalesce("copies", F.lit(1))).otherwise(1).alias("n_copies")))
