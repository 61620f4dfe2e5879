"""Language-model scores from a hierarchical Pitman-Yor process.

Restaurants. A context is the previous word, as it is; the start of a text has its own. Every context has a restaurant;
all context restaurants share one parent, whose base is uniform over the known tokens and one unknown.

Seating. A sweep draws, for every restaurant and dish, the number of tables from its conditional distribution given
all other seats (generalised Stirling numbers; beyond ``EXACT`` customers the further customers are seated in
steps), then the parent's tables given the customers that the contexts send. The restaurants' totals are global numbers
and are refreshed between rounds. Predictive probabilities of the last ``SAMPLES`` sweeps, each with its own totals, are
averaged, so the probabilities of a context add up to one.

Spark. Words are counted once with a combine per map task. A map task packs its texts: the different pairs of context and
token with their training counts go to buckets, and the texts stay as lists of pair numbers. All pairs of a word are in
one bucket, so the parent's draws are local. The pairs of the ``HEAD`` most frequent words (a bounded list) are dealt by
context instead, so a frequent word is never gathered anywhere; what their contexts send is a global number like the
totals of the restaurants. Those are a table: a round sums it by context and sends the sums to the buckets that have the
context. A pair with one customer always has one table, so rounds carry the other pairs and the numbers of these. At last
every bucket scores its pairs, and every pack adds up its texts. Buckets are sized by the corpus.

Disk. Numbers are sent and written as compressed planes of bytes, contexts as two bytes if they are among the frequent
words; a table goes when no later step reads it, the shuffle files of a write when it ends. Buckets, and at the end packs,
are shuffled in up to ``GROUPS`` groups, one after another, so that only a part is in a table and in shuffle files at once.

Memory. Rows of a bucket or a pack are megabytes: they are written in small row groups, since a reader takes a group of
them at once, and a worker hands back after each of them what it took.

Defined cases: null text is empty; an empty text has one token, its end. Null ids are held out. Repeated rows are
scored each. Without training documents every probability is 1. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spectraloom.llm.common import Scratch, release, slices, text_bytes, total_bytes
from spectraloom.llm.textscan import Words

CLASSES = 512          # contexts of a seating that is not of a bucket
HEAD = 2048            # words whose pairs are dealt by context
COMMON = 65_000        # words whose hashes are sent as numbers of two bytes, at most
RARE = 65_535          # the number of all others, whose hashes follow
EXACT = 32             # customers of one dish up to which table counts are drawn from their exact distribution
BURN_IN, SAMPLES, ROUNDS = 2, 3, 3
STRENGTH = 1.0
START, END = 0, 1      # the context of a text's first word, and the hash that stands for the end of a text
PACK = 1_000_000       # occurrences a map task gathers before it sends them
BUCKET_BYTES = 24 << 20
GROUPS = 3             # parts, at most, of the buckets, and of the packs, that are shuffled one after another


def tokens(offsets, data, words):
    """Of all rows: token hashes with one end per row, their contexts (the words before), and rows' first tokens."""
    _, _, h, first = words.scan(offsets, data)
    rows, n = len(first) - 1, len(h)
    token = np.full(n + rows, END, np.uint64)
    token[np.arange(n) + np.repeat(np.arange(rows), np.diff(first))] = h
    first = first + np.arange(rows + 1)
    context = np.zeros(n + rows, np.uint64)
    context[1:] = token[:-1]
    context[first[:-1]] = START
    return token, context, first


def handed_back(found):
    """The result of a group, when what it was computed with is freed: the worker lives on."""
    release()
    return found


def distinct(*parts):
    """Sorted different numbers of all arrays. A sort is several times faster than ``np.unique``, which hashes them."""
    values = np.concatenate(parts)
    values.sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return values[new]


def pair_order(bucket, token, context, width):
    """The order by bucket, token, context (numbers below ``width``), and in it where another pair begins."""
    if (int(bucket.max(initial=0)) + 1) * width * width < 1 << 63:  # as one number
        key = (bucket.astype(np.int64) * width + token) * width + context
        by = np.argsort(key)
        columns = [key[by]]
    else:
        by = np.lexsort((context, token, bucket))
        columns = [x[by] for x in (bucket, token, context)]
    new = np.ones(len(by), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in columns], axis=0)
    return by, new


def summed(keys, counts):
    unique, at = np.unique(keys, return_inverse=True)
    return unique, np.bincount(at, counts, len(unique)).astype(np.int64)


def word_counts(batches):
    """Training tokens of a map task with their counts."""
    words = Words()
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    waiting, held = [], 0

    def merge():
        return summed(np.concatenate([keys, *[k for k, _ in waiting]]),
                      np.concatenate([counts, *[c for _, c in waiting]]))

    for batch in batches:
        offsets, data = text_bytes(batch.column(0))
        for a, b in slices(offsets):
            token = tokens(offsets[a:b + 1] - offsets[a], data[offsets[a]:offsets[b]], words)[0]
            waiting.append(np.unique(token, return_counts=True))
            held += len(waiting[-1][0])
            if held > max(PACK, len(keys)):
                keys, counts = merge()
                waiting, held = [], 0
                if len(keys) > 4 * PACK:
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["word", "n"])
                    keys, counts = keys[:0], counts[:0]
    keys, counts = merge()
    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["word", "n"])
    del keys, counts, waiting, words
    release()


def planes(values) -> bytes:
    """Unsigned numbers as bytes, first all lowest ones: the upper ones of small or sorted numbers compress to little.
    Compressed here already, so that what is shuffled and what the executors hold is small; the size comes first."""
    raw = values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unplaned(value, kind):
    held, width = value.as_buffer(), np.dtype(kind).itemsize
    size = int.from_bytes(held.slice(0, 8).to_pybytes(), "little")
    raw = np.frombuffer(pa.decompress(held.slice(8), size, "zstd"), np.uint8) if size else np.zeros(0, np.uint8)
    return np.ascontiguousarray(raw.reshape(width, len(raw) // width).T).view(kind).ravel()


PACKS = ("pack long, bucket int, words binary, runs binary, context binary, rare binary, count binary, doc_id {0}, "
         "train array<boolean>, sizes binary, pairs binary")


def ranks(head, token):
    """Positions of the tokens in the sorted head, and which of them are in it."""
    at = np.minimum(np.searchsorted(head, token), max(len(head) - 1, 0))
    return at, head[at] == token if len(head) else np.zeros(len(token), bool)


def occurrences(head, common, buckets):
    """Packs of a map task: its pairs by bucket (those of the head: ``buckets`` and more), and its texts (-1)."""
    def run(batches):
        from pyspark import TaskContext
        words, kinds = Words(), {}
        serial, held, parts, ids = TaskContext.get().partitionId() << 32, 0, [], []

        def row(**values):
            return pa.RecordBatch.from_arrays([pa.array([values.get(name)], kind) for name, kind in kinds.items()],
                                              names=list(kinds))

        def pack():
            token, context, trained = (np.concatenate(x) for x in zip(*(p[:3] for p in parts)))
            names, at = np.unique(np.append(token, np.uint64(START)), return_inverse=True)
            near = np.append(at[-1], at[:-2])  # a context is the token before, or the start
            near[context == START] = at[-1]
            at = at[:-1]
            own, frequent = ((names >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32), ranks(head, names)[1]
            coded, known = ranks(common, names)
            bucket = np.where(frequent[at], buckets + own[near], own[at])
            by, new = pair_order(bucket, at, near, len(names))
            number = np.empty(len(by), np.uint32)
            number[by] = np.cumsum(new) - 1
            start = np.flatnonzero(new)
            count = np.add.reduceat(trained[by].astype(np.int64), start).astype(np.uint32)
            at, near, bucket = (x[by[start]] for x in (at, near, bucket))
            code, token, context, known = np.where(known, coded, RARE).astype(np.uint16)[near], names[at], names[near], known[near]
            cuts = np.searchsorted(bucket, np.arange(2 * buckets + 1))
            for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])):
                if y > x:
                    unique, runs = np.unique(token[x:y], return_counts=True)
                    yield row(pack=serial, bucket=b, words=planes(unique), runs=planes(runs.astype(np.uint32)),
                              context=planes(code[x:y]), rare=planes(context[x:y][~known[x:y]]), count=planes(count[x:y]))
            yield row(pack=serial, bucket=-1, doc_id=pa.concat_arrays([x for x, _ in ids]).to_pylist(),
                      train=np.concatenate([x for _, x in ids]).tolist(),
                      sizes=planes(np.concatenate([p[3] for p in parts]).astype(np.uint32)), pairs=planes(number))

        for batch in batches:
            kinds = kinds or {"pack": pa.int64(), "bucket": pa.int32(), **dict.fromkeys(
                ["words", "runs", "context", "rare", "count"], pa.binary()), "doc_id": pa.list_(batch.column(0).type),
                "train": pa.list_(pa.bool_()), "sizes": pa.binary(), "pairs": pa.binary()}
            offsets, data = text_bytes(batch.column(2))
            train = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for a, b in slices(offsets):
                token, context, first = tokens(offsets[a:b + 1] - offsets[a], data[offsets[a]:offsets[b]], words)
                sizes = np.diff(first)
                parts.append((token, context, np.repeat(train[a:b], sizes), sizes))
                ids.append((batch.column(0).slice(a, b - a), train[a:b]))
                held += len(token)
                if held >= PACK:
                    yield from pack()
                    serial, held, parts, ids = serial + 1, 0, [], []
        if ids:
            yield from pack()
        del parts, ids, words
        release()
    return run


PAIRS = ("bucket int, words binary, runs binary, contexts binary, context binary, count binary, packs array<long>, "
         "places array<binary>")


def bucket_pairs(common):
    """One bucket: its words and contexts, its pairs (by word, then context) with counts, and each pack's pairs."""
    def numbered(group):
        runs = [(unplaned(w, np.uint64), unplaned(r, np.uint32)) for w, r in zip(group["words"], group["runs"])]
        words = distinct(*[w for w, _ in runs])
        codes, rare = [unplaned(c, np.uint16) for c in group["context"]], [unplaned(r, np.uint64) for r in group["rare"]]
        used = np.zeros(RARE + 1, bool)
        for code in codes:
            used[code] = True
        contexts = distinct(common[np.flatnonzero(used[:RARE])], *rare)
        spot, pairs = np.searchsorted(contexts, common), []  # where the common ones are, if they are there
        for i, (w, r) in enumerate(runs):
            near = spot[np.minimum(codes[i], len(common) - 1)]
            near[codes[i] == RARE] = np.searchsorted(contexts, rare[i])
            pairs.append(np.repeat(np.searchsorted(words, w) * len(contexts), r) + near)
            codes[i] = rare[i] = None
        pair = distinct(*pairs)
        counts = np.zeros(len(pair), np.uint64)
        for i, c in enumerate(group["count"]):
            place = np.searchsorted(pair, pairs[i])
            counts[place] += unplaned(c, np.uint32)  # a pack's pairs differ
            # a pack's pairs are sorted like the bucket's: steps are small numbers
            pairs[i] = planes(np.diff(place.astype(np.uint32), prepend=np.uint32(0)))
        word, near = np.divmod(pair, len(contexts))
        held = [("bucket", group["bucket"][0].as_py(), pa.int32()), ("words", planes(words), pa.binary()),
                ("runs", planes(np.bincount(word, minlength=len(words)).astype(np.uint32)), pa.binary()),
                ("contexts", planes(contexts), pa.binary()), ("context", planes(near.astype(np.uint32)), pa.binary()),
                ("count", planes(counts), pa.binary()), ("packs", group["pack"].to_pylist(), pa.list_(pa.int64())),
                ("places", pairs, pa.list_(pa.binary()))]
        return pa.table({name: pa.array([value], kind) for name, value, kind in held})

    def run(group: pa.Table) -> pa.Table:
        return handed_back(numbered(group))
    return run


class Bucket:
    """The numbers of a bucket's row; ``trained`` are the pairs with a count."""

    def __init__(self, row, head, buckets):
        self.number = row["bucket"].as_py()
        self.words, self.contexts = unplaned(row["words"], np.uint64), unplaned(row["contexts"], np.uint64)
        self.word = np.repeat(np.arange(len(self.words)), unplaned(row["runs"], np.uint32))
        self.context = unplaned(row["context"], np.uint32).astype(np.int64)
        counts = unplaned(row["count"], np.uint64).astype(np.int64)
        self.trained = np.flatnonzero(counts)
        self.counts = counts[self.trained]
        self.rank = ranks(head, self.words)[0] if self.number >= buckets else None

    def seating(self, sums: pa.Table, totals, number):
        """Sampled tables with the restaurants' totals of ``sums``, and the rows of ``sums`` by context."""
        at = places_of(self.contexts, sums)
        table = {name: np.zeros(len(self.contexts)) for name in ("customers", "used", "t0", "t1", "t2")}
        customers = sums["customers"].to_numpy()
        for name, values in table.items():  # only pairs of more than one customer have more tables than customers
            values[at] = sums[name].fill_null(-1).to_numpy()
            values[at] = np.where(values[at] < 0, customers, values[at])
        own = totals | {"customers": table["customers"], "tables": table["used"]}
        sent = None if self.rank is None else [totals["head"][k][self.rank] for k in range(2)]
        return Seating(self.word[self.trained] * len(self.contexts) + self.context[self.trained], self.counts,
                       len(self.words), own, seeds(number, self.number), sent), table


def places_of(contexts, sums: pa.Table):
    return np.searchsorted(contexts, sums["key"].to_numpy().astype(np.int64, copy=False).view(np.uint64))


def seeds(number, bucket):
    return np.random.default_rng([number, bucket + 1_000_000])


LIVE = ("bucket int, rank binary, ones binary, runs binary, contexts binary, context binary, count binary, alone long")


def live_pairs(head, buckets):
    """Of each bucket what rounds draw: pairs of two or more customers (others have one table) and their contexts, words
    with two or more in the parent, or of the head (others, ``alone``, have one table there), with their single pairs."""
    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                held = Bucket({name: batch.column(name)[i] for name in batch.schema.names}, head, buckets)
                word, context = held.word[held.trained], held.context[held.trained]
                many = held.counts > 1
                ones = np.bincount(word[~many], minlength=len(held.words))
                runs = np.bincount(word[many], minlength=len(held.words))
                live = (ones + runs > 1) | (runs > 0)
                if held.rank is not None:
                    live[:] = True
                contexts, near = np.unique(context[many], return_inverse=True)
                rank = held.rank if held.rank is not None else np.zeros(0, np.int64)
                values = [pa.array([held.number], pa.int32()), *[pa.array([planes(x)], pa.binary()) for x in (
                    rank.astype(np.uint32), ones[live].astype(np.uint64), runs[live].astype(np.uint32),
                    held.contexts[contexts], near.astype(np.uint32), held.counts[many].astype(np.uint64))],
                    pa.array([int((ones[~live] > 0).sum())])]
                yield pa.RecordBatch.from_arrays(
                    values, names=["bucket", "rank", "ones", "runs", "contexts", "context", "count", "alone"])
                del held, word, context, many, ones, runs, live, contexts, near, values
                release()
    return run


SUMS = "kind int, bucket int, key long, t0 long, t1 long, t2 long"
CONTEXT, WORD, PARENT = 0, 1, 2  # kinds of sums: of a context, of a head word, of all


def sums_table(bucket, *parts):
    """Rows (kind, bucket, key, t0, t1, t2) of (kind, keys, three numbers each)."""
    kinds = np.concatenate([np.full(len(keys), kind, np.int32) for kind, keys, _ in parts])
    numbers = np.concatenate([np.asarray(n, np.int64).reshape(-1, 3) for _, _, n in parts])
    keys = np.concatenate([np.asarray(k).astype(np.int64, copy=False) if k.dtype != np.uint64 else k.view(np.int64)
                           for _, k, _ in parts])
    return pa.RecordBatch.from_arrays(
        [pa.array(kinds), pa.array(np.full(len(kinds), bucket, np.int32)), pa.array(keys),
         *[pa.array(np.ascontiguousarray(numbers[:, i])) for i in range(3)]], names=["kind", "bucket", "key", "t0", "t1", "t2"])


def first_sums(head, buckets):
    """Before any round: customers and dishes of the contexts, contexts of the head's words, pairs seen once and twice."""
    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                held = Bucket({name: batch.column(name)[i] for name in batch.schema.names}, head, buckets)
                context, width = held.context[held.trained], len(held.contexts)
                customers, dishes = np.bincount(context, held.counts, width), np.bincount(context, minlength=width)
                parts = [(CONTEXT, held.contexts, np.stack([customers, dishes, customers > dishes], 1)),
                         (PARENT, np.zeros(1, np.int64), [(held.counts == 1).sum(), (held.counts == 2).sum(), 0])]
                if held.rank is not None:
                    seen = np.bincount(held.word[held.trained], minlength=len(held.words))
                    parts.append((WORD, held.rank, np.stack([seen] * 3, 1)))
                yield sums_table(held.number, *parts)
                del held, context, customers, dishes, parts
                release()
    return run


def log_stirling(discount):
    """log of the generalised Stirling numbers S(c, t) for c, t up to EXACT."""
    table = np.full((EXACT + 1, EXACT + 1), -np.inf)
    table[0, 0] = 0.0
    for c in range(EXACT):
        t = np.arange(1, c + 2)
        grow = np.where(c - discount * t > 0, np.log(np.maximum(c - discount * t, 1e-300)), -np.inf)
        table[c + 1, 1:c + 2] = np.logaddexp(table[c, :c + 1], table[c, 1:c + 2] + grow)
    return table


def draw_tables(customers, weight, discount, stirling, rng):
    """Tables of each dish, given its customers and the weight of opening one."""
    tables = np.minimum(customers, 1)
    small = np.minimum(customers, EXACT)
    order = np.argsort(small, kind="stable")
    cuts = np.searchsorted(small[order], np.arange(EXACT + 2))
    log_weight = np.log(weight)
    for c in range(2, EXACT + 1):
        these = order[cuts[c]:cuts[c + 1]]
        for a in range(0, len(these), 200_000):
            some = these[a:a + 200_000]
            chance = stirling[c, 1:c + 1] + log_weight[some, None] * np.arange(1, c + 1)
            chance = np.exp(chance - chance.max(axis=1, keepdims=True)).cumsum(axis=1)
            tables[some] = 1 + (chance < rng.random(len(some))[:, None] * chance[:, -1:]).sum(axis=1)
    large = np.flatnonzero(customers > EXACT)
    seated, opened = np.full(len(large), EXACT, np.int64), tables[large]
    total, weight = customers[large], weight[large]
    while len(large):
        step = np.minimum(total - seated, seated // 8)
        free = np.maximum(seated + step / 2 - discount * opened, 1e-9)
        opened = opened + rng.binomial(step, weight / (weight + free))
        seated = seated + step
        done = seated >= total
        tables[large[done]] = opened[done]
        large, seated, opened, total, weight = (x[~done] for x in (large, seated, opened, total, weight))
    return tables


class Seating:
    """Samples of one bucket, given the restaurants' totals."""

    def __init__(self, pair, counts, words, totals, rng, head=None, ones=0):
        """``head``: customers that all buckets send to the parent and its tables, per word, if words are in several;
        ``ones``: pairs of a word with one customer that are not among ``pair``."""
        self.word, self.context = np.divmod(pair, max(len(totals["customers"]), 1))
        d1, d0, base = totals["d1"], totals["d0"], totals["base"]
        open_root = STRENGTH + d0 * totals["root_tables"]
        all_root = STRENGTH + totals["root_customers"]
        open_context = STRENGTH + d1 * totals["tables"]
        one, two = log_stirling(d1), log_stirling(d0)
        tables = np.ones(len(pair), np.int64)
        self.counts, self.totals, self.samples = counts, totals, []
        root = np.ones(words, np.int64) if head is None else head[1]
        for sweep in range(BURN_IN + SAMPLES):
            sent = ones + np.bincount(self.word, tables, words).astype(np.int64) if head is None else head[0]
            others = np.maximum(sent[self.word] - tables, 0)
            beside = np.minimum(root[self.word], others)
            parent = (others - d0 * beside + open_root * base) / all_root
            tables = draw_tables(counts, open_context[self.context] * parent, d1, one, rng)
            sent = ones + np.bincount(self.word, tables, words).astype(np.int64)
            if head is None:
                root = draw_tables(sent, np.full(words, open_root * base), d0, two, rng)
            if sweep >= BURN_IN:
                self.samples.append((tables, sent, root))

    def predict(self, matched, rank=None):
        """Averaged predictive probabilities; ``matched`` has the restaurants' totals of the same samples, and what
        all buckets send of words of the head, by ``rank``."""
        d1, d0, base = self.totals["d1"], self.totals["d0"], self.totals["base"]
        share = STRENGTH + self.totals["customers"]
        self.left = (STRENGTH + d1 * matched["tables"]) / share  # of a context's mass, what goes to the parent
        self.added, self.parent, self.unknown = np.zeros(len(self.counts)), [], []
        for k, ((tables, sent, root), opened, seated) in enumerate(zip(self.samples, matched["root_tables"],
                                                                       matched["root_customers"])):
            if rank is not None:
                sent, root = (matched["head"][k][i][rank] for i in range(2))
            self.added += (self.counts - d1 * tables) / share[self.context] / SAMPLES
            new = (STRENGTH + d0 * opened) * base
            self.parent.append((sent - d0 * root + new) / (STRENGTH + seated))
            self.unknown.append(new / (STRENGTH + seated))
        return self


def seat(head, buckets, totals, number):
    """One round of a bucket: for each sample its contexts' tables beyond one a dish, and what is sent to the parent."""
    def drawn(pairs, sums):
        row = {name: pairs[name][0] for name in pairs.column_names}
        bucket, alone = row["bucket"].as_py(), row["alone"].as_py()
        contexts, ones = unplaned(row["contexts"], np.uint64), unplaned(row["ones"], np.uint64).astype(np.int64)
        word = np.repeat(np.arange(len(ones)), unplaned(row["runs"], np.uint32))
        used = np.zeros(len(contexts))
        used[places_of(contexts, sums)] = sums["used"].to_numpy()
        rank = unplaned(row["rank"], np.uint32).astype(np.int64) if bucket >= buckets else None
        found = Seating(word * len(contexts) + unplaned(row["context"], np.uint32),
                        unplaned(row["count"], np.uint64).astype(np.int64), len(ones),
                        totals | {"customers": np.zeros(len(contexts)), "tables": used}, seeds(number, bucket),
                        None if rank is None else [totals["head"][k][rank] for k in range(2)], ones)
        beyond = np.stack([np.bincount(found.context, t - 1, len(contexts)) for t, _, _ in found.samples], 1)
        live = beyond.any(axis=1)  # every dish has one table, known from the start
        parts = [(CONTEXT, contexts[live], beyond[live])]
        sent = np.stack([s for _, s, _ in found.samples], 1)
        if rank is None:
            root = [r.sum() + alone for _, _, r in found.samples]
            parts.append((PARENT, np.arange(2), [sent.sum(axis=0) + alone, root]))
        else:
            parts.append((WORD, rank, sent))
        return pa.Table.from_batches([sums_table(bucket, *parts)])

    def run(key, pairs: pa.Table, sums: pa.Table) -> pa.Table:
        return handed_back(drawn(pairs, sums))
    return run


SCORES = "pack long, bucket int, score binary, count binary"


def pair_scores(head, buckets, totals, matched, head_counts):
    """Of one bucket: log10 probabilities of the pairs of each pack, in the pack's order, and counts of their words."""
    def chances(row, sums):
        """Of the bucket's pairs: their probabilities, and how often their words are in the training texts."""
        held = Bucket(row, head, buckets)
        found, table = held.seating(sums, totals, ROUNDS)
        found.predict(matched | {"tables": np.stack([table[f"t{k}"] for k in range(SAMPLES)])}, held.rank)
        n = (np.bincount(held.word[held.trained], held.counts, len(held.words)) if held.rank is None
             else head_counts[held.rank])
        chance = sum(p[held.word] * left[held.context] for p, left in zip(found.parent, found.left)) / SAMPLES
        chance[held.trained] += found.added
        return np.log10(chance), n.astype(np.uint64)[held.word]

    def scored(pairs, sums):
        row = {name: pairs[name][0] for name in pairs.column_names}
        values = chances(row, sums)
        release()  # what is sent can be as large as what the seating took
        steps = row["places"].values
        score, count = (pa.array([planes(value[np.cumsum(unplaned(x, np.uint32), dtype=np.uint32)]) for x in steps], pa.binary())
                        for value in values)
        return pa.table({"pack": row["packs"].values, "bucket": pa.array([row["bucket"].as_py()] * len(steps), pa.int32()),
                         "score": score, "count": count})

    def run(key, pairs: pa.Table, sums: pa.Table) -> pa.Table:
        return handed_back(scored(pairs, sums))
    return run


def pack_documents(base_all):
    """One pack's documents: sums over the pairs of their tokens."""
    def added(documents, scores):
        order = np.argsort(scores["bucket"].to_numpy())
        score, count = (np.concatenate([unplaned(scores[x][int(i)], kind) for i in order])
                        for x, kind in (("score", np.float64), ("count", np.uint64)))
        count = count.astype(np.int64)
        first = np.concatenate([[0], unplaned(documents["sizes"][0], np.uint32).astype(np.int64)]).cumsum()
        pairs = unplaned(documents["pairs"][0], np.uint32)
        add = lambda values: np.add.reduceat(values[pairs], first[:-1])
        return pa.table({"doc_id": documents["doc_id"][0].values, "train": documents["train"][0].values,
                         "n_tokens": np.diff(first), "n_known": add((count > 0).astype(np.int64)),
                         "base_score": add(np.log10((count + 0.1) / base_all)), "score": add(score)})

    def run(key, documents: pa.Table, scores: pa.Table) -> pa.Table:
        return handed_back(added(documents, scores))
    return run


def common_words(counts: DataFrame) -> np.ndarray:
    """Sorted hashes of up to COMMON words, no less frequent than others up to a step of counts, and of the start."""
    step = F.floor(4 * F.log2("n"))
    room, least = COMMON, None
    for level, n in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        if n > room:
            break
        room, least = room - n, level
    rows = counts.where(step >= least).select("word").toArrow()["word"].to_numpy() if least is not None else []
    return np.unique(np.append(np.asarray(rows, np.int64).view(np.uint64), np.uint64(START)))


def score_documents(docs: DataFrame, train: F.Column, id_col: str = "doc_id", text_col: str = "text",
                    scratch: Scratch | None = None) -> DataFrame:
    """Learn from the rows where ``train`` holds and score every row.

    Returns doc_id, train, n_tokens, n_known, train_tokens, base_score, score (both log10 of the whole text).
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "pitman-yor")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"),
                       F.col(text_col).alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    buckets = max(1, total_bytes(docs) // BUCKET_BYTES)
    groups = max(1, min(GROUPS, buckets // 2))

    def part(rows, group, name="bucket"):
        """The rows of one group of buckets, or of packs."""
        number = F.col(name) if name == "bucket" else F.xxhash64(name)
        return rows.where(F.pmod(number, F.lit(groups)) == group) if groups > 1 else rows

    def union(tables):
        return reduce(DataFrame.union, tables)

    counts = scratch.keep_lean(docs.where("train").select("text").mapInArrow(word_counts, "word long, n long")
                          .groupBy("word").agg(F.sum("n").alias("n")), "words")
    n, v, ones, twos = counts.agg(F.sum("n"), F.count("*"), F.count_if(F.col("n") == 1),
                                  F.count_if(F.col("n") == 2)).first()
    n = n or 0
    top = counts.orderBy(F.desc("n"), "word").limit(HEAD).collect()
    head = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    by = np.argsort(head)
    head, head_counts = head[by], np.array([r["n"] for r in top], np.int64)[by]
    common = common_words(counts)
    scratch.drop(counts)

    packs = scratch.keep_lean(docs.mapInArrow(occurrences(head, common, buckets), PACKS.format(f"array<{kind}>")), "packed")
    sent = packs.where("bucket >= 0").select("pack", "bucket", "words", "runs", "context", "rare", "count")
    pairs = [scratch.keep_lean(part(sent, group).groupBy("bucket").applyInArrow(bucket_pairs(common), PAIRS), "pairs")
             for group in range(groups)]
    documents = scratch.keep_lean(packs.where("bucket = -1").select("pack", "doc_id", "train", "sizes", "pairs"), "packs")
    scratch.drop(packs)  # its pairs are in the buckets, and would be the largest table on disk when pairs are scored
    model = union(pairs).drop("packs", "places")
    sums = scratch.keep_lean(model.mapInArrow(first_sums(head, buckets), SUMS), "sums")

    def of_kind(rows, kind):
        """Sums over the buckets by key: a few thousand rows at most."""
        return {r["key"]: [r[f"t{k}"] for k in range(3)] for r in rows.where(F.col("kind") == kind).groupBy("key").agg(
            *[F.sum(f"t{k}").alias(f"t{k}") for k in range(3)]).collect()}

    def of_head(rows):
        found = np.zeros((3, len(head)), np.int64)
        for rank, numbers in of_kind(rows, WORD).items():
            found[:, rank] = numbers
        return found

    def discount(once, twice):
        return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5

    once, twice, _ = of_kind(sums, PARENT).get(0, [0, 0, 0])
    totals = {"d1": discount(once, twice), "d0": discount(ones, twos), "base": 1 / (v + 1),
              "base_all": n + 0.1 * (v + 1), "root_tables": v, "root_customers": max(v, 1),
              "head": (of_head(sums)[0], np.ones(len(head), np.int64))}
    known = scratch.keep_lean(sums.where(F.col("kind") == CONTEXT).groupBy("key").agg(
        F.sum("t0").alias("customers"), F.sum("t1").alias("dishes"), F.collect_list("bucket").alias("buckets"),
        F.collect_list(F.when(F.col("t2") > 0, F.col("bucket"))).alias("live")).where("customers > 0"), "customers")
    scratch.drop(sums)
    live = scratch.keep_lean(model.mapInArrow(live_pairs(head, buckets), LIVE), "live")
    drawn = scratch.keep_lean(known.where(F.size("live") > 0).select("key", "live", "dishes", F.col("dishes").alias("used")),
                              "drawn")
    stirling = log_stirling(totals["d0"])
    for number in range(ROUNDS + 1):  # the last one gives the totals of the samples that are scored with
        asked = drawn.select(F.explode("live").alias("bucket"), "key", "used")
        seated = scratch.keep_lean(live.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(
            seat(head, buckets, totals, number), SUMS), "seated")
        all_sent, parent, rng = of_head(seated), of_kind(seated, PARENT), np.random.default_rng(number)
        opening = (STRENGTH + totals["d0"] * totals["root_tables"]) * totals["base"]
        opened = [draw_tables(s, np.full(len(head), opening), totals["d0"], stirling, rng) for s in all_sent]
        customers, tables = (np.array(parent.get(i, [0] * 3)) + [x.sum() for x in of] for i, of in enumerate((all_sent, opened)))
        matched = {"root_customers": customers, "root_tables": tables, "head": list(zip(all_sent, opened))}
        added = seated.where(F.col("kind") == CONTEXT).groupBy("key").agg(*[F.sum(f"t{k}").alias(f"t{k}") for k in range(3)])
        before = drawn
        drawn = scratch.keep_lean(drawn.select("key", "live", "dishes", "used").join(added, "key", "left").select(
            "key", "live", "dishes", "used", *[(F.col("dishes") + F.coalesce(f"t{k}", F.lit(0))).alias(f"t{k}")
                                               for k in range(3)]), "totals")
        scratch.drop(before)
        scratch.drop(seated)
        if number < ROUNDS:
            drawn = drawn.withColumn("used", F.col("t2"))
            totals = totals | {k: x[-1] for k, x in matched.items()}
    scratch.drop(live)

    asked = known.join(drawn.select("key", "used", "t0", "t1", "t2"), "key", "left").select(
        F.explode("buckets").alias("bucket"), "key", "customers", "used", "t0", "t1", "t2")
    if groups > 1:  # else each group would join again
        asked = scratch.keep_lean(asked, "asked")
        scratch.drop(known)
        scratch.drop(drawn)
    scores = []
    for group, some in enumerate(pairs):
        scores.append(scratch.keep_lean(some.groupBy("bucket").cogroup(part(asked, group).groupBy("bucket")).applyInArrow(
            pair_scores(head, buckets, totals, matched, head_counts), SCORES), "scores"))
        scratch.drop(some)
    for done in [asked] if groups > 1 else [known, drawn]:
        scratch.drop(done)

    def of_packs(group):
        return (part(documents, group, "pack").groupBy("pack").cogroup(part(union(scores), group, "pack").groupBy("pack"))
                .applyInArrow(pack_documents(totals["base_all"]), f"doc_id {kind}, train boolean, n_tokens long, "
                              "n_known long, base_score double, score double"))

    rows = union([*[scratch.keep_lean(of_packs(group), "rows") for group in range(groups - 1)], of_packs(groups - 1)])
    return rows.select("doc_id", "train", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
                       "base_score", "score")
