"""Byte-level BPE encoding and decoding of whole texts with a public file of ranked byte strings.

Method, two tiers. A text is cut into pre-tokens by the vocabulary's pattern. First tier: a minimal perfect hash over
the vocabulary gives the one place where a pre-token can be; its bytes are compared with the pre-token's, so a hit is
exact, and is the id. Second tier, for misses: the bytes form a linked list, a heap holds the neighbours whose joined
bytes have a rank, the lowest rank (leftmost on ties) is joined until none is left. What was resolved is remembered in
two generations of bounded bytes per worker, from task to task. Decoding gathers each id's bytes from one flat table.

The perfect hash has levels of bits: a key whose bit on a level is not shared with another key stays there, the others
go on to the next level; the number of set bits before a key's bit is its place. It has one place per token.

Scale. No shuffle: texts are encoded where they are read, in slices of bounded text, and a longer text in pieces cut
where white space follows other characters, which no pre-token crosses. The vocabulary is a file of fixed size, sent
once to every executor. One pre-token is merged by one task, whatever its length.

Defined cases: null or empty text has no ids and decodes to no bytes; repeated rows and ids give a row each; a text
of any length is encoded whole; special tokens' strings are ordinary text; other columns are dropped, whatever their
names.
"""

from __future__ import annotations

import base64
import re
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from spectraloom.llm.common import grown, release, spans
from spectraloom.llm.textscan import BASE, byte_numbers, mix

#: Letters and numbers that Unicode has had since version 17; the pattern is of version 16, where they
#: are neither.
LATER = ("\\u0558\\u058b-\\u058c\\u088f\\u0c5c\\u0cdc\\u208f\\u209d-\\u209f\\ua7ce-\\ua7cf\\ua7d2\\ua7d4\\ua7dd\\ua7e2\\ua7f1"
         "\\uab6c-\\uab6d\\U000107bb-\\U000107bf\\U00010940-\\U00010959\\U00010ec5-\\U00010ec7\\U00010ed9-\\U00010eee"
         "\\U00011b0a\\U00011db0-\\U00011ddb\\U00011de0-\\U00011de9\\U00011df1\\U0001246f\\U00012475-\\U0001247f"
         "\\U00012550-\\U00012686\\U00016ea0-\\U00016eb8\\U00016ebb-\\U00016ed3\\U00016ff2-\\U00016ff6"
         "\\U000187f8-\\U000187ff\\U00018cd6-\\U00018cda\\U00018d09-\\U00018d20\\U00018d80-\\U00018df2"
         "\\U00018e00-\\U00019191\\U000191a0-\\U000191d2\\U0001b123-\\U0001b128\\U0001b168\\U0001d6a6"
         "\\U0001df1f-\\U0001df24\\U0001df2b-\\U0001df81\\U0001df90-\\U0001df96\\U0001dfcd-\\U0001dfff"
         "\\U0001e6c0-\\U0001e6de\\U0001e6e0-\\U0001e6e2\\U0001e6e4-\\U0001e6e5\\U0001e6e7-\\U0001e6ed"
         "\\U0001e6f0-\\U0001e6f4\\U0001e6fe-\\U0001e6ff\\U0002b73a-\\U0002b73f\\U0002b81e\\U0002cea2-\\U0002cead"
         "\\U000323b0-\\U00033479\\U0003d000-\\U0003fc3f")
SLICE = 1 << 18             # characters that are cut into pre-tokens at a time
REMEMBER_BYTES = 64 << 20   # of one generation of remembered pre-tokens
MOST_LEVELS = 64


class ByteHash:
    """64-bit hashes of byte strings that lie one after another."""

    def __init__(self, seed: int = 11):
        self.numbers = byte_numbers(seed)
        self.powers = np.ones(1, np.uint64)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        lengths = np.diff(offsets)
        longest = int(lengths.max(initial=0))
        if len(self.powers) < longest:
            steps = np.full(max(longest, 1024), BASE, np.uint64)
            steps[0] = 1
            self.powers = np.multiply.accumulate(steps)
        if not len(data):
            return mix(lengths.astype(np.uint64))
        place = np.arange(len(data)) - np.repeat(offsets[:-1], lengths)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.numbers[data] * self.powers[place], out=sums[1:])
        return mix(sums[offsets[1:]] - sums[offsets[:-1]] + lengths.astype(np.uint64))


class PerfectHash:
    """Places 0 to n - 1 of n distinct 64-bit keys; another key gets any place or none (-1)."""

    def __init__(self, keys: np.ndarray, spread: float = 1.5):
        if len(np.unique(keys)) != len(keys):
            raise ValueError("keys occur twice")
        self.sizes, bits, left = [], [], keys
        while len(left):
            if len(self.sizes) == MOST_LEVELS:
                raise ValueError("no perfect hash found")
            size = int(len(left) * spread) + 1
            at = self._at(left, len(self.sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            self.sizes.append(size)
            bits.append(alone)
            left = left[~alone[at]]
        self.bits = np.concatenate(bits) if bits else np.zeros(0, bool)
        self.before = np.cumsum(self.bits) - self.bits

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        salt = np.uint64((level + 1) * BASE % (1 << 64))
        return (mix(keys + salt) % np.uint64(size)).astype(np.int64)

    def places(self, keys: np.ndarray) -> np.ndarray:
        found = np.full(len(keys), -1, np.int64)
        open_rows, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = base + self._at(keys[open_rows], level, size)
            hit = self.bits[at]
            found[open_rows[hit]] = self.before[at[hit]]
            open_rows, base = open_rows[~hit], base + size
        return found


def join_bytes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(x) for x in parts], out=offsets[1:])
    return np.frombuffer(b"".join(parts), np.uint8), offsets


class Vocabulary:
    """Ranked byte strings with their perfect hash; small enough to be sent to every executor."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every byte needs a rank")
        self.ranks, self.pattern, self.own = ranks, pattern, None
        tokens = list(ranks)
        keys = ByteHash()(*join_bytes(tokens))
        self.hash = PerfectHash(keys)
        order = np.argsort(self.hash.places(keys))
        self.data, self.offsets = join_bytes([tokens[i] for i in order])       # by place
        self.ids = np.array([ranks[tokens[i]] for i in order], np.int64)
        self.pair_ranks = np.full(1 << 16, -1, np.int64)  # of two bytes
        for token, rank in ranks.items():
            if len(token) == 2:
                self.pair_ranks[token[0] << 8 | token[1]] = rank
        self.place_of = np.full(max(ranks.values()) + 1, -1, np.int64)
        self.place_of[self.ids] = np.arange(len(self.ids))

    def coder(self) -> "Coder":
        """The coder of this process: what it remembers serves the next tasks of the same worker too."""
        if self.own is None:
            self.own = Coder(self)
        return self.own

    def __getstate__(self):
        return self.__dict__ | {"own": None}

    @staticmethod
    def read(path: str, pattern: str) -> "Vocabulary":
        with open(path, "rb") as file:
            return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}, pattern)


class Remembered:
    """Ids of pre-tokens that were resolved, in two generations of bounded bytes.

    A full young generation becomes the old one; what is found in the old one comes back. ``numbers`` gives a
    pre-token's row in ``starts`` and ``counts``, which point into ``flat``.
    """

    def __init__(self, limit: int = REMEMBER_BYTES):
        self.limit, self.old = limit, None
        self._fresh()

    def _fresh(self) -> None:
        self.numbers: dict[str, int] = {}
        self.starts, self.counts, self.flat = (np.zeros(1024, np.int64) for _ in range(3))
        self.used = self.size = 0

    def renew(self) -> None:
        """Between slices, so that all pre-tokens of a slice are in one generation."""
        if self.size >= self.limit:
            self.old = self.numbers, self.starts, self.counts, self.flat
            self._fresh()

    def from_old(self, pieces: list[str]) -> list[str]:
        """Takes over what the old generation knows; the rest comes back."""
        if self.old is None:
            return pieces
        numbers, starts, counts, flat = self.old
        known = [x for x in pieces if x in numbers]
        if known:
            at = np.array([numbers[x] for x in known])
            self.add(known, counts[at], flat[spans(starts[at], counts[at])])
        return [x for x in pieces if x not in numbers]

    def add(self, pieces: list[str], counts: np.ndarray, ids: np.ndarray) -> None:
        n, first = len(self.numbers), self.used
        self.starts, self.counts = grown(self.starts, n + len(pieces)), grown(self.counts, n + len(pieces))
        self.flat = grown(self.flat, first + len(ids))
        self.starts[n:n + len(pieces)] = first + np.cumsum(counts) - counts
        self.counts[n:n + len(pieces)] = counts
        self.flat[first:first + len(ids)] = ids
        self.numbers.update(zip(pieces, range(n, n + len(pieces))))
        self.used += len(ids)
        self.size += 200 * len(pieces) + 8 * len(ids) + sum(map(len, pieces))

    def gather(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and how many each has."""
        at = np.fromiter(map(self.numbers.__getitem__, pieces), np.int64, len(pieces))
        counts = self.counts[at]
        return self.flat[spans(self.starts[at], counts)], counts


def merge(piece: bytes, ranks: dict[bytes, int], pairs: list[int]) -> list[int]:
    """Ids of a pre-token: a heap of rankable neighbours over a linked list of parts.

    ``pairs`` are the ranks of two neighbouring bytes each, negative if there is none. A heap entry is one number:
    rank, start and end of the joined bytes, so equal ranks come out from left to right.
    """
    n, rank_of = len(piece), ranks.get
    width = n.bit_length()
    stop, before = [*range(1, n + 1), None], [*range(-1, n)]  # by a part's start: its end, the start of the one before
    heap = [(rank << width | i) << width | i + 2 for i, rank in enumerate(pairs) if rank >= 0]
    heapify(heap)
    low = (1 << width) - 1
    while heap:
        entry = heappop(heap)
        end, start = entry & low, entry >> width & low
        middle = stop[start]
        if middle is None or middle >= end or stop[middle] != end:
            continue  # one of the two parts was joined meanwhile
        stop[start], stop[middle], before[end] = end, None, start
        if end < n:
            rank = rank_of(piece[start:stop[end]])
            if rank is not None:
                heappush(heap, (rank << width | start) << width | stop[end])
        left = before[start]
        if left >= 0:
            rank = rank_of(piece[left:end])
            if rank is not None:
                heappush(heap, (rank << width | left) << width | end)
    found, at = [], 0
    while at < n:
        found.append(ranks[piece[at:stop[at]]])
        at = stop[at]
    return found


def of_version_16(pattern: str) -> str:
    """The pattern with letters and numbers as Unicode 16 has them."""
    narrow = {"L": f"[\\p{{L}}--[{LATER}]]", "N": f"[\\p{{N}}--[{LATER}]]"}
    return "(?V1)" + regex.sub(r"\\p\{([LN])\}", lambda found: narrow[found[1]], pattern)


class Coder:
    """Encodes and decodes; one per task."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.pattern = regex.compile(vocabulary.pattern)
        self.later = re.compile(f"[{LATER}]")
        self.careful = regex.compile(of_version_16(vocabulary.pattern))
        self.cut = regex.compile(r"(?<=\S)\s")  # no pre-token has white space after another character
        self.hashed = ByteHash()
        self.remembered = Remembered()

    def pieces(self, text: str):
        """A text in parts of about SLICE characters that can be cut into pre-tokens by themselves."""
        at = 0
        while len(text) - at > SLICE:
            found = self.cut.search(text, at + SLICE)
            if found is None:
                break
            yield text[at:found.start()]
            at = found.start()
        yield text[at:]

    def in_vocabulary(self, raw: list[bytes]) -> np.ndarray:
        """Ids by the perfect hash; -1 for what is no token."""
        held = self.vocabulary
        data, offsets = join_bytes(raw)
        lengths = np.diff(offsets)
        places = held.hash.places(self.hashed(data, offsets))
        starts = held.offsets[:-1][places]
        same = (places >= 0) & (held.offsets[1:][places] - starts == lengths)
        some = np.flatnonzero(same & (lengths > 0))
        differs = held.data[spans(starts[some], lengths[some])] != data[spans(offsets[some], lengths[some])]
        if len(some):
            same[some] = ~np.logical_or.reduceat(differs, np.cumsum(lengths[some]) - lengths[some])
        return np.where(same, held.ids[places], -1)

    def resolve(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of the pieces has, and the ids: by the perfect hash, else by merging."""
        raw = [x.encode() for x in pieces]
        ids = self.in_vocabulary(raw)
        misses = np.flatnonzero(ids < 0).tolist()
        counts = np.ones(len(raw), np.int64)
        if not misses:
            return counts, ids
        held = self.vocabulary
        data, offsets = join_bytes([raw[i] for i in misses])
        pairs = held.pair_ranks[data[:-1].astype(np.int64) << 8 | data[1:]].tolist()  # those across two pieces go unused
        at, merged = offsets.tolist(), []
        for j, i in enumerate(misses):
            merged.append(merge(raw[i], held.ranks, pairs[at[j]:at[j + 1] - 1]))
        counts[misses] = [len(x) for x in merged]
        found = np.repeat(ids, counts)
        found[found < 0] = [x for some in merged for x in some]
        return counts, found

    def encode_pieces(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts one after another, and how many each part has."""
        every, sizes = [], []
        for part in parts:
            plain = part.isascii() or self.later.search(part) is None
            found = (self.pattern if plain else self.careful).findall(part)
            every += found
            sizes.append(len(found))
        memory = self.remembered
        memory.renew()
        new = memory.from_old([x for x in set(every) if x not in memory.numbers])
        if new:
            memory.add(new, *self.resolve(new))
        ids, counts = memory.gather(every)
        stops = np.concatenate([[0], np.cumsum(counts)])
        ends = np.cumsum(sizes)
        return ids, stops[ends] - stops[ends - sizes]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        found, waiting, owners, size = [[] for _ in texts], [], [], 0

        def flush():
            ids, counts = self.encode_pieces(waiting)
            for owner, some in zip(owners, np.split(ids, np.cumsum(counts)[:-1])):
                found[owner].append(some)
            waiting.clear()
            owners.clear()

        for row, text in enumerate(texts):
            for part in self.pieces(text) if text else ():
                waiting.append(part)
                owners.append(row)
                size += len(part)
                if size >= SLICE:
                    flush()
                    size = 0
        if waiting:
            flush()
        return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in found]

    def decode(self, ids: np.ndarray) -> bytes:
        held = self.vocabulary
        places = held.place_of[ids]
        starts = held.offsets[:-1][places]
        return held.data[spans(starts, held.offsets[1:][places] - starts)].tobytes()


def code_rows(vocabulary):
    def run(batches):
        coder = vocabulary.value.coder()
        for batch in batches:
            size, first = 0, 0
            texts = batch.column(1)
            lengths = texts.fill_null("").to_numpy(zero_copy_only=False)
            for row in range(len(batch)):
                size += len(lengths[row])
                if size < SLICE and row + 1 < len(batch):
                    continue
                ids = coder.encode_all([x or "" for x in lengths[first:row + 1]])
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, row + 1 - first), pa.array(np.diff(offsets).astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32))),
                     pa.array([coder.decode(x) for x in ids], pa.binary())],
                    ["doc_id", "n_tokens", "ids", "decoded"])
                size, first = 0, row + 1
            del lengths
        release()  # the worker lives on
    return run


def encode_documents(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids and the decoded bytes of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # one file of fixed size
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return docs.mapInArrow(code_rows(sent), f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids array<int>, "
                                            "decoded binary")
