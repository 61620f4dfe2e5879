"""BPE encoding and decoding of whole texts with a public vocabulary file.

Method. Two neighbouring symbols (bytes; the last byte of a word is a symbol of its own) that stand next to each
other inside no vocabulary token can never be merged, so a word is certainly cut between them. The fragments between
such cuts are encoded independently by the ranked merges and their ids are concatenated. Fragments, words and runs
between white space are remembered by a task in tables of bounded bytes that forget what was not used for long; a text is
their concatenation.

The ids and the decoded text are those of the file's own tokenizer without added special tokens: NFC, white space
dropped, lower case, words split by its pattern, special tokens recognised in the raw text; decoding joins the
tokens' strings by spaces, as the file names no decoder.

Defined cases: null or empty text has no ids and decodes to an empty string; repeated rows and ids give a row each;
text of any length is encoded whole; other columns are dropped, whatever their names.
"""

from __future__ import annotations

import heapq
import json
import struct
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from spectraloom.llm.common import Generations, grown, release, slices, spans, text_bytes
from spectraloom.llm.textscan import Words

#: Unicode white space, as the file's pattern understands it.
WHITE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The file's word pattern.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+"
LONG = 100             # symbols of a fragment from which on merging uses a heap
REMEMBER_WORDS = 8 << 20   # bytes of one generation of a task's words
REMEMBER_RUNS = 10 << 20   # and of its runs between white space
RUN_BYTES = 20             # of a run beside its ids and text
SLICE = 256 << 10          # text that one numpy pass looks at


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next free one from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    free = iter(range(256, 512))
    return [chr(b) if b in set(printable) else chr(next(free)) for b in range(256)]


def word_bytes(packed: bytes) -> int:
    """About the bytes that a remembered word takes: a text, its packed ids, a place in the table."""
    return 220 + len(packed)


def pack(ids) -> bytes:
    """Little-endian unsigned 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Runs:
    """Packed ids and decoded text of runs by their hash, in two generations of bounded bytes of flat arrays."""

    def __init__(self, limit: int):
        self.limit, self.old = limit, None
        self._fresh()

    def _fresh(self) -> None:
        self.names, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # sorted hashes, and the runs' numbers
        self.bounds = np.zeros((1024, 2), np.int32)  # where a run's ids and text end; they start where the last one's end
        self.ids, self.text = np.zeros(1024, np.uint32), np.zeros(4096, np.uint8)
        self.size = 0

    def renew(self) -> None:
        """Between slices, so that all runs of a slice are in one generation."""
        if self.size >= self.limit:
            self.old = self.names, self.numbers, self.bounds, self.ids, self.text
            self._fresh()

    def missing(self, names: np.ndarray) -> np.ndarray:
        """Positions of the names (sorted, different) that are not known; those of the old generation come back."""
        new = np.flatnonzero(~found(self.names, names)[1])
        if self.old is None:
            return new
        held, numbers, bounds, ids, text = self.old
        place, known = found(held, names[new])
        if known.any():
            at = numbers[place[known]]
            starts = bounds[at].astype(np.int64)
            lengths = bounds[at + 1] - starts
            self.add(names[new[known]], lengths[:, 0], ids[spans(starts[:, 0], lengths[:, 0])],
                     lengths[:, 1], text[spans(starts[:, 1], lengths[:, 1])])
        return new[~known]

    def add(self, names: np.ndarray, counts: np.ndarray, ids: np.ndarray, sizes: np.ndarray, text: np.ndarray) -> None:
        n = len(self.names)
        used = self.bounds[n].astype(np.int64)
        if n + len(names) + 1 > len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros((max(len(names) + 1, len(self.bounds) // 2), 2), np.int32)])
        self.ids, self.text = grown(self.ids, used[0] + len(ids)), grown(self.text, used[1] + len(text))
        self.ids[used[0]:used[0] + len(ids)], self.text[used[1]:used[1] + len(text)] = ids, text
        ends = used + np.cumsum(np.stack([counts, sizes], 1), axis=0)
        if len(ends) and ends[-1].max() >= 1 << 31:  # a generation takes little more than its limit and one slice or text
            raise ValueError("ids or text of one slice beyond 2 GB")
        self.bounds[n + 1:n + len(names) + 1] = ends
        place = np.searchsorted(self.names, names)
        self.names = np.insert(self.names, place, names)
        self.numbers = np.insert(self.numbers, place, np.arange(n, n + len(names), dtype=np.int32))
        self.size += RUN_BYTES * len(names) + 4 * len(ids) + len(text)

    def gather(self, names: np.ndarray, which: np.ndarray):
        """For the runs names[which] one after another: counts and ids, sizes and text."""
        at = self.numbers[np.searchsorted(self.names, names)][which]
        starts = self.bounds[at].astype(np.int64)
        lengths = self.bounds[at + 1] - starts
        return (lengths[:, 0], self.ids[spans(starts[:, 0], lengths[:, 0])],
                lengths[:, 1], self.text[spans(starts[:, 1], lengths[:, 1])])


def found(held: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the names in a sorted array, and which of them are in it."""
    if not len(held):
        return np.zeros(len(names), np.int64), np.zeros(len(names), bool)
    place = np.minimum(np.searchsorted(held, names), len(held) - 1)
    return place, held[place] == names


class Vocabulary:
    """What a vocabulary file says, small enough to be sent to every task."""

    def __init__(self, text: str):
        held = json.loads(text)
        model = held["model"]
        self.tokens = model["vocab"]
        self.special = {x["content"]: x["id"] for x in held["added_tokens"]}
        merges = (x if isinstance(x, list) else x.split(" ") for x in model["merges"])
        self.pairs = np.array([[self.tokens[x], self.tokens[y], self.tokens[x + y]] for x, y in merges], np.int64)
        self.suffix = model["end_of_word_suffix"]
        if model["type"] != "BPE" or not self.suffix or held["decoder"] is not None:
            raise ValueError("not a byte-level BPE file with word ends and without a decoder")


class Encoder:
    """Encodes words by fragments; one per task."""

    def __init__(self, vocabulary: Vocabulary):
        self.ids = vocabulary.tokens
        self.special = vocabulary.special
        names = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        strings = [names.get(i, "").encode() + b" " for i in range(max(names) + 1)]
        self.strings = np.frombuffer(b"".join(strings), np.uint8)  # by id
        self.string_ends = np.concatenate([[0], np.cumsum([len(x) for x in strings])])
        self.marks = regex.compile("|".join(regex.escape(x) for x in self.special)) if self.special else None
        self.words = regex.compile(PATTERN)
        characters = byte_characters()
        self.first = np.array([self.ids[c] for c in characters])                     # a byte inside a word
        self.last = np.array([self.ids[c + vocabulary.suffix] for c in characters])  # the last byte of a word
        pairs = vocabulary.pairs
        keys = pairs[:, 0] << 32 | pairs[:, 1]
        order = np.argsort(keys)
        self.pair, self.rank, self.merged = keys[order], order, pairs[:, 2]  # rank: place among the merges
        # symbols next to each other inside some token; a word's last byte is symbol 256 + byte
        place = {c: i for i, c in enumerate(characters)}
        self.joined = np.zeros((256, 512), bool)
        for token in self.ids:
            ends = token.endswith(vocabulary.suffix) and token != vocabulary.suffix
            inner = [place[c] for c in (token[:-len(vocabulary.suffix)] if ends else token)]
            if ends:
                inner[-1] += 256
            self.joined[inner[:-1], inner[1:]] = True
        self.known = Generations(REMEMBER_WORDS)  # word: its packed ids

    def ranks(self, left, right):
        """Place of each pair among the merges; beyond all of them if there is none."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair, keys), len(self.pair) - 1)
        return np.where((self.pair[at] == keys) & (right >= 0), self.rank[at], len(self.pair))

    def merge(self, ids):
        """Ids of fragments of equal length (one a row): the lowest-ranked pair is merged until none is left."""
        found = [None] * len(ids)
        row, none = np.arange(len(ids)), len(self.pair)
        ranks = self.ranks(ids[:, :-1], ids[:, 1:]) if ids.shape[1] > 1 else np.full((len(ids), 1), none)
        while len(row):
            at = ranks.argmin(axis=1)
            here = np.arange(len(row))
            best = ranks[here, at]
            done = best == none
            if done.any():
                lengths = (ids[done] >= 0).sum(axis=1)
                for i, values, n in zip(row[done].tolist(), ids[done].tolist(), lengths.tolist()):
                    found[i] = values[:n]
                ids, ranks, row, at, best = ids[~done], ranks[~done], row[~done], at[~done], best[~done]
                here = np.arange(len(row))
                if not len(row):
                    break
            width = ids.shape[1]
            ids[here, at] = self.merged[best]
            column = np.arange(width - 1)
            ids[:, :-1] = np.take_along_axis(ids, column + (column > at[:, None]) * 1, 1) if width > 1 else ids[:, :-1]
            moved = column >= (at + 1)[:, None]
            ids_next = ids.copy()
            ids_next[:, -1] = -1
            ids = ids_next
            column = np.arange(width - 1)
            shifted = np.minimum(column + moved, width - 2)
            ranks = np.take_along_axis(ranks, shifted, 1)
            ranks[:, -1] = none
            inside = at < width - 1
            ranks[here[inside], at[inside]] = self.ranks(ids[here, at], ids[here, np.minimum(at + 1, width - 1)])[inside]
            before = at > 0
            ranks[here[before], at[before] - 1] = self.ranks(ids[here, at - 1], ids[here, at])[before]
        return found

    def merge_long(self, ids):
        """The same for one long fragment, with a heap of pairs and links to the neighbours."""
        none, n = len(self.pair), len(ids)
        ids, before, after = ids.tolist(), list(range(-1, n - 1)), [*range(1, n), -1]
        ranks = self.ranks(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(ranks) if r < none]
        heapq.heapify(heap)
        merge = {}
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i], ids[j], after[i] = int(self.merged[rank]), -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0:
                    pair = ids[x], ids[y]
                    if pair not in merge:
                        merge[pair] = int(self.ranks(np.array([pair[0]]), np.array([pair[1]]))[0])
                    if merge[pair] < none:
                        heapq.heappush(heap, (merge[pair], x, *pair))
        return [i for i in ids if i >= 0]

    def learn(self, words) -> None:
        """Ids of all words that are not known yet: cut, encode the fragments, concatenate."""
        self.known.renew()
        words = list(set(words))
        words = [words[i] for i in self.known.missing(words, word_bytes)]
        if not words:
            return
        raw = [w.encode() for w in words]
        sizes = np.array([len(x) for x in raw])
        flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        stops = np.cumsum(sizes)
        symbols = flat.copy()
        symbols[stops - 1] += 256
        first = np.zeros(len(flat), bool)
        first[0] = True
        first[1:] = ~self.joined[flat[:-1], symbols[1:]]
        first[stops[:-1]] = True
        starts = np.flatnonzero(first)
        lengths = np.diff(np.append(starts, len(flat)))
        ids = np.where(symbols > 255, self.last[flat], self.first[flat])
        fragments = [None] * len(starts)
        for length in np.unique(lengths).tolist():
            these = np.flatnonzero(lengths == length)
            if length > LONG:
                for j in these.tolist():
                    fragments[j] = self.merge_long(ids[starts[j]:starts[j] + length])
                continue
            for i in range(0, len(these), 20_000):
                some = these[i:i + 20_000]
                for j, found in zip(some.tolist(), self.merge(ids[starts[some][:, None] + np.arange(length)])):
                    fragments[j] = found
        per_word = np.searchsorted(starts, stops)
        at = 0
        for word, stop in zip(words, per_word.tolist()):
            ids = fragments[at] if stop - at == 1 else [i for x in fragments[at:stop] for i in x]
            packed = pack(ids)
            self.known.put(word, packed, word_bytes(packed))
            at = stop

    def split(self, text: str) -> list:
        """Words of a text, and special tokens as numbers."""
        if not text.isascii():
            if self.marks is not None and self.marks.search(text):
                return self.split_marked(text)
            text = "".join([c.lower() for c in unicodedata.normalize("NFC", text)])  # no context rules
            return self.words.findall(text)
        if text.isalpha():
            return [text.lower()]
        if self.marks is not None and "<" in text and self.marks.search(text):
            return self.split_marked(text)
        return self.words.findall(text.lower())

    def split_marked(self, text: str) -> list:
        parts, at = [], 0
        for mark in self.marks.finditer(text):
            parts += [*self.split(text[at:mark.start()]), self.special[mark.group()]]
            at = mark.end()
        return parts + self.split(text[at:])

    def encode_all(self, texts: list) -> list[bytes]:
        """Packed ids of all texts."""
        parts = [self.split(x) for x in texts]
        self.learn(w for words in parts for w in words if isinstance(w, str))
        known = self.known.young
        return [known[words[0]] if len(words) == 1 and words[0] in known else
                b"".join([known[w] if isinstance(w, str) else pack((w,)) for w in words]) for words in parts]

    def encode(self, text: str) -> list:
        """Ids of any text."""
        return np.frombuffer(self.encode_all([text])[0], "<u4").tolist()

    def spelled(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens' strings, each followed by a space, one after another; and the bytes of every ``counts`` of them."""
        lengths = np.diff(self.string_ends)[ids]
        sums = np.concatenate([[0], np.cumsum(lengths)])
        ends = np.cumsum(counts)
        return sums[ends] - sums[ends - counts], self.strings[spans(self.string_ends[ids], lengths)]

    def decode(self, ids) -> str:
        ids = np.asarray(ids, np.int64)
        return self.spelled(ids, np.array([len(ids)]))[1].tobytes().decode()[:-1]


def per_row(lengths: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where each row's part ends in what its runs have together, from the runs' lengths; one more at the start."""
    return np.concatenate([[0], np.cumsum(lengths)])[first]


def encode_rows(vocabulary):
    def run(batches):
        encoder = Encoder(vocabulary.value)
        words = Words(lower=False)
        remembered = Runs(REMEMBER_RUNS)
        for batch in batches:
            offsets, data = text_bytes(batch.column(1))
            names = batch.column(0).take(pa.array(np.arange(len(batch))))  # a copy, so that what is sent holds no texts
            for a, b in slices(offsets, SLICE):
                here = data[offsets[a]:offsets[b]]
                starts, ends, hashes, first = words.scan(offsets[a:b + 1] - offsets[a], here)
                distinct, at, which = np.unique(hashes, return_index=True, return_inverse=True)
                raw = here.tobytes()
                remembered.renew()
                new = remembered.missing(distinct)
                if len(new):
                    places = zip(starts[at[new]].tolist(), ends[at[new]].tolist())
                    packed = encoder.encode_all([raw[s:e].decode() for s, e in places])
                    ids = np.frombuffer(b"".join(packed), "<u4")
                    counts = np.array([len(x) // 4 for x in packed], np.int64)
                    sizes, text = encoder.spelled(ids, counts)
                    remembered.add(distinct[new], counts, ids, sizes, text)
                counts, ids, sizes, text = remembered.gather(distinct, which)
                id_ends, text_ends = per_row(counts, first), per_row(sizes, first)
                filled = np.flatnonzero(np.diff(text_ends))  # all rows with ids: their text ends with a space
                keep = np.ones(len(text), bool)
                keep[text_ends[1:][filled] - 1] = False
                text_ends = text_ends - np.concatenate([[0], np.cumsum(np.diff(text_ends) > 0)])
                yield pa.RecordBatch.from_arrays(
                    [names.slice(a, b - a), pa.array(np.diff(id_ends)),
                     buffers(pa.binary(), 4 * id_ends, ids), buffers(pa.string(), text_ends, text[keep])],
                    ["doc_id", "n_tokens", "ids", "decoded"])
                del here, raw
            del batch, data  # before the next batch is read
        del remembered, encoder, words  # the worker lives on
        release()
    return run


def buffers(kind: pa.DataType, offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    if offsets[-1] >= 1 << 31:  # a slice is small or one text, which Spark holds in 2 GB itself
        raise ValueError("ids of one text beyond 2 GB")
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)),
                                                          pa.py_buffer(np.ascontiguousarray(data))])


def read_vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as file:
        return Vocabulary(file.read())


def encode_documents(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit numbers) and the decoded text of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # one file of fixed size
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(encode_rows(sent), f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids binary, "
                                              "decoded string")
