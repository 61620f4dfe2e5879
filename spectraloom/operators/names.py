"""Which of many names occur in a text, read once whatever the number of names.

An automaton over the names' bytes: from every prefix of a name it knows, for every next byte, the longest prefix of a
name that the text now ends with. A batch of texts is walked together, one byte of every text at a time. Names may
overlap and contain each other; a name is found wherever its bytes occur (UTF-8 keeps that equal to characters).

The table has a row per prefix and a column per kind of byte; names are a parameter, so it does not grow with the data.
It is sent once to every executor. ``operators.labels`` has the same rules as column expressions for a handful of names.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from spectraloom.functions.kernels import add_columns

LARGEST = 1 << 28  # bytes of the table


class Names:
    """The automaton of a list of names; the first of equal names counts."""

    def __init__(self, names: Sequence[str]):
        self.names = list(names)
        raw = [n.encode() for n in self.names]
        self.kinds = np.zeros(256, np.int64)  # bytes that no name has are one kind
        for kind, byte in enumerate(sorted(set(b"".join(raw))), 1):
            self.kinds[byte] = kind
        width = int(self.kinds.max(initial=0)) + 1
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for number, name in enumerate(raw):
            at = 0
            for kind in self.kinds[np.frombuffer(name, np.uint8)].tolist():
                if kind not in children[at]:
                    children[at][kind] = len(children)
                    children.append({})
                at = children[at][kind]
            ends.setdefault(at, number)
        if 4 * width * len(children) > LARGEST:
            raise ValueError(f"the names need a table of more than {LARGEST} bytes")
        none = len(self.names)
        self.next = np.zeros((len(children), width), np.int32)
        self.name = np.full(len(children), none, np.int64)   # the name that ends here
        self.first = np.full(len(children), none, np.int64)  # the first in the list of all that end here
        self.shorter = np.zeros(len(children), np.int64)     # the longest shorter prefix at which a name ends
        for at, number in ends.items():
            self.name[at] = number
        fall = np.zeros(len(children), np.int64)
        waiting = deque([0])
        while waiting:  # by length, so that shorter prefixes are done
            at = waiting.popleft()
            self.next[at] = self.next[fall[at]] if at else 0
            self.first[at] = min(self.name[at], self.first[fall[at]] if at else none)
            self.shorter[at] = fall[at] if self.name[fall[at]] < none else self.shorter[fall[at]]
            for kind, child in children[at].items():
                fall[child] = self.next[fall[at], kind] if at else 0
                self.next[at, kind] = child
                waiting.append(child)

    def walk(self, offsets: np.ndarray, data: np.ndarray):
        """For each step the rows that still have bytes, and their states; once before the first byte."""
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        starts, ordered = offsets[:-1][order], lengths[order]
        state = np.zeros(len(order), np.int64)
        yield order, state
        kinds = self.kinds[data]
        for step in range(int(ordered[0]) if len(ordered) else 0):
            active = int(np.searchsorted(-ordered, -step, "left"))  # rows longer than the step
            state = self.next[state[:active], kinds[starts[:active] + step]].astype(np.int64)
            yield order[:active], state

    def first_in(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Per text the number of the first name in the list that occurs; the number of names if none does."""
        found = np.full(len(offsets) - 1, len(self.names), np.int64)
        for rows, state in self.walk(offsets, data):
            found[rows] = np.minimum(found[rows], self.first[state])
        return found

    def all_in(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (text, name number), each once, in order."""
        pairs, held, count = [], 0, len(self.names)
        for rows, state in self.walk(offsets, data):
            while len(rows):
                ends = self.name[state] < count
                if ends.any():
                    pairs.append(rows[ends] * count + self.name[state[ends]])
                    held += len(pairs[-1])
                more = (self.shorter[state] > 0) | ((self.name[0] < count) & (state > 0) & (self.shorter[state] == 0))
                rows, state = rows[more], self.shorter[state[more]]
            if held > 1_000_000:
                pairs = [np.unique(np.concatenate(pairs))]
                held = len(pairs[0])
        found = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        return found // max(count, 1), found % max(count, 1)


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0]:offsets[-1]]


def first_name(df: DataFrame, text: str, names: Sequence[str], output: str = "name", lower: bool = True) -> DataFrame:
    """The first of ``names``, in their order, that occurs in the text (lower-cased unless told otherwise), or NULL."""
    held = df.sparkSession.sparkContext.broadcast(Names(names))

    def find(column: pa.Array) -> list[pa.Array]:
        at = held.value.first_in(*string_bytes(column))
        missing = (at == len(held.value.names)) | column.is_null().to_numpy(zero_copy_only=False)
        return [pa.array([*held.value.names, None]).take(pa.array(np.where(missing, len(held.value.names), at)))]

    return with_lowered(df, text, lower, {output: T.StringType()}, find)


def names_found(df: DataFrame, text: str, names: Sequence[str], output: str = "names", lower: bool = True) -> DataFrame:
    """All of ``names`` that occur, in the order of the list; NULL for a NULL text."""
    held = df.sparkSession.sparkContext.broadcast(Names(names))

    def find(column: pa.Array) -> list[pa.Array]:
        rows, numbers = held.value.all_in(*string_bytes(column))
        offsets = np.searchsorted(rows, np.arange(len(column) + 1)).astype(np.int32)
        values = pa.array(held.value.names, pa.string()).take(pa.array(numbers))
        nulls = column.is_null() if column.null_count else None
        return [pa.ListArray.from_arrays(pa.array(offsets), values, mask=nulls)]

    return with_lowered(df, text, lower, {output: T.ArrayType(T.StringType())}, find)


def name_targets(df: DataFrame, label: str, names: Sequence[str], output: str = "targets") -> DataFrame:
    """0/1 array in the order of ``names``: whether the name occurs in the label. A missing label has none."""
    held = df.sparkSession.sparkContext.broadcast(Names(names))

    def find(column: pa.Array) -> list[pa.Array]:
        count = len(held.value.names)
        rows, numbers = held.value.all_in(*string_bytes(column))
        hits = np.zeros((len(column), count), np.int32)
        hits[rows, numbers] = 1
        offsets = np.arange(len(column) + 1, dtype=np.int32) * count
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(hits.ravel()))]

    return with_lowered(df, label, False, {output: T.ArrayType(T.IntegerType())}, find)


def with_lowered(df: DataFrame, text: str, lower: bool, outputs: dict, kernel) -> DataFrame:
    if not lower:
        return add_columns(df, text, outputs, kernel)
    return add_columns(df.withColumn("_lowered", F.lower(text)), "_lowered", outputs, kernel).drop("_lowered")
