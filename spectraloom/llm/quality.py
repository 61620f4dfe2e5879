"""Quality scores from attention-based multiple-instance learning.

Method. A text is a bag of passages (windows of ``PASSAGE`` bytes over the whole text). Every passage is encoded:
frequencies of pairs of character classes, repeated words and their share. Gated attention,
softmax(w . (tanh(V h) * sigmoid(U h))) over the passages of a text, learned from document labels only, weighs the
passage representations h; the weighted sum is scored.

The model is fitted on the driver from a bounded sample of labelled rows (``SAMPLE`` documents by hash of their id,
at most ``BAG`` evenly spaced passages of each); scoring reads every passage of every text, in place and without a
shuffle. Labels, language, source and id are no inputs of a score.

Defined cases: null text is empty; an empty text is one empty passage and gets a score; rows without a label, or with
a null one, are not learned from; several labels of an id: the smallest counts; no labelled rows of one of the
classes: every score is the smoothed share of label 1. Repeated rows get equal scores. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spectraloom.llm.common import slices, text_bytes
from spectraloom.llm.textscan import Words

PASSAGE = 1024
SAMPLE, BAG = 4000, 24
HIDDEN, GATE = 24, 12
EPOCHS, BATCH, RATE, DECAY = 40, 128, 0.01, 1e-4
CLASSES = 12


def character_classes() -> np.ndarray:
    """Class of each byte: letters by case, digits, spaces, line ends, marks by kind, bytes of other characters."""
    kind = np.full(256, 10, np.uint8)
    for number, members in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789",
                                      b" \t", b"\n\r", b".,;:", b"!?", b"'\"()-", b"|/\\_=<>", b"#$%&*@~^+"]):
        kind[list(members)] = number
    kind[128:] = 11
    return kind


FEATURES = CLASSES * CLASSES + 5


def passages(offsets, data, words, kinds):
    """Encoded passages of all rows (each row has one at least), and the number of each row's first passage."""
    rows = len(offsets) - 1
    sizes = np.diff(offsets)
    per_row = np.maximum(1, -(-sizes // PASSAGE))
    first = np.concatenate([[0], np.cumsum(per_row)])
    total = int(first[-1])
    row = np.repeat(np.arange(rows), sizes)
    where = first[row] + (np.arange(len(data)) - offsets[row]) // PASSAGE
    kind = kinds[data].astype(np.int64)
    same = where[1:] == where[:-1]
    pairs = where[:-1] * (CLASSES * CLASSES) + kind[:-1] * CLASSES + kind[1:]
    counts = np.bincount(pairs[same], minlength=total * CLASSES * CLASSES).reshape(total, -1)
    out = np.zeros((total, FEATURES), np.float32)
    out[:, :CLASSES * CLASSES] = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
    starts, ends, hashes, _ = words.scan(offsets, data)
    if len(starts):
        place = where[starts]
        n = np.bincount(place, minlength=total)
        near = np.zeros(len(hashes), bool)
        near[1:] = (hashes[1:] == hashes[:-1]) & (place[1:] == place[:-1])
        order = np.lexsort((hashes, place))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (place[order[1:]] != place[order[:-1]])
        distinct = np.bincount(place[order], fresh, total)
        out[:, -5] = np.bincount(place, near, total) / np.maximum(n, 1)
        out[:, -4] = distinct / np.maximum(n, 1)
        out[:, -3] = np.log1p(n) / 5
        out[:, -2] = np.bincount(place, ends - starts, total) / np.maximum(n, 1) / 10
    out[:, -1] = np.log1p(sizes).repeat(per_row) / 10
    return out, first


class Attention:
    """Gated attention over passages, fitted by Adam with hand-written gradients."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.p = {"W": rng.normal(0, 0.1, (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN),
                  "V": rng.normal(0, 0.3, (HIDDEN, GATE)), "U": rng.normal(0, 0.3, (HIDDEN, GATE)),
                  "w": rng.normal(0, 0.3, GATE), "o": rng.normal(0, 0.3, HIDDEN), "c": np.zeros(1)}
        self.mean, self.scale, self.constant = np.zeros(FEATURES), np.ones(FEATURES), None

    def forward(self, x, first):
        p = self.p
        bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
        h = np.tanh(((x - self.mean) / self.scale) @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, first[:-1])[bag])
        a = e / np.add.reduceat(e, first[:-1])[bag]
        z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
        score = 1 / (1 + np.exp(-(z @ p["o"] + p["c"])))
        return score, (bag, h, t, g, a, z)

    def gradients(self, x, first, y):
        p = self.p
        score, (bag, h, t, g, a, z) = self.forward(x, first)
        d = (score - y) / len(y)
        dz = d[:, None] * p["o"]
        da = (h * dz[bag]).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, first[:-1])[bag])
        dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
        dh = (a[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return {"o": z.T @ d, "c": np.array([d.sum()]), "w": (t * g).T @ de, "V": h.T @ dt, "U": h.T @ dg,
                "W": ((x - self.mean) / self.scale).T @ dh, "b": dh.sum(axis=0)}

    def fit(self, bags, labels, seed: int = 4):
        y = np.asarray(labels, float)
        if len(set(labels)) < 2:
            self.constant = (y.sum() + 1) / (len(y) + 2)
            return self
        flat = np.concatenate(bags)
        self.mean, self.scale = flat.mean(axis=0), flat.std(axis=0) + 0.02
        first = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
        rng, m, v, step = np.random.default_rng(seed), {}, {}, 0
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS) + 1e-4
            order = rng.permutation(len(y))
            for i in range(0, len(y), BATCH):
                some = order[i:i + BATCH]
                x = np.concatenate([flat[first[j]:first[j + 1]] for j in some])
                sizes = np.concatenate([[0], np.cumsum([first[j + 1] - first[j] for j in some])])
                step += 1
                for k, grad in self.gradients(x, sizes, y[some]).items():
                    grad = grad + DECAY * self.p[k]
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * grad
                    v[k] = 0.999 * v.get(k, 0) + 0.001 * grad * grad
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (
                        np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
        return self

    def score(self, x, first):
        if self.constant is not None:
            return np.full(len(first) - 1, self.constant)
        return self.forward(x, first)[0]


def encode_rows(batches):
    """Passages of the sample: one row per document."""
    words, kinds = Words(), character_classes()
    for batch in batches:
        offsets, data = text_bytes(batch.column(1))
        for a, b in slices(offsets):
            x, first = passages(offsets[a:b + 1] - offsets[a], data[offsets[a]:offsets[b]], words, kinds)
            bags = []
            for i, j in zip(first[:-1], first[1:]):
                some = np.unique(np.linspace(i, j - 1, min(BAG, j - i)).astype(int))
                bags.append(x[some].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(bags, pa.binary())],
                                             ["label", "passages"])


def score_rows(model):
    def run(batches):
        words, kinds, held = Words(), character_classes(), model.value
        for batch in batches:
            offsets, data = text_bytes(batch.column(batch.num_columns - 1))
            scores = [np.zeros(0)]
            for a, b in slices(offsets, 1 << 20):
                scores.append(held.score(*passages(offsets[a:b + 1] - offsets[a], data[offsets[a]:offsets[b]],
                                                   words, kinds)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores))],
                                             [*batch.schema.names, "score"])
    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, learn: F.Column, id_col: str, text_col: str,
                    limit: int) -> DataFrame:
    """(label, text) of at most ``limit`` labelled documents for which ``learn`` holds, chosen by a hash of the id."""
    chosen = (labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
              .where("_id is not null and _label is not null").groupBy("_id").agg(F.min("_label").alias("_label"))
              .withColumnRenamed("_id", id_col).where(learn)
              .orderBy(F.xxhash64(id_col), id_col).limit(limit))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    chosen = F.broadcast(chosen.select(F.col(id_col).alias("_id"), "_label"))  # at most ``limit`` pairs of numbers
    return texts.join(chosen, "_id").select(F.col("_label").alias("label"), F.col("_text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, learn: F.Column, label_col: str = "quality", id_col: str = "doc_id",
        text_col: str = "text", limit: int = SAMPLE) -> Attention:
    sample = labelled_sample(docs, labels, label_col, learn, id_col, text_col, limit)
    rows = sample.mapInArrow(encode_rows, "label int, passages binary").toArrow()
    found = [(x.as_py(), p.as_py()) for x, p in zip(rows["label"], rows["passages"])]
    found.sort(key=lambda x: x[1])  # the same model whatever the partitioning
    bags = [np.frombuffer(p, "<f4").reshape(-1, FEATURES) for _, p in found]
    return Attention().fit(bags, [x for x, _ in found])


def scored_rows(docs: DataFrame, run, text_col: str) -> DataFrame:
    """(row, score): a document's own columns are in ``row``, so no names clash."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)],
                        F.col(f"`{text_col}`").alias("text"))
    kinds = ", ".join(f"{n} {t}" for n, t in plain.dtypes)
    scored = plain.mapInArrow(run, f"{kinds}, score double")
    return scored.select(F.struct(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)]).alias("row"), "score")


def with_row(docs: DataFrame, model: Attention, text_col: str = "text") -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers
    return scored_rows(docs, score_rows(sent), text_col)


def score(docs: DataFrame, model: Attention, text_col: str = "text") -> DataFrame:
    """All columns of the rows and ``score`` (in place of a column of that name)."""
    return with_row(docs, model, text_col).select(*[F.col(f"row.`{c}`") for c in docs.columns if c != "score"], "score")
