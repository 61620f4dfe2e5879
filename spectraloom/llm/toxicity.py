"""Toxicity scores: misspelled lexicon terms by Levenshtein automata, weighed in their context.

Method. The lexicon's terms form a trie; a term is a whole word or a stem that any ending may follow. The Levenshtein
automaton of a word and the trie are intersected: a state is the set of (trie place, edits used), built lazily and
remembered, so a word is read once, letter by letter, and most words end after a few letters. Longer terms allow an
edit. Every (term, edits) pair has a weight learned from labelled texts: an edit that mostly finds harmless words
weighs nothing.

A hit is looked at in its context window: inside quotation marks or after a word of report it counts as quotation,
else as abuse; neighbouring hits strengthen each other. A logistic model over these sums gives the score.

The lexicon, its weights and the model come from a bounded sample of labelled rows (``SAMPLE`` documents by hash of
their id; candidate terms are counted on Spark). Scoring reads whole texts in place, without a shuffle. Labels,
language, source and id are no inputs of a score.

Defined cases: null or empty text has no hits and gets the lowest score; rows without a label are not learned from;
several labels of an id: the smallest counts; no labelled rows or one class only: every score is the smoothed share
of label 1; repeated rows get equal scores. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spectraloom.llm.common import Scratch, slices, text_bytes
from spectraloom.llm.quality import labelled_sample, scored_rows
from spectraloom.llm.textscan import Words

SAMPLE = 8000
TERMS = 400            # most terms of a lexicon
SUPPORT = 4            # toxic documents of the sample that a term needs, or a hundredth of them
LIFT = 12.0            # how many times more frequent a term is in toxic documents
STEM = (4, 9)          # lengths of stems
EDIT_FROM = 5          # terms of this length on allow one edit
WINDOW = 12            # words on either side
REMEMBER = 300_000
STATES = 50_000        # of the automaton, after which it is built anew
STRIP = ".,!?;:\"'()[]{}<>|#$%&*@~^+=-_/\\«»„“”‘’…"
OPENING, CLOSING = "\"'«„“‘", "\"'»“”’"
#: Words before a hit that mark it as reported speech.
REPORT = frozenset("said says wrote called word term quote quoted dit mot terme sagte wort begriff dijo palabra".split())


class Lexicon:
    """Automaton over (term, is a stem, weights by edits)."""

    def __init__(self, terms):
        self.terms = list(terms)
        self.children, self.ends = [{}], [[]]
        for number, (term, stem, _) in enumerate(self.terms):
            at = 0
            for letter in term:
                if letter not in self.children[at]:
                    self.children[at][letter] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                at = self.children[at][letter]
            self.ends[at].append(number)
        self.edits = [1 if len(t) >= EDIT_FROM else 0 for t, _, _ in self.terms]
        self.most = [0] * len(self.children)  # edits that some term below allows
        for number, (term, _, _) in enumerate(self.terms):
            at = 0
            self.most[at] = max(self.most[at], self.edits[number])
            for letter in term:
                at = self.children[at][letter]
                self.most[at] = max(self.most[at], self.edits[number])
        self.forget()

    def forget(self) -> None:
        self.states, self.number, self.steps, self.found = [], {}, [], []
        self.start = self.state([(0, 0)])

    def spread(self, places):
        """Adds letters of a term that the word leaves out; keeps the fewest edits per place, and notes stems."""
        best = {}
        work = [(at, edits) for (at, edits) in places]
        while work:
            at, edits = work.pop()
            if edits > self.most[at] or best.get(at, 9) <= edits:
                continue
            best[at] = edits
            work += [(child, edits + 1) for child in self.children[at].values()]
        return best

    def state(self, places) -> int:
        """Number of a state: fewest edits per place of the trie and per stem already read."""
        stems = {at: e for at, e in sorted(places, reverse=True) if at < 0}
        best = self.spread([(at, e) for at, e in places if at >= 0])
        for at, edits in best.items():
            for number in self.ends[at]:
                if self.terms[number][1] and edits <= self.edits[number]:
                    stems[-1 - number] = min(stems.get(-1 - number, 9), edits)
        key = frozenset([*best.items(), *stems.items()])
        if key not in self.number:
            hits = {}
            for at, edits in best.items():
                for number in self.ends[at]:
                    if edits <= self.edits[number]:
                        hits[number] = min(hits.get(number, 9), edits)
            for at, edits in stems.items():
                hits[-1 - at] = min(hits.get(-1 - at, 9), edits)
            self.number[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
            self.found.append(tuple(sorted(hits.items())))
        return self.number[key]

    def step(self, state: int, letter: str) -> int:
        reached = self.steps[state].get(letter)
        if reached is None:
            places = []
            for at, edits in self.states[state]:
                if at < 0:
                    places.append((at, edits))
                    continue
                for other, child in self.children[at].items():
                    places.append((child, edits if other == letter else edits + 1))
                places.append((at, edits + 1))
            places = [(at, e) for at, e in places if at < 0 or e <= self.most[at]]
            reached = self.state(places) if places else -1
            if reached >= 0 and not self.states[reached]:
                reached = -1
            self.steps[state][letter] = reached
        return reached

    def hits(self, word: str) -> tuple:
        """(term number, fewest edits) of all terms the word matches."""
        if len(self.states) > STATES:
            self.forget()
        state, steps = self.start, self.steps
        for letter in word:
            reached = steps[state].get(letter)
            state = self.step(state, letter) if reached is None else reached
            if state < 0:
                return ()
        return self.found[state]

    def weight(self, word: str) -> float:
        return max([0.0, *(self.terms[n][2][e] for n, e in self.hits(word))])


def terms_of(word: str):
    """The word itself and its stems."""
    yield word, False
    for n in range(STEM[0], min(STEM[1], len(word)) + 1):
        yield word[:n], True


def plain_word(raw: str) -> str:
    return raw.strip(STRIP).lower()


def count_terms(batches):
    """Candidate terms of the sample: toxic and other documents that have them, summed per map task."""
    toxic, other = Counter(), Counter()
    for batch in batches:
        for label, text in zip(batch.column(0), batch.column(1)):
            words = {plain_word(w) for w in (text.as_py() or "").split()}
            terms = {t for w in words if w for t in terms_of(w)}
            (toxic if label.as_py() else other).update(terms)
            if len(toxic) + len(other) > 1_000_000:
                yield term_rows(toxic, other)
                toxic, other = Counter(), Counter()
    yield term_rows(toxic, other)


def term_rows(toxic, other):
    terms = sorted(toxic.keys() | other.keys())
    return pa.RecordBatch.from_arrays([
        pa.array([t for t, _ in terms], pa.string()), pa.array([s for _, s in terms], pa.bool_()),
        pa.array([toxic[t] for t in terms], pa.int64()), pa.array([other[t] for t in terms], pa.int64())],
        ["term", "stem", "toxic", "other"])


def choose_terms(rows, toxic: int, other: int):
    """Strongest terms first, the longer of equals. Left out: what a chosen stem covers, and a stem that finds hardly
    more documents than a chosen term that begins with it."""
    def lift(a, b):
        return ((a + 0.5) / (toxic + 1)) / ((b + 0.5) / (other + 1))

    support = max(SUPPORT, toxic // 100)
    good = [(t, s, a, b) for t, s, a, b in rows if a >= support and lift(a, b) >= LIFT]
    good.sort(key=lambda x: (-x[2] * np.log(lift(x[2], x[3])), x[1], -len(x[0]), x[0]))
    chosen, stems, whole, longest = [], set(), set(), {}
    for term, stem, a, b in good:
        if any(term[:k] in stems for k in range(1, len(term) + 1)) or term in whole:
            continue
        if stem and longest.get(term, 0) >= 0.8 * a:
            continue
        chosen.append((term, stem))
        (stems if stem else whole).add(term)
        for k in range(1, len(term) + 1):
            longest[term[:k]] = max(longest.get(term[:k], 0), a)
        if len(chosen) == TERMS:
            break
    return chosen


def fuzzy_rows(lexicon):
    """Documents of the sample per (term, edits), and their labels."""
    def run(batches):
        held = lexicon.value
        for batch in batches:
            labels, numbers, edits = [], [], []
            for label, text in zip(batch.column(0), batch.column(1)):
                words = {plain_word(w) for w in (text.as_py() or "").split()}
                for number, e in {hit for w in words for hit in held.hits(w)}:
                    labels.append(label.as_py())
                    numbers.append(number)
                    edits.append(e)
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(numbers, pa.int32()),
                                              pa.array(edits, pa.int32())], ["label", "number", "edits"])
    return run


FEATURES = 7
CITED = 1  # the feature that may only lower a score


class Finder:
    """Context features of texts; one per task."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.words, self.known = lexicon, Words(lower=False), {}

    def about(self, raw: str):
        """Weight of a word, and marks: opens, closes, reports."""
        word = plain_word(raw)
        marks = (1 if raw[:1] in OPENING else 0) | (2 if raw.rstrip(".,!?;:")[-1:] in CLOSING else 0) | (
            4 if word in REPORT else 0)
        return self.lexicon.weight(word) if word else 0.0, marks

    def features(self, offsets, data):
        """One row of ``FEATURES`` numbers per text."""
        starts, ends, hashes, first = self.words.scan(offsets, data)
        out = np.zeros((len(first) - 1, FEATURES))
        if not len(hashes):
            return out
        distinct, at, which = np.unique(hashes, return_index=True, return_inverse=True)
        raw, known = data.tobytes(), self.known
        if len(known) > REMEMBER:
            known.clear()
        weights, marks = np.zeros(len(distinct)), np.zeros(len(distinct), np.int8)
        for i, (name, s, e) in enumerate(zip(distinct.tolist(), starts[at].tolist(), ends[at].tolist())):
            found = known.get(name)
            if found is None:
                found = known[name] = self.about(raw[s:e].decode())
            if found[0] or found[1]:
                weights[i], marks[i] = found
        weights, marks = weights[which], marks[which]
        hits = np.flatnonzero(weights)
        if not len(hits):
            return out
        row = np.searchsorted(first, hits, "right") - 1
        # quoted: a quotation opens before the hit and closes after it, or a word of report stands before it
        low, high = np.maximum(hits - WINDOW, first[row]), np.minimum(hits + WINDOW + 1, first[row + 1])
        opens, closes, reports = (np.concatenate([[0], np.cumsum((marks & bit) > 0)]) for bit in (1, 2, 4))
        quoted = ((opens[hits + 1] - opens[low] > 0) & (closes[high] - closes[hits] > 0)) | (
            reports[hits] - reports[np.maximum(hits - 3, first[row])] > 0)
        free, held = weights * 0, weights * 0
        free[hits[~quoted]], held[hits[quoted]] = weights[hits[~quoted]], weights[hits[quoted]]
        sums = np.concatenate([[0], np.cumsum(free)])
        window = sums[high] - sums[low]
        rows = len(out)
        total, cited = np.bincount(row, free[hits], rows), np.bincount(row, held[hits], rows)
        length = np.maximum(np.diff(first), 1)
        out[:, 0] = np.log1p(total)
        out[:, 1] = np.log1p(cited)
        np.maximum.at(out[:, 2], row, window)
        np.maximum.at(out[:, 3], row, free[hits])
        out[:, 2] = np.log1p(out[:, 2])
        out[:, 4] = np.log1p(np.bincount(row, free[hits] > 0, rows))
        out[:, 5] = np.log1p(1000 * total / length) / 4
        out[:, 6] = (total > 0)
        return out


class Scorer:
    """Logistic model of the context features."""

    def __init__(self, lexicon, coefficients, constant):
        self.lexicon, self.coefficients, self.constant = lexicon, coefficients, constant

    def score(self, x):
        return 1 / (1 + np.exp(-np.clip(x @ self.coefficients + self.constant, -30, 30)))


def logistic(x, y, ridge=1.0):
    """Projected Newton steps; weights of abuse are not negative, that of quotation (``CITED``) is not positive."""
    signs = np.ones(x.shape[1])
    signs[CITED:CITED + 1] = -1
    x = np.column_stack([x * signs, np.ones(len(x))])  # now no weight but the constant may be negative
    bounded = np.append(np.ones(len(signs), bool), False)
    penalty = np.append(np.full(len(signs), ridge), 1e-6)
    loss = lambda w: np.logaddexp(0, x @ w).sum() - y @ (x @ w) + 0.5 * (penalty * w * w).sum()
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        free = ~(bounded & (w <= 0) & (gradient > 0))
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.zeros_like(w)
        step[free] = -np.linalg.solve(curve[np.ix_(free, free)], gradient[free])
        length, now = 1.0, loss(w)
        while length > 1e-6:
            trial = np.where(bounded, np.maximum(w + length * step, 0), w + length * step)
            if loss(trial) <= now:
                break
            length /= 2
        else:
            break
        moved = np.abs(trial - w).max()
        w = trial
        if moved < 1e-10:
            break
    return w[:-1] * signs, w[-1]


def sample_features(lexicon):
    def run(batches):
        finder = Finder(lexicon.value)
        for batch in batches:
            offsets, data = text_bytes(batch.column(1))
            for a, b in slices(offsets):
                x = finder.features(offsets[a:b + 1] - offsets[a], data[offsets[a]:offsets[b]])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a),
                                                  pa.array(list(x), pa.list_(pa.float64()))], ["label", "x"])
    return run


def score_rows(model):
    def run(batches):
        held = model.value
        finder = Finder(held.lexicon)
        for batch in batches:
            offsets, data = text_bytes(batch.column(batch.num_columns - 1))
            scores = [np.zeros(0)]
            for a, b in slices(offsets):
                scores.append(held.score(finder.features(offsets[a:b + 1] - offsets[a], data[offsets[a]:offsets[b]])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores))],
                                             [*batch.schema.names, "score"])
    return run


def fit(docs: DataFrame, labels: DataFrame, learn: F.Column, label_col: str = "toxic", id_col: str = "doc_id",
        text_col: str = "text", limit: int = SAMPLE) -> Scorer:
    context = docs.sparkSession.sparkContext
    sample = Scratch(docs.sparkSession, "toxicity").keep(  # at most ``limit`` texts, read four times
        labelled_sample(docs, labels, label_col, learn, id_col, text_col, limit).withColumn(
            "label", (F.col("label") > 0).cast("int")), "sample")
    toxic, other = sample.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    if not toxic or not other:
        share = (toxic + 1) / (toxic + other + 2)
        return Scorer(Lexicon([]), np.zeros(FEATURES), float(np.log(share / (1 - share))))
    counts = (sample.mapInArrow(count_terms, "term string, stem boolean, toxic long, other long")
              .groupBy("term", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
              .where((F.col("toxic") >= SUPPORT) &
                     ((F.col("toxic") + 0.5) / (toxic + 1) >= LIFT * (F.col("other") + 0.5) / (other + 1)))
              .orderBy(F.desc("toxic"), "other", "term", "stem").limit(50 * TERMS))
    chosen = choose_terms([tuple(r) for r in counts.collect()], toxic, other)
    plain = Lexicon([(t, s, (1.0, 1.0)) for t, s in chosen])
    seen = (sample.mapInArrow(fuzzy_rows(context.broadcast(plain)), "label int, number int, edits int")
            .groupBy("number", "edits").agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).collect())
    weights = {n: [0.0, 0.0] for n in range(len(chosen))}
    for number, edits, a, b in seen:
        found = np.log(((a + 0.5) / (toxic + 1)) / ((b + 0.5) / (other + 1)))
        weights[number][edits] = float(max(0.0, found - np.log(4)))
    for number, (term, stem) in enumerate(chosen):
        if (number, 1) not in {(n, e) for n, e, _, _ in seen}:
            # an unseen misspelling: half of the term's weight if the term is a whole, long word
            weights[number][1] = 0.5 * weights[number][0] if len(term) >= EDIT_FROM else 0.0
    lexicon = Lexicon([(t, s, tuple(weights[n])) for n, (t, s) in enumerate(chosen)])
    rows = sample.mapInArrow(sample_features(context.broadcast(lexicon)), "label int, x array<double>").toArrow()
    x = np.array(rows["x"].to_pylist(), float).reshape(-1, FEATURES)
    y = np.array(rows["label"].to_pylist(), float)
    return Scorer(lexicon, *logistic(x, y))


def score(docs: DataFrame, model: Scorer, text_col: str = "text") -> DataFrame:
    """All columns of the rows and ``score`` (in place of a column of that name)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a lexicon of bounded size
    rows = scored_rows(docs, score_rows(sent), text_col)
    return rows.select(*[F.col(f"row.`{c}`") for c in docs.columns if c != "score"], "score")
