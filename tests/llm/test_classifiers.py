"""Quality and toxicity: held-out accuracy, the automaton against edit distances, odd rows; the pipeline."""

import os
import re
import shutil
import subprocess
import sys

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
import corpus_pipeline
from spectraloom.llm import bpe, jaccard, line_dedup, mixing, quality, queries, toxicity
from spectraloom.plans import catalog
from tests.llm.conftest import CLASH, ODD

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("name, label", [("op5_quality", "quality"), ("op9_toxicity", "toxic")])
def test_held_out_accuracy(name, label, spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = queries.QUERIES[name](spark, SF).join(labels, "doc_id").where("held_out").toPandas()
    wrong = (rows.predicted != rows[label]).mean()
    assert wrong < 0.02
    rare = rows[rows[label] == (0 if label == "quality" else 1)]
    assert (rare.predicted == rare[label]).mean() > 0.9
    assert rows.score.between(0, 1).all()


def test_labels_of_held_out_rows_are_not_read(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learn = queries.remainder(5) != 0
    turned = labels.withColumn("quality", F.when(learn, F.col("quality")).otherwise(1 - F.col("quality")))
    scores = [sorted(tuple(r) for r in quality.score(docs, quality.fit(docs, x, learn)).select("doc_id", "score").collect())
              for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_gradients_of_attention():
    rng = np.random.default_rng(0)
    model = quality.Attention()
    x, first, y = rng.random((7, quality.FEATURES)), np.array([0, 3, 4, 7]), np.array([1.0, 0.0, 1.0])

    def loss():
        s = model.forward(x, first)[0]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    for name, grad in model.gradients(x, first, y).items():
        p = model.p[name]
        at = tuple(int(rng.integers(n)) for n in p.shape)
        held = p[at]
        p[at] = held + 1e-5
        up = loss()
        p[at] = held - 1e-5
        down = loss()
        p[at] = held
        assert abs((up - down) / 2e-5 - grad[at]) < 1e-6


@pytest.mark.parametrize("operator, label", [(quality, "quality"), (toxicity, "toxic")])
def test_odd_rows(operator, label, spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (9, 0, 1), (7, 1, 0), (7, None, None), (None, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    everything = F.lit(True)
    for known in (labels, labels.where("false"), labels.where("doc_id = 1")):
        model = operator.fit(odd, known, everything, label)
        found = operator.score(odd, model)
        rows = found.collect()
        assert found.columns == [c for c in odd.columns if c != "score"] + ["score"] and len(rows) == len(ODD)
        assert all(0 <= r.score <= 1 for r in rows) and all(r[c] == "keep" for r in rows for c in CLASH if c != "score")
        assert len({r.score for r in rows if r.doc_id in (4, 5)}) == 1  # null and empty text
        assert len({r.score for r in rows if r.doc_id == 2}) == 1
        assert operator.score(none, model).collect() == []


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


TERMS = [("stupid", False), ("stub", False), ("stu", True), ("abcabc", True), ("ab", False)]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text("abcstupid", max_size=9), st.sampled_from([t for t, _ in TERMS]).flatmap(
    lambda t: st.tuples(st.integers(0, len(t)), st.text("abx", max_size=2)).map(lambda x: t[:x[0]] + x[1] + t[x[0]:]))))
def test_automaton_equals_edit_distance(word):
    found = dict(toxicity.Lexicon([(t, s, (1.0, 0.5)) for t, s in TERMS]).hits(word))
    for number, (term, stem) in enumerate(TERMS):
        allowed = 1 if len(term) >= toxicity.EDIT_FROM else 0
        ends = [word[:k] for k in range(len(word) + 1)] if stem else [word]
        least = min(edits(term, e) for e in ends)
        assert found.get(number) == (least if least <= allowed else None)


def test_misspelled_and_quoted_terms():
    lexicon = toxicity.Lexicon([("worthless", False, (4.0, 2.0)), ("scum", False, (4.0, 0.0))])
    finder = toxicity.Finder(lexicon)

    def features(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return finder.features(np.array([0, len(data)]), data)[0]

    plain, typo, quoted = features("you worthless scum"), features("you worthles thing"), features(
        'he wrote "worthless scum" about it')
    assert plain[0] > typo[0] > 0 and quoted[0] == 0 and quoted[1] > 0
    assert not features("a fine day").any() and not features("").any()


def test_registered_queries():
    names = entry_module.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names} and "pipeline" in names
    assert set(queries.SQL) <= set(entry_module.oracle_sql())


def test_pipeline_stage_by_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    kept = stages["quality"](spark, docs, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    clean = docs.join(labels, "doc_id").where("quality = 1")
    assert kept.columns == columns and clean.join(kept, "doc_id", "left_anti").count() <= 0.02 * clean.count()
    assert kept.join(labels, "doc_id").where("quality = 0").count() <= 0.1 * labels.where("quality = 0").count()
    kept = kept.cache()
    lines = stages["lines"](spark, kept, sf_dir)
    expected = line_dedup.drop_lines(kept, "source")
    assert lines.columns == columns and lines.count() == kept.count()
    assert lines.select("doc_id", "text").exceptAll(expected.select("doc_id", "text")).count() == 0
    single = stages["near_duplicates"](spark, lines, sf_dir)
    groups = jaccard.similar_documents(lines).toPandas()
    assert sorted(r.doc_id for r in single.collect()) == sorted(groups[groups.doc_id == groups.component_id].doc_id)
    mixed = stages["mixture"](spark, single, sf_dir)
    assert mixed.columns == columns
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(
        r.doc_id for r in mixing.mix_documents(single).where("kept").collect())
    tokens = {r.doc_id: r for r in stages["tokens"](spark, mixed, sf_dir).collect()}
    encoder = bpe.Encoder(bpe.read_vocabulary(queries.VOCABULARY))
    assert {i: list(np.frombuffer(bytes(r.ids), "<u4")) for i, r in tokens.items()} == {
        r.doc_id: encoder.encode(r.text) for r in mixed.collect()}
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").collect()) == sorted(tokens)


def test_pipeline_stages_on_odd_rows(spark, odd, none, sf_dir):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, docs, sf_dir)
            if name != "tokens":
                assert found.columns == docs.columns
            assert found.count() <= docs.count()
    assert corpus_pipeline.STAGES[2][1](spark, odd, sf_dir).where("doc_id in (2, 3, 8)").count() == 0


def test_one_row_of_each_group_stays(spark):
    """Repeated ids, rows without an id, and an id of two texts, one of them a copy."""
    copy, other = "one two three four five six seven eight", "an own text that is nowhere else at all"
    rows = [(3, copy), (3, copy), (None, copy), (7, copy), (7, other), (None, other), (None, "alone"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "").collect()
    assert sorted(map(tuple, found), key=str) == sorted([(3, copy), (7, other), (None, "alone"), (9, None)], key=str)


def test_the_rest_works_without_this_subpackage(tmp_path):
    """Copies the library without the subpackage and the pipeline, and imports the entry module there."""
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(os.path.join(repo, "spectraloom"), tmp_path / "spectraloom", ignore=shutil.ignore_patterns("llm"))
    shutil.copy(os.path.join(repo, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()))"
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=environment, capture_output=True, text=True)
    assert done.stdout.split() == [str(len(catalog.QUERIES)), "False"], done.stderr[-1000:]


def test_signs_of_the_toxicity_model():
    """Abuse never lowers a score and quotation never raises it, also where the sample says otherwise."""
    rng = np.random.default_rng(4)
    x = np.abs(rng.normal(size=(500, toxicity.FEATURES)))
    lean = np.array([1.0, 2.0, -1.5, 0.5, 0.0, 0.3, -0.2])
    y = (rng.random(500) < 1 / (1 + np.exp(-(x @ lean - 1)))).astype(float)
    weights, constant = toxicity.logistic(x, y)
    assert weights[toxicity.CITED] <= 0 and (np.delete(weights, toxicity.CITED) >= 0).all()
    loss = lambda w, c: (np.logaddexp(0, x @ w + c) - y * (x @ w + c)).sum() + 0.5 * (w * w).sum()
    best = loss(weights, constant)
    for _ in range(300):  # no allowed change is better
        other = weights + rng.normal(size=len(weights)) * 0.05
        other = np.where(np.arange(len(other)) == toxicity.CITED, np.minimum(other, 0), np.maximum(other, 0))
        assert loss(other, constant + rng.normal() * 0.05) >= best - 1e-6


def test_toxicity_scores_by_hand(spark):
    """Scores of whole texts from the model's parts, word by word."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.fit(docs, labels, queries.remainder(4) != 2)
    found = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    some = sorted(found, key=found.get)[-40:] + sorted(found)[:60]
    for ident in some:
        words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", texts[ident]) if w]
        weights = [model.lexicon.weight(toxicity.plain_word(w)) if toxicity.plain_word(w) else 0.0 for w in words]
        opens = [w[:1] in toxicity.OPENING for w in words]
        closes = [w.rstrip(".,!?;:")[-1:] in toxicity.CLOSING for w in words]
        reports = [toxicity.plain_word(w) in toxicity.REPORT for w in words]
        free, cited = [0.0] * len(words), 0.0
        hits = [i for i, w in enumerate(weights) if w]
        for i in hits:
            low, high = max(i - toxicity.WINDOW, 0), min(i + toxicity.WINDOW + 1, len(words))
            if any(opens[low:i + 1]) and any(closes[i:high]) or any(reports[max(i - 3, 0):i]):
                cited += weights[i]
            else:
                free[i] = weights[i]
        total = sum(free)
        window = max([sum(free[max(i - toxicity.WINDOW, 0):i + toxicity.WINDOW + 1]) for i in hits], default=0.0)
        x = [np.log1p(total), np.log1p(cited), np.log1p(window), max([free[i] for i in hits], default=0.0),
             np.log1p(sum(f > 0 for f in free)), np.log1p(1000 * total / max(len(words), 1)) / 4, float(total > 0)]
        if not hits:
            x = [0.0] * toxicity.FEATURES
        expected = 1 / (1 + np.exp(-(np.dot(x, model.coefficients) + model.constant)))
        assert abs(found[ident] - expected) < 1e-6, ident
