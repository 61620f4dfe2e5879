"""The automaton of names against one containment test per name."""

import time

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from spectraloom.operators import labels
from spectraloom.operators.names import Names, first_name, name_targets, names_found


def packed(texts):
    raw = [t.encode() for t in texts]
    return np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64), np.frombuffer(b"".join(raw), np.uint8)


SOME = st.text(alphabet="abé ", max_size=12)


@settings(max_examples=300, deadline=None)
@given(st.lists(SOME, max_size=12), st.lists(SOME, max_size=8))
def test_same_as_containment(names, texts):
    held, (offsets, data) = Names(names), packed(texts)
    unique = list(dict.fromkeys(names))
    first = [next((n for n in names if n in t), None) for t in texts]
    assert [None if i == len(names) else names[i] for i in held.first_in(offsets, data)] == first
    rows, numbers = held.all_in(offsets, data)
    found = [[names[n] for r, n in zip(rows, numbers) if r == i] for i in range(len(texts))]
    assert found == [[n for n in unique if n in t] for t in texts]


def test_operators_follow_the_column_rules(spark):
    rows = [("a+Casei",), ("brevis/casei",), (None,), ("",), ("xrossiaex",), ("grayi innocua grayi",)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "label string, id int").repartition(2)
    choices = ["casei", "brevis", "rossiae", "ros", "grayi", "innocua"]
    both = first_name(df, "label", choices).withColumn("other", labels.first_match(F.col("label"), choices)).orderBy("id")
    assert all(r["name"] == r["other"] for r in both.collect()) and both.collect()[1]["name"] == "casei"
    every = {r["id"]: r["names"] for r in names_found(df, "label", choices).collect()}
    assert every[4] == ["rossiae", "ros"] and every[5] == ["grayi", "innocua"] and every[2] is None and every[3] == []
    mine = name_targets(df, "label", choices).select("id", "targets").orderBy("id").collect()
    assert mine == labels.multilabel_targets(df, choices, "label").select("id", "targets").orderBy("id").collect()
    assert names_found(df.where("false"), "label", choices).collect() == []
    assert first_name(df, "label", []).where("name is not null").count() == 0


def test_time_does_not_depend_on_the_names():
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefghij"), 9)) for _ in range(10_000)]
    texts = [" ".join(rng.choice(words, 12)) for _ in range(2000)]
    offsets, data = packed(texts)
    seconds = []
    for names in (words[:10], words):
        held = Names(names)
        held.first_in(offsets, data)
        start = time.perf_counter()
        found = held.first_in(offsets, data)
        seconds.append(time.perf_counter() - start)
    assert (found == [min(words.index(w) for w in t.split()) for t in texts[:50]] + found[50:].tolist()).all()
    assert seconds[1] < 4 * seconds[0] + 0.05


def test_too_many_names(monkeypatch):
    monkeypatch.setattr("spectraloom.operators.names.LARGEST", 100)
    with pytest.raises(ValueError):
        Names(["a long name", "another one"])
