"""Despiking a stream against all spectra so far."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom.operators.quantile import difference_stats
from spectraloom.operators.signal import preprocess
from spectraloom.streaming import spectra as streams

STEPS = [("despike", {"threshold": 8, "ma": 3}), ("smooth", {"window": 5})]


@pytest.fixture()
def parts(spark, tmp_path):
    rng = np.random.default_rng(4)
    found = []
    for part in range(3):
        x = np.cumsum(rng.normal(0, 1 + part, (120, 40)), axis=1)
        x[rng.integers(0, 120, 10), rng.integers(0, 40, 10)] += 500
        rows = [(f"s{part}-{i:03d}", [float(v) for v in range(40)], [float(v) for v in r]) for i, r in enumerate(x)]
        rows.append((f"s{part}-null", None, None))
        found.append(spark.createDataFrame(rows, streams.SPECTRA).coalesce(1))
    return found


def run(spark, tmp_path, name, times=1):
    stream = streams.read_spectra_stream(spark, str(tmp_path / "in"))
    query = streams.clean_so_far(stream, STEPS, str(tmp_path / f"out{name}"), str(tmp_path / f"state{name}"),
                                 str(tmp_path / f"check{name}"))
    query.awaitTermination(180)


def rank_of(values, x):
    values = np.sort(values)
    return np.searchsorted(values, x) / len(values)


def test_statistics_so_far_and_after_a_restart(spark, parts, tmp_path):
    for number, part in enumerate(parts):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        run(spark, tmp_path, "a")  # each run starts from the checkpoint of the one before
    state = streams.DifferencesSoFar(spark, str(tmp_path / "statea"))
    everything = spark.read.parquet(str(tmp_path / "in"))
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "statea").iterdir() if "=" in p.name)
    median, deviation = streams.spread_of(state.read(last))
    differences = np.concatenate([np.diff(r["intensities"]) for r in everything.where("intensities IS NOT NULL").collect()])
    exact = difference_stats(everything)
    assert abs(rank_of(differences, median) - 0.5) < streams.RANK_ERROR
    assert abs(rank_of(np.abs(differences - exact[0]), deviation) - 0.5) < 2 * streams.RANK_ERROR
    assert state.read(last).first()["n"] == len(differences)
    out = spark.read.parquet(str(tmp_path / "outa"))
    assert out.count() == everything.count() == out.select("spectrum_id").distinct().count()
    rows = out.where(F.col("batch") == last).drop("batch")
    source = everything.join(rows.select("spectrum_id"), "spectrum_id")
    again = preprocess(source, [("despike", {**STEPS[0][1], "stats": (median, deviation)}), STEPS[1]])
    key = lambda df: sorted((r["spectrum_id"], r["intensities"] or []) for r in df.collect())
    assert key(rows) == key(again)


def test_a_batch_that_runs_again_gives_the_same(spark, parts, tmp_path):
    state = streams.DifferencesSoFar(spark, str(tmp_path / "state"))
    first = streams.spread_of(state.add(0, parts[0], "intensities"))
    one = state.add(1, parts[1], "intensities").first()["n"]
    two = state.add(1, parts[1], "intensities").first()["n"]
    assert one == two and state.read(0).first()["n"] == 120 * 39 and streams.spread_of(state.read(0)) == first
    empty = state.add(2, parts[0].where("false"), "intensities")
    assert empty.first()["n"] == one and streams.spread_of(empty)[0] is not None


def test_a_stream_without_points(spark, parts, tmp_path):
    parts[0].where("intensities IS NULL").write.parquet(str(tmp_path / "in"))
    run(spark, tmp_path, "b")
    out = spark.read.parquet(str(tmp_path / "outb"))
    assert [r["intensities"] for r in out.collect()] == [None]
