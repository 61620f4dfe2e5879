"""Signal steps against direct definitions in numpy, and their edge rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom.functions import arpls
from spectraloom.functions.savgol import fit_matrix, smooth_matrix
from spectraloom.operators import quantile, signal


def frame(spark, rows):
    return spark.createDataFrame([(i, None if r is None else [float(v) for v in r]) for i, r in enumerate(rows)],
                                 "spectrum_id long, intensities array<double>")


def collect(df, column="intensities"):
    return [row[column] for row in df.orderBy("spectrum_id").collect()]


def random_spectra(n=12, points=40, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, points)).cumsum(axis=1)
    for k in range(n):
        x[k, rng.integers(0, points, 3)] += rng.choice([-1, 1]) * 60
    x[0, 0] += 80
    x[1, -1] += 80
    return x


def spikes_by_definition(x, ma, threshold, stats_over):
    d = np.diff(x, axis=1)
    out = x.copy()
    for k in range(len(x)):
        basis = d if stats_over == "dataset" else d[k]
        median = np.median(basis)
        mad = np.median(np.abs(basis - median))
        z = np.zeros(d.shape[1]) if abs(mad) < 0.001 else 0.6745 * (d[k] - median) / mad
        flags = np.append(np.abs(z) > threshold, False)
        for i in np.flatnonzero(flags):
            near = [j for j in range(max(0, i - ma), min(x.shape[1], i + ma + 1)) if not flags[j]]
            out[k, i] = x[k, near].mean() if near else np.nan
    return out


@pytest.mark.parametrize("scope", ["dataset", "spectrum"])
@pytest.mark.parametrize("ma,threshold", [(10, 8.0), (2, 3.0), (1, 0.5)])
def test_despike_by_definition(spark, scope, ma, threshold):
    x = random_spectra()
    got = collect(signal.despike(frame(spark, x), ma, threshold, scope))
    expected = spikes_by_definition(x, ma, threshold, scope)
    got = np.array([[np.nan if v is None else v for v in row] for row in got])
    np.testing.assert_allclose(got, expected, atol=1e-9)


def test_constant_spectra_have_no_spikes(spark):
    x = [[5.0] * 20, [5.0] * 19 + [900.0]]
    assert collect(signal.despike(frame(spark, x), threshold=1.0)) == x
    assert collect(signal.modified_z(frame(spark, x)), "z") == [[0.0] * 19] * 2


def test_window_of_spikes_only_gives_null(spark):
    got = collect(signal.despike(frame(spark, [[0, 1, 0, 9, 0, 9, 0, 1]]), ma=0, threshold=1.0, stats=(0.0, 1.0)))[0]
    assert got[3] is None and got[-1] == 1.0


def test_unknown_scope(spark):
    with pytest.raises(ValueError):
        signal.despike(frame(spark, [[1, 2]]), scope="batch")


@pytest.mark.parametrize("values", [
    [3.0], [1.0, 2.0], [1.0, 2.0, 2.0, 2.0, 9.0], [7.0] * 50 + [1.0, 2.0], [-1e9, 0.0, 0.1, 0.2, 1e9, 5e9],
    list(np.random.default_rng(1).normal(size=501)), list(np.random.default_rng(2).standard_cauchy(size=1000)),
    [0.0] * 500 + list(np.random.default_rng(3).normal(size=500))])
@pytest.mark.parametrize("pick_limit", [0, 20])
def test_exact_median(spark, values, pick_limit):
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(3)
    assert quantile.exact_median(df, F.col("v"), pick_limit) == np.median(values)


def test_exact_median_skips_missing_and_empty(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "v double")
    assert quantile.exact_median(df, F.col("v")) == 2.0
    assert quantile.exact_median(df.where("v < 0"), F.col("v")) is None


@pytest.mark.parametrize("pick_limit", [0, 10, 10_000])
def test_difference_stats(spark, pick_limit):
    x = random_spectra(20, 50, seed=5)
    d = np.diff(x, axis=1)
    median = np.median(d)
    got = quantile.difference_stats(frame(spark, x), pick_limit=pick_limit)
    assert got == (median, np.median(np.abs(d - median)))


def test_sort_keys_keep_the_order():
    values = np.array([-1e300, -2.0, -5e-324, -0.0, 0.0, 5e-324, 1.0, 1.5, 1e300])
    keys = quantile.sort_keys(values)
    assert (np.sort(keys) == keys).all() and keys[3] == keys[4]
    assert [quantile.key_value(int(k)) for k in keys] == list(values)


def test_savgol_keeps_polynomials_exactly(spark):
    t = np.arange(30) / 10
    cubic = 1 - 2 * t + 0.5 * t ** 2 + 3 * t ** 3
    got = collect(signal.smooth(frame(spark, [cubic]), 7, 3))[0]
    np.testing.assert_allclose(got, cubic, atol=1e-10)


def test_savgol_by_local_fits(spark):
    x = random_spectra(5, 25)
    got = np.array(collect(signal.smooth(frame(spark, x), 9, 2)))
    positions = np.arange(25)
    for k in range(5):
        for i in range(25):
            start = min(max(i - 4, 0), 25 - 9)
            window = positions[start:start + 9]
            fit = np.polyfit(window - i, x[k, window], 2)
            assert got[k, i] == pytest.approx(fit[-1], abs=1e-8)


def test_savgol_window_equal_to_length_and_errors(spark):
    assert len(collect(signal.smooth(frame(spark, [range(5)]), 5, 2))[0]) == 5
    for window, order in [(10, 2), (0, 0), (5, 5)]:
        with pytest.raises(ValueError):
            fit_matrix(window, order)
    with pytest.raises(ValueError):
        smooth_matrix(np.zeros((1, 4)), fit_matrix(5, 2))


def test_kernels_take_null_and_mixed_lengths(spark):
    rows = [list(range(12)), None, list(range(20)), list(range(12))]
    assert collect(signal.smooth(frame(spark, rows), 5, 2))[1] is None
    got = collect(signal.smooth(frame(spark, rows), 5, 1))
    np.testing.assert_allclose(got[2], rows[2], atol=1e-9)
    np.testing.assert_allclose(got[3], rows[3], atol=1e-9)


def test_normalize_edges(spark):
    x = [[3, 4], [0, 0], [0.0004, 0.0003], [float("nan"), 2.0]]
    got = collect(signal.normalize(frame(spark, x)))
    assert got[0] == pytest.approx([60.0, 80.0])
    assert got[1] == [0.0, 0.0]
    assert got[2] == pytest.approx([0.04, 0.03])
    assert np.isnan(got[3][0]) and got[3][1] == 200.0


def test_demean(spark):
    assert collect(signal.demean(frame(spark, [[1, 2, 6]]))) == [[-2.0, -1.0, 3.0]]


def dense_baseline(y, lam, order):
    penalty = np.diff(np.eye(len(y)), order, axis=0)
    penalty = lam * penalty.T @ penalty
    weights = np.ones(len(y))
    for _ in range(arpls.MAX_ITERATIONS + 1):
        z = np.linalg.solve(np.diag(weights) + penalty, weights * y)
        below = (y - z)[y - z < 0]
        if len(below) < 2:
            return z
        m, s = below.mean(), below.std(ddof=1)
        updated = 1 / (1 + np.exp(np.clip(2 * (y - z - (2 * s - m)) / s, -700, 700)))
        if np.linalg.norm(updated - weights) / np.linalg.norm(weights) < arpls.TOLERANCE:
            return z
        weights = updated
    return z


@pytest.mark.parametrize("order", [1, 2, 3])
def test_baseline_equals_dense_solver(order):
    rng = np.random.default_rng(order)
    t = np.linspace(0, 1, 120)
    y = 50 * t + rng.normal(0, 0.3, (6, 120)) + 30 * np.exp(-((t - 0.5) / 0.03) ** 2)
    got, _, _ = arpls.fit_baselines(y, 1e4, order)
    for k in range(6):
        np.testing.assert_allclose(got[k], dense_baseline(y[k], 1e4, order), atol=1e-4)


def test_baseline_recovers_a_slope(spark):
    t = np.linspace(0, 1, 200)
    truth = 100 + 40 * t
    rng = np.random.default_rng(0)
    y = truth + rng.normal(0, 0.2, 200) + 80 * np.exp(-((t - 0.4) / 0.02) ** 2)
    df = signal.correct_baseline(frame(spark, [y]), lam=1e4, return_baselines=True)
    row = df.collect()[0]
    assert row["converged"] and np.abs(np.array(row["baseline"]) - truth).max() < 2.0
    np.testing.assert_allclose(np.array(row["baseline"]) + row["intensities"], y, atol=1e-9)


def test_baseline_guard(spark):
    lam = 1000.0
    x = [[100.0] * 10, [100.1] * 10, [99.9] * 10, [-500.0] * 10]
    df = signal.correct_baseline(frame(spark, x), lam=lam, return_baselines=True)
    rows = df.orderBy("spectrum_id").collect()
    assert [r["iterations"] is not None for r in rows] == [False, True, False, True]
    assert rows[0]["intensities"] == x[0] and rows[0]["baseline"] == [0.0] * 10
    report = {r["corrected"]: r["n"] for r in signal.baseline_guard_report(frame(spark, x), lam).collect()}
    assert report == {True: 2, False: 2}
    assert "baseline" not in signal.correct_baseline(frame(spark, x), lam=lam).columns


def test_steps_in_any_order_and_unknown_step(spark):
    import itertools
    x = frame(spark, random_spectra(4, 30) + 100)
    steps = [("despike", {"threshold": 5}), ("smooth", {"window": 5}), ("baseline", {"lam": 10.0}), ("normalize", {})]
    for order in itertools.permutations(steps, 3):
        got = collect(signal.preprocess(x, order))
        assert all(len(row) == 30 for row in got)
    with pytest.raises(ValueError):
        signal.preprocess(x, [("sharpen", {})])


def test_default_steps_equal_single_steps(spark):
    x = frame(spark, (random_spectra(6, 40) + 50) * 1e4)
    chained = signal.normalize(signal.correct_baseline(signal.smooth(signal.despike(x))))
    np.testing.assert_allclose(collect(signal.preprocess(x)), collect(chained), atol=1e-9)
    np.testing.assert_allclose(np.linalg.norm(collect(chained), axis=1), 100.0)


def test_preview_uses_first_rows_only(spark):
    x = random_spectra(10, 30)
    got = signal.preview_steps(frame(spark, x), 3, [("despike", {"threshold": 6.0}), ("normalize", {})])
    np.testing.assert_allclose(collect(got, "despike"), spikes_by_definition(x[:3], 10, 6.0, "dataset"), atol=1e-9)
    assert got.columns == ["spectrum_id", "intensities", "despike", "normalize"]


def test_steps_add_no_shuffle(spark):
    x = frame(spark, random_spectra(4, 30))
    cleaned = signal.preprocess(x, [("despike", {"scope": "spectrum"}), ("smooth", {}), ("baseline", {}), ("normalize", {})])
    assert "Exchange" not in cleaned._jdf.queryExecution().executedPlan().toString()
