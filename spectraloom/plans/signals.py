"""Registered queries on the signal steps. Every one runs over all spectra and all their points."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectraloom.functions.savgol import fit_matrix
from spectraloom.operators import quantile, signal
from spectraloom.plans import views
from spectraloom.plans.relational import query, rounded
from spectraloom.plans.views import SQL_POINTS

SPIKE_THRESHOLD = 3.0

SQL_DIFFERENCES = f"""{SQL_POINTS},
d AS (SELECT spectrum_id, idx, lead(x) OVER (PARTITION BY spectrum_id ORDER BY idx) - x AS d FROM points),
med AS (SELECT median(d) AS med FROM d WHERE d IS NOT NULL),
mad AS (SELECT med, median(abs(d - med)) AS mad FROM d CROSS JOIN med WHERE d IS NOT NULL GROUP BY med)"""


def _despiked(threshold: float, ma: int) -> str:
    """SQL for despiking the view ``points`` with data-set scope, as the view ``despiked``."""
    return f"""{SQL_DIFFERENCES},
s AS (SELECT p.spectrum_id, p.idx, p.x, coalesce(abs(CASE WHEN abs(mad) < 0.001 THEN 0
    ELSE 0.6745 * (d.d - med) / mad END) > {threshold}, FALSE) AS spike
  FROM points p JOIN d ON p.spectrum_id = d.spectrum_id AND p.idx = d.idx CROSS JOIN mad),
despiked AS (SELECT spectrum_id, idx, spike, CASE WHEN spike THEN avg(CASE WHEN NOT spike THEN x END) OVER (
    PARTITION BY spectrum_id ORDER BY idx ROWS BETWEEN {ma} PRECEDING AND {ma} FOLLOWING) ELSE x END AS x FROM s)"""


def _smoothed(source: str, window: int, polyorder: int) -> str:
    """SQL for smoothing the view ``source``, as the view ``smoothed``: weights as a table."""
    fit, half = fit_matrix(window, polyorder), window // 2
    rows = ", ".join(f"({i}, {j}, CAST('{float(fit[i, j])!r}' AS DOUBLE))"
                     for i in range(window) for j in range(window))
    return f"""w AS (SELECT * FROM (VALUES {rows}) t(i, j, c)),
n AS (SELECT spectrum_id, count(*) AS n FROM {source} GROUP BY spectrum_id),
a AS (SELECT p.spectrum_id, p.idx, CASE WHEN p.idx < {half} THEN p.idx WHEN p.idx >= n - {half}
    THEN p.idx - n + {window} ELSE {half} END AS i, least(greatest(p.idx - {half}, 0), n - {window}) AS start
  FROM {source} p JOIN n ON p.spectrum_id = n.spectrum_id),
smoothed AS (SELECT a.spectrum_id, a.idx, sum(w.c * p.x) AS x FROM a JOIN w ON w.i = a.i
  JOIN {source} p ON p.spectrum_id = a.spectrum_id AND p.idx = a.start + w.j GROUP BY a.spectrum_id, a.idx)"""


def _normalized(source: str) -> str:
    return f"""norms AS (SELECT spectrum_id, sqrt(sum(x * x)) AS norm FROM {source} GROUP BY spectrum_id),
normalized AS (SELECT p.spectrum_id, p.idx, p.x / CASE WHEN norm < 0.001 OR norm IS NULL THEN 1 ELSE norm END * 100 AS x
  FROM {source} p JOIN norms n ON p.spectrum_id = n.spectrum_id)"""


def _long(df, *columns):
    return signal.explode_points(df, columns).withColumns(rounded(*columns))


def _output(view: str) -> str:
    return f"SELECT spectrum_id, CAST(idx AS INTEGER) AS idx, round(x, 6) AS intensities FROM {view}"


@query(f"""
WITH {SQL_DIFFERENCES} SELECT spectrum_id, CAST(idx AS INTEGER) AS idx, round(d, 6) AS difference
FROM d WHERE d IS NOT NULL""")
def first_difference(spark, sf_dir):
    return _long(signal.first_difference(views.spectra(spark, sf_dir)), "difference")


@query(f"WITH {SQL_DIFFERENCES} SELECT round(med, 6) AS median, round(mad, 6) AS mad FROM mad")
def diff_median_mad(spark, sf_dir):
    median, mad = quantile.difference_stats(views.spectra(spark, sf_dir))
    return spark.range(1).select(F.round(F.lit(median), 6).alias("median"), F.round(F.lit(mad), 6).alias("mad"))


@query(f"""
WITH {SQL_DIFFERENCES} SELECT spectrum_id, CAST(idx AS INTEGER) AS idx, round(0.6745 * (d - med) / mad, 6) AS z
FROM d CROSS JOIN mad WHERE d IS NOT NULL""")
def modified_z(spark, sf_dir):
    return _long(signal.modified_z(views.spectra(spark, sf_dir)), "z")


@query(f"""
WITH {SQL_DIFFERENCES}, m AS (SELECT spectrum_id, median(d) AS m FROM d WHERE d IS NOT NULL GROUP BY spectrum_id),
q AS (SELECT d.spectrum_id, m, median(abs(d.d - m)) AS q FROM d JOIN m ON d.spectrum_id = m.spectrum_id
  WHERE d.d IS NOT NULL GROUP BY d.spectrum_id, m)
SELECT d.spectrum_id, CAST(idx AS INTEGER) AS idx, round(CASE WHEN abs(q) < 0.001 THEN 0 ELSE 0.6745 * (d - m) / q END, 6) AS z
FROM d JOIN q ON d.spectrum_id = q.spectrum_id WHERE d IS NOT NULL""")
def modified_z_per_spectrum(spark, sf_dir):
    return _long(signal.modified_z(views.spectra(spark, sf_dir), scope="spectrum"), "z")


@query(f"WITH {_despiked(SPIKE_THRESHOLD, 10)} {_output('despiked')}")
def despike(spark, sf_dir):
    return _long(signal.despike(views.spectra(spark, sf_dir), threshold=SPIKE_THRESHOLD), "intensities")


@query(f"WITH {SQL_POINTS}, {_smoothed('points', 11, 2)} {_output('smoothed')}")
def savgol(spark, sf_dir):
    return _long(signal.smooth(views.spectra(spark, sf_dir)), "intensities")


@query(f"""
WITH {SQL_POINTS}, m AS (SELECT spectrum_id, avg(x) AS mean FROM points GROUP BY spectrum_id)
SELECT p.spectrum_id, CAST(idx AS INTEGER) AS idx, round(x - mean, 6) AS intensities
FROM points p JOIN m ON p.spectrum_id = m.spectrum_id""")
def demean(spark, sf_dir):
    return _long(signal.demean(views.spectra(spark, sf_dir)), "intensities")


@query(f"WITH {SQL_POINTS}, {_normalized('points')} {_output('normalized')}")
def l2_normalize(spark, sf_dir):
    return _long(signal.normalize(views.spectra(spark, sf_dir)), "intensities")


@query(f"""
WITH {SQL_POINTS}, s AS (SELECT spectrum_id, sum(x) AS total FROM points GROUP BY spectrum_id)
SELECT abs(total) > 1000000 AS corrected, count(*) AS n, round(min(total), 4) AS min_sum, round(max(total), 4) AS max_sum
FROM s GROUP BY abs(total) > 1000000""")
def baseline_guard_report(spark, sf_dir):
    report = signal.baseline_guard_report(views.spectra(spark, sf_dir))
    return report.withColumns({c: F.round(F.col(c), 4) for c in ("min_sum", "max_sum")})


@query()
def baseline_correct(spark, sf_dir):
    """Iterative fit, no SQL form; checked in tests against a dense solver."""
    corrected = signal.correct_baseline(views.spectra(spark, sf_dir), return_baselines=True)
    return signal.explode_points(corrected, ["intensities", "baseline"], ["spectrum_id", "iterations", "converged"])


@query()
def preprocess_default(spark, sf_dir):
    return _long(signal.preprocess(views.spectra(spark, sf_dir)), "intensities")


@query(f"""
WITH {_despiked(SPIKE_THRESHOLD, 7)}, {_smoothed('despiked', 9, 3)}, {_normalized('smoothed')} {_output('normalized')}""")
def preprocess_subset(spark, sf_dir):
    steps = [("despike", {"threshold": SPIKE_THRESHOLD, "ma": 7}), ("smooth", {"window": 9, "polyorder": 3}),
             ("normalize", {})]
    return _long(signal.preprocess(views.spectra(spark, sf_dir), steps), "intensities")


@query(f"""
WITH first_ids AS (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 6),
{_despiked(SPIKE_THRESHOLD, 11).replace('FROM embeddings)', 'FROM embeddings WHERE vec_id IN (SELECT vec_id FROM first_ids))')},
{_smoothed('despiked', 9, 2)}, {_normalized('smoothed')}
SELECT d.spectrum_id, CAST(d.idx AS INTEGER) AS idx, round(p.x, 6) AS intensities, round(d.x, 6) AS despike,
       round(s.x, 6) AS smooth, round(n.x, 6) AS normalize
FROM despiked d JOIN points p ON d.spectrum_id = p.spectrum_id AND d.idx = p.idx
JOIN smoothed s ON d.spectrum_id = s.spectrum_id AND d.idx = s.idx
JOIN normalized n ON d.spectrum_id = n.spectrum_id AND d.idx = n.idx""")
def preview_steps(spark, sf_dir):
    steps = [("despike", {"threshold": SPIKE_THRESHOLD, "ma": 11}), ("smooth", {"window": 9}), ("normalize", {})]
    preview = signal.preview_steps(views.spectra(spark, sf_dir), 6, steps)
    return _long(preview, "intensities", "despike", "smooth", "normalize")
