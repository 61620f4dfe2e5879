"""Jobs run where the package is not installed: workers started from another folder cannot import it."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as entry_module
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
for name in ("savgol", "diff_median_mad", "baseline_correct", "clf_perceptron", "clf_svm"):
    print(name, entry_module.queries()[name](spark, {sf_dir!r}).count())
"""


def test_queries_run_from_another_folder(tmp_path, sf_dir):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo, sf_dir=sf_dir)], cwd=tmp_path,
                          env=environment, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert [line.split()[1] for line in done.stdout.splitlines()] == ["32000", "1", "32000", "500", "500"]
