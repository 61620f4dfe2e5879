"""Session helpers. Nothing here overrides a value the cluster already set."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

LOCAL_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.driver.memory": "8g",
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.session.timeZone": "UTC",
    # one Arrow batch holds a few MB of signal, whatever the number of points per spectrum
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def local_session(cpus: int | str = 8, app: str = "spectraloom", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; on a cluster use the session you are given."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in {**LOCAL_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for ``DataFrame.checkpoint``.

    The folder in ``spark.checkpoint.dir`` is shared by all executors, so a lost one loses nothing.
    A machine-local folder is made only for ``local[...]`` masters that name none.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="spectraloom-checkpoint-")
    context.setCheckpointDir(folder)
    return folder
