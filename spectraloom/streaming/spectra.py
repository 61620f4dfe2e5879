"""The same cleaning steps on spectra that keep arriving.

Steps that look at one row at a time run unchanged on a stream (``clean_stream``). Despiking against a whole data set
needs its statistics: either those of stored spectra, passed as ``stats``, or those of all spectra so far
(``clean_so_far``), kept as a mergeable quantile sketch of the differences from micro-batch to micro-batch.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from spectraloom.functions import arrays
from spectraloom.operators.signal import preprocess
from spectraloom.schema import SPECTRA

SKETCH = 4096           # size of the quantile sketch; its ranks are off by about 0.1 % of the values
RANKS = 4001            # read from a sketch to find the median and the median deviation
RANK_ERROR = 0.005      # of median and deviation, stated with room to spare


def read_spectra_stream(spark: SparkSession, folder: str, schema: StructType = SPECTRA) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def clean_stream(stream: DataFrame, steps: Sequence[tuple[str, dict]]) -> DataFrame:
    for name, params in steps:
        if needs_stats(name, params):
            raise ValueError("despiking a stream needs scope='spectrum', the stats of the stored spectra, or clean_so_far")
    return preprocess(stream, steps)


def write_spectra_stream(stream: DataFrame, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append to Parquet, each row exactly once; the checkpoint folder must be on shared storage."""
    writer = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def needs_stats(name: str, params: dict) -> bool:
    return name == "despike" and params.get("scope") != "spectrum" and "stats" not in params


def difference_sketch(df: DataFrame, intensities: str = "intensities") -> DataFrame:
    """One row (sketch, n): the finite first differences of all spectra, summed up before the shuffle."""
    differences = df.select(F.explode(arrays.first_difference(F.col(intensities))).alias("d"))
    finite = differences.where(F.col("d").isNotNull() & ~F.isnan("d") & (F.abs("d") < float("inf")))
    return finite.agg(F.kll_sketch_agg_double("d", F.lit(SKETCH)).alias("sketch"), F.count("*").alias("n"))


def spread_of(sketches: DataFrame) -> tuple[float | None, float | None]:
    """Median and median absolute deviation from a row (sketch, n), each within RANK_ERROR of its rank."""
    ranks = F.array(*[F.lit((i + 0.5) / RANKS) for i in range(RANKS)])
    row = sketches.where("n > 0").select(F.kll_sketch_get_quantile_double("sketch", ranks).alias("q")).first()
    if row is None:
        return None, None
    values = np.array(row["q"])
    median = float(np.median(values))
    return median, float(np.median(np.abs(values - median)))


class DifferencesSoFar:
    """The sketch after every micro-batch, one small table each, so a batch that runs again finds what was before it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def read(self, batch: int) -> DataFrame:
        return self.spark.read.schema("sketch binary, n long").parquet(f"{self.folder}/batch={batch}")

    def add(self, batch: int, df: DataFrame, intensities: str) -> DataFrame:
        new = difference_sketch(df, intensities)
        if batch:
            both = self.read(batch - 1).union(new).where("n > 0")
            new = both.agg(F.kll_merge_agg_double("sketch", F.lit(SKETCH)).alias("sketch"), F.sum("n").alias("n"))
            new = new.withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
        new.write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")
        return self.read(batch)


def clean_so_far(stream: DataFrame, steps: Sequence[tuple[str, dict]], folder: str, state: str, checkpoint: str,
                 intensities: str = "intensities", available_now: bool = True) -> StreamingQuery:
    """Clean each micro-batch against the differences of all spectra up to and with it.

    Rows go to ``folder/batch=<number>``, sketches to ``state/batch=<number>``. Both are written over when a batch runs
    again after a failure, so every row is there once. The folders and the checkpoint must be on shared storage. The
    ``stats`` of the last batch are those of the whole stream (``spread_of(DifferencesSoFar(...).read(number))``).
    """
    so_far = DifferencesSoFar(stream.sparkSession, state)

    def take(batch_rows: DataFrame, number: int) -> None:
        rows = batch_rows.persist()
        try:
            stats = spread_of(so_far.add(number, rows, intensities))
            known = [(name, {**params, "stats": stats} if needs_stats(name, params) else params) for name, params in steps]
            cleaned = preprocess(rows, known if stats[0] is not None else [s for s in known if s[0] != "despike"], intensities)
            cleaned.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={number}")
        finally:
            rows.unpersist()

    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
