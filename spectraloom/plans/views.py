"""Stand-in tables: spectra, metadata, predictions, probabilities and a training log derived from the
test tables. Every view is a projection of one table, so it grows with it and adds no shuffle.

The SQL text next to each view says the same for the checking engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spectraloom.operators.labels import label_name
from spectraloom.schema import SPECIES_10

COUNTS = 1e6          # embedding components are read as detector counts in millions
ITERATIONS_PER_EPOCH = 400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = F.transform("embedding", lambda v: v.cast("double") * COUNTS)
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("spectrum_id"), "label", points.alias("intensities"))


def _remainder(column: str, n: int) -> Column:
    return F.col(column) % n


def metadata_columns() -> dict[str, Column]:
    name = label_name(F.col("label"), SPECIES_10)
    partner = F.when(_remainder("label", 2) == 0, "brevis").otherwise("grayi")
    return {
        "spectrum_id": F.col("vec_id"),
        "class_id": F.col("label"),
        "name": name,
        "species": F.when(_remainder("vec_id", 4) != 0, name),
        "pcr": F.concat_ws("+", name, partner),
        "culture": F.concat(name, F.lit("-"), _remainder("vec_id", 7).cast("string")),
        "measurement": F.concat(F.lit("m"), _remainder("vec_id", 5).cast("string")),
        "filename": F.concat(F.lit("f"), F.col("vec_id").cast("string"), F.lit(".txt")),
        "sample": _remainder("vec_id", 40),
        "source": F.concat(F.lit("src"), _remainder("vec_id", 3).cast("string")),
    }


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        *[c.alias(name) for name, c in metadata_columns().items()])


def labelled_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra with their metadata in one row (the table a finished ingest writes)."""
    points = F.transform("embedding", lambda v: v.cast("double") * COUNTS)
    return table(spark, sf_dir, "embeddings").select(
        *[c.alias(name) for name, c in metadata_columns().items()], points.alias("intensities"))


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    y_pred = F.when(_remainder("vec_id", 7) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("spectrum_id"), F.col("label").alias("y"),
        _remainder("vec_id", 5).alias("fold"), y_pred.alias("y_pred"))


def probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four labels per spectrum as arrays of targets and probabilities, probability 0 included."""
    labels = F.array(*[F.lit(k) for k in range(4)])
    target = lambda k: ((F.col("label") % 4 == k) | (F.col("vec_id") % 6 == k)).cast("int")
    probability = lambda k: ((F.col("vec_id") * 37 + k * 11) % 101).cast("double") / 101
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("spectrum_id"), F.transform(labels, target).alias("targets"),
        F.transform(labels, probability).alias("probabilities"))


def train_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as training iterations, a fixed number per epoch."""
    return table(spark, sf_dir, "events").select(
        F.floor(F.col("event_id") / ITERATIONS_PER_EPOCH).alias("epoch"),
        (F.col("event_id") % ITERATIONS_PER_EPOCH).alias("iter"), F.col("event_id").alias("total_iter"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("timestamp"), F.col("value").alias("loss"))


SQL_META = """meta AS (
  SELECT vec_id AS spectrum_id, label AS class_id, name,
         CASE WHEN vec_id % 4 <> 0 THEN name END AS species,
         name || '+' || CASE WHEN label % 2 = 0 THEN 'brevis' ELSE 'grayi' END AS pcr,
         name || '-' || CAST(vec_id % 7 AS VARCHAR) AS culture,
         'm' || CAST(vec_id % 5 AS VARCHAR) AS measurement,
         'f' || CAST(vec_id AS VARCHAR) || '.txt' AS filename,
         vec_id % 40 AS sample, 'src' || CAST(vec_id % 3 AS VARCHAR) AS source
  FROM (SELECT vec_id, label,
          CASE label WHEN 0 THEN 'casei' WHEN 1 THEN 'rossiae' WHEN 2 THEN 'plantarum' WHEN 3 THEN 'buchneri'
                     WHEN 4 THEN 'lindneri' WHEN 5 THEN 'brevis' WHEN 6 THEN 'ecoli' WHEN 7 THEN 'grayi'
                     WHEN 8 THEN 'innocua' WHEN 9 THEN 'pectinatus' END AS name
        FROM embeddings) t)"""

SQL_POINTS = """points AS (
  SELECT vec_id AS spectrum_id, label, unnest(range(len(embedding))) AS idx,
         CAST(unnest(embedding) AS DOUBLE) * CAST(1000000 AS DOUBLE) AS x
  FROM embeddings)"""

SQL_PREDS = """preds AS (
  SELECT vec_id AS spectrum_id, label AS y, vec_id % 5 AS fold,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS y_pred
  FROM embeddings)"""

SQL_PROBS = """probs AS (
  SELECT vec_id AS spectrum_id, k, CASE WHEN label % 4 = k OR vec_id % 6 = k THEN 1 ELSE 0 END AS y,
         CAST((vec_id * 37 + k * 11) % 101 AS DOUBLE) / 101 AS p
  FROM (SELECT vec_id, label, unnest(range(4)) AS k FROM embeddings) t)"""

SQL_LOG = f"""train_log AS (
  SELECT event_id // {ITERATIONS_PER_EPOCH} AS epoch, event_id % {ITERATIONS_PER_EPOCH} AS iter,
         event_id AS total_iter, epoch_us(ts) AS ts_us, value AS loss
  FROM events)"""
