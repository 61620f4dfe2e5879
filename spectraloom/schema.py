"""Table schemas and fixed values."""

from __future__ import annotations

from pyspark.sql import types as T

# One row per spectrum. The points stay in one array cell: no shuffle is needed to see a whole signal,
# and queries on metadata never read them.
SPECTRA = T.StructType([
    T.StructField("spectrum_id", T.StringType(), False),
    T.StructField("wavenumbers", T.ArrayType(T.DoubleType()), True),
    T.StructField("intensities", T.ArrayType(T.DoubleType()), True),
])

METADATA = T.StructType([
    T.StructField("growth_time", T.StringType()),
    T.StructField("substrate", T.StringType()),
    T.StructField("strain", T.StringType()),
    T.StructField("measurement", T.StringType()),
    T.StructField("filename", T.StringType()),
    T.StructField("spectrum_id", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("species", T.StringType()),
    T.StructField("pcr", T.StringType()),
    T.StructField("sample", T.StringType()),
])

TRAIN_LOG = T.StructType([
    T.StructField("epoch", T.LongType()),
    T.StructField("iter", T.LongType()),
    T.StructField("total_iter", T.LongType()),
    T.StructField("timestamp", T.DoubleType()),
    T.StructField("loss", T.DoubleType()),
    T.StructField("acc", T.DoubleType()),
    T.StructField("time_dataloading", T.DoubleType()),
    T.StructField("time_processing", T.DoubleType()),
    T.StructField("iter_time", T.DoubleType()),
])

# Class lists and method names that results are keyed by.
SPECIES_5 = ["casei", "rossiae", "plantarum", "buchneri", "lindneri"]
SPECIES_9 = ["casei", "rossiae", "plantarum", "lindneri",
             "brevis", "ecoli", "grayi", "innocua", "pectinatus"]
SPECIES_10 = ["casei", "rossiae", "plantarum", "buchneri", "lindneri",
              "brevis", "ecoli", "grayi", "innocua", "pectinatus"]

METHOD_SVM = "Support Vector Machine"
METHOD_RANDOM_FOREST = "Random Forest"
METHOD_LOGISTIC_REGRESSION = "Logistic Regression"
METHOD_PERCEPTRON = "Perceptron"
METHOD_BOOSTING = "Boosting"
