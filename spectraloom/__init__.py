"""Spectra-table analytics on Spark: ingest, label, clean, describe, split, train, evaluate, export."""

import sys

from pyspark import cloudpickle

# The kernels travel to the executors inside the jobs, so the package is needed on the driver only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
