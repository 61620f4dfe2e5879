"""Tables that a job keeps between its steps, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from spectraloom.session import ensure_checkpoint_dir


class SharedTables:
    """Written tables cut lineage and survive lost executors. ``close`` deletes them; else they go with the session."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self.path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.files = self.path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.files.mkdirs(self.path)
        self.files.deleteOnExit(self.path)
        self.number = 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.number += 1
        folder = f"{self.root}/{self.number:03d}-{name}"
        df.write.parquet(folder)
        return self.spark.read.schema(df.schema).parquet(folder)

    def close(self) -> None:
        self.files.delete(self.path, True)
