"""Helpers shared by the operators: tables in the shared folder, text bytes of Arrow batches, checked broadcasts."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from spectraloom.session import ensure_checkpoint_dir

SLICE_BYTES = 512 << 10   # text that one numpy pass looks at; a longer text is a slice of its own
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of megabytes: sizes are looked at from the first row on, not from the hundredth, and a reader holds one group.
SMALL_GROUPS = {"parquet.block.size": str(8 << 20), "parquet.block.size.row.check.min": "1",
                "parquet.page.size.row.check.min": "1"}
BROADCAST_ROWS = 300_000  # of two or three numbers each: a few MB


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Intermediate tables in the folder that all executors share (``spark.checkpoint.dir``).

    A written table cuts lineage and survives lost executors. The folder goes when the session's JVM ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
        self.root = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        self.number = 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        return self.read(self.write(df, name), df)

    def read(self, path: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(path)

    def write(self, df: DataFrame, name: str, **options: str) -> str:
        self.number += 1
        path = f"{self.root}/{self.number:03d}-{name}"
        df.write.options(**options).parquet(path)
        return path

    def keep_lean(self, df: DataFrame, name: str) -> DataFrame:
        """Compressed further, in row groups of a few MB, and the shuffle files of the write go with its end instead of the driver's garbage."""
        before = self.spark.conf.get(CLEAN_SHUFFLES, None)
        self.spark.conf.set(CLEAN_SHUFFLES, "true")
        try:
            path = self.write(df, name, compression="zstd", **SMALL_GROUPS)
        finally:
            if before is None:
                self.spark.conf.unset(CLEAN_SHUFFLES)
            else:
                self.spark.conf.set(CLEAN_SHUFFLES, before)
        return self.read(path, df)

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing reads any more."""
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if not folder.split(":", 1)[-1].lstrip("/").startswith(self.root.split(":", 1)[-1].lstrip("/")):
                raise ValueError(f"{folder} is not a table of this folder")
            path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a written table for broadcast if it has at most ``limit`` rows; else leave the join to a shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


class Generations:
    """A table of bounded bytes that keeps what is used: a full young generation becomes the old one."""

    def __init__(self, limit: int):
        self.limit, self.size, self.young, self.old = limit, 0, {}, {}

    def renew(self) -> None:
        """Between batches, so that all that a batch has found or put is in the young generation."""
        if self.size >= self.limit:
            self.old, self.young, self.size = self.young, {}, 0

    def missing(self, keys, size) -> list:
        """Positions of the keys that are not known; those of the old generation come back, ``size(value)`` bytes each."""
        young, old, found = self.young, self.old, []
        for i, key in enumerate(keys):
            if key in young:
                continue
            value = old.get(key)
            if value is None:
                found.append(i)
            else:
                self.put(key, value, size(value))
        return found

    def put(self, key, value, size: int) -> None:
        self.young[key] = value
        self.size += size


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and all UTF-8 bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        width = np.int64
    else:
        width = np.int32
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, width)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return offsets - offsets[0], np.zeros(0, np.uint8)
    return offsets - offsets[0], np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions start, start + 1, ... of all spans."""
    stops = np.cumsum(lengths)
    return np.arange(int(stops[-1]) if len(stops) else 0) + np.repeat(starts - (stops - lengths), lengths)


def grown(array: np.ndarray, n: int) -> np.ndarray:
    """The array with room for n numbers."""
    return array if n <= len(array) else np.concatenate(
        [array, np.zeros(max(n, 3 * len(array) // 2) - len(array), array.dtype)])


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges of about ``limit`` bytes each, at least one row."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        stop = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        stop = min(max(stop, row + 1), rows)
        yield row, stop
        row = stop
    release()


def release() -> None:
    """Hand freed memory back: a Python worker lives on between stages and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def total_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of text in all rows: sizes the number of buckets."""
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
