"""Shared plumbing: table access and the folder in which intermediate tables survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that an operator turns into Python or numpy objects at once; a longer text is taken alone.
SLICE = 8_000_000


def slices(batch: pa.RecordBatch, column: int | str, limit: int = SLICE) -> Iterable[pa.RecordBatch]:
    """``batch`` in runs of rows whose ``column`` (strings or bytes) holds ``limit`` bytes at most, or of one row."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(sizes[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


def sliced(batches: Iterable[pa.RecordBatch], column: int | str) -> Iterable[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, column)


def texts_of(column: pa.Array) -> pa.Array:
    """Strings without nulls: a null is an empty text."""
    return pc.fill_null(column, "") if column.null_count else column


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``, read by Spark so that any file system it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which the driver and every executor can reach.

    Only a session in one JVM, as in tests, may go without the setting; it then gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="framelake-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def removed_at_exit(spark: SparkSession, path: str) -> str:
    """``path``, which Hadoop removes when the application ends."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def materialize(spark: SparkSession, df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back, which cuts its lineage.

    The files outlive any executor; Hadoop removes them when the application ends.
    """
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(removed_at_exit(spark, path))
