"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch: a task holds a few of them on either side of its Python worker.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that long texts do not decide a worker's memory; a session's own smaller bound stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, "67108864", "64MB", "64m", "67108864b"):
        spark.conf.set(key, str(BATCH_BYTES))


def release() -> None:
    """Hand memory that is free back to the system: Python workers are reused, and a stage's peak would stay with all of them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not with this C library


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, releasing memory at the end of its task."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return inner


def slices(batch: pa.RecordBatch, column: int, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows of a batch with about `limit` bytes of text in a column."""
    size = np.cumsum([0, *(x or 0 for x in pa.compute.binary_length(batch.column(column)).to_pylist())])
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(size, size[a] + limit, side="right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where it is unset (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        path = f"{tempfile.gettempdir()}/riskweave-checkpoints"
        spark.sparkContext.setCheckpointDir(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write a table below the shared folder and read it back."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/riskweave/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pow2_at_least(x: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(1.0, x)))))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts: the scale from which partition and shard counts follow."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("b")).first()["b"])


def spare_name(columns: list[str], name: str) -> str:
    """`name`, or a longer one that none of the columns has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
