"""Tables written in the folder that all executors share, to cut a lineage or to read a result more than once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOOKED_UP = 1 << 19  #: rows of a table sent everywhere
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  #: lets Spark drop what a query shuffled when it ends


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """What is shuffled for the jobs in here is dropped as each of them ends, not whenever the driver's memory is next cleared."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)


def written(df: DataFrame) -> DataFrame:
    """df, written below spark.checkpoint.dir and read back. Where no such folder is set (tests on one machine), one is set for the session."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="riskweave-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder}/riskweave/{uuid.uuid4().hex}"
    with freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def forget(table: DataFrame) -> None:
    """Delete a written table that nothing reads any more."""
    jvm, context = table.sparkSession._jvm, table.sparkSession.sparkContext._jsc
    path = jvm.org.apache.hadoop.fs.Path(table._written)
    path.getFileSystem(context.hadoopConfiguration()).delete(path, True)


def sent(table: DataFrame, most: int = LOOKED_UP) -> DataFrame:
    """A table, written, that a join sends everywhere if it is small."""
    held = written(table)
    return F.broadcast(held) if held.count() <= most else held
