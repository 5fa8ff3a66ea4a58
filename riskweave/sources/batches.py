"""A table that grows by whole batches: what a run wrote is kept if it ended, and nothing of it otherwise.

A batch is written beside the table and moved into it when its files are complete, by one rename. A batch
that is there already is not written again, so that an interrupted job is run again as a whole. Any store
that Spark writes will do whose renames are atomic.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators.legs import dedupe


def _store(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(folder).getFileSystem(spark._jsc.hadoopConfiguration())


def committed(spark: SparkSession, folder: str) -> list[str]:
    """Names of the batches that are complete."""
    path, fs = _store(spark, folder)
    if not fs.exists(path(folder)):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(path(folder)) if x.isDirectory()]
    return sorted(n.removeprefix("batch=") for n in names if n.startswith("batch=") and fs.exists(path(f"{folder}/{n}/_SUCCESS")))


def append_batch(df: DataFrame, folder: str, batch: str) -> bool:
    """Write df as a batch of the table in folder; False, and nothing done, if it has that batch."""
    if not re.fullmatch(r"[\w.-]+", batch):
        raise ValueError("a batch is named by letters, digits, dots and dashes")
    spark = df.sparkSession
    path, fs = _store(spark, folder)
    target = path(f"{folder}/batch={batch}")
    if batch in committed(spark, folder):
        return False
    staged = path(f"{folder}/_staged/{batch}-{uuid.uuid4().hex}")
    try:
        df.write.parquet(str(staged.toString()))
        if fs.exists(target):  # another run of the batch was first
            return False
        fs.mkdirs(path(folder))
        return bool(fs.rename(staged, target))
    finally:
        fs.delete(staged, True)


def read_batches(spark: SparkSession, folder: str, schema: str, keys: list[str] | None = None) -> DataFrame:
    """The table of all complete batches, empty where there is none; with keys, a row a key (the smallest whole row)."""
    names = committed(spark, folder)
    if not names:
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema).parquet(*(f"{folder}/batch={n}" for n in names))
    return dedupe(df, keys) if keys else df


def append_in_batches(todo: DataFrame, key: str, make, folder: str, batches: int, prefix: str = "b") -> int:
    """Of the rows of todo, in `batches` parts by a hash of the key, write make(part) for each part that the table lacks; how many were written."""
    part = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(batches))
    return sum(append_batch(make(todo.where(part == i)), folder, f"{prefix}{i:05}-of-{batches:05}") for i in range(batches))
