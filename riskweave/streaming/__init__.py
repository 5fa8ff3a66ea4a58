"""Transfers and freezes as streams: micro-batches appended once, features from the stored warehouse, earliest freezes kept.

The trailing windows of a feature are relative to each event, so they are no tumbling windows: a
micro-batch of events is joined as of its times with the stored warehouse (`score_stream`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from riskweave.sources.driver_tables import DAY

KEYS = ["tx_hash", "to_address"]


def deduplicated(stream: DataFrame, keys: list[str] = KEYS, late: str = "2 days") -> DataFrame:
    """A stream of transfers without repeats among those at most `late` apart; block_time is epoch ms."""
    timed = stream.withColumn("arrived", F.timestamp_millis("block_time"))
    return timed.withWatermark("arrived", late).dropDuplicatesWithinWatermark(keys).drop("arrived")


def append_new(batch: DataFrame, warehouse: str, keys: list[str] = KEYS) -> None:
    """Append the rows of a micro-batch that the warehouse (a Parquet folder by `day`) does not have; running a batch again appends nothing.

    Rows of one key are taken to be at most a day apart, so that of the warehouse only the days around the
    batch's own are read.
    """
    spark = batch.sparkSession
    fresh = batch.dropDuplicates(keys).withColumn("day", F.floor(F.col("block_time") / DAY).cast("int"))
    days = fresh.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    if days["a"] is None and fresh.isEmpty():
        return
    try:
        known = spark.read.schema(fresh.schema).parquet(warehouse)
        if days["a"] is not None:
            known = known.where(F.col("day").between(days["a"] - 1, days["b"] + 1) | F.col("day").isNull())
        fresh = fresh.join(known.select(*keys), keys, "left_anti")
    except Exception as e:  # the first batch: there is no folder yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    fresh.write.mode("append").partitionBy("day").parquet(warehouse)


def ingest(stream: DataFrame, warehouse: str, checkpoint: str, keys: list[str] = KEYS) -> StreamingQuery:
    """Append what is there now, each transfer once however often it is delivered."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, _: append_new(batch, warehouse, keys)).start()


def score_stream(events: DataFrame, score: Callable[[DataFrame, DataFrame], DataFrame], warehouse: str, out: str, checkpoint: str) -> StreamingQuery:
    """Write score(events of a micro-batch, stored transfers) to a folder a batch, so that a repeated batch replaces its own rows."""

    def one(batch: DataFrame, number: int) -> None:
        stored = batch.sparkSession.read.parquet(warehouse)
        score(batch, stored).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(one).start()


def earliest_freezes(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """(address, block_time) of a stream of freezes with re-reads: the earliest of each address; for update or complete mode."""
    timed = stream.withColumn("seen", F.timestamp_millis("block_time")).withWatermark("seen", late)
    return timed.groupBy("address").agg(F.min("block_time").alias("block_time"))


def changed_freezes(stream: DataFrame) -> DataFrame:
    """(address, block_time, before) of a stream of freezes (address, block_time) whose overlap is read again and again: a row only when an address's earliest freeze is new or earlier than before.

    An address's state is its earliest freeze alone, so that repeats cost nothing further on and a late,
    earlier row still counts whenever it comes. Rows without an address or a time say nothing. For update mode.
    """

    def earlier(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else None
        first = min((int(b["block_time"].min()) for b in batches if len(b)), default=before)
        if first is not None and (before is None or first < before):
            state.update((first,))
            yield pd.DataFrame({"address": [key[0]], "block_time": [first], "before": pd.array([before], "Int64")})

    rows = stream.select("address", F.col("block_time").cast("long")).where("address is not null and block_time is not null")
    return rows.groupBy("address").applyInPandasWithState(earlier, "address string, block_time long, before long", "first long", "update", GroupStateTimeout.NoTimeout)


def keep_changes(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Write the changes of a stream of freezes, a folder a micro-batch, so that a repeated batch replaces its own; see earliest_of."""

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return changed_freezes(stream).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(one).start()


def earliest_of(spark: SparkSession, table: str) -> DataFrame:
    """(address, block_time) as the changes written so far leave it."""
    return spark.read.parquet(table).groupBy("address").agg(F.min("block_time").alias("block_time"))


def chain(spark: SparkSession, jobs: list[Callable[[SparkSession], StreamingQuery]]) -> None:
    """Run AvailableNow jobs in order, each after the one before has taken in all there was."""
    for job in jobs:
        job(spark).awaitTermination()
