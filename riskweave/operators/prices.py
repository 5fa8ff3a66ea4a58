"""Prices as of a moment: the last candle that had closed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY_SECONDS = 86_400


def price_as_of(rows: DataFrame, candles: DataFrame, time: str = "block_time") -> DataFrame:
    """rows with `price`: the close of the last candle (day: epoch seconds at its start) that ended by then; null before the first.

    Candles become spans [closed, next closed) and rows look theirs up by day number, so nothing is ordered
    with the rows; a series without gaps needs one row a day, and the days of the calendar are sent everywhere,
    so that rows are not shuffled.
    """
    spans = candles.groupBy("day").agg(F.max("close").alias("close"))
    after = F.lead("day").over(Window.orderBy("day"))  # a row a day
    spans = spans.withColumn("next", F.coalesce(after, F.lit(4_102_444_800)))
    days = spans.select(F.explode(F.sequence(F.expr(f"day div {DAY_SECONDS} + 1"), F.expr(f"next div {DAY_SECONDS}"))).alias("on"), F.col("close").alias("price"))
    return rows.withColumn("on", F.expr(f"{time} div 1000 div {DAY_SECONDS}")).join(F.broadcast(days), "on", "left").drop("on")
