"""The append-only log of predictions: its hash chain, what became of them, and rates by age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.sources.driver_tables import DAY

GENESIS = "0" * 64


def entry_hash(prev: Column, payload: Column) -> Column:
    """SHA-256 of the previous hash and the canonical payload."""
    return F.sha2(F.concat(prev, payload), 256)


def verify(log: DataFrame) -> DataFrame:
    """One row of a log (seq, prev, hash, payload): entries, first_bad (seq; null if none), problem (chain: it does not follow the one before; content: its hash is not its own), head.

    An entry is checked against its own payload and the hash of the one before it, which a join by seq
    brings: no window orders the log in one task. seq counts from 0 without gaps.
    """
    before = log.select((F.col("seq") + 1).alias("seq"), F.col("hash").alias("want"))
    rows = log.join(before, "seq", "left").withColumn("want", F.when(F.col("seq") == 0, GENESIS).otherwise(F.col("want")))
    unchained = ~F.col("prev").eqNullSafe(F.col("want"))
    changed = ~F.col("hash").eqNullSafe(entry_hash(F.col("prev"), F.col("payload")))
    bad = F.when(unchained, "chain").when(changed, "content")
    first = F.min(F.when(bad.isNotNull(), F.struct("seq", bad.alias("problem")))).alias("first")
    got = rows.agg(F.count("*").alias("entries"), first, F.max_by("hash", "seq").alias("head"))
    return got.select("entries", F.col("first.seq").alias("first_bad"), F.col("first.problem").alias("problem"), F.coalesce("head", F.lit(GENESIS)).alias("head"))


def resolve(predictions: DataFrame, freezes: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """predictions (address, predicted_at) that were frozen since: frozen_at (the earliest), lead_days, valid (predicted before it). Those already resolved are left out."""
    first = freezes.groupBy("address").agg(F.min("block_time").alias("frozen_at"))
    out = predictions.join(first, "address")
    if resolved is not None:
        out = out.join(resolved.select("address").distinct(), "address", "left_anti")
    lead = (F.col("frozen_at") - F.col("predicted_at")) / float(DAY)
    return out.withColumns({"lead_days": lead, "valid": lead > 0})


def report(predictions: DataFrame, resolutions: DataFrame, now: int) -> DataFrame:
    """(cohort, predictions, hits, rate, median_lead_days) by age; below 30 days there is no rate yet, later freezes may come."""
    hits = resolutions.where("valid").groupBy("address").agg(F.min("lead_days").alias("lead_days"))
    age = (F.lit(now) - F.col("predicted_at")) / float(DAY)
    rows = predictions.join(hits, "address", "left").withColumn("cohort", F.when(age >= 90, "90+").when(age >= 30, "30-90").otherwise("<30"))
    out = rows.groupBy("cohort").agg(F.count("*").alias("predictions"), F.count("lead_days").alias("hits"), F.median("lead_days").alias("median_lead_days"))
    return out.select("cohort", "predictions", "hits", F.when(F.col("cohort") != "<30", F.col("hits") / F.col("predictions")).alias("rate"), "median_lead_days")


def chained(rows: DataFrame, order: str, payload: str) -> DataFrame:
    """A log of these rows. Each hash needs the one before, so a chain is built in order by its writer: for appends of a bounded batch."""
    import hashlib

    log, prev = [], GENESIS
    for seq, r in enumerate(rows.select(payload).orderBy(order).collect()):
        own = hashlib.sha256((prev + r[0]).encode()).hexdigest()
        log.append((seq, prev, own, r[0]))
        prev = own
    return rows.sparkSession.createDataFrame(log, "seq long, prev string, hash string, payload string")
