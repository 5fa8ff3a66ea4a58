"""Point-in-time probes of addresses: frozen ones some days before their freeze, others before a time that gives them a like age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.sources.driver_tables import DAY

from .order import nearest, numbered

# Days before the mark, and the share of probes that are tested on.
HORIZONS = [7, 30, 90, 180]
TEST_SHARE = 0.30


def draw(address: Column, seed: int = 17) -> Column:
    """A number from an address: eight hex digits of its hash."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), address)), 1, 8), 16, 10).cast("long")


def age_matched(controls: DataFrame, positives: DataFrame, horizons: list[int] = HORIZONS, seed: int = 17) -> DataFrame:
    """controls (address, first_seen) with `mark`: of the positives' marks (address, first_seen, mark) the one nearest to the age of a positive drawn by hash.

    Only marks count before which the control was known for the shortest horizon; a control without one is
    left out. Each positive age (mark - first_seen) is as likely as any other.
    """
    ages = numbered(positives.select((F.col("mark") - F.col("first_seen")).alias("age")).where("age > 0"), ["age"], "nth")
    n = ages.count()
    if not n:
        return controls.withColumn("mark", F.lit(None).cast("long")).limit(0)
    asked = controls.where("first_seen is not null").withColumn("nth", draw(F.col("address"), seed) % n)
    asked = asked.join(ages, "nth").withColumns({"want": F.col("first_seen") + F.col("age"), "least": F.col("first_seen") + min(horizons) * DAY})
    found = nearest(asked, positives.select(F.col("mark").alias("value")).where("value is not null"), "want", "least")
    return found.where("mark is not null").select(*controls.columns, "mark")


def probes(positives: DataFrame, controls: DataFrame, covered: DataFrame, horizons: list[int] = HORIZONS, seed: int = 17, test_share: float = TEST_SHARE) -> DataFrame:
    """(address, label, event_time, mark, horizon, part) of positives (address, first_seen, mark) and controls (address, first_seen).

    A probe stands `horizon` days before its mark, after the address was first seen and, where its history was
    cut (covered: address, truncated, last_seen), not after its end. The latest marks are the test part: those
    from the quantile (interpolated) of all probes' marks on.
    """
    rows = positives.select("address", "first_seen", "mark", F.lit(1).alias("label")).unionByName(age_matched(controls, positives, horizons, seed).select("address", "first_seen", "mark", F.lit(0).alias("label")))
    rows = rows.join(covered.select("address", "truncated", "last_seen"), "address", "left")
    rows = rows.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons)))).withColumn("event_time", F.col("mark") - F.col("horizon").cast("long") * DAY)
    cut = F.coalesce("truncated", F.lit(False)) & (F.col("event_time") > F.col("last_seen"))
    rows = numbered(rows.where((F.col("event_time") > F.col("first_seen")) & ~F.coalesce(cut, F.lit(False))), ["mark"], "place")
    at = (rows.count() - 1) * (1 - test_share)
    low = int(at) if at > 0 else 0
    edge = rows.where(F.col("place").isin(low, low + 1)).agg(F.min(F.when(F.col("place") == low, F.col("mark"))).alias("a"), F.min(F.when(F.col("place") == low + 1, F.col("mark"))).alias("b")).first()
    bound = None if edge["a"] is None else edge["a"] + ((edge["b"] if edge["b"] is not None else edge["a"]) - edge["a"]) * (at - low)
    return rows.select("address", "label", "event_time", "mark", "horizon", F.when(F.col("mark") >= bound, "test").otherwise("train").alias("part"))
