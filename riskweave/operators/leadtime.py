"""Lead time before a freeze, what it is worth in payments, and reports of scored addresses.

Reports start from counts per distinct value or from one row per address. Tables of probes, thresholds
and rates that are broadcast have a row per horizon, budget or bin.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .labels import cut, hash_order
from .metrics import by_score, cumulated, ranking_metrics

DAY = 86_400_000
AGE_MARKS = [7, 30, 90, 365, 1095]


def at_ranks(rows: DataFrame, column: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """One row: n, and per name the value at a zero-based ascending rank, given as a function of n. Nulls take no part; without values n is 0 and the rest null."""
    runs = cumulated(by_score(rows.select(F.lit(1).alias("one"), F.col(column).alias("value")), "one", "value"))
    n, upto = F.col("n"), F.col("n") - F.col("tp") + F.col("pos")
    found = (F.min(F.when(upto > rank(n), F.col("score"))).alias(name) for name, rank in ranks.items())
    return runs.crossJoin(F.broadcast(runs.agg(F.sum("pos").alias("n")))).agg(F.coalesce(F.max(n), F.lit(0)).alias("n"), *found)


MIDDLE = {"lower": lambda n: F.floor((n - 1) / 2), "upper": lambda n: F.ceil((n - 1) / 2)}


def median(rows: DataFrame, column: str, name: str) -> DataFrame:
    """One row: n and the median, the mean of the two middle values of an even number."""
    return at_ranks(rows, column, MIDDLE).select("n", ((F.col("lower") + F.col("upper")) / 2).alias(name))


def probes(frozen: DataFrame, spans: DataFrame, horizons: list[int]) -> DataFrame:
    """(address, horizon, frozen_at, t) for each horizon in days before a freeze at which the address existed and, if its history is cut off, was still inside it."""
    rows = frozen.join(spans, "address").withColumn("horizon", F.explode(F.array(*(F.lit(h) for h in horizons))))
    rows = rows.withColumn("t", F.col("frozen_at") - F.col("horizon").cast("long") * DAY)
    unseen = F.coalesce(F.col("truncated"), F.lit(False)) & (F.col("t") > F.col("last_seen"))
    return rows.where((F.col("t") > F.col("first_seen")) & ~unseen).select("address", "horizon", "frozen_at", "t")


def lead_times(scored: DataFrame, threshold: float) -> DataFrame:
    """Per address: the furthest horizon at which it was flagged (null: never) and whether it ever was."""
    hit = F.col("score") >= threshold
    return scored.groupBy("address").agg(F.max(F.when(hit, F.col("horizon"))).alias("lead_days"), F.coalesce(F.bool_or(hit), F.lit(False)).alias("ever_high"))


def lead_report(leads: DataFrame) -> DataFrame:
    """One row: addresses, flagged ones, their rate, and the lead's median, quartiles (value at the nearest rank) and maximum."""
    rank = lambda q: lambda n: F.floor(F.lit(q) * (n - 1) + 0.5)
    days = at_ranks(leads, "lead_days", MIDDLE | {"p25": rank(0.25), "p75": rank(0.75), "most": lambda n: n - 1})
    every = leads.agg(F.count("*").alias("addresses"), F.count_if("ever_high").alias("flagged"))
    rate = F.when(F.col("addresses") > 0, F.col("flagged") / F.col("addresses"))
    return every.crossJoin(F.broadcast(days)).select("addresses", "flagged", rate.alias("rate"), ((F.col("lower") + F.col("upper")) / 2).alias("median"), "p25", "p75", "most")


def horizon_rates(scored: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Per horizon: probes and the share at or above each threshold."""
    return scored.groupBy("horizon").agg(F.count("*").alias("n"), *(F.avg((F.col("score") >= t).cast("double")).alias(name) for name, t in thresholds.items()))


def payments_in_window(transfers: DataFrame, probed: DataFrame) -> DataFrame:
    """Transfers to a probed address after its probe and up to its freeze, with the probe's score."""
    during = (F.col("block_time") > F.col("t")) & (F.col("block_time") <= F.col("frozen_at"))
    return transfers.withColumnRenamed("to_address", "address").join(probed, "address").where(during)


def payment_recall(probed: DataFrame, payments: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, addresses, payments, address_recall, payment_recall); payments are counted per address before they meet the thresholds."""
    paid = payments.groupBy("address", "t").agg(F.count("*").alias("paid"))
    rows = probed.join(paid, ["address", "t"], "left").withColumns({"paid": F.coalesce("paid", F.lit(0)), "threshold": F.explode(F.array(*(F.lit(float(t)) for t in thresholds)))})
    hit = F.col("score") >= F.col("threshold")
    out = rows.groupBy("threshold").agg(F.count("*").alias("addresses"), F.sum("paid").alias("payments"), F.count_if(hit).alias("a"), F.coalesce(F.sum(F.when(hit, F.col("paid"))), F.lit(0)).alias("p"))
    of = lambda x, n: F.col(x) / F.greatest(F.col(n), F.lit(1))
    return out.select("threshold", "addresses", "payments", of("a", "addresses").alias("address_recall"), of("p", "payments").alias("payment_recall"))


def unseen_freezes(freezes: DataFrame, known: list[DataFrame], snapshot: int) -> DataFrame:
    """(address, frozen_at): the earliest freeze after the snapshot of addresses in none of the known ones (each with one column)."""
    late = freezes.where(F.col("address").isNotNull() & (F.col("frozen_at") > snapshot)).groupBy("address").agg(F.min("frozen_at").alias("frozen_at"))
    for k in known:
        late = late.join(k.toDF("address"), "address", "left_anti")
    return late


def hash_head(rows: DataFrame, group: str, need: DataFrame, key: str = "event_id", seed: int = 17) -> DataFrame:
    """The first `need` rows of each group in hash order. Counts per 1/4096 of the hashes tell which part completes a group, so that no group (there are few) is ordered in one task."""
    keyed = rows.join(F.broadcast(need), group).withColumn("_order", hash_order(F.col(key), seed=seed)).withColumn("_part", F.substring("_order", 1, 3))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = keyed.groupBy(group, "_part").count().select(group, "_part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(group, "_part").orderBy("_order", key))
    near = keyed.join(F.broadcast(before), [group, "_part"]).where("_before < need").withColumn("_place", place)
    return near.where("_before + _place <= need").drop("need", "_order", "_part", "_before", "_place")


def age_balanced(rows: DataFrame, age: str, ratio: int = 3, seed: int = 17) -> DataFrame:
    """All positives, and of the controls of each age bin that holds positives up to `ratio` a positive in hash order; with `age_bin`."""
    binned = rows.withColumn("age_bin", cut(F.coalesce(F.col(age).cast("double"), F.lit(0.0)), AGE_MARKS, "b"))
    pos = binned.where("label = 1")
    need = pos.groupBy("age_bin").agg((F.count("*") * ratio).alias("need"))
    return pos.unionByName(hash_head(binned.where("label = 0"), "age_bin", need, seed=seed).select(*pos.columns))


def prevalence(receipts: DataFrame, listed: DataFrame) -> DataFrame:
    """One row: how many receipts and distinct receivers are listed already, and the upper 95 % bound 3/n of a rate of none in n."""
    per = receipts.where(F.col("to_address").isNotNull()).groupBy(F.col("to_address").alias("address")).agg(F.count("*").alias("n"))
    per = per.join(listed.select("address").distinct().withColumn("hit", F.lit(1)), "address", "left")
    hit = F.col("hit").isNotNull()
    out = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("receipts"), F.count("*").alias("addresses"), F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("listed_receipts"), F.count_if(hit).alias("listed_addresses"))
    of = lambda x, n: x / F.greatest(F.col(n), F.lit(1))
    return out.select("*", of(F.col("listed_addresses"), "addresses").alias("prevalence_address"), of(F.col("listed_receipts"), "receipts").alias("prevalence_receipt"), of(F.lit(3.0), "addresses").alias("upper_95"))


def address_report(scored: DataFrame, exclude: DataFrame) -> DataFrame:
    """One row over labelled addresses outside `exclude` (those trained on): ranking metrics, base rate and the median score of either class."""
    rows = scored.where("label is not null").join(exclude.select("address").distinct(), "address", "left_anti")
    out = ranking_metrics(rows).withColumn("base_rate", F.col("n_pos") / (F.col("n_pos") + F.col("n_neg")))
    for label, name in ((1, "median_scam"), (0, "median_control")):
        out = out.crossJoin(F.broadcast(median(rows.where(F.col("label") == label), "score", name).drop("n")))
    return out


def balance(rows: DataFrame, covariates: list[str]) -> DataFrame:
    """(label, covariate, n, median) for both labels."""
    parts = [median(rows.where(F.col("label") == k), c, "median").select(F.lit(k).alias("label"), F.lit(c).alias("covariate"), "n", "median") for k in (0, 1) for c in covariates]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def latency(rows: DataFrame, column: str) -> DataFrame:
    """One row: n, p50 (median), and the values at the positions floor(n * share) as p95 and p99, and the largest."""
    at = lambda q: lambda n: F.least(F.floor(n * F.lit(q)), n - 1)
    got = at_ranks(rows, column, MIDDLE | {"p95": at(0.95), "p99": at(0.99), "most": lambda n: n - 1})
    return got.select("n", ((F.col("lower") + F.col("upper")) / 2).alias("p50"), "p95", "p99", "most")


def nearest_edges(rows: DataFrame, edges: list[float], n: int = 400, key: str = "event_id") -> DataFrame:
    """The n rows whose score lies closest to a band's edge, ties to the smaller key."""
    far = [F.abs(F.col("score") - F.lit(float(e))) for e in edges]
    return rows.withColumn("edge_distance", F.least(*far) if len(far) > 1 else far[0]).orderBy("edge_distance", key).limit(n)


def family_gain(gains: DataFrame, families: dict[str, str]) -> DataFrame:
    """(family, gain, share) of (feature, gain), features in no family under `other`."""
    named = F.coalesce(*(F.when(F.col("feature") == k, F.lit(v)) for k, v in families.items()), F.lit("other"))
    sums = gains.groupBy(named.alias("family")).agg(F.sum("gain").alias("gain"))
    total = sums.agg(F.greatest(F.sum("gain").cast("double"), F.lit(1e-9)).alias("total"))
    return sums.crossJoin(F.broadcast(total)).select("family", "gain", (F.col("gain") / F.col("total")).alias("share"))


def resampled(rates: DataFrame, hits: str, n: str, reps: int = 400, seed: int = 17) -> DataFrame:
    """rates (a row a rate) with rate, lo and hi, the 2.5 and 97.5 percentiles of the rate over resamples of its n units.

    The mean of n zeros and ones drawn with replacement is binomial, so units need not be copied.
    """

    @F.pandas_udf("struct<lo: double, hi: double>")
    def bounds(h: pd.Series, m: pd.Series) -> pd.DataFrame:
        out = [np.percentile(np.random.default_rng(seed).binomial(b, a / b, reps) / b, [2.5, 97.5]) if b else [np.nan] * 2 for a, b in zip(h, m)]
        return pd.DataFrame(out, columns=["lo", "hi"])

    return rates.withColumn("_b", bounds(hits, n)).select(*rates.columns, F.when(F.col(n) > 0, F.col(hits) / F.col(n)).alias("rate"), F.nanvl("_b.lo", F.lit(None)).alias("lo"), F.nanvl("_b.hi", F.lit(None)).alias("hi"))
