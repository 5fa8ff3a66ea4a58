"""Vetting of reported addresses, victims and events, strata and splits of the training set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import asked_of
from .legs import transfer_position
from .order import quantiles, values_at
from .store import sent, written

# Thresholds that are part of the semantics.
MIN_SOURCES, MIN_VICTIM_CENTS, MAX_EVENTS_PER_PAIR = 2, 5000, 10
FIRST_SHARE = 8  #: times as many transfers are looked at first as controls are asked for
RETAIL = {"least_senders": 5, "most_senders": 5000, "most_cents_per_sender": 25_000_000, "least_cents": 50_000}
COLLECTION = {"senders": 5, "in_out": 2.0, "consolidation": 0.60}
AGE_BINS, COUNT_BINS, SIZE_BINS = [7, 30, 90, 365], [1, 3, 10, 30, 100], [50, 200, 1000, 5000]


def aggregate_reports(reports: DataFrame) -> DataFrame:
    """One row per (address, chain) with what its reports say together; category is that of the first source in order."""
    out = reports.groupBy("address", "chain").agg(
        F.count_distinct("source").alias("source_count"), F.max("weight").alias("max_source_weight"), F.sum("weight").alias("corroboration_score"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.min("reported_at").alias("first_reported_at"), F.min_by("category", "source").alias("category"))
    return out.withColumn("corroborated_offchain", (F.col("source_count") >= MIN_SOURCES) | (F.col("max_source_weight") >= 1.0))


def destination_profiles(transfers: DataFrame, addresses: DataFrame) -> DataFrame:
    """Whole-history facts of these addresses (address, chain) that ever received on their chain: for vetting labels, never for a model."""
    keys = ["address", "chain"]
    wanted = written(addresses.select(*keys).distinct())
    side = lambda own, peer, inward: F.struct(F.col(own).alias("address"), F.col(peer).alias("peer"), F.lit(inward).alias("inward"))
    sides = F.explode(F.array(side("to_address", "from_address", True), side("from_address", "to_address", False)))
    rows = transfers.select("chain", sides.alias("x"), "cents", "block_time").select("chain", "x.*", "cents", "block_time")
    # only legs of these addresses are shuffled, and they are read for two groupings
    rows = written(asked_of(rows, wanted, "address").join(sent(wanted), keys, "left_semi"))
    into, out = F.col("inward"), ~F.col("inward")
    pairs = rows.groupBy(*keys, "inward", "peer").agg(F.count("*").alias("n"), F.sum("cents").alias("v"), F.min("block_time").alias("first"), F.max("block_time").alias("last"))
    of = lambda f, side, c: f(F.when(side, F.col(c)))
    facts = pairs.groupBy(*keys).agg(
        of(F.sum, into, "n").alias("inbound_count"), F.count_if(into & F.col("peer").isNotNull()).alias("distinct_inbound_senders"), of(F.sum, into, "v").alias("inbound_cents"),
        of(F.min, into, "first").alias("first_seen"), of(F.max, into, "last").alias("last_inbound"),
        of(F.sum, out, "n").alias("outbound_count"), F.count_if(out).alias("distinct_outbound_dests"), of(F.sum, out, "v").alias("outbound_cents"), of(F.max, out, "v").alias("top"))
    middle = rows.where(into).groupBy(*keys).agg(F.median("cents").alias("median_inbound_cents"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    known = [*keys, "inbound_count", "distinct_inbound_senders", "inbound_cents", "median_inbound_cents", "first_seen", "last_inbound"]
    return facts.join(middle, keys).select(*known, *map(zero, ("outbound_count", "outbound_cents", "distinct_outbound_dests")), F.coalesce(F.col("top") / F.col("outbound_cents"), F.lit(0.0)).alias("consolidation_ratio"), (F.col("inbound_cents") / F.col("distinct_inbound_senders")).alias("cents_per_sender"))


def collection_like() -> Column:
    """Does a profile behave like a collector? Unknown facts count as 0."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    shape = (n("inbound_count") / F.greatest(n("outbound_count"), F.lit(1)) >= COLLECTION["in_out"]) & (F.coalesce("consolidation_ratio", F.lit(0.0)) >= COLLECTION["consolidation"])
    return (n("distinct_inbound_senders") >= COLLECTION["senders"]) & F.when(n("outbound_count") == 0, n("inbound_count") >= COLLECTION["senders"]).otherwise(shape)


def finalise(aggregated: DataFrame, profiles: DataFrame) -> DataFrame:
    """Labels with their corroboration on their own chain, whether they are accepted and on what basis."""
    rows = aggregated.join(profiles, ["address", "chain"], "left").withColumn("corroborated_onchain", collection_like())
    basis = F.when(F.col("source_count") >= MIN_SOURCES, "multi_source").when(F.col("max_source_weight") >= 1.0, "authoritative_single_source").when(F.col("corroborated_onchain"), "report_plus_onchain_pattern").otherwise("uncorroborated")
    return rows.select(*aggregated.columns, "corroborated_onchain", (F.col("corroborated_offchain") | F.col("corroborated_onchain")).alias("accepted"), basis.alias("label_basis"))


def retail_collection(profiles: DataFrame) -> DataFrame:
    r = RETAIL
    return profiles.where(F.col("distinct_inbound_senders").between(r["least_senders"], r["most_senders"]) & (F.col("cents_per_sender") <= r["most_cents_per_sender"]) & (F.col("inbound_cents") >= r["least_cents"]))


def victims(transfers: DataFrame, scams: DataFrame) -> DataFrame:
    """Pairs that sent a confirmed scam address enough before it was frozen; labelled senders are no victims. scams: (address, first_reported_at), one row an address."""
    frozen = sent(scams.select(F.col("address").alias("to_address"), F.col("first_reported_at").alias("frozen_at")))
    sends = transfers.join(frozen, "to_address").where("block_time < frozen_at").join(frozen.select(F.col("to_address").alias("from_address")), "from_address", "left_anti")
    out = sends.groupBy(F.col("from_address").alias("victim"), F.col("to_address").alias("scam")).agg(F.min("block_time").alias("first_send_at"), F.max("block_time").alias("last_send_at"), F.sum("cents").alias("total_cents"), F.count("*").alias("n_sends"), F.min("frozen_at").alias("frozen_at"))
    return out.where(F.col("total_cents") >= MIN_VICTIM_CENTS)


EVENT = ["chain", "sender", "destination", "cents", "asset", "event_time", "event_id", "transfer_k", "frozen_at", "label", "group_key"]


def positive_events(transfers: DataFrame, pairs: DataFrame) -> DataFrame:
    """One event per transfer of a victim to its scam before the freeze, by position; the first ten of a pair."""
    pairs = pairs.select(F.col("victim").alias("sender"), F.col("scam").alias("destination"), "frozen_at")
    rows = transfers.withColumnsRenamed({"from_address": "sender", "to_address": "destination", "block_time": "event_time", "tx_hash": "event_id"}).join(pairs, ["sender", "destination"]).where("event_time < frozen_at")
    return transfer_position(rows, MAX_EVENTS_PER_PAIR).withColumns({"label": F.lit(1), "group_key": F.col("destination")}).select(*EVENT)


def hash_order(*parts: Column, seed: int = 17) -> Column:
    """A reproducible random order: md5 of the seed and the key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def control_events(transfers: DataFrame, exclude: DataFrame, scams: DataFrame, n: int, seed: int = 17) -> DataFrame:
    """n transfers, by hash order, of senders and destinations without a link to any scam address. exclude: (sender).

    The first of the order are looked at first, as many as should do, and more of them until there are n, so
    that not all transfers are shuffled to find their links: who is not looked at comes later in the order.
    """
    rows = transfers.withColumnsRenamed({"from_address": "sender", "to_address": "destination", "block_time": "event_time", "tx_hash": "event_id"})
    rows = rows.withColumn("order", hash_order(F.col("event_id"), seed=seed))
    excluded, linked = sent(exclude.select("sender").distinct()), sent(scams.select("address"))
    share = FIRST_SHARE * n / max(1, transfers.count())
    while True:
        some = rows if share >= 1 else rows.where(F.col("order") < f"{int(share * 2**32):08x}")
        for end in ("sender", "destination"):
            some = some.join(linked.select(F.col("address").alias(end)), end, "left_anti")
        some = some.join(excluded, "sender", "left_anti")
        if share >= 1:
            break
        some = written(some)
        if some.count() >= n:
            break
        share *= 16
    rows = some.orderBy("order", "event_id").limit(n)
    none = F.lit(None).cast("long")
    return rows.withColumns({"label": F.lit(0), "transfer_k": F.lit(0), "frozen_at": none, "group_key": F.col("sender")}).select(*EVENT)


def cut(x: Column, marks: list[float], prefix: str) -> Column:
    """Right-closed bins: prefix and the number of marks below x."""
    return F.concat(F.lit(prefix), sum(((x > F.lit(float(m))).cast("int") for m in marks), F.lit(0)).cast("string"))


def add_strata(rows: DataFrame) -> DataFrame:
    bins = {"s_age": ("sender_age_days", AGE_BINS, "a"), "s_count": ("sender_outbound_count", COUNT_BINS, "c"), "s_size": ("sender_median_out_usd", SIZE_BINS, "s")}
    out = rows.withColumns({k: cut(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), marks, p) for k, (c, marks, p) in bins.items()})
    return out.withColumn("stratum", F.concat_ws("|", "chain", *bins))


def shuffled_rank(rows: DataFrame, group: str, key: str, seed: int = 17) -> DataFrame:
    """Position of a row in its group's hash order."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(hash_order(F.col(key).cast("string"), seed=seed), key)))


def match_by_stratum(rows: DataFrame, keys: list[list[str]], ratio: int, seed: int = 17) -> DataFrame:
    """Controls (label 0) drawn per stratum of the positives, `ratio` each, in hash order without replacement; what a key list cannot give is asked of the next, coarser one.

    rows: event_id (unique), label and the key columns. Returns (event_id, level).
    """
    pos, left = rows.where("label = 1"), rows.where("label = 0")
    wanted = {tuple(k): None for k in keys}
    picked, out = None, None
    for level, key in enumerate(wanted):
        demand = pos.groupBy(*key).agg((F.count("*") * ratio).alias("need"))
        if picked is not None:
            filled = picked.join(rows, "event_id").groupBy(*key).agg(F.count("*").alias("had"))
            demand = demand.join(filled, list(key), "left").select(*key, (F.col("need") - F.coalesce("had", F.lit(0))).alias("need")).where("need > 0")
            left = left.join(picked, "event_id", "left_anti")
        w = Window.partitionBy(*key).orderBy(hash_order(F.col("event_id"), seed=seed), "event_id")
        got = left.join(F.broadcast(demand), list(key)).withColumn("rank", F.row_number().over(w)).where("rank <= need").select("event_id", F.lit(level).alias("level"))
        out = got if out is None else out.unionByName(got)
        picked = out.select("event_id")
    return out


def mean_differences(rows: DataFrame, covariates: list[str]) -> DataFrame:
    """(covariate, pos_median, neg_median, smd, abs_smd) of log1p values, pooled population variance."""
    each = F.array(*(F.struct(F.lit(c).alias("covariate"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("v")) for c in covariates))
    long = rows.select("label", F.explode(each).alias("x")).select("label", "x.covariate", "x.v").withColumn("l", F.log1p(F.greatest("v", F.lit(0.0))))
    is_ = lambda k, c: F.when(F.col("label") == k, F.col(c))
    out = long.groupBy("covariate").agg(*(f(is_(k, "l")).alias(f"{n}{k}") for k in (0, 1) for n, f in (("mean", F.avg), ("var", F.var_pop))))
    middle = quantiles(long, "v", [0.5], "q", ["covariate", "label"]).groupBy("covariate").agg(*(F.max(F.when(F.col("label") == k, F.col("q")[0])).alias(f"median{k}") for k in (0, 1)))
    out = out.join(middle, "covariate")
    sd = F.sqrt((F.col("var1") + F.col("var0")) / 2)
    smd = (F.col("mean1") - F.col("mean0")) / F.when(sd > 0, sd).otherwise(1.0)
    return out.select("covariate", F.col("median1").alias("pos_median"), F.col("median0").alias("neg_median"), smd.alias("smd"), F.abs(smd).alias("abs_smd"))


def nearest_rank(rows: DataFrame, column: str, q: float) -> DataFrame:
    """One row, one column `cut`: the value at rank round(q (n - 1)) in ascending order."""
    return values_at(rows, column, {"cut": lambda n: F.floor(F.lit(q) * (n - 1) + 0.5)}).select("cut")


def temporal_split(events: DataFrame, q: float = 0.70) -> DataFrame:
    """events with `part` (train, test): positives by when their scam was frozen, negatives by their own time, both at the positives' quantile."""
    pos = events.where("label = 1")
    cuts = nearest_rank(pos, "frozen_at", q).withColumnRenamed("cut", "frozen_cut").crossJoin(nearest_rank(pos, "event_time", q).withColumnRenamed("cut", "event_cut"))
    late = F.when(F.col("label") == 1, F.col("frozen_at") >= F.col("frozen_cut")).otherwise(F.col("event_time") >= F.col("event_cut"))
    return events.crossJoin(F.broadcast(cuts)).withColumn("part", F.when(late, "test").otherwise("train")).drop("frozen_cut", "event_cut")


def calibration_split(train: DataFrame, share: float = 0.25) -> DataFrame:
    """train rows with `fold`: the latest share by time calibrates, the rest fits."""
    mark = nearest_rank(train, "event_time", 1 - share)
    return train.crossJoin(F.broadcast(mark)).withColumn("fold", F.when(F.col("event_time") >= F.col("cut"), "calibrate").otherwise("fit")).drop("cut")
