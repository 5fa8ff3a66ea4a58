"""Scores of single payments with their reasons, of all addresses at a moment, and the predictions that follow."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.sources.driver_tables import DAY

from . import boosting, shapley, trees

UNKNOWN = "neither the recipient's income nor the sender's payments are known"


def model_id(model: dict) -> str:
    """The first 16 hex digits of the SHA-256 of a model's canonical JSON."""
    return hashlib.sha256(json.dumps(model, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def history_known() -> Column:
    """Did the recipient receive, or the sender send, anything before?"""
    n = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    return n("dest_inbound_count") | n("sender_outbound_count")


def score_events(facts: DataFrame, model: dict, thresholds: dict, calibration: tuple[float, float] | None = None, most: int = 5) -> DataFrame:
    """facts (a row an event with the model's features, dest_inbound_count and sender_outbound_count) with score, band, reasons and features_available.

    The band goes by the raw score, `score` is calibrated (slope and offset of a logit) and has four
    decimals. Reasons are at most `most` statements; where no history is known, UNKNOWN comes first.
    The model needs numbers of rows for its Shapley values. Works on any number of events at once.
    """
    raw = trees.probability(F.col("margin"))
    out = boosting.score(facts, model)
    out = shapley.reasons(shapley.contributions(out, model), model["features"], most=most)
    known = history_known()
    said = F.when(known, F.col("reasons")).otherwise(F.slice(F.concat(F.array(F.lit(UNKNOWN)), F.col("reasons")), 1, most))
    score = trees.platt(raw, *calibration) if calibration else raw
    return out.withColumns({"score": F.round(score, 4), "band": trees.event_bands(raw, thresholds), "reasons": said, "features_available": known}).drop("contributions", "margin")


def address_facts(legs: DataFrame, at: int) -> DataFrame:
    """(address, dest_*): what is known of every address of legs at one moment, from legs before it.

    Legs are first summed by address, side and peer, so that distinct peers are counts of rows and a hub's
    traffic meets in partial sums; an address without an earlier leg has no row.
    """
    per = legs.where(F.col("block_time") < at).groupBy("address", "side", "peer").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"), F.min("block_time").alias("first"), F.max("block_time").alias("last"))
    into, out = F.col("side") == "in", F.col("side") == "out"
    total = lambda c, w: F.coalesce(F.sum(F.when(w, F.col(c))), F.lit(0)).cast("long")
    lately = {f"dest_senders_{d}d": F.count_if(into & (F.col("last") >= at - d * DAY)) for d in (1, 7, 30)}
    sums = {
        "dest_inbound_count": total("n", into), "dest_inbound_cents_all": total("cents", into), "dest_outbound_count": total("n", out), "dest_outbound_cents_all": total("cents", out),
        "dest_senders_all": F.count_if(into), "dest_distinct_out": F.count_if(out), **lately, "dest_top_payee_cents": F.max(F.when(out, F.col("cents"))), "dest_first_seen": F.min("first"),
    }
    facts = per.groupBy("address").agg(*(c.alias(name) for name, c in sums.items()))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return facts.withColumns({
        "dest_age_days": (F.lit(at) - F.col("dest_first_seen")) / float(DAY), "dest_usd_per_sender": ratio("dest_inbound_cents_all", "dest_senders_all") / 100,
        "dest_forward_ratio": ratio("dest_outbound_cents_all", "dest_inbound_cents_all"), "dest_consolidation_ratio": ratio("dest_top_payee_cents", "dest_outbound_cents_all"),
    })


def score_addresses(facts: DataFrame, model: dict, complete: DataFrame | None = None) -> DataFrame:
    """facts with score and band. complete: only these addresses, those whose whole history is known; of a part, age and totals would be wrong."""
    if complete is not None:
        facts = facts.join(complete.select("address").distinct(), "address", "left_semi")
    out = boosting.score(trees.quantised(facts, model), model)
    score = trees.probability(F.col("margin"))
    return out.withColumns({"score": score, "band": trees.bands(score, model["thresholds"])}).drop("margin")


def predictions(scored: DataFrame, model: dict, chain: str, at: int, listed: DataFrame, already: DataFrame) -> DataFrame:
    """Addresses at or above the model's upper threshold that no list names and no earlier prediction has, with their evidence.

    One row an address: chain, predicted_at, score (6 decimals), threshold, model, senders, inbound_usd,
    features (the model's, 6 decimals, null where unknown) and payload, the same as canonical JSON for the log.
    """
    rows = scored.where(F.col("score") >= model["thresholds"]["high"])
    for known in (listed, already):
        rows = rows.join(known.select("address").distinct(), "address", "left_anti")
    evidence = F.create_map(*(x for f in sorted(model["features"]) for x in (F.lit(f), F.round(F.col(f).cast("double"), 6))))
    out = rows.select(
        "address", F.lit(chain).alias("chain"), F.lit(at).cast("long").alias("predicted_at"), F.round("score", 6).alias("score"), F.lit(round(float(model["thresholds"]["high"]), 6)).alias("threshold"),
        F.lit("high").alias("band"), F.lit(model_id(model)).alias("model"), F.col("dest_senders_all").alias("senders"), F.round(F.col("dest_inbound_cents_all") / 100, 2).alias("inbound_usd"), evidence.alias("features"))
    return out.withColumn("payload", F.to_json(F.struct(*sorted(out.columns)), {"ignoreNullFields": "false"}))
