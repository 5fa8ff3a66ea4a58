"""The feature matrix: facts of both ends told in a fold each, ratios derived from them, and fills for what is unknown.

Zero, -1 and null say different things to a model: no history of the kind, not applicable, unknown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.sources.driver_tables import DAY, HOUR

from . import asof
from .legs import clean, legs
from .store import written

EPS = 1e-9

# The model's columns by family.
DESTINATION = ["dest_age_days", "dest_inbound_count", "dest_outbound_count", "dest_senders_all", "dest_senders_1d", "dest_senders_7d", "dest_senders_30d", "dest_inbound_usd_7d", "dest_inbound_usd_30d", "dest_inbound_count_7d", "dest_distinct_out", "dest_consolidation_ratio", "dest_median_hold_secs", "dest_p25_hold_secs", "dest_funder_fanout", "dest_forward_ratio", "dest_in_out_ratio", "dest_usd_per_sender"]
SENDER = ["sender_age_days", "sender_outbound_count", "sender_distinct_dests", "sender_distinct_counterparties", "sender_median_out_usd", "sender_max_out_usd", "sender_lifetime_out_usd", "sender_balance_proxy_usd", "sender_burst_1h", "sender_burst_24h", "sender_burst_7d", "sender_recent_inflow_max_usd", "sender_recent_inflow_usd_7d", "sender_secs_since_last_out", "sender_out_mean_usd", "sender_out_std_usd", "sender_outflow_usd_7d", "sender_outflow_usd_30d", "sender_distinct_dests_7d", "sender_distinct_dests_30d", "sender_median_in_usd", "amount_vs_sender_median", "amount_vs_sender_max", "amount_vs_balance", "amount_share_of_lifetime_out", "amount_zscore_own", "sender_dormancy_days", "sender_drawdown_7d", "sender_dest_churn_7d", "sender_recent_dest_share", "sender_passthrough_7d", "sender_outflow_accel", "sender_burst_accel", "sender_lifetime_rate", "sender_rate_vs_lifetime", "sender_value_rate_vs_lifetime", "sender_inflow_cover_7d"]
RELATIONSHIP = ["sender_prior_sends_to_dest", "pair_prior_usd", "pair_secs_since_last", "pair_span_days", "escalation_ratio", "escalation_vs_first", "pair_peak_vs_first", "is_first_send_to_dest", "first_send_to_young_dest", "shared_counterparties", "no_shared_counterparties", "pair_outflow_usd_7d", "pair_outflow_usd_all", "pair_share_of_outflow_7d", "pair_share_of_outflow_all"]
CONTEXT = ["amount_usd", "event_hour", "hour_deviation", "amount_round_1k", "amount_round_100"]
FEATURE_COLUMNS = DESTINATION + SENDER + RELATIONSHIP + CONTEXT
FEATURE_FAMILY = {c: f for f, cs in (("destination", DESTINATION), ("sender", SENDER), ("relationship", RELATIONSHIP), ("context", CONTEXT)) for c in cs}
GRAPH_FEATURES = ["payout_fanin"]


def _clip(x: Column, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(hi))


def _or(x: Column, fill: float) -> Column:
    return F.coalesce(x, F.lit(fill))


def derive(blocks: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Model columns from the joined blocks, and those to `keep`. Ratios read unfilled inputs unless a fill is their meaning."""
    c = F.col
    usd = lambda name: c(name) / 100.0
    n_in, n_out, sent = c("dest_inbound_count"), c("dest_outbound_count"), c("sender_outbound_count")
    has_in, has_out, has_sent = n_in > 0, n_out > 0, sent > 0
    amount, t = usd("cents"), c("event_time")
    base = blocks.select(
        *keep,
        "event_id",
        "sender",
        "destination",
        "cents",
        "event_time",
        _or((t - c("dest_first_seen")) / float(DAY), 0.0).alias("dest_age_days"),
        *DESTINATION[1:7],
        usd("dest_inbound_cents_7d").alias("dest_inbound_usd_7d"),
        usd("dest_inbound_cents_30d").alias("dest_inbound_usd_30d"),
        "dest_inbound_count_7d",
        "dest_distinct_out",
        _or(F.when(has_out, c("dest_top_payee_cents") / c("dest_outbound_cents_all")), 0.0).alias("dest_consolidation_ratio"),
        _or(c("dest_median_hold_secs"), -1.0).alias("dest_median_hold_secs"),
        _or(c("dest_p25_hold_secs"), -1.0).alias("dest_p25_hold_secs"),
        "dest_funder_fanout",
        F.when(has_in & has_out, usd("dest_outbound_cents_all") / (usd("dest_inbound_cents_all") + EPS)).alias("dest_forward_ratio"),
        (n_in / (n_out + EPS)).alias("dest_in_out_ratio"),
        F.when(has_in, usd("dest_inbound_cents_all") / (c("dest_senders_all") + EPS)).alias("dest_usd_per_sender"),
        _or((t - c("sender_first_seen")) / float(DAY), 0.0).alias("sender_age_days"),
        "sender_outbound_count",
        "sender_distinct_dests",
        "sender_distinct_counterparties",
        _or(usd("sender_median_out_cents"), 0.0).alias("sender_median_out_usd"),
        _or(usd("sender_max_out_cents"), 0.0).alias("sender_max_out_usd"),
        usd("sender_lifetime_out_cents").alias("sender_lifetime_out_usd"),
        ((c("sender_lifetime_in_cents") - c("sender_lifetime_out_cents")) / 100.0).alias("sender_balance_proxy_usd"),
        "sender_burst_1h",
        "sender_burst_24h",
        "sender_burst_7d",
        usd("sender_recent_inflow_cents_7d").alias("sender_recent_inflow_usd_7d"),
        _or(usd("sender_recent_inflow_max_cents"), 0.0).alias("sender_recent_inflow_max_usd"),
        _or(usd("sender_median_in_cents"), 0.0).alias("sender_median_in_usd"),
        ((t - c("sender_last_out")) / 1000.0).alias("sender_secs_since_last_out"),
        _or(F.when(has_sent, c("sender_lifetime_out_cents") / sent / 100.0), 0.0).alias("sender_out_mean_usd"),
        F.when(sent > 1, F.sqrt(((c("sender_out_squares") * sent - c("sender_lifetime_out_cents").cast("decimal(19,0)") * c("sender_lifetime_out_cents")).cast("double")) / sent / (sent - 1)) / 100.0).alias("std"),
        usd("sender_outflow_cents_7d").alias("sender_outflow_usd_7d"),
        usd("sender_outflow_cents_30d").alias("sender_outflow_usd_30d"),
        "sender_distinct_dests_7d",
        "sender_distinct_dests_30d",
        F.when(has_sent, usd("sender_median_out_cents")).alias("median"),
        F.when(has_sent, usd("sender_max_out_cents")).alias("largest"),
        _or(F.when(has_sent, c("sender_out_hours") / sent), -1.0).alias("mean_hour"),
        "sender_prior_sends_to_dest",
        usd("pair_prior_cents").alias("pair_prior_usd"),
        usd("pair_outflow_cents_7d").alias("pair_outflow_usd_7d"),
        usd("pair_prior_cents").alias("pair_outflow_usd_all"),
        _or((t - c("pair_last")) / 1000.0, -1.0).alias("pair_secs_since_last"),
        _or((c("pair_last") - c("pair_first")) / float(DAY), -1.0).alias("pair_span_days"),
        _or(amount / (usd("pair_max_prior_cents") + EPS), -1.0).alias("escalation_ratio"),
        _or(amount / (usd("pair_first_cents") + EPS), -1.0).alias("escalation_vs_first"),
        _or(usd("pair_max_prior_cents") / (usd("pair_first_cents") + EPS), -1.0).alias("pair_peak_vs_first"),
        "shared_counterparties",
        "top_payee",
        "payout_fanin",
        amount.alias("amount_usd"),
        F.expr(f"event_time div {HOUR} % 24").cast("double").alias("event_hour"),
        (c("cents") % 100000 == 0).cast("int").alias("amount_round_1k"),
        (c("cents") % 10000 == 0).cast("int").alias("amount_round_100"),
    )
    out7, out30, in7, balance = c("sender_outflow_usd_7d"), c("sender_outflow_usd_30d"), c("sender_recent_inflow_usd_7d"), F.greatest("sender_balance_proxy_usd", F.lit(0.0))
    rate = c("sender_outbound_count") / (c("sender_age_days") + 1)
    first = (c("sender_prior_sends_to_dest") == 0).cast("int")
    return base.withColumns(
        {
            "sender_out_std_usd": _or(c("std"), 0.0),
            "amount_vs_sender_median": _or(c("amount_usd") / (c("median") + EPS), -1.0),
            "amount_vs_sender_max": _or(c("amount_usd") / (c("largest") + EPS), -1.0),
            "amount_vs_balance": c("amount_usd") / (balance + EPS),
            "amount_share_of_lifetime_out": c("amount_usd") / (c("sender_lifetime_out_usd") + EPS),
            "amount_zscore_own": _or((c("amount_usd") - c("sender_out_mean_usd")) / (c("std") + 1.0), 0.0),
            "sender_dormancy_days": _or(c("sender_secs_since_last_out") / 86400, -1.0),
            "sender_drawdown_7d": out7 / (balance + EPS),
            "sender_dest_churn_7d": c("sender_distinct_dests_7d") / (c("sender_burst_7d") + EPS),
            "sender_recent_dest_share": c("sender_distinct_dests_30d") / (c("sender_distinct_counterparties") + EPS),
            "sender_passthrough_7d": _clip(out7 / (in7 + EPS), 50.0),
            "sender_outflow_accel": _clip((out7 / 7) / (out30 / 30 + EPS), 100.0),
            "sender_burst_accel": _clip(c("sender_burst_24h") / (c("sender_burst_7d") / 7 + EPS), 100.0),
            "sender_lifetime_rate": rate,
            "sender_rate_vs_lifetime": _clip((c("sender_burst_7d") / 7) / (rate + EPS), 200.0),
            "sender_value_rate_vs_lifetime": _clip((out7 / 7) / (c("sender_lifetime_out_usd") / (c("sender_age_days") + 1) + EPS), 500.0),
            "sender_inflow_cover_7d": _clip(in7 / (out7 + EPS), 50.0),
            "is_first_send_to_dest": first,
            "first_send_to_young_dest": (first * (c("dest_age_days") < 30).cast("int")),
            "no_shared_counterparties": (c("shared_counterparties") == 0).cast("int"),
            "pair_share_of_outflow_7d": _clip(c("pair_outflow_usd_7d") / (out7 + EPS), 1.0),
            "pair_share_of_outflow_all": _clip(c("pair_outflow_usd_all") / (c("sender_lifetime_out_usd") + EPS), 1.0),
            "hour_deviation": F.abs(c("event_hour") - c("mean_hour")),
        }
    ).drop("std", "median", "largest", "mean_hour")


class FeatureEngine:
    """Legs of a warehouse of transfers, for any number of event sets. They are lazy: pass transfers that are written (or cached) to read them once."""

    def __init__(self, transfers: DataFrame) -> None:
        self.legs = legs(clean(transfers))

    def blocks(self, events: DataFrame) -> DataFrame:
        """The events with all facts: those of the destination come along into the fold of the sender's, counts of payees, funders and shared peers are looked up between."""
        kept = tuple(c for c in events.columns if c != "event_id")
        known = written(asof.destination_facts(events, self.legs, kept))
        counts = {
            "shared_counterparties": (asof.shared_since(events, self.legs), F.concat_ws("|", "sender", "destination")),
            "dest_funder_fanout": (asof.first_dealt(self.legs, known, "funder", "out"), F.col("funder")),
            "payout_fanin": (asof.first_dealt(self.legs, known, "top_payee", "in"), F.col("top_payee")),
        }
        rows = asof.counted(known, counts).drop("funder")
        return asof.sender_facts(rows, self.legs, tuple(c for c in rows.columns if c != "event_id"), known)

    def compute(self, events: DataFrame) -> DataFrame:
        """events (event_id, sender, destination, cents, event_time; event_id unique) with FEATURE_COLUMNS and GRAPH_FEATURES."""
        return derive(self.blocks(events))


def compute_features(events: DataFrame, transfers: DataFrame) -> DataFrame:
    return FeatureEngine(transfers).compute(events)
