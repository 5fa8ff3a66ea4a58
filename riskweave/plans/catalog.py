"""Registered queries of the risk engine over the driver's tables, each with its SQL equivalent where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators import asof, metrics, trees
from riskweave.operators import legs as L
from riskweave.operators.features import FeatureEngine
from riskweave.operators.store import written
from riskweave.sources import driver_tables as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = (f"WITH {D.TX_SQL}" + sql) if sql.lstrip().startswith((",", "SELECT", "select")) else sql
        return f

    return add


def _engine(spark: SparkSession, sf_dir: str) -> tuple[FeatureEngine, DataFrame]:
    """Transfers are written once: each branch of a block reads them again, and would else join lines and orders again."""
    tx = D.kept(D.derive_transfers(spark, sf_dir))
    return FeatureEngine(tx), L.payments_as_events(tx)


@query("a2_transfers", " SELECT tx_hash, from_address, to_address, CAST(cents AS BIGINT) AS cents, CAST(block_time AS BIGINT) AS block_time FROM tx")
def a2_transfers(spark, sf_dir):
    return D.derive_transfers(spark, sf_dir).select("tx_hash", "from_address", "to_address", "cents", "block_time")


@query("b2_legs", " SELECT address, peer, side, CAST(cents AS BIGINT) AS cents, CAST(block_time AS BIGINT) AS block_time, tx_hash FROM legs")
def b2_legs(spark, sf_dir):
    return L.legs(L.clean(D.derive_transfers(spark, sf_dir)))


SWEEP_SQL = """, sweep AS (
  SELECT address, peer, cents, block_time, tx_hash, block_time - arrived AS hold_ms FROM (
    SELECT *, last_value(CASE WHEN side = 'in' THEN block_time END IGNORE NULLS) OVER (PARTITION BY address ORDER BY block_time, side ROWS UNBOUNDED PRECEDING) AS arrived FROM legs
  ) WHERE side = 'out'
)"""


@query("e1_sweep", SWEEP_SQL + " SELECT tx_hash, address, CAST(hold_ms AS BIGINT) AS hold_ms FROM sweep")
def e1_sweep(spark, sf_dir):
    return L.sweep(L.legs(L.clean(D.derive_transfers(spark, sf_dir)))).select("tx_hash", "address", "hold_ms")


@query("d8_spans", " SELECT address, CAST(min(block_time) AS BIGINT) AS first_seen, CAST(max(block_time) AS BIGINT) AS last_seen, count(*) AS n_legs FROM legs GROUP BY address")
def d8_spans(spark, sf_dir):
    return L.spans(L.legs(L.clean(D.derive_transfers(spark, sf_dir))))


@query("e4_dedupe", """ , doubled AS (SELECT * FROM tx UNION ALL SELECT tx_hash, from_address, to_address, cents + 1, block_time + 1000 FROM tx WHERE cents % 3 = 0)
SELECT tx_hash, to_address, CAST(min(cents) AS BIGINT) AS cents, CAST(min(block_time) AS BIGINT) AS block_time FROM doubled GROUP BY tx_hash, to_address""")
def e4_dedupe(spark, sf_dir):
    tx = D.derive_transfers(spark, sf_dir).select("tx_hash", "from_address", "to_address", "cents", "block_time", "amount_usd")
    again = tx.where("cents % 3 = 0").withColumns({"cents": F.col("cents") + 1, "block_time": F.col("block_time") + 1000})
    return L.warehouse([tx, again]).select("tx_hash", "to_address", "cents", "block_time")


COVERED_SQL = """, truncated AS (
  SELECT address, hash = 0 AS truncated FROM (SELECT DISTINCT address, CAST(substr(address, 2) AS BIGINT) % 3 AS hash FROM legs)
), cover AS (
  SELECT t.address, truncated, last_fetched, CASE WHEN truncated THEN last_fetched ELSE 4611686018427387904 END AS complete_until
  FROM truncated t LEFT JOIN (SELECT address, max(block_time) - 2592000000 AS last_fetched FROM legs GROUP BY address) USING (address)
)"""


def _coverage(tx: DataFrame) -> DataFrame:
    legs = L.legs(L.clean(tx))
    truncated = legs.select("address").distinct().withColumn("truncated", F.substring("address", 2, 20).cast("long") % 3 == 0)
    return L.coverage(legs.withColumn("block_time", F.col("block_time") - 30 * D.DAY), truncated)


@query("d13_coverage", COVERED_SQL + " SELECT address, truncated, CAST(last_fetched AS BIGINT) AS last_fetched, CAST(complete_until AS BIGINT) AS complete_until FROM cover")
def d13_coverage(spark, sf_dir):
    return _coverage(D.derive_transfers(spark, sf_dir))


@query("b10_within_coverage", COVERED_SQL + """ SELECT event_id FROM ev LEFT JOIN cover s ON s.address = sender LEFT JOIN cover d ON d.address = destination
WHERE event_time <= coalesce(s.complete_until, 4611686018427387904) AND event_time <= coalesce(d.complete_until, 4611686018427387904)""")
def b10_within_coverage(spark, sf_dir):
    tx = D.derive_transfers(spark, sf_dir)
    return L.within_coverage(L.payments_as_events(tx), _coverage(tx)).select("event_id")


DAY_MS = 86400000
DEST_SQL = f"""
  SELECT e.event_id,
    count(*) FILTER (side = 'in') AS dest_inbound_count, coalesce(CAST(sum(l.cents) FILTER (side = 'in') AS BIGINT), 0) AS dest_inbound_cents_all,
    count(*) FILTER (side = 'out') AS dest_outbound_count, coalesce(CAST(sum(l.cents) FILTER (side = 'out') AS BIGINT), 0) AS dest_outbound_cents_all,
    count(DISTINCT peer) FILTER (side = 'in') AS dest_senders_all, count(DISTINCT peer) FILTER (side = 'out') AS dest_distinct_out,
    coalesce(CAST(sum(l.cents) FILTER (side = 'in' AND block_time >= event_time - {7 * DAY_MS}) AS BIGINT), 0) AS dest_inbound_cents_7d,
    count(*) FILTER (side = 'in' AND block_time >= event_time - {7 * DAY_MS}) AS dest_inbound_count_7d,
    coalesce(CAST(sum(l.cents) FILTER (side = 'in' AND block_time >= event_time - {30 * DAY_MS}) AS BIGINT), 0) AS dest_inbound_cents_30d,
    count(DISTINCT peer) FILTER (side = 'in' AND block_time >= event_time - {DAY_MS}) AS dest_senders_1d,
    count(DISTINCT peer) FILTER (side = 'in' AND block_time >= event_time - {7 * DAY_MS}) AS dest_senders_7d,
    count(DISTINCT peer) FILTER (side = 'in' AND block_time >= event_time - {30 * DAY_MS}) AS dest_senders_30d,
    CAST(min(block_time) AS BIGINT) AS dest_first_seen
  FROM ev e LEFT JOIN legs l ON l.address = e.destination AND l.block_time < e.event_time GROUP BY e.event_id"""
PAYEE_SQL = "SELECT event_id, peer, sum(l.cents) AS v FROM ev e JOIN legs l ON l.address = e.destination AND l.side = 'out' AND l.block_time < e.event_time GROUP BY 1, 2"


@query("g1_destination_block", f", d AS ({DEST_SQL}), p AS (SELECT event_id, CAST(max(v) AS BIGINT) AS dest_top_payee_cents FROM ({PAYEE_SQL}) GROUP BY 1) SELECT d.*, dest_top_payee_cents FROM d LEFT JOIN p USING (event_id)")
def g1_destination_block(spark, sf_dir):
    engine, events = _engine(spark, sf_dir)
    return asof.destination_block(events, engine.legs)


def _sum(what: str, days: int | None, side: str) -> str:
    return f"coalesce(CAST(sum({what}) FILTER (side = '{side}'" + (f" AND block_time >= event_time - {days * DAY_MS}" if days else "") + ") AS BIGINT), 0)"


SENDER_SQL = f"""
  SELECT e.event_id,
    count(*) FILTER (side = 'out') AS sender_outbound_count, {_sum('l.cents', None, 'out')} AS sender_lifetime_out_cents,
    coalesce(CAST(sum(l.cents * l.cents) FILTER (side = 'out') AS DECIMAL(38, 0)), 0) AS sender_out_squares,
    coalesce(CAST(sum(block_time // 3600000 % 24) FILTER (side = 'out') AS BIGINT), 0) AS sender_out_hours,
    {_sum('l.cents', None, 'in')} AS sender_lifetime_in_cents,
    count(DISTINCT peer) FILTER (side = 'out') AS sender_distinct_dests, count(DISTINCT peer) AS sender_distinct_counterparties,
    count(*) FILTER (side = 'out' AND block_time >= event_time - 3600000) AS sender_burst_1h,
    count(*) FILTER (side = 'out' AND block_time >= event_time - {DAY_MS}) AS sender_burst_24h,
    count(*) FILTER (side = 'out' AND block_time >= event_time - {7 * DAY_MS}) AS sender_burst_7d,
    {_sum('l.cents', 7, 'out')} AS sender_outflow_cents_7d, {_sum('l.cents', 30, 'out')} AS sender_outflow_cents_30d, {_sum('l.cents', 7, 'in')} AS sender_recent_inflow_cents_7d,
    count(DISTINCT peer) FILTER (side = 'out' AND block_time >= event_time - {7 * DAY_MS}) AS sender_distinct_dests_7d,
    count(DISTINCT peer) FILTER (side = 'out' AND block_time >= event_time - {30 * DAY_MS}) AS sender_distinct_dests_30d,
    CAST(max(l.cents) FILTER (side = 'out') AS BIGINT) AS sender_max_out_cents, CAST(max(block_time) FILTER (side = 'out') AS BIGINT) AS sender_last_out,
    CAST(min(block_time) AS BIGINT) AS sender_first_seen
  FROM ev e LEFT JOIN legs l ON l.address = e.sender AND l.block_time < e.event_time GROUP BY e.event_id"""


@query("g2_sender_block", f", s AS ({SENDER_SQL}) SELECT * REPLACE (CAST(sender_out_squares AS VARCHAR) AS sender_out_squares) FROM s")
def g2_sender_block(spark, sf_dir):
    engine, events = _engine(spark, sf_dir)
    return asof.sender_block(events, engine.legs).withColumn("sender_out_squares", F.col("sender_out_squares").cast("string"))


PAIR_SQL = f"""
  SELECT e.event_id, count(l.tx_hash) AS sender_prior_sends_to_dest, coalesce(CAST(sum(l.cents) AS BIGINT), 0) AS pair_prior_cents,
    coalesce(CAST(sum(l.cents) FILTER (block_time >= event_time - {7 * DAY_MS}) AS BIGINT), 0) AS pair_outflow_cents_7d,
    CAST(max(l.cents) AS BIGINT) AS pair_max_prior_cents, CAST(min(l.cents) AS BIGINT) AS pair_min_prior_cents,
    CAST(max(block_time) AS BIGINT) AS pair_last, CAST(min(block_time) AS BIGINT) AS pair_first,
    CAST(arg_min(l.cents, (block_time, l.tx_hash)) AS BIGINT) AS pair_first_cents
  FROM ev e LEFT JOIN legs l ON l.address = e.sender AND l.peer = e.destination AND l.side = 'out' AND l.block_time < e.event_time GROUP BY e.event_id"""


@query("g3_pair_block", f", p AS ({PAIR_SQL}) SELECT * FROM p")
def g3_pair_block(spark, sf_dir):
    engine, events = _engine(spark, sf_dir)
    return asof.pair_block(events, engine.legs)


SHARED_SQL = """, met AS (SELECT address, peer, min(block_time) AS met FROM legs GROUP BY 1, 2), sh AS (
  SELECT e.event_id, count(b.peer) AS shared_counterparties
  FROM ev e LEFT JOIN met a ON a.address = e.sender AND a.met < e.event_time LEFT JOIN met b ON b.address = e.destination AND b.peer = a.peer AND b.met < e.event_time
  GROUP BY 1
)"""


SELF_SQL = """, ev_self AS (SELECT event_id, sender, destination, event_time FROM ev UNION ALL SELECT 'self' || event_id, sender, sender, event_time FROM ev WHERE cents % 50 = 0)"""


@query("c7_shared_counterparties", SELF_SQL + SHARED_SQL.replace("FROM ev e", "FROM ev_self e") + " SELECT event_id, shared_counterparties FROM sh")
def c7_shared_counterparties(spark, sf_dir):
    engine, events = _engine(spark, sf_dir)
    own = events.where("cents % 50 = 0").withColumns({"event_id": F.concat(F.lit("self"), "event_id"), "destination": F.col("sender")})
    return asof.shared_block(events.unionByName(own), engine.legs)


FUNDER_SQL = """, fu AS (
  SELECT e.event_id, count(DISTINCT l.peer) AS dest_funder_fanout
  FROM ev e LEFT JOIN (SELECT address, arg_min(peer, (block_time, peer)) AS funder, min(block_time) AS since FROM legs WHERE side = 'in' GROUP BY 1) f ON f.address = e.destination AND f.since < e.event_time
  LEFT JOIN legs l ON l.address = f.funder AND l.side = 'out' AND l.block_time < e.event_time GROUP BY 1
)"""


@query("c4_funder_fanout", FUNDER_SQL + " SELECT event_id, dest_funder_fanout FROM fu")
def c4_funder_fanout(spark, sf_dir):
    engine, events = _engine(spark, sf_dir)
    return asof.funder_fanout(events, engine.legs)


FANIN_SQL = f""", best AS (SELECT event_id, arg_min(peer, (-v, peer)) AS top_payee FROM ({PAYEE_SQL}) GROUP BY 1
), met_in AS (SELECT address, peer, min(block_time) AS met FROM legs WHERE side = 'in' GROUP BY 1, 2
), fan AS (
  SELECT e.event_id, any_value(top_payee) AS top_payee, count(peer) AS payout_fanin
  FROM ev e LEFT JOIN best USING (event_id) LEFT JOIN met_in m ON m.address = top_payee AND m.met < e.event_time GROUP BY 1
)"""


@query("c5_payout_fanin", FANIN_SQL + " SELECT event_id, top_payee, payout_fanin FROM fan")
def c5_payout_fanin(spark, sf_dir):
    engine, events = _engine(spark, sf_dir)
    return asof.payout_fanin(events, engine.legs)


MEDIAN_SQL = SWEEP_SQL + """, med AS (
  SELECT e.event_id, quantile_cont(CAST(l.cents AS DOUBLE), 0.5) AS sender_median_out_cents
  FROM ev e LEFT JOIN legs l ON l.address = e.sender AND l.side = 'out' AND l.block_time < e.event_time GROUP BY 1
), hold AS (
  SELECT e.event_id, quantile_cont(s.hold_ms / 1000, 0.5) AS dest_median_hold_secs, quantile_cont(s.hold_ms / 1000, 0.25) AS dest_p25_hold_secs
  FROM ev e LEFT JOIN sweep s ON s.address = e.destination AND s.block_time < e.event_time GROUP BY 1
)"""


@query("d4_asof_medians", MEDIAN_SQL + " SELECT event_id, round(sender_median_out_cents, 3) AS sender_median_out_cents, round(dest_median_hold_secs, 3) AS dest_median_hold_secs, round(dest_p25_hold_secs, 3) AS dest_p25_hold_secs FROM med JOIN hold USING (event_id)")
def d4_asof_medians(spark, sf_dir):
    engine, events = _engine(spark, sf_dir)
    out = asof.median_block(events, engine.legs)
    return out.select("event_id", *(F.round(c, 3).alias(c) for c in ("sender_median_out_cents", "dest_median_hold_secs", "dest_p25_hold_secs")))


SCORED_SQL = f""", d AS ({DEST_SQL}), b AS (
  SELECT event_id, dest_senders_7d, coalesce((event_time - dest_first_seen) / 86400000.0, 0.0) AS dest_age_days, dest_inbound_count, sender, destination, cents FROM d JOIN ev USING (event_id)
), scored AS (
  SELECT *, CASE WHEN dest_senders_7d <= 2.5 THEN -0.6 WHEN dest_age_days <= 300.0 THEN 1.1 ELSE 0.4 END
    + CASE WHEN dest_inbound_count <= 20.0 THEN -0.3 ELSE 0.5 END + CASE WHEN dest_age_days <= 90.0 THEN 0.7 ELSE -0.2 END AS margin FROM b
)"""


def aged(facts: DataFrame) -> DataFrame:
    return facts.withColumn("dest_age_days", F.coalesce((F.col("event_time") - F.col("dest_first_seen")) / 86400000.0, F.lit(0.0)))


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every payment with its destination's facts before it, the fixed ensemble's score and band."""
    engine, events = _engine(spark, sf_dir)
    facts = aged(asof.destination_block(events, engine.legs, ("sender", "destination", "cents", "event_time")))
    score = trees.probability(trees.margin(trees.FIXED_MODEL))
    return facts.withColumn("score", F.round(score, 9)).withColumn("band", trees.bands(F.col("score"), trees.FIXED_MODEL["thresholds"]))


@query("j6_tree_score", SCORED_SQL + """ SELECT event_id, round(1 / (1 + exp(-margin)), 9) AS score,
CASE WHEN round(1 / (1 + exp(-margin)), 9) >= 0.7 THEN 'high' WHEN round(1 / (1 + exp(-margin)), 9) >= 0.5 THEN 'elevated' ELSE 'ordinary' END AS band FROM scored""")
def j6_tree_score(spark, sf_dir):
    return scored_events(spark, sf_dir).select("event_id", "score", "band")


LABELLED = " , l AS (SELECT round(1 / (1 + exp(-margin)), 9) AS score, CAST(CAST(substr(destination, 2) AS BIGINT) % 7 = 0 AS BIGINT) AS label FROM scored)"


def _labelled(spark, sf_dir):
    return scored_events(spark, sf_dir).select("score", (F.substring("destination", 2, 20).cast("long") % 7 == 0).cast("long").alias("label"))


@query("k3_ranking_metrics", SCORED_SQL + LABELLED + """, r AS (SELECT label, (rank() OVER (ORDER BY score) + rank() OVER (ORDER BY score) + count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM l
), c AS (SELECT score, sum(label) AS p, count(*) AS n FROM l GROUP BY 1), s AS (SELECT p, sum(p) OVER w AS tp, sum(n) OVER w AS every FROM c WINDOW w AS (ORDER BY score DESC))
SELECT CAST(sum(label) AS BIGINT) AS n_pos, CAST(count(*) - sum(label) AS BIGINT) AS n_neg,
  round((sum(rk) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))), 9) AS roc_auc,
  (SELECT round(sum(p * tp / every) / sum(p), 9) FROM s) AS average_precision FROM r""")
def k3_ranking_metrics(spark, sf_dir):
    out = metrics.ranking_metrics(_labelled(spark, sf_dir))
    return out.select("n_pos", "n_neg", F.round("roc_auc", 9).alias("roc_auc"), F.round("average_precision", 9).alias("average_precision"))


REPORTS_SQL = """ SELECT address, chain, count(DISTINCT source) AS n_sources, max(weight) AS max_weight, string_agg(DISTINCT source, ',' ORDER BY source) AS sources,
  CAST(min(reported_at) AS BIGINT) AS first_reported_at, count(DISTINCT source) >= 2 OR max(weight) >= 1.0 AS accepted FROM reports GROUP BY 1, 2"""


@query("d11_label_aggregate", REPORTS_SQL)
def d11_label_aggregate(spark, sf_dir):
    rows = D.scam_reports(spark, sf_dir)
    out = rows.groupBy("address", "chain").agg(F.count_distinct("source").alias("n_sources"), F.max("weight").alias("max_weight"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.min("reported_at").alias("first_reported_at"))
    return out.withColumn("accepted", (F.col("n_sources") >= 2) | (F.col("max_weight") >= 1.0))


@query("a24_prices", "SELECT epoch(date_trunc('day', o_orderdate))::BIGINT AS day, floor(CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*)) / 100.0 AS close FROM orders GROUP BY 1".replace("SELECT", "/* plain */ SELECT", 1))
def a24_prices(spark, sf_dir):
    return D.prices(spark, sf_dir)


@query("e5_transfer_position", " SELECT event_id, transfer_k FROM (SELECT event_id, CAST(row_number() OVER (PARTITION BY sender, destination ORDER BY event_time, event_id) AS INTEGER) AS transfer_k FROM ev) WHERE transfer_k <= 10")
def e5_transfer_position(spark, sf_dir):
    return L.transfer_position(L.payments_as_events(D.derive_transfers(spark, sf_dir))).select("event_id", "transfer_k")
