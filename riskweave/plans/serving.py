"""Queries of sections A, C, K and L: prices, normalised raw rows, profiles, verdicts and the ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.operators import ledger, profile, prices
from riskweave.operators import legs as L
from riskweave.operators import normalise as N
from riskweave.sources import driver_tables as D

from .catalog import SWEEP_SQL, query

AS_OF = 852_076_800_000  # 1997-01-01


def _profile_sql(as_of: str, rows: str, sweep: str) -> str:
    return f"""{SWEEP_SQL}, l AS ({rows}), pp AS (SELECT address, peer, sum(cents) AS v FROM l WHERE side = 'out' GROUP BY 1, 2), cons AS (SELECT address, max(v) / sum(v) AS consolidation_ratio FROM pp GROUP BY 1
), held AS (SELECT address, median(hold_ms) / 1000 AS median_hold_secs FROM ({sweep}) WHERE hold_ms IS NOT NULL GROUP BY 1
), fact AS (SELECT address, any_value(until) AS until, count(*) FILTER (side = 'in') AS inbound_count, count(*) FILTER (side = 'out') AS outbound_count, count(DISTINCT peer) FILTER (side = 'in') AS senders_all, count(DISTINCT peer) FILTER (side = 'out') AS payees_all,
  coalesce(CAST(sum(cents) FILTER (side = 'in') AS BIGINT), 0) AS inbound_cents, coalesce(CAST(sum(cents) FILTER (side = 'out') AS BIGINT), 0) AS outbound_cents, CAST(min(block_time) AS BIGINT) AS first_seen, CAST(max(block_time) AS BIGINT) AS last_seen,
  count(DISTINCT peer) FILTER (side = 'in' AND block_time >= until - 604800000) AS senders_7d, count(DISTINCT peer) FILTER (side = 'in' AND block_time >= until - 2592000000) AS senders_30d FROM l GROUP BY 1
), prof AS (SELECT address, inbound_count, outbound_count, senders_all, payees_all, inbound_cents, outbound_cents, first_seen, last_seen, senders_7d, senders_30d, median_hold_secs, consolidation_ratio, round((until - first_seen) / 86400000.0, 1) AS age_days,
  CASE WHEN inbound_cents > 0 THEN round(outbound_cents / inbound_cents, 3) END AS forward_ratio, CASE WHEN senders_all > 0 THEN round(inbound_cents / senders_all) / 100 END AS usd_per_sender FROM fact LEFT JOIN held USING (address) LEFT JOIN cons USING (address))"""


AT = _profile_sql("", f"SELECT *, {AS_OF} AS until FROM legs WHERE block_time < {AS_OF}", f"SELECT * FROM sweep WHERE block_time < {AS_OF}")
LAST = _profile_sql("", "SELECT legs.*, until FROM legs JOIN (SELECT address, max(block_time) AS until FROM legs GROUP BY 1) USING (address)", "SELECT * FROM sweep")
COLUMNS = "SELECT * REPLACE (round(median_hold_secs, 3) AS median_hold_secs, round(consolidation_ratio, 9) AS consolidation_ratio) FROM prof"


def _legs(spark, sf_dir):
    return L.legs(L.clean(D.derive_transfers(spark, sf_dir)))


def _shown(rows):
    return rows.withColumns({"median_hold_secs": F.round("median_hold_secs", 3), "consolidation_ratio": F.round("consolidation_ratio", 9)})


@query("l3_profiles", AT + COLUMNS)
def l3_profiles(spark, sf_dir):
    legs = _legs(spark, sf_dir)
    return _shown(profile.profiles(legs, L.sweep(legs), AS_OF))


@query("l7_address_index", LAST + COLUMNS)
def l7_address_index(spark, sf_dir):
    legs = _legs(spark, sf_dir)
    return _shown(profile.profiles(legs, L.sweep(legs)))


@query("l4_verdicts", AT + """, pt AS (SELECT *, coalesce(usd_per_sender, 0) >= 1000000 OR inbound_cents >= 10000000000 AS big, coalesce(age_days, 0) AS age,
  (senders_all >= 5)::INT + (age_days > 0 AND age_days <= 60)::INT + coalesce(forward_ratio >= 0.85, false)::INT + coalesce(consolidation_ratio >= 0.6, false)::INT + coalesce(median_hold_secs BETWEEN 0 AND 3600, false)::INT + (inbound_count / greatest(outbound_count, 1) >= 2)::INT AS p FROM prof)
SELECT address, CASE WHEN big THEN 0 ELSE p END AS points, CASE WHEN big THEN 'institutional infrastructure, not a retail collector' WHEN age >= 365 AND p < 5 AND p >= 3 THEN 'some collection-like behaviour, but long-lived' WHEN age >= 365 AND p < 5 THEN 'no clear collection pattern'
  WHEN p >= 4 THEN 'behaves like a collection address' WHEN p >= 2 THEN 'some collection-like behaviour' ELSE 'no collection-like pattern' END AS verdict, CASE WHEN big THEN 1 ELSE p END AS n_notes FROM pt""")
def l4_verdicts(spark, sf_dir):
    legs = _legs(spark, sf_dir)
    return profile.verdicts(profile.profiles(legs, L.sweep(legs), AS_OF)).select("address", "points", "verdict", F.size("notes").alias("n_notes"))


CANDLES = """, candles AS (SELECT epoch(date_trunc('day', o_orderdate))::BIGINT AS day, floor(CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*)) / 100.0 AS close FROM orders WHERE o_orderdate >= TIMESTAMP '1994-01-01' GROUP BY 1)"""


def _candles(spark, sf_dir):
    return D.prices(spark, sf_dir).where("day >= 757382400")


@query("c9_price_as_of", CANDLES + " SELECT tx_hash, close AS price FROM tx ASOF LEFT JOIN (SELECT day + 86400 AS closed, close FROM candles) c ON c.closed <= block_time // 1000")
def c9_price_as_of(spark, sf_dir):
    return prices.price_as_of(D.derive_transfers(spark, sf_dir), _candles(spark, sf_dir)).select("tx_hash", "price")


def _s(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


@query("a13_tron_rows", " SELECT tx_hash, from_address, to_address, cents * 10000 / power(10.0, 6) AS amount_usd, 'USDT' AS asset, CAST(block_time AS BIGINT) AS block_time FROM tx WHERE cents % 7 <> 0 AND cents % 5 <> 0 AND cents % 11 <> 0 AND cents % 13 <> 0")
def a13_tron_rows(spark, sf_dir):
    tx = D.derive_transfers(spark, sf_dir)
    c = F.col("cents")
    info = F.struct(F.when(c % 5 == 0, "SCAM").when(c % 2 == 0, "usdt").otherwise("USDT").alias("symbol"), F.when(c % 13 == 0, F.lit("six")).when(c % 3 == 0, F.lit("6")).alias("decimals"))
    raw = tx.select(F.to_json(F.struct(F.when(c % 7 == 0, "Approval").otherwise("Transfer").alias("type"), F.col("tx_hash").alias("transaction_id"), F.col("from_address").alias("from"), F.col("to_address").alias("to"), F.when(c % 11 == 0, "x").otherwise((c * 10000).cast("string")).alias("value"), F.col("block_time").alias("block_timestamp"), info.alias("token_info"))).alias("raw"))
    return N.tron_transfers(raw, valid=lambda a: a.rlike("^[CSH][0-9]+$")).drop("chain")


@query("a14_blockscout_rows", " SELECT tx_hash, lower(from_address) AS from_address, lower(to_address) AS to_address, CAST(cents || '0000' AS DOUBLE) / power(10.0, CASE WHEN cents % 13 = 0 THEN 18 WHEN cents % 3 = 0 THEN 8 ELSE 6 END) AS amount_usd, 'USDC' AS asset, CAST(block_time // 1000 * 1000 AS BIGINT) AS block_time FROM tx WHERE cents % 5 <> 0")
def a14_blockscout_rows(spark, sf_dir):
    tx = D.derive_transfers(spark, sf_dir)
    iso = F.date_format(F.timestamp_millis("block_time"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    party = lambda c: F.struct(F.col(c).alias("hash"))
    raw = tx.select(F.to_json(F.struct(F.col("tx_hash").alias("transaction_hash"), iso.alias("timestamp"), party("from_address").alias("from"), party("to_address").alias("to"), F.struct((F.col("cents") * 10000).cast("string").alias("value"), F.when((F.col("cents") % 3 != 0) & (F.col("cents") % 13 != 0), F.lit("6")).alias("decimals")).alias("total"), F.struct(F.when(F.col("cents") % 5 == 0, "XYZ").otherwise("USDC").alias("symbol"), F.when(F.col("cents") % 13 != 0, F.lit("8")).alias("decimals")).alias("token"))).alias("raw"))
    return N.blockscout_transfers(raw).drop("chain")


@query("a15_etherscan_tokens", " SELECT tx_hash, lower(from_address) AS from_address, lower(to_address) AS to_address, CAST(cents AS DOUBLE) / power(10.0, 2) AS amount_usd, CASE WHEN cents % 2 = 0 THEN 'AAA' ELSE 'BBB' END AS asset, CAST(block_time // 1000 * 1000 AS BIGINT) AS block_time FROM tx WHERE cents % 3 <> 0")
def a15_etherscan_tokens(spark, sf_dir):
    tx = D.derive_transfers(spark, sf_dir)
    c = F.col("cents")
    contract = F.when(c % 3 == 0, "0xFAKE").when(c % 2 == 0, "0xAa").otherwise("0xBb")
    raw = tx.select(F.to_json(F.struct(F.col("tx_hash").alias("hash"), F.expr("cast(block_time div 1000 as string)").alias("timeStamp"), F.col("from_address").alias("from"), F.col("to_address").alias("to"), c.cast("string").alias("value"), contract.alias("contractAddress"))).alias("raw"))
    known = spark.createDataFrame([("0xaa", "AAA", 2), ("0xbb", "BBB", 2)], "contract string, asset string, decimals int")
    return N.etherscan_tokens(raw, known).drop("chain")


@query("a16_etherscan_native", CANDLES + " SELECT tx_hash, lower(from_address) AS from_address, lower(to_address) AS to_address, CAST(cents || '0000000000000000' AS DOUBLE) / power(10.0, 18) * close AS amount_usd, CAST(block_time // 1000 * 1000 AS BIGINT) AS block_time FROM tx ASOF JOIN (SELECT day + 86400 AS closed, close FROM candles) c ON c.closed <= block_time // 1000 WHERE cents > 0 AND cents % 4 <> 0")
def a16_etherscan_native(spark, sf_dir):
    tx = D.derive_transfers(spark, sf_dir)
    raw = tx.select(F.to_json(F.struct(F.col("tx_hash").alias("hash"), F.expr("cast(block_time div 1000 as string)").alias("timeStamp"), F.col("from_address").alias("from"), F.col("to_address").alias("to"), _s(F.col("cents"), "0000000000000000").alias("value"), F.when(F.col("cents") % 4 == 0, "1").otherwise("0").alias("isError"))).alias("raw"))
    return N.etherscan_native(raw, _candles(spark, sf_dir)).drop("chain", "asset")


@query("a22_log_addresses", " SELECT '0x' || lpad(lower(to_hex(s_suppkey)), 40, '0') AS address, CAST(1000000000 + s_suppkey AS BIGINT) * 1000 AS block_time FROM supplier")
def a22_log_addresses(spark, sf_dir):
    s = D.table(spark, sf_dir, "supplier").select(F.concat(F.lit("0x"), F.lpad(F.hex("s_suppkey"), 64, "0")).alias("data"), F.concat(F.lit("0x"), F.hex(F.col("s_suppkey") + 1000000000)).alias("time"))
    return N.log_addresses(s)


@query("a9_sanctioned", " SELECT DISTINCT 'XBT' AS currency, lpad(CAST(s_suppkey AS VARCHAR), 30, 'A') AS address FROM supplier")
def a9_sanctioned(spark, sf_dir):
    s = D.table(spark, sf_dir, "supplier").select(_s("entity; Digital Currency Address - XBT ", F.lpad(F.col("s_suppkey").cast("string"), 30, "A"), "; alt. Digital Currency Address - XBT ", F.lpad(F.col("s_suppkey").cast("string"), 30, "A"), ";").alias("value"))
    return N.sanctioned(s)


@query("a10_listed", " SELECT DISTINCT 'ethereum' AS chain, '0x' || md5('a' || s_suppkey) || '00000000' AS address FROM supplier")
def a10_listed(spark, sf_dir):
    s = D.table(spark, sf_dir, "supplier").select(_s("- address: 0x", F.upper(F.md5(_s("a", F.col("s_suppkey")))), "00000000 # seen, and TXYZ").alias("value"))
    return N.listed(s)


@query("a21_earliest_freezes", " , f AS (SELECT to_address AS address, block_time, tx_hash FROM tx WHERE cents % 3 = 0 UNION ALL SELECT to_address, block_time - 1000, tx_hash FROM tx WHERE cents % 5 = 0) SELECT address, CAST(min(block_time) AS BIGINT) AS block_time, arg_min(tx_hash, (block_time, tx_hash)) AS tx_hash FROM f GROUP BY 1")
def a21_earliest_freezes(spark, sf_dir):
    tx = D.derive_transfers(spark, sf_dir).select(F.col("to_address").alias("address"), "block_time", "tx_hash", "cents")
    old, new = tx.where("cents % 3 = 0").drop("cents"), tx.where("cents % 5 = 0").withColumn("block_time", F.col("block_time") - 1000).drop("cents")
    return N.earliest(old, new)


@query("a26_usage_tally", "SELECT CAST(epoch_ms(ts) // 86400000 AS BIGINT) AS day, event_type AS band, count(*) AS calls, count(DISTINCT user_id) AS browsers FROM events GROUP BY 1, 2".replace("SELECT", "/* plain */ SELECT", 1))
def a26_usage_tally(spark, sf_dir):
    rows = D.table(spark, sf_dir, "events").select(F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz)) div 86400000").alias("day"), F.col("event_type").alias("band"), F.col("user_id").alias("who"))
    return N.usage_tally(rows)


LOG = """, p AS (SELECT 'S' || s_suppkey AS address, 852076800000 + s_suppkey * 13 % 200 * 86400000 AS predicted_at FROM supplier WHERE s_suppkey % 2 = 1), fz AS (SELECT address, CAST(min(reported_at) AS BIGINT) AS frozen_at FROM reports WHERE reported_at IS NOT NULL GROUP BY 1),
res AS (SELECT address, predicted_at, frozen_at, (frozen_at - predicted_at) / 86400000.0 AS lead_days FROM p JOIN fz USING (address))"""


def _log(spark, sf_dir):
    p = D.table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 1").select(_s("S", F.col("s_suppkey")).alias("address"), (F.col("s_suppkey") * 13 % 200 * D.DAY + 852076800000).cast("long").alias("predicted_at"))
    return p, D.scam_reports(spark, sf_dir).where("reported_at is not null").select("address", F.col("reported_at").alias("block_time"))


@query("l10_resolve", LOG + " SELECT address, CAST(predicted_at AS BIGINT) AS predicted_at, frozen_at, round(lead_days, 6) AS lead_days, lead_days > 0 AS valid FROM res")
def l10_resolve(spark, sf_dir):
    return ledger.resolve(*_log(spark, sf_dir)).withColumn("lead_days", F.round("lead_days", 6))


@query("l11_report", LOG + """, g AS (SELECT p.address, CASE WHEN (868000000000 - p.predicted_at) / 86400000.0 >= 90 THEN '90+' WHEN (868000000000 - p.predicted_at) / 86400000.0 >= 30 THEN '30-90' ELSE '<30' END AS cohort, lead_days FROM p LEFT JOIN (SELECT * FROM res WHERE lead_days > 0) r USING (address))
SELECT cohort, count(*) AS predictions, count(lead_days) AS hits, CASE WHEN cohort <> '<30' THEN round(count(lead_days) / count(*), 9) END AS rate, round(median(lead_days), 6) AS median_lead_days FROM g GROUP BY 1""")
def l11_report(spark, sf_dir):
    p, freezes = _log(spark, sf_dir)
    out = ledger.report(p, ledger.resolve(p, freezes), 868_000_000_000)
    return out.withColumns({"rate": F.round("rate", 9), "median_lead_days": F.round("median_lead_days", 6)})


@query("l8_verify", """ , s AS (SELECT s_suppkey AS seq, 'entry ' || s_suppkey AS payload FROM supplier), h AS (SELECT seq, payload, sha256(coalesce(repeat('0', 64), '') || payload) AS own FROM s)
, c AS (SELECT seq, own, CASE WHEN seq = 0 THEN repeat('0', 64) ELSE (SELECT p.own FROM h p WHERE p.seq = h.seq - 1) END AS want FROM h)
, bad AS (SELECT seq, CASE WHEN want IS DISTINCT FROM repeat('0', 64) THEN 'chain' WHEN own <> sha256(repeat('0', 64) || 'entry ' || seq) THEN 'content' END AS problem FROM c)
SELECT count(*) AS entries, CAST(min(seq) FILTER (problem IS NOT NULL) AS BIGINT) AS first_bad, arg_min(problem, seq) FILTER (problem IS NOT NULL) AS problem, (SELECT own FROM h ORDER BY seq DESC LIMIT 1) AS head FROM bad""")
def l8_verify(spark, sf_dir):
    """A log whose entries all hang on the genesis: the second breaks the chain."""
    rows = D.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("seq"), F.lit(ledger.GENESIS).alias("prev"), _s("entry ", F.col("s_suppkey")).alias("payload"))
    return ledger.verify(rows.withColumn("hash", ledger.entry_hash(F.col("prev"), F.col("payload"))))
