"""Queries of sections B to E, I and K: lead times, payments in them, prevalence, address-level reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators import leadtime as T
from riskweave.operators import legs as L
from riskweave.operators import metrics as M
from riskweave.sources import driver_tables as D

from .catalog import query
from .evaluation import BASE, rounded, scored

HORIZONS = [7, 30, 90, 365, 1095, 1825]
FAMILIES = {f"f{i}": ("sender", "destination", "pair")[i % 3] for i in range(9)}


def number(c: str = "address"):
    return F.substring(c, 2, 20).cast("long")


PROBES = """, frz AS (SELECT address, CAST(min(reported_at) AS BIGINT) AS frozen_at FROM reports WHERE reported_at IS NOT NULL GROUP BY 1
), spn AS (SELECT *, first_seen + 1500 * 86400000::BIGINT AS last_seen, CAST(substr(address, 2) AS BIGINT) % 5 = 0 AS truncated FROM (SELECT address, CAST(min(block_time) AS BIGINT) AS first_seen FROM legs GROUP BY 1)
), pr AS (
  SELECT *, ((t // 86400000) * 37 + CAST(substr(address, 2) AS BIGINT) * 11) % 1000 / 1000.0::DOUBLE AS score FROM (
    SELECT address, horizon, frozen_at, CAST(frozen_at - horizon::BIGINT * 86400000 AS BIGINT) AS t, first_seen, last_seen, truncated FROM frz JOIN spn USING (address), (SELECT unnest([7, 30, 90, 365, 1095, 1825]) AS horizon)
  ) WHERE t > first_seen AND NOT (truncated AND t > last_seen)
), ld AS (SELECT address, max(horizon) FILTER (score >= 0.5) AS lead_days, bool_or(score >= 0.5) AS ever_high FROM pr GROUP BY 1
), inw AS (SELECT tx_hash, cents, p.* FROM tx JOIN pr p ON to_address = address AND block_time > t AND block_time <= frozen_at WHERE horizon = 90 AND cents > 0)"""


def _frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.scam_reports(spark, sf_dir).where("reported_at is not null").groupBy("address").agg(F.min("reported_at").alias("frozen_at"))


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes of the dated labels; every fifth address's history ends after 1500 days. The score is a plain function of the probe."""
    spans = L.spans(L.legs(L.clean(D.derive_transfers(spark, sf_dir)))).select("address", "first_seen", (F.col("first_seen") + 1500 * T.DAY).alias("last_seen"), (number() % 5 == 0).alias("truncated"))
    score = (F.expr(f"t div {T.DAY}") * 37 + number() * 11) % 1000 / 1000.0
    return T.probes(_frozen(spark, sf_dir), spans, HORIZONS).withColumn("score", score)


@query("b11_probes", PROBES + " SELECT address, horizon, frozen_at, t FROM pr")
def b11_probes(spark, sf_dir):
    return _probes(spark, sf_dir).drop("score")


@query("d22_lead_times", PROBES + " SELECT address, lead_days, ever_high FROM ld")
def d22_lead_times(spark, sf_dir):
    return T.lead_times(_probes(spark, sf_dir), 0.5)


@query("k18_horizon_rates", PROBES + " SELECT horizon, count(*) AS n, round(avg(CAST(score >= 0.5 AS INT)), 9) AS high, round(avg(CAST(score >= 0.2 AS INT)), 9) AS elevated FROM pr GROUP BY 1")
def k18_horizon_rates(spark, sf_dir):
    return rounded(T.horizon_rates(_probes(spark, sf_dir), {"high": 0.5, "elevated": 0.2}))


@query("k19_lead_report", PROBES + """, s AS (SELECT list_sort(list(lead_days)) AS x FROM ld WHERE lead_days IS NOT NULL)
SELECT count(*) AS addresses, count(*) FILTER (ever_high) AS flagged, round(count(*) FILTER (ever_high) / count(*), 9) AS rate, median(lead_days)::DOUBLE AS median,
  (SELECT x[CAST(floor(0.25::DOUBLE * (len(x) - 1) + 0.5::DOUBLE) AS BIGINT) + 1] FROM s) AS p25, (SELECT x[CAST(floor(0.75::DOUBLE * (len(x) - 1) + 0.5::DOUBLE) AS BIGINT) + 1] FROM s) AS p75, max(lead_days) AS most FROM ld""")
def k19_lead_report(spark, sf_dir):
    return rounded(T.lead_report(T.lead_times(_probes(spark, sf_dir), 0.5)))


def _window(spark, sf_dir):
    probed = _probes(spark, sf_dir).where("horizon = 90")
    return probed, T.payments_in_window(L.clean(D.derive_transfers(spark, sf_dir)), probed)


@query("c16_payments_in_window", PROBES + " SELECT tx_hash, address, CAST(cents AS BIGINT) AS cents, t, frozen_at FROM inw")
def c16_payments_in_window(spark, sf_dir):
    return _window(spark, sf_dir)[1].select("tx_hash", "address", "cents", "t", "frozen_at")


@query("k20_payment_recall", PROBES + """, p90 AS (SELECT address, score, (SELECT count(*) FROM inw i WHERE i.address = pr.address) AS paid FROM pr WHERE horizon = 90)
SELECT threshold, count(*) AS addresses, CAST(sum(paid) AS BIGINT) AS payments, round(count(*) FILTER (score >= threshold) / count(*), 9) AS address_recall, round(coalesce(sum(paid) FILTER (score >= threshold), 0) / greatest(sum(paid), 1), 9) AS payment_recall
FROM p90, (SELECT unnest([0.2, 0.4, 0.6, 0.8])::DOUBLE AS threshold) GROUP BY 1""")
def k20_payment_recall(spark, sf_dir):
    return rounded(T.payment_recall(*_window(spark, sf_dir), [0.2, 0.4, 0.6, 0.8]))


@query("i19_unseen_freezes", PROBES + """ SELECT address, frozen_at FROM frz WHERE frozen_at > 870000000000 AND CAST(substr(address, 2) AS BIGINT) % 14 <> 0
AND address NOT IN (SELECT destination FROM ev WHERE cents > 10440000) AND address NOT IN (SELECT sender FROM ev WHERE cents > 10440000)""")
def i19_unseen_freezes(spark, sf_dir):
    frozen = _frozen(spark, sf_dir)
    events = L.payments_as_events(D.derive_transfers(spark, sf_dir)).where("cents > 10440000")
    return T.unseen_freezes(frozen, [frozen.where(number() % 14 == 0).select("address"), events.select("destination"), events.select("sender")], 870000000000)


@query("i13_age_balanced", BASE + """, ag AS (SELECT event_id, label, (event_time - min(event_time) OVER (PARTITION BY destination)) / 86400000 AS age FROM sc
), bn AS (SELECT event_id, label, 'b' || ((age > 7)::INT + (age > 30)::INT + (age > 90)::INT + (age > 365)::INT + (age > 1095)::INT) AS age_bin FROM ag
), nd AS (SELECT age_bin, count(*) * 3 AS need FROM bn WHERE label = 1 GROUP BY 1)
SELECT event_id, label, age_bin FROM bn WHERE label = 1 UNION ALL
SELECT event_id, label, age_bin FROM (SELECT bn.*, need FROM bn JOIN nd USING (age_bin) WHERE label = 0 QUALIFY row_number() OVER (PARTITION BY age_bin ORDER BY md5('17|' || event_id), event_id) <= need)""")
def i13_age_balanced(spark, sf_dir):
    rows = scored(spark, sf_dir)
    first = rows.groupBy("destination").agg(F.min("event_time").alias("since"))
    aged = rows.join(first, "destination").select("event_id", "label", ((F.col("event_time") - F.col("since")) / T.DAY).alias("age"))
    return T.age_balanced(aged, "age").select("event_id", "label", "age_bin")


@query("k21_prevalence", """, r AS (SELECT to_address, to_address IN (SELECT address FROM reports WHERE reported_at IS NOT NULL) AS hit FROM tx)
SELECT count(*) AS receipts, count(DISTINCT to_address) AS addresses, count(*) FILTER (hit) AS listed_receipts, count(DISTINCT to_address) FILTER (hit) AS listed_addresses,
  round(count(DISTINCT to_address) FILTER (hit) / count(DISTINCT to_address), 9) AS prevalence_address, round(count(*) FILTER (hit) / count(*), 9) AS prevalence_receipt, round(3 / count(DISTINCT to_address), 9) AS upper_95 FROM r""")
def k21_prevalence(spark, sf_dir):
    return rounded(T.prevalence(D.derive_transfers(spark, sf_dir), _frozen(spark, sf_dir)))


ADDRESSES = """, ad AS (SELECT destination AS address, max(label) AS label, avg(cents % 1000) AS score FROM sc WHERE CAST(substr(destination, 2) AS BIGINT) % 3 <> 0 GROUP BY 1)"""


@query("k24_address_report", BASE + ADDRESSES + """, dn AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM ad GROUP BY 1
), cu AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM dn)
SELECT CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg, round((SELECT avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END) FROM ad p, ad n WHERE p.label = 1 AND n.label = 0), 9) AS roc_auc,
  round(sum(pos * tp / (tp + fp)) / sum(pos), 9) AS average_precision, round(sum(pos) / (sum(pos) + sum(neg)), 9) AS base_rate,
  round((SELECT median(score) FROM ad WHERE label = 1), 9) AS median_scam, round((SELECT median(score) FROM ad WHERE label = 0), 9) AS median_control FROM cu""")
def k24_address_report(spark, sf_dir):
    per = scored(spark, sf_dir).groupBy(F.col("destination").alias("address")).agg(F.max("label").alias("label"), F.avg(F.col("cents") % 1000).alias("score"))
    return rounded(T.address_report(per, per.where(number() % 3 == 0).select("address")))


@query("k25_latency", """, l AS (SELECT list_sort(list(cents % 10007)) AS x, count(*) AS n, median(cents % 10007) AS p50 FROM ev)
SELECT n, p50::DOUBLE AS p50, CAST(x[CAST(floor(n * 0.95::DOUBLE) AS BIGINT) + 1] AS BIGINT) AS p95, CAST(x[CAST(floor(n * 0.99::DOUBLE) AS BIGINT) + 1] AS BIGINT) AS p99, CAST(x[n] AS BIGINT) AS most FROM l""")
def k25_latency(spark, sf_dir):
    return T.latency(L.payments_as_events(D.derive_transfers(spark, sf_dir)).withColumn("ms", F.col("cents") % 10007), "ms")


@query("d17_balance", BASE + """ SELECT CAST(label AS INTEGER) AS label, 'cents' AS covariate, count(*) AS n, median(cents)::DOUBLE AS median FROM sc GROUP BY 1
UNION ALL SELECT CAST(label AS INTEGER), 'transfer_k', count(*), median(transfer_k)::DOUBLE FROM sc GROUP BY 1""")
def d17_balance(spark, sf_dir):
    return T.balance(scored(spark, sf_dir), ["cents", "transfer_k"])


@query("d18_band_tally", BASE + " SELECT label, count(*) FILTER (score < 0.3) AS ordinary, count(*) FILTER (score >= 0.3 AND score < 0.7) AS elevated, count(*) FILTER (score >= 0.7) AS high FROM sc GROUP BY 1")
def d18_band_tally(spark, sf_dir):
    band = F.when(F.col("score") >= 0.7, "high").when(F.col("score") >= 0.3, "elevated").otherwise("ordinary")
    return scored(spark, sf_dir).withColumn("band", band).groupBy("label").pivot("band", ["ordinary", "elevated", "high"]).count().na.fill(0)


@query("e12_nearest_edges", BASE + """ SELECT event_id, round(score, 9) AS score, round(edge_distance, 9) AS edge_distance FROM (
SELECT *, least(abs(score - 0.4::DOUBLE), abs(score - 0.7::DOUBLE)) AS edge_distance FROM sc) ORDER BY least(abs(score - 0.4::DOUBLE), abs(score - 0.7::DOUBLE)), event_id LIMIT 400""")
def e12_nearest_edges(spark, sf_dir):
    return rounded(T.nearest_edges(scored(spark, sf_dir), [0.4, 0.7]).select("event_id", "score", "edge_distance"))


@query("k7_family_gain", """, g AS (SELECT CASE WHEN cents % 12 > 8 THEN 'other' ELSE (['sender', 'destination', 'pair'])[cents % 12 % 3 + 1] END AS family, CAST(sum(cents) AS BIGINT) AS gain FROM ev GROUP BY 1)
SELECT family, gain, round(gain / (SELECT sum(gain) FROM g), 9) AS share FROM g""")
def k7_family_gain(spark, sf_dir):
    gains = L.payments_as_events(D.derive_transfers(spark, sf_dir)).groupBy(F.concat(F.lit("f"), F.col("cents") % 12).alias("feature")).agg(F.sum("cents").alias("gain"))
    return rounded(T.family_gain(gains, FAMILIES))


@query("k13_resampled_detection")
def k13_resampled_detection(spark, sf_dir):
    """No SQL: the bounds are percentiles of 400 seeded resamples; tested against drawing the units themselves."""
    rows = scored(spark, sf_dir)
    return T.resampled(M.early_detection(rows, M.thresholds_at_fpr(rows, [0.01])).drop("rate"), "flagged", "victims")
