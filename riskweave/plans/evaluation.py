"""Queries of section K: metrics of scored payments. Scores are a plain function of the payment, so that SQL has the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.operators import legs as L
from riskweave.operators import metrics as M
from riskweave.operators import trees
from riskweave.sources import driver_tables as D

from .catalog import query

BUDGETS = [0.005, 0.01, 0.02, 0.05, 0.1]


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten payments of each pair with label (a supplier whose key divides by 7) and a score."""
    rows = L.transfer_position(L.payments_as_events(D.derive_transfers(spark, sf_dir)))  # before columns that follow from others, which would be moved too
    rows = rows.withColumn("label", (F.substring("destination", 2, 20).cast("long") % 7 == 0).cast("long"))
    return rows.withColumn("score", (F.col("cents") % 1000 + 250 * F.col("label") * (F.col("cents") % 2)) / 1250.0)


BASE = """, sc AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY sender, destination ORDER BY event_time, event_id) AS INTEGER) AS transfer_k, (cents % 1000 + 250 * label * (cents % 2)) / 1250.0 AS score
  FROM (SELECT *, CAST(CAST(substr(destination, 2) AS BIGINT) % 7 = 0 AS BIGINT) AS label FROM ev)
  QUALIFY transfer_k <= 10
), budgets AS (SELECT unnest([0.005, 0.01, 0.02, 0.05, 0.1])::DOUBLE AS budget
), marks AS (
  SELECT budget, coalesce((SELECT min(score) FROM (SELECT score, sum(count(*)) OVER (ORDER BY score DESC) AS upto FROM sc WHERE label = 0 GROUP BY score) WHERE upto <= budget * (SELECT count(*) FROM sc WHERE label = 0)),
    (SELECT max(score) FROM sc WHERE label = 0), 0.5) AS threshold FROM budgets
), conf AS (
  SELECT budget, threshold, count(*) FILTER (score >= threshold AND label = 1) AS tp, count(*) FILTER (score >= threshold AND label = 0) AS fp,
    count(*) FILTER (score < threshold AND label = 0) AS tn, count(*) FILTER (score < threshold AND label = 1) AS fn FROM sc, marks GROUP BY 1, 2
), rates AS (
  SELECT *, tp / greatest(tp + fp, 1) AS precision, tp / greatest(tp + fn, 1) AS recall, fp / greatest(fp + tn, 1) AS fpr FROM conf
), firsts AS (
  SELECT budget, threshold, sender, destination, min(transfer_k) FILTER (score >= threshold) AS first FROM sc, marks WHERE label = 1 GROUP BY 1, 2, 3, 4
), prot AS (
  SELECT budget, CAST(sum(cents) AS BIGINT) AS total_cents, CAST(coalesce(sum(cents) FILTER (transfer_k >= first), 0) AS BIGINT) AS protected_cents,
    count(DISTINCT (sender, destination)) FILTER (first IS NOT NULL) AS victims_ever_flagged, count(DISTINCT (sender, destination)) AS victims_total, count(*) AS events
  FROM sc JOIN firsts USING (sender, destination) WHERE label = 1 GROUP BY 1
)"""


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*(F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema))


@query("k1_thresholds", BASE + " SELECT budget, round(threshold, 9) AS threshold FROM marks")
def k1_thresholds(spark, sf_dir):
    return rounded(M.thresholds_at_fpr(scored(spark, sf_dir), BUDGETS))


@query("k2_confusion", BASE + " SELECT budget, round(threshold, 9) AS threshold, tp, fp, tn, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(fpr, 9) AS fpr FROM rates")
def k2_confusion(spark, sf_dir):
    rows = scored(spark, sf_dir)
    return rounded(M.confusion(rows, M.thresholds_at_fpr(rows, BUDGETS)))


@query("k5_early_detection", BASE + """ SELECT budget, CAST(k AS INTEGER) AS k, count(*) AS victims, count(*) FILTER (first <= k) AS flagged, round(count(*) FILTER (first <= k) / count(*), 9) AS rate
FROM firsts, (SELECT unnest([1, 2, 3, 5]) AS k) GROUP BY 1, 2""")
def k5_early_detection(spark, sf_dir):
    rows = scored(spark, sf_dir)
    return rounded(M.early_detection(rows, M.thresholds_at_fpr(rows, BUDGETS)))


@query("k6_protected", BASE + " SELECT budget, total_cents, protected_cents, victims_ever_flagged, victims_total FROM prot")
def k6_protected(spark, sf_dir):
    rows = scored(spark, sf_dir)
    return M.protected(rows, M.thresholds_at_fpr(rows, BUDGETS)).select("budget", "total_cents", "protected_cents", "victims_ever_flagged", "victims_total")


@query("k8_reliability", BASE + """, e AS (SELECT list_distinct(quantile_cont(score, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS u FROM sc), s AS (SELECT list_sort(u) AS edges FROM e),
b AS (SELECT CAST(i AS INTEGER) AS bin, edges[i] AS lo, edges[i + 1] AS hi FROM s, (SELECT unnest(range(1, 6)) AS i) WHERE i < len(edges))
SELECT bin, round(lo, 9) AS lo, round(hi, 9) AS hi, count(*) AS n, round(avg(score), 9) AS predicted, round(avg(label), 9) AS observed FROM b JOIN sc ON score BETWEEN lo AND hi GROUP BY 1, 2, 3""")
def k8_reliability(spark, sf_dir):
    return rounded(M.reliability(scored(spark, sf_dir)))


@query("k8_brier", BASE + " SELECT round(avg((score - label) * (score - label)), 9) AS brier, round(max(score), 9) AS max_prob, round(avg(score), 9) AS mean_prob FROM sc")
def k8_brier(spark, sf_dir):
    return rounded(M.brier(scored(spark, sf_dir)))


DECILES = "[0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]"


@query("k9_calibration_error", BASE + f""", e AS (SELECT list_sort(list_distinct(quantile_cont(score, {DECILES}))) AS edges FROM sc),
b AS (SELECT len(list_filter(edges[2:len(edges) - 1], lambda x: x <= score)) AS bin, count(*) AS n, abs(avg(score) - avg(label)) AS gap FROM sc, e GROUP BY 1)
SELECT round(sum(n * gap) / sum(n), 9) AS ece, round(max(gap), 9) AS max_gap FROM b""")
def k9_calibration_error(spark, sf_dir):
    return rounded(M.calibration_error(scored(spark, sf_dir)))


@query("k10_stability", BASE + f""", long AS (
  SELECT event_time < 852076800000 AS train, 'cents' AS feature, CAST(cents AS DOUBLE) AS v FROM sc UNION ALL SELECT event_time < 852076800000, 'transfer_k', transfer_k FROM sc UNION ALL SELECT event_time < 852076800000, 'score', score FROM sc
), e AS (SELECT feature, list_sort(list_distinct(quantile_cont(v, {DECILES}))) AS edges FROM long WHERE train GROUP BY 1), ok AS (SELECT * FROM e WHERE len(edges) >= 3),
b AS (SELECT feature, train, least(len(list_filter(edges, lambda x: x <= v)), len(edges) - 1) AS bin, count(*) AS n FROM long JOIN ok USING (feature) WHERE v BETWEEN edges[1] AND edges[len(edges)] GROUP BY 1, 2, 3),
g AS (SELECT feature, unnest(range(1, len(edges))) AS bin FROM ok),
p AS (SELECT feature, greatest(coalesce(x.n, 0) / greatest(sum(coalesce(x.n, 0)) OVER (PARTITION BY feature), 1), 1e-6) AS pa, greatest(coalesce(y.n, 0) / greatest(sum(coalesce(y.n, 0)) OVER (PARTITION BY feature), 1), 1e-6) AS pb
  FROM g LEFT JOIN (SELECT * FROM b WHERE train) x USING (feature, bin) LEFT JOIN (SELECT * FROM b WHERE NOT train) y USING (feature, bin))
SELECT feature, round(sum((pb - pa) * ln(pb / pa)), 9) AS psi, CASE WHEN sum((pb - pa) * ln(pb / pa)) < 0.1 THEN 'stable' WHEN sum((pb - pa) * ln(pb / pa)) < 0.25 THEN 'moderate shift' ELSE 'material shift' END AS verdict FROM p GROUP BY 1""")
def k10_stability(spark, sf_dir):
    rows = scored(spark, sf_dir)
    return rounded(M.stability(rows.where("event_time < 852076800000"), rows.where("event_time >= 852076800000"), ["cents", "transfer_k", "score"]))


@query("k15_cost_curve", BASE + """ SELECT budget, round(fpr, 9) AS fpr, fp AS interruptions, round(protected_cents / 100.0, 2) AS protected_usd, round(protected_cents / greatest(total_cents, 1), 9) AS protected_share,
round(CASE WHEN fp > 0 THEN protected_cents / 100.0 / fp END, 6) AS usd_per_interruption FROM rates JOIN prot USING (budget)""")
def k15_cost_curve(spark, sf_dir):
    return rounded(M.cost_curve(scored(spark, sf_dir), BUDGETS)).withColumns({"protected_usd": F.round("protected_usd", 2), "usd_per_interruption": F.round("usd_per_interruption", 6)})


@query("k16_deployment", BASE + """, t AS (SELECT budget, prevalence, recall * prevalence * 100000 AS t, fpr * (1 - prevalence) * 100000 AS f, recall * prevalence AS found, recall * prevalence + fpr * (1 - prevalence) AS every
  FROM rates, (SELECT unnest([0.01, 0.003, 0.001, 0.0003, 0.0001])::DOUBLE AS prevalence))
SELECT budget, prevalence, round(CASE WHEN every > 0 THEN found / every ELSE 0.0 END, 9) AS precision, round(t + f, 6) AS alerts_per_n, round(t, 6) AS true_alerts_per_n, round(f, 6) AS false_alerts_per_n, round(CASE WHEN t > 0 THEN f / t END, 6) AS false_per_true FROM t""")
def k16_deployment(spark, sf_dir):
    rows = scored(spark, sf_dir)
    out = M.deployment_table(M.confusion(rows, M.thresholds_at_fpr(rows, BUDGETS)))
    return out.select("budget", "prevalence", F.round("precision", 9).alias("precision"), *(F.round(c, 6).alias(c) for c in ("alerts_per_n", "true_alerts_per_n", "false_alerts_per_n", "false_per_true")))


@query("k16_economics", BASE + """, t AS (SELECT budget, recall, fpr, victims_ever_flagged AS caught, protected_cents / 100.0 / greatest(victims_ever_flagged, 1) AS per_rel,
  recall * 0.001 * 100000 / (events / greatest(victims_total, 1)) AS t, fpr * (1 - 0.001) * 100000 AS f FROM rates JOIN prot USING (budget))
SELECT budget, caught AS relationships_caught, round(per_rel, 4) AS usd_per_relationship, round(t, 6) AS true_alerts_per_n, round(f, 6) AS false_alerts_per_n, round(t * per_rel / greatest(f, 1e-9), 4) AS usd_per_false_alert FROM t""")
def k16_economics(spark, sf_dir):
    out = M.economics(scored(spark, sf_dir), BUDGETS, 0.001)
    return out.select("budget", "relationships_caught", F.round("usd_per_relationship", 4).alias("usd_per_relationship"), F.round("true_alerts_per_n", 6).alias("true_alerts_per_n"), F.round("false_alerts_per_n", 6).alias("false_alerts_per_n"), F.round("usd_per_false_alert", 4).alias("usd_per_false_alert"))


@query("k17_shifted_prior", BASE + """ SELECT event_id, round(o / (1 + o), 9) AS shifted FROM (SELECT event_id, p / (1 - p) * ((0.001 / (1 - 0.001)) / (0.15 / (1 - 0.15))) AS o FROM (SELECT event_id, greatest(least(score, 1 - 1e-9), 1e-9) AS p FROM sc))""")
def k17_shifted_prior(spark, sf_dir):
    return scored(spark, sf_dir).select("event_id", F.round(M.shifted_prior(F.col("score"), 0.15, 0.001), 9).alias("shifted"))


@query("k18_rates_by_month", BASE + """ SELECT CAST(event_time // 2592000000 AS BIGINT) AS period, count(*) FILTER (label = 1) AS n_pos, round(count(*) FILTER (score >= 0.6 AND label = 1) / greatest(count(*) FILTER (label = 1), 1), 9) AS tpr, round(count(*) FILTER (score >= 0.6 AND label = 0) / greatest(count(*) FILTER (label = 0), 1), 9) AS fpr FROM sc GROUP BY 1""")
def k18_rates_by_month(spark, sf_dir):
    hit, pos = F.col("score") >= 0.6, F.col("label") == 1
    n = lambda c: F.greatest(F.count_if(c), F.lit(1))
    return scored(spark, sf_dir).groupBy(F.expr("event_time div 2592000000").alias("period")).agg(F.count_if(pos).alias("n_pos"), F.round(F.count_if(hit & pos) / n(pos), 9).alias("tpr"), F.round(F.count_if(hit & ~pos) / n(~pos), 9).alias("fpr"))


@query("k22_wilson", BASE + """, r AS (SELECT sender, count(*) AS n, count(*) FILTER (score >= 0.6) AS hits FROM sc GROUP BY 1), p AS (SELECT *, hits / n AS p FROM r)
SELECT sender, n, hits, round((p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 9) AS lo, round((p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 9) AS hi FROM p""")
def k22_wilson(spark, sf_dir):
    rows = scored(spark, sf_dir).groupBy("sender").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 0.6).alias("hits"))
    lo, hi = M.wilson(F.col("hits"), F.col("n"))
    return rows.select("sender", "n", "hits", F.round(lo, 9).alias("lo"), F.round(hi, 9).alias("hi"))


@query("k23_operating_curve", BASE + """ SELECT budget, round(recall, 9) AS recall, round(fpr * 1000, 6) AS interruptions_per_1000, round((SELECT count(*) FILTER (first <= 1) / count(*) FROM firsts f WHERE f.budget = r.budget), 9) AS early_1 FROM rates r""")
def k23_operating_curve(spark, sf_dir):
    rows = scored(spark, sf_dir)
    marks = M.thresholds_at_fpr(rows, BUDGETS)
    early = M.early_detection(rows, marks, (1,)).select("budget", F.round("rate", 9).alias("early_1"))
    return M.confusion(rows, marks).join(early, "budget").select("budget", F.round("recall", 9).alias("recall"), F.round(F.col("fpr") * 1000, 6).alias("interruptions_per_1000"), "early_1")


@query("e6_cumulative_evidence", BASE + " SELECT event_id, round(sum(score - 0.3) OVER (PARTITION BY sender, destination ORDER BY transfer_k), 9) AS evidence FROM sc")
def e6_cumulative_evidence(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("value", F.col("score") - 0.3)
    return L.sequential_evidence(rows).select("event_id", F.round("evidence", 9).alias("evidence"))


@query("e7_decayed_evidence", BASE + """ SELECT a.event_id, round(sum((b.score - 0.3) * power(0.5, a.transfer_k - b.transfer_k)), 12) AS evidence FROM sc a JOIN sc b ON a.sender = b.sender AND a.destination = b.destination AND b.transfer_k <= a.transfer_k GROUP BY 1""")
def e7_decayed_evidence(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("value", F.col("score") - 0.3)
    return L.sequential_evidence(rows, 0.5).select("event_id", F.round("evidence", 12).alias("evidence"))


@query("j4_event_bands", BASE + ", q AS (SELECT quantile_cont(score, 0.95) AS lower, quantile_cont(score, 0.99) AS upper FROM sc WHERE label = 0) SELECT label, CASE WHEN score >= upper THEN 'high_risk' WHEN score >= lower THEN 'caution' ELSE 'safe' END AS band, count(*) AS n FROM sc, q GROUP BY 1, 2")
def j4_event_bands(spark, sf_dir):
    rows = scored(spark, sf_dir)
    marked = rows.crossJoin(F.broadcast(trees.band_thresholds(rows)))
    return marked.groupBy("label", trees.event_bands(F.col("score"), {"high_risk": F.col("upper"), "caution": F.col("lower")}).alias("band")).agg(F.count("*").alias("n"))


@query("j5_band_thresholds", BASE + " SELECT round(quantile_cont(score, 0.95), 9) AS lower, round(quantile_cont(score, 0.99), 9) AS upper FROM sc WHERE label = 0")
def j5_band_thresholds(spark, sf_dir):
    return rounded(trees.band_thresholds(scored(spark, sf_dir)))


@query("j3_platt", BASE + " SELECT event_id, round(1 / (1 + exp(-(1.7 * ln(p / (1 - p)) + -0.4))), 9) AS probability FROM (SELECT event_id, greatest(least(score, 1 - 1e-9), 1e-9) AS p FROM sc)")
def j3_platt(spark, sf_dir):
    return scored(spark, sf_dir).select("event_id", F.round(trees.platt(F.col("score"), 1.7, -0.4), 9).alias("probability"))


@query("h3_quantise", BASE + " SELECT event_id, CAST(format('{:.12g}', score * 1000 / 7) AS DOUBLE) AS quantised FROM sc")
def h3_quantise(spark, sf_dir):
    return scored(spark, sf_dir).select("event_id", trees.quantise(F.col("score") * 1000 / 7).alias("quantised"))


@query("d23_seen_so_far", BASE + " SELECT event_id, count(*) OVER (PARTITION BY destination ORDER BY event_time, event_id) - 1 AS seen, CAST(sum(cents) OVER (PARTITION BY sender, destination ORDER BY transfer_k) AS BIGINT) AS running_cents FROM sc")
def d23_seen_so_far(spark, sf_dir):
    seen = F.count("*").over(Window.partitionBy("destination").orderBy("event_time", "event_id").rowsBetween(Window.unboundedPreceding, 0)) - 1
    paid = F.sum("cents").over(Window.partitionBy("sender", "destination").orderBy("transfer_k").rowsBetween(Window.unboundedPreceding, 0))
    return scored(spark, sf_dir).select("event_id", seen.alias("seen"), paid.alias("running_cents"))


@query("d20_pair_replay", BASE + """ SELECT sender, destination, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents, CAST(arg_min(cents, transfer_k) AS BIGINT) AS first_cents, CAST(max(cents) AS BIGINT) AS most_cents, min(transfer_k) FILTER (score >= 0.6) AS first_hit, count(*) FILTER (score >= 0.6) > 0 AS any_hit FROM sc WHERE label = 1 GROUP BY 1, 2""")
def d20_pair_replay(spark, sf_dir):
    hit = F.col("score") >= 0.6
    return scored(spark, sf_dir).where("label = 1").groupBy("sender", "destination").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"), F.min_by("cents", "transfer_k").alias("first_cents"), F.max("cents").alias("most_cents"), F.min(F.when(hit, F.col("transfer_k"))).alias("first_hit"), F.bool_or(hit).alias("any_hit"))
