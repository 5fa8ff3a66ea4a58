"""Registered queries of nearest values, point-in-time probes and nearest-neighbour matching."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskweave.operators import legs as L
from riskweave.operators import asof, nearest, order, probes, resampling, sampling, slices
from riskweave.operators.store import written
from riskweave.sources import driver_tables as D
from riskweave.sources import pages

from .catalog import DEST_SQL, _engine, query, scored_events

DAY = D.DAY
MIDDLE = 820_454_400_000  # the first day of 1996
SEEN = """, seen AS (SELECT address, min(block_time) AS first_seen, max(block_time) AS last_seen FROM legs GROUP BY 1
), mk AS (SELECT address, reported_at AS mark FROM reports WHERE reported_at IS NOT NULL"""


@query("c19_nearest_value", f"""{SEEN}), v AS (SELECT o_orderkey, epoch_ms(o_orderdate) AS want, epoch_ms(o_orderdate) - (o_custkey % 40) * {10 * DAY} AS least FROM orders)
SELECT o_orderkey, CAST((SELECT mark FROM mk WHERE mark > least ORDER BY abs(mark - want), mark LIMIT 1) AS BIGINT) AS mark FROM v""")
def c19_nearest_value(spark, sf_dir):
    """Of each order the reported freeze nearest to it, of those after a moment of its own."""
    at = D.epoch_ms("o_orderdate")
    asked = D.table(spark, sf_dir, "orders").select("o_orderkey", at.alias("want"), (at - F.col("o_custkey") % 40 * F.lit(10 * DAY)).alias("least"))
    marks = D.scam_reports(spark, sf_dir).where("reported_at is not null").select(F.col("reported_at").alias("value"))
    return order.nearest(asked, marks, "want", "least").select("o_orderkey", "mark")


PROBES_SQL = f"""{SEEN}
), pos AS (SELECT address, first_seen, CAST(mark AS BIGINT) AS mark FROM mk JOIN seen USING (address)
), ages AS (SELECT mark - first_seen AS age, row_number() OVER (ORDER BY mark - first_seen) - 1 AS nth FROM pos WHERE mark > first_seen
), ctl AS (SELECT address, first_seen, CAST('0x' || substr(md5('17|' || address), 1, 8) AS BIGINT) % (SELECT count(*) FROM ages) AS nth FROM seen WHERE address LIKE 'C%'
), neg AS (SELECT address, c.first_seen, (SELECT mark FROM pos WHERE mark > c.first_seen + {7 * DAY} ORDER BY abs(mark - (c.first_seen + age)), mark LIMIT 1) AS mark FROM ctl c JOIN ages USING (nth)
), pr AS (
  SELECT address, label, mark - h * {DAY} AS event_time, mark, CAST(h AS INTEGER) AS horizon FROM (SELECT *, 1 AS label FROM pos UNION ALL SELECT *, 0 FROM neg WHERE mark IS NOT NULL) JOIN seen USING (address) CROSS JOIN (SELECT CAST(unnest([7, 30, 90, 180]) AS BIGINT) AS h)
  WHERE mark - h * {DAY} > seen.first_seen AND NOT (CAST(substr(address, 2) AS BIGINT) % 3 = 0 AND mark - h * {DAY} > seen.last_seen)
) SELECT address, label, CAST(event_time AS BIGINT) AS event_time, CAST(mark AS BIGINT) AS mark, horizon, CASE WHEN mark >= (SELECT quantile_cont(mark, 0.7) FROM pr) THEN 'test' ELSE 'train' END AS part FROM pr"""


@query("i16_probes", PROBES_SQL)
def i16_probes(spark, sf_dir):
    legs = L.legs(L.clean(D.derive_transfers(spark, sf_dir)))
    seen = written(L.spans(legs).select("address", "first_seen", "last_seen"))  # read for marks, controls and coverage
    marks = D.scam_reports(spark, sf_dir).where("reported_at is not null").select("address", F.col("reported_at").alias("mark"))
    positives = marks.join(seen, "address").select("address", "first_seen", "mark")
    covered = seen.select("address", (F.substring("address", 2, 20).cast("long") % 3 == 0).alias("truncated"), "last_seen")
    return probes.probes(positives, seen.where("address like 'C%'").select("address", "first_seen"), covered)


@query("i10_nearest_controls")
def i10_nearest_controls(spark, sf_dir):
    """Three controls for each payment to a supplier that issuer and community report, alike in age, number and size, among first or repeated payments."""
    events = scored_events(spark, sf_dir)
    n = F.substring("destination", 2, 20).cast("long")
    first = F.when(F.col("dest_inbound_count") == 0, "first").otherwise("again")
    rows = events.select("event_id", (n % 35 == 0).cast("int").alias("label"), "dest_age_days", "dest_inbound_count", (F.col("cents") / 100).alias("amount_usd"), first.alias("kind"))
    out = nearest.match_nearest(rows, 3, ["dest_age_days", "dest_inbound_count", "amount_usd"], F.col("kind"))
    return out.select("event_id", "control", F.round("distance", 9).alias("distance"))


@query("k14_resampled_metrics")
def k14_resampled_metrics(spark, sf_dir):
    """Bounds of two ranking metrics of all scored payments, 100 replicates, senders drawn whole."""
    rows = scored_events(spark, sf_dir).select("sender", "score", (F.substring("destination", 2, 20).cast("long") % 7 == 0).cast("int").alias("label"))
    out = resampling.bounds(resampling.replicate_metrics(rows, replicates=100, unit="sender"))
    return out.select("metric", *(F.round(c, 9).alias(c) for c in ("value", "lo", "hi")))


WINDOWS_SQL = f"""{SEEN}), win AS (SELECT y * 100 + m AS w, epoch_ms(make_timestamp(y, m, 15, 0, 0, 0)) AS a FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders) CROSS JOIN (SELECT unnest([2, 6, 10]) AS m)
), shown AS (SELECT w, from_address, to_address, row_number() OVER (PARTITION BY w ORDER BY block_time, tx_hash, to_address) AS k FROM win JOIN tx ON block_time >= a AND block_time < a + {2 * DAY} QUALIFY k <= 400
), sides AS (SELECT from_address AS address, w, k, 0 AS side FROM shown UNION ALL SELECT to_address, w, k, 1 FROM shown
), first AS (SELECT address, min((w, k, side)) AS seen FROM sides WHERE address NOT IN (SELECT address FROM reports) GROUP BY 1
), chosen AS (SELECT * FROM first ORDER BY md5('17|' || address), address LIMIT 500)
SELECT address, CAST(row_number() OVER (ORDER BY seen) - 1 AS INTEGER) AS place FROM chosen"""


@query("a23_firehose", WINDOWS_SQL)
def a23_firehose(spark, sf_dir):
    """500 addresses without a report that moved money in the two days from the 15th of three months a year."""
    year = D.table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y")).distinct()
    month = F.explode(F.array(*map(F.lit, (2, 6, 10)))).alias("m")
    windows = year.select("y", month).withColumn("day", F.expr("make_timestamp_ntz(y, m, 15, 0, 0, 0)"))
    windows = windows.select((F.col("y") * 100 + F.col("m")).alias("window"), D.epoch_ms("day").alias("start")).withColumn("stop", F.col("start") + 2 * DAY)
    return sampling.firehose(D.derive_transfers(spark, sf_dir), windows, D.scam_reports(spark, sf_dir), 500)


@query("e13_quota_pick")
def e13_quota_pick(spark, sf_dir):
    """Cases to show: up to 12, 8 and 5 payments of each band and label, each of another customer to another supplier."""
    events = scored_events(spark, sf_dir).withColumn("label", (F.substring("destination", 2, 20).cast("long") % 7 == 0).cast("int"))
    wanted = [((F.col("label") == y) & (F.col("band") == b), k) for y in (1, 0) for b, k in (("high", 12), ("elevated", 8), ("ordinary", 5))]
    return sampling.quota_pick(events.select("event_id", "sender", "destination", "label", "band"), wanted)


@query("a20_harvest", """, own AS (SELECT from_address AS address, count(*) AS n FROM tx WHERE from_address LIKE 'C%' GROUP BY 1
), k AS (SELECT *, CAST(substr(address, 2) AS BIGINT) % 5 = 0 AND n >= 10 AS refused FROM own)
SELECT address, CASE WHEN refused THEN 2 WHEN n >= 40 THEN 4 ELSE n // 10 + 1 END AS pages, CAST(CASE WHEN refused THEN 10 ELSE least(n, 40) END AS BIGINT) AS rows, refused, CASE WHEN refused THEN NULL ELSE n >= 40 END AS truncated FROM k""")
def a20_harvest(spark, sf_dir):
    """Histories of four pages of ten at most, from pages made of the customers' payments; every fifth customer's second page is refused."""
    tx = D.derive_transfers(spark, sf_dir).where("from_address like 'C%'")
    nth = F.row_number().over(Window.partitionBy("from_address").orderBy("block_time", "tx_hash")) - 1
    item = F.struct(F.col("tx_hash").alias("hash"), F.col("cents").cast("string").alias("value"))
    held = tx.withColumn("page", (F.floor(nth / 10) + 1).cast("int")).groupBy(F.col("from_address").alias("address"), "page").agg(F.collect_list(item).alias("result"))
    ok = held.select("address", "page", F.to_json(F.struct(F.lit("1").alias("status"), F.lit("OK").alias("message"), "result")).alias("payload"))
    full = held.groupBy("address").agg(F.max(F.struct("page", F.size("result").alias("n"))).alias("x")).where("x.n = 10")
    nothing = full.select("address", (F.col("x.page") + 1).alias("page"), F.lit('{"status":"0","message":"No transactions found","result":[]}').alias("payload"))
    refused = F.when((F.substring("address", 2, 20).cast("long") % 5 == 0) & (F.col("page") == 2), F.lit('{"status":"0","message":"NOTOK","result":"later"}')).otherwise(F.col("payload"))
    every = ok.unionByName(nothing).select("address", "page", refused.alias("payload")).where("not (address rlike '[05]$' and page > 2)")
    return pages.histories(every, most=4, page_rows=10)


@query("b12_slices", f""", d AS ({DEST_SQL}), t AS (SELECT ev.*, dest_senders_all, CAST(CAST(substr(destination, 2) AS BIGINT) % 7 = 0 AS INTEGER) AS label, event_time = min(event_time) OVER (PARTITION BY sender, destination) AS first, event_time < {MIDDLE} AS early FROM ev JOIN d USING (event_id))
, late AS (SELECT * FROM t WHERE NOT early)
SELECT event_id, 'hard_negatives' AS slice FROM late WHERE label = 1 OR dest_senders_all >= 5 UNION ALL SELECT event_id, 'first_sends' FROM late WHERE first UNION ALL SELECT event_id, 'new_destinations' FROM late WHERE dest_senders_all <= 1
UNION ALL SELECT event_id, 'unseen_destinations' FROM late WHERE destination NOT IN (SELECT destination FROM t WHERE early AND CAST(substr(destination, 2) AS BIGINT) % 4 <> 1)""")
def b12_slices(spark, sf_dir):
    """Slices of the payments after the middle of the years; a quarter of the suppliers is not trained on."""
    engine, events = _engine(spark, sf_dir)
    n, early = F.substring("destination", 2, 20).cast("long"), F.col("event_time") < MIDDLE
    late = written(L.first_sends(events).where(~early).drop("sender", "cents"))  # the slices read no facts of earlier ones
    rows = asof.destination_block(late, engine.legs, ("destination", "event_time", "is_first_send_to_dest")).withColumn("label", (n % 7 == 0).cast("int"))
    return slices.slices(rows.select("event_id", "destination", "event_time", "label", "dest_senders_all", "is_first_send_to_dest"), events.where(early & (n % 4 != 1))).select("event_id", "slice")
