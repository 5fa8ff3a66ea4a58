"""Transfers, labels and prices derived from the retail star schema.

A line item is a payment from its customer to its supplier; a returned one (R) is refunded by half
three days later; of an accepted one (A) the supplier forwards 40 % to its nation's hub a day later.
Amounts are whole cents, so that sums do not depend on their order; times are epoch milliseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.operators.packed import matched
from riskweave.operators.store import LOOKED_UP, written

DAY = 86_400_000
HOUR = 3_600_000
DEALT_ROWS = 1 << 18  #: lines that meet their orders in a task at once
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate"]

TRANSFER_COLUMNS = ["chain", "tx_hash", "from_address", "to_address", "amount_usd", "cents", "asset", "block_time"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(c: str) -> Column:
    """Milliseconds since the epoch of a zone-free timestamp."""
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', {c})")


def ordered(lines: DataFrame, orders: DataFrame, most: int = LOOKED_UP) -> DataFrame:
    """Lines with the customer of their order. Few orders are sent everywhere; else both are dealt out packed."""
    if orders.count() <= most:
        return lines.join(F.broadcast(orders), F.col("l_orderkey") == F.col("o_orderkey"))
    return matched(lines, orders, ("l_orderkey", "o_orderkey"), lines.count() // DEALT_ROWS)


def derive_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven columns of a transfer, with its exact cents."""
    lines, orders, suppliers = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "supplier"))
    pay = ordered(lines.select(*LINE), orders.select("o_orderkey", "o_custkey")).select(
        F.concat(F.lit("C"), F.col("o_custkey")).alias("customer"),
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("supplier"),
        "l_suppkey",
        "l_returnflag",
        F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("long").alias("paid"),
        (epoch_ms("l_shipdate") + (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729 + F.col("l_partkey") * 31) % 86400 * 1000).alias("at"),
        F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long"), "l_returnflag").alias("line"),
    )
    nth = F.row_number().over(Window.partitionBy("s_suppkey").orderBy("s_nationkey"))  # a supplier that is listed twice forwards twice, its lines are paid once
    hubs = suppliers.where("s_suppkey is not null").select(F.col("s_suppkey").alias("l_suppkey"), F.concat(F.lit("H"), F.col("s_nationkey")).alias("hub"), nth.alias("nth"))

    def leg(kind: str, sender: str, receiver: str, cents: Column, delay: int) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.col(sender).alias("from_address"), F.col(receiver).alias("to_address"), cents.alias("cents"), (F.col("at") + delay).alias("block_time"))

    share = lambda p: F.expr(f"paid * {p} div 100")
    payment, refund, forward = leg("p", "customer", "supplier", F.col("paid"), 0), leg("r", "supplier", "customer", share(50), 3 * DAY), leg("f", "supplier", "hub", share(40), DAY)
    main, forwards = F.coalesce("nth", F.lit(1)) == 1, (F.col("l_returnflag") == "A") & F.col("nth").isNotNull()
    # lines and orders are joined once for all three
    moved = F.when(main & (F.col("l_returnflag") == "R"), F.array(payment, refund)).when(main & forwards, F.array(payment, forward)).when(main, F.array(payment)).when(forwards, F.array(forward))
    rows = pay.join(hubs, "l_suppkey", "left").select("line", F.inline(moved))
    return rows.select(
        F.lit("tron").alias("chain"),
        F.md5(F.concat("kind", "line")).alias("tx_hash"),
        "from_address",
        "to_address",
        (F.col("cents") / 100.0).alias("amount_usd"),
        "cents",
        F.lit("USDT").alias("asset"),
        "block_time",
    )


def kept(transfers: DataFrame) -> DataFrame:
    """Transfers, written without the columns that follow from the others."""
    rows = {"chain": F.lit("tron"), "amount_usd": F.col("cents") / 100.0, "asset": F.lit("USDT")}
    return written(transfers.drop(*rows)).withColumns(rows).select(*TRANSFER_COLUMNS)


def scam_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of suppliers: one dated authoritative source, two undated community ones."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("S"), F.col("s_suppkey")).alias("address"))

    def source(step: int, name: str, weight: float, dated: bool) -> DataFrame:
        rows = s.where(F.col("s_suppkey") % step == 0)
        at = (F.lit(852076800000) + F.col("s_suppkey") * 37 % 700 * DAY).cast("long") if dated else F.lit(None).cast("long")
        return rows.select("address", F.lit("tron").alias("chain"), F.lit(name).alias("source"), at.alias("reported_at"), F.lit(name + "-list").alias("category"), F.lit(weight).alias("weight"))

    return source(7, "issuer", 1.0, True).unionByName(source(5, "community", 0.5, False)).unionByName(source(11, "forum", 0.5, False))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily closes (day: epoch seconds): the mean order price, to whole cents."""
    day = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', date_trunc('DAY', o_orderdate))")
    total = F.sum(F.round(F.col("o_totalprice") * 100).cast("long"))
    return table(spark, sf_dir, "orders").groupBy(day.alias("day")).agg((F.floor(total / F.count("*")) / 100.0).alias("close"))


#: The same derivations for the SQL equivalents: transfers as `tx`, legs of both sides as `legs`, payments as `ev`.
TX_SQL = """
lines AS (
  SELECT 'C' || o_custkey AS customer, 'S' || l_suppkey AS supplier, l_suppkey, l_returnflag,
         CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT) AS paid,
         epoch_ms(l_shipdate) + (l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % 86400 * 1000 AS paid_at,
         concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT), l_returnflag) AS line
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), tx AS (
  SELECT md5('p' || line) AS tx_hash, customer AS from_address, supplier AS to_address, paid AS cents, paid_at AS block_time FROM lines
  UNION ALL SELECT md5('r' || line), supplier, customer, paid * 50 // 100, paid_at + 3 * 86400000 FROM lines WHERE l_returnflag = 'R'
  UNION ALL SELECT md5('f' || line), supplier, 'H' || s_nationkey, paid * 40 // 100, paid_at + 86400000 FROM lines JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag = 'A'
), legs AS (
  SELECT from_address AS address, to_address AS peer, 'out' AS side, cents, block_time, tx_hash FROM tx WHERE cents > 0
  UNION ALL SELECT to_address, from_address, 'in', cents, block_time, tx_hash FROM tx WHERE cents > 0
), ev AS (
  SELECT md5('p' || line) AS event_id, customer AS sender, supplier AS destination, paid AS cents, paid_at AS event_time FROM lines WHERE paid > 0
), reports AS (
  SELECT 'S' || s_suppkey AS address, 'tron' AS chain, 'issuer' AS source, CAST(852076800000 + s_suppkey * 37 % 700 * 86400000 AS BIGINT) AS reported_at, 'issuer-list' AS category, 1.0 AS weight FROM supplier WHERE s_suppkey % 7 = 0
  UNION ALL SELECT 'S' || s_suppkey, 'tron', 'community', NULL, 'community-list', 0.5 FROM supplier WHERE s_suppkey % 5 = 0
  UNION ALL SELECT 'S' || s_suppkey, 'tron', 'forum', NULL, 'forum-list', 0.5 FROM supplier WHERE s_suppkey % 11 = 0
)"""
