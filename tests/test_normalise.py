"""Raw rows are parsed once, prices looked up without a shuffle of the rows."""

from pyspark.sql import functions as F

from riskweave.operators import normalise as N
from riskweave.operators import prices


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_raw_rows_are_parsed_once(spark):
    raw = spark.createDataFrame([('{"hash": "h", "type": "Transfer"}',), ("no JSON",), (None,)], "raw string")
    contracts = spark.createDataFrame([("0xaa", "AAA", 2)], "contract string, asset string, decimals int")
    candles = spark.createDataFrame([(0, 1.0)], "day long, close double")
    for df in (N.tron_transfers(raw, valid=lambda a: a.isNotNull()), N.blockscout_transfers(raw), N.etherscan_tokens(raw, contracts), N.etherscan_native(raw, candles)):
        assert plan(df).count("from_json") + plan(df).count("JsonToStructs") == 1
        assert df.count() == 0


def test_rows_without_a_field_are_left_out(spark):
    row = '{"transaction_hash": "h", "timestamp": "1996-01-01T00:00:00Z", "from": {"hash": "A"}, "to": {"hash": "B"}, "total": {"value": "5000000", "decimals": "6"}, "token": {"symbol": "USDC"}}'
    rows = [(row,), (row.replace('{"hash": "B"}', "null"),), (row.replace("1996", "x"),), ("[]",), ("{",), (None,)]
    got = N.blockscout_transfers(spark.createDataFrame(rows, "raw string")).collect()
    assert [(r["tx_hash"], r["from_address"], r["to_address"], r["amount_usd"]) for r in got] == [("h", "a", "b", 5.0)]


def test_prices_are_sent_to_the_rows(spark):
    rows = spark.range(10).select((F.col("id") * 43_200_000).alias("block_time"))
    candles = spark.createDataFrame([(0, 1.0), (86_400, 2.0)], "day long, close double")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = prices.price_as_of(rows, candles)
        assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
        assert [r["price"] for r in df.orderBy("block_time").collect()] == [None, None, 1.0, 1.0] + [2.0] * 6
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
