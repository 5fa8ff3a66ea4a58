"""Label sources, address sets, scores at a moment and predictions."""

import json

from pyspark.sql import functions as F

from riskweave.operators import asof, reports, scoring
from riskweave.operators import legs as L
from riskweave.plans.models import EXPLAINED
from riskweave.sources import pages

TRON, EVM = "TR7NHqjeKQxGTCi8q8ZY4pL8otSzgjLj6t", "0x" + "aB" * 20


def texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_sources_and_their_union(spark):
    freeze = json.dumps([{"address": TRON, "block_time": 7, "tx_hash": "x"}, {"address": TRON[:-1] + "u", "block_time": 8}, {"address": None}, {"block_time": 9}])
    evm = json.dumps([{"address": EVM, "block_time": 5}, {"address": EVM}, {"address": "0x12"}, {}])
    dark = json.dumps([{"address": EVM, "comment": "ä" * 70}, {"address": EVM, "comment": ""}, {"address": EVM}, {"address": "no", "comment": "c"}])
    odd = [None, "", "no json", "{}", "[]", "[null]", "3"]
    got = reports.collect_reports({
        "tether_freeze": texts(spark, freeze, *odd), "tether_freeze_eth": texts(spark, evm, *odd), "scamsniffer": texts(spark, json.dumps([EVM, 3, None, {"a": EVM}, "0x1"]), *odd), "mew_darklist": texts(spark, dark, *odd),
        "ofac_sdn": texts(spark, f"x; Digital Currency Address - USDT {TRON}; Digital Currency Address - ETH {EVM}; Digital Currency Address - XBT {'A' * 30};", f"Digital Currency Address - TRX {TRON};", None),
        "cryptoscamdb": texts(spark, f"- {TRON} {EVM}", f"{EVM.lower()} {TRON}", TRON[:-1] + "u", None),
    })
    assert got.columns == reports.REPORT
    low = EVM.lower()
    assert rows_of(got, *reports.REPORT) == sorted([
        (TRON, "tron", "tether_freeze", 7, "frozen_by_issuer", 1.0), (low, "ethereum", "tether_freeze_eth", 5, "frozen_by_issuer", 1.0), (low, "ethereum", "tether_freeze_eth", None, "frozen_by_issuer", 1.0),
        (low, "ethereum", "scamsniffer", None, "phishing", 0.5), (low, "ethereum", "mew_darklist", None, "ä" * 60, 0.5), *[(low, "ethereum", "mew_darklist", None, "reported_scam", 0.5)] * 2,
        (TRON, "tron", "ofac_sdn", None, "sanctioned", 1.0), (EVM, "ethereum", "ofac_sdn", None, "sanctioned", 1.0), (TRON, "tron", "cryptoscamdb", None, "reported_scam", 0.5), (low, "ethereum", "cryptoscamdb", None, "reported_scam", 0.5),
    ], key=str)


def test_files_of_a_list(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"address": TRON, "block_time": 1}], indent=2))
    (tmp_path / "b.json").write_text("[")
    assert rows_of(reports.issuer_freezes(spark.read.text(str(tmp_path), wholetext=True)), "address", "reported_at") == [(TRON, 1)]


def test_address_sets(spark):
    one = spark.createDataFrame([("a", True), ("b", False), ("c", None), ("a", True), (None, False)], "address string, truncated boolean")
    two = spark.createDataFrame([("a", False, 1), ("b", True, 1), ("d", True, 1)], "address string, truncated boolean, complete int")
    assert rows_of(pages.address_sets(one, two), "address", "complete") == [("a", True), ("b", True), ("d", False)]


def test_facts_at_a_moment_equal_those_of_an_event_then(spark):
    t0, day = 1_700_000_000_000, 86_400_000
    rows = [(f"t{i}", f"w{i % 7}", f"w{i % 5 + 2}", i * 100, t0 - i * i * day // 9) for i in range(1, 60)] + [("later", "w0", "w3", 5000, t0 + 1), ("now", "w1", "w3", 5000, t0), ("zero", "z", "w3", 0, t0 - 1), ("new", "w0", "n", 1, t0 + 5)]
    legs = L.legs(L.clean(spark.createDataFrame(rows, "tx_hash string, from_address string, to_address string, cents long, block_time long").withColumn("amount_usd", F.col("cents") / 100)))
    got = scoring.address_facts(legs, t0)
    events = legs.select(F.col("address").alias("event_id"), F.col("address").alias("destination"), F.lit(t0).alias("event_time")).distinct()
    want = asof.destination_block(events, legs).withColumnRenamed("event_id", "address").where("dest_first_seen is not null")
    same = ["address"] + [c for c in want.columns if c in got.columns and c != "address"]
    assert len(same) == 12 and rows_of(got, *same) == rows_of(want, *same) and got.count() == 7


def test_scores_say_when_nothing_is_known(spark):
    facts = spark.createDataFrame([("new", 0, 0.0, 0, None), ("sender", 0, 0.0, 0, 3), ("old", 9, 20.0, 40, 0), ("none", None, None, None, None)], "event_id string, dest_senders_7d long, dest_age_days double, dest_inbound_count long, sender_outbound_count long")
    got = {r["event_id"]: r for r in scoring.score_events(facts, EXPLAINED, {"caution": 0.5, "high_risk": 0.7}, most=2).collect()}
    assert {k: r["features_available"] for k, r in got.items()} == {"new": False, "sender": True, "old": True, "none": False}
    assert all((r["reasons"][:1] == [scoring.UNKNOWN]) == (not r["features_available"]) and len(r["reasons"]) <= 2 for r in got.values())
    assert got["new"]["score"] == got["sender"]["score"] and got["old"]["band"] == "high_risk"
    assert scoring.score_events(facts.limit(0), EXPLAINED, {"caution": 0.5, "high_risk": 0.7}).count() == 0


def test_predictions_leave_out_what_is_known(spark):
    model = {"features": ["dest_age_days", "x"], "trees": [], "thresholds": {"elevated": 0.4, "high": 0.5}}
    scored = spark.createDataFrame([(a, s, 1.23456789, None, 4, 12345) for a, s in [("a", 0.5), ("b", 0.49), ("listed", 0.9), ("said", 0.9), ("c", 0.7654321)]], "address string, score double, dest_age_days double, x double, dest_senders_all long, dest_inbound_cents_all long")
    one = lambda a: spark.createDataFrame([(a,), (None,)], "address string")
    got = sorted(scoring.predictions(scored, model, "tron", 9, one("listed"), one("said")).collect(), key=lambda r: r["address"])
    assert [(r["address"], r["score"], r["senders"], r["inbound_usd"], r["features"]) for r in got] == [("a", 0.5, 4, 123.45, {"dest_age_days": 1.234568, "x": None}), ("c", 0.765432, 4, 123.45, {"dest_age_days": 1.234568, "x": None})]
    said = json.loads(got[0]["payload"])
    assert list(said) == sorted(said) and said["model"] == scoring.model_id(model) and said["features"] == {"dest_age_days": 1.234568, "x": None} and said["predicted_at"] == 9
