"""Operators that SQL does not cover, and cases that the tables do not have."""

import hashlib

import pytest
from pyspark.sql import functions as F

from riskweave.operators import ledger, metrics, normalise, trees


def test_missing_values_take_the_default_branch(spark):
    tree = {"f": 0, "t": 1.0, "l": {"v": 10.0}, "r": {"v": 20.0}}
    rows = spark.createDataFrame([(0.5,), (1.0,), (2.0,), (None,), (float("nan"),)], "x double")
    got = lambda d: [r[0] for r in rows.select(trees.margin({"features": ["x"], "trees": [{**tree, "d": d}]})).collect()]
    assert got(1) == got(True) == [10.0, 10.0, 20.0, 10.0, 10.0] and got(0) == [10.0, 10.0, 20.0, 20.0, 20.0]


def test_contributions_add_up_to_the_margin(spark):
    model = trees.FIXED_MODEL
    rows = spark.createDataFrame([("a", 1.0, 10.0, 5.0), ("b", 9.0, 500.0, 90.0), ("c", None, 200.0, None)], "event_id string, dest_senders_7d double, dest_age_days double, dest_inbound_count double")
    parts = trees.contributions(rows, model)
    base = (-0.6 + (1.1 + 0.4) / 2) / 2 + (-0.3 + 0.5) / 2 + (0.7 - 0.2) / 2
    total = {r["event_id"]: r["s"] for r in parts.groupBy("event_id").agg(F.sum("contribution").alias("s")).collect()}
    margin = {r[0]: r[1] for r in rows.select("event_id", trees.margin(model)).collect()}
    assert all(abs(base + total[k] - margin[k]) < 1e-12 for k in margin)
    up = {r["event_id"]: r["reasons"] for r in trees.reasons(parts).collect()}
    assert up["b"][0] == "dest_senders_7d" and "dest_age_days" not in up["b"]


@pytest.mark.parametrize("rows, want", [([(0, 0.5), (0, 0.5), (1, 0.9)], 0.5), ([(1, 0.9)], 0.5), ([(0, x / 100) for x in range(100)], 0.99), ([], 0.5)])
def test_threshold_is_a_negative_score(spark, rows, want):
    assert metrics.threshold_at_fpr(spark.createDataFrame(rows, "label int, score double"), 0.01).first()["threshold"] == want


def test_ranking_equals_pairs(spark):
    import random

    rng = random.Random(1)
    rows = [(int(rng.random() < 0.3), round(rng.random(), 2)) for _ in range(400)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert abs(metrics.ranking_metrics(spark.createDataFrame(rows, "label int, score double")).first()["roc_auc"] - auc) < 1e-12


def test_addresses():
    raw = bytes([0x41]) + bytes(range(20))
    raw += hashlib.sha256(hashlib.sha256(raw).digest()).digest()[:4]
    n, s = int.from_bytes(raw, "big"), ""
    while n:
        n, d = divmod(n, 58)
        s = normalise._ALPHABET[d] + s
    assert normalise.base58_valid(s) and len(s) == 34
    assert not normalise.base58_valid(s[:-1] + ("1" if s[-1] != "1" else "2")) and not normalise.base58_valid(None) and not normalise.base58_valid("0" * 34)


def test_ledger(spark):
    rows = spark.createDataFrame([(i, f'{{"address":"a{i}"}}') for i in range(5)], "k int, payload string")
    log = ledger.chained(rows, "k", "payload")
    good = ledger.verify(log).first()
    assert good["first_bad"] is None and good["entries"] == 5 and good["head"] == log.where("seq = 4").first()["hash"]
    changed = ledger.verify(log.withColumn("payload", F.when(F.col("seq") == 2, "x").otherwise(F.col("payload")))).first()
    assert (changed["first_bad"], changed["problem"]) == (2, "content")
    cut = ledger.verify(log.where("seq <> 2")).first()
    assert (cut["first_bad"], cut["problem"]) == (3, "chain")
    assert ledger.verify(log.limit(0)).first()["head"] == ledger.GENESIS


def test_events_without_an_end_stay_in_the_matrix(spark):
    from riskweave.operators.features import FEATURE_COLUMNS, FeatureEngine

    day = 86_400_000
    tx = spark.createDataFrame([("1", "a", "b", 5.0, 500, day), ("2", "b", "c", 3.0, 300, 2 * day), ("3", "a", "a", 2.0, 200, 3 * day)], "tx_hash string, from_address string, to_address string, amount_usd double, cents long, block_time long")
    events = spark.createDataFrame([("both", "a", "b", 100, 9 * day), ("no sender", None, "b", 100, 9 * day), ("no destination", "a", None, 100, 9 * day), ("none", None, None, 100, 9 * day), ("own", "a", "a", 100, 9 * day)], "event_id string, sender string, destination string, cents long, event_time long")
    got = {r["event_id"]: r.asDict() for r in FeatureEngine(tx).compute(events).select("event_id", *FEATURE_COLUMNS).collect()}
    assert len(got) == 5
    assert got["no sender"]["sender_outbound_count"] == 0 and got["no sender"]["dest_inbound_count"] == 1
    assert got["no destination"]["dest_inbound_count"] == 0 and got["no destination"]["sender_outbound_count"] == 2
    assert got["none"]["shared_counterparties"] == 0 and got["own"]["shared_counterparties"] == 2  # b and itself


def test_labels_meet_profiles_of_their_chain(spark):
    from riskweave.operators import labels as B

    tx = spark.createDataFrame([(c, f"{c}{i}", f"v{i}", "s", 10_000, i) for c, n in (("one", 7), ("two", 2)) for i in range(n)], "chain string, tx_hash string, from_address string, to_address string, cents long, block_time long")
    reports = spark.createDataFrame([("s", c, "forum", None, "list", 0.5) for c in ("one", "two", "three")], "address string, chain string, source string, reported_at long, category string, weight double")
    lab = B.aggregate_reports(reports)
    got = {r["chain"]: (r["accepted"], r["label_basis"]) for r in B.finalise(lab, B.destination_profiles(tx, lab)).collect()}
    assert got == {"one": (True, "report_plus_onchain_pattern"), "two": (False, "uncorroborated"), "three": (False, "uncorroborated")}


def test_more_contracts_than_a_thousand(spark):
    from pyspark.sql import functions as F

    from riskweave.operators import normalise as N

    n = 1500
    contracts = spark.range(n).select(F.concat(F.lit("0x"), "id").alias("contract"), F.lit("AAA").alias("asset"), F.lit(2).alias("decimals"))
    raw = spark.range(n).select(F.to_json(F.struct(F.col("id").cast("string").alias("hash"), F.lit("5").alias("timeStamp"), F.lit("a").alias("from"), F.lit("b").alias("to"), F.lit("100").alias("value"), F.concat(F.lit("0x"), "id").alias("contractAddress"))).alias("raw"))
    assert N.etherscan_tokens(raw, contracts).count() == n
