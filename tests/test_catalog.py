"""Catalog queries against DuckDB on the smallest tables, and the causal rule."""

import os

import duckdb
import pytest

from riskweave.operators.features import FEATURE_COLUMNS, FeatureEngine
from riskweave.plans import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def rows_of(df):
    plain = lambda v: "null" if v is None or v != v else f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    names = sorted(df.columns)
    return names, sorted(tuple(plain(r[c]) for c in names) for r in df.astype(object).to_dict("records"))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["a2_transfers", "e1_sweep", "e4_dedupe", "b10_within_coverage", "d13_coverage", "g3_pair_block", "g2_inflow_peak", "c5_payout_fanin", "c7_shared_counterparties", "c9_price_as_of", "k1_thresholds", "k6_protected", "k10_stability", "i3_label_basis", "i5_positive_events", "l4_verdicts", "a13_tron_rows", "l11_report", "k3_ranking_metrics", "d11_label_aggregate", "d22_lead_times", "k20_payment_recall", "i13_age_balanced", "k24_address_report", "k25_latency", "i17_all_combined", "i18_attack_report", "k12_sequential_sweep", "c6_peer_links", "c17_payout_batch"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    assert rows_of(QUERIES[name](spark, SF).toPandas()) == rows_of(con.execute(SQL[name]).df())


def test_later_transfers_do_not_move_features(spark):
    day, t0 = 86_400_000, 1_700_000_000_000
    past = [("v", "s", 100.0, -10), ("v", "s", 500.0, -5), ("o", "s", 300.0, -4), ("s", "c", 900.0, -3), ("x", "v", 9000.0, -20), ("v", "f", 50.0, -30)]
    late = [("late", "s", 2000.0, 1), ("v", "s", 7777.0, 0), ("s", "c", 80000.0, 2)]

    def transfers(rows):
        return spark.createDataFrame([(f"{i}{a}{b}", a, b, usd, int(usd * 100), t0 + d * day) for i, (a, b, usd, d) in enumerate(rows)], "tx_hash string, from_address string, to_address string, amount_usd double, cents long, block_time long")

    events = spark.createDataFrame([("e", "v", "s", 500_000, t0)], "event_id string, sender string, destination string, cents long, event_time long")
    one, two = (FeatureEngine(transfers(r)).compute(events).first().asDict() for r in (past, past + late))
    assert one == two and set(FEATURE_COLUMNS) <= set(one)
    assert (one["sender_prior_sends_to_dest"], one["dest_senders_all"], one["dest_age_days"], one["shared_counterparties"]) == (2, 2, 10.0, 0)
    assert abs(one["escalation_ratio"] - 10.0) < 1e-9 and one["sender_max_out_usd"] == 500.0
