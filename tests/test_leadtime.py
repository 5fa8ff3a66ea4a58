"""Lead times and reports against plain Python."""

import hashlib

import numpy as np

from riskweave.operators import leadtime as T


def test_ranks_and_latency(spark):
    values = [3.0, 1.0, None, 2.0, 2.0, 9.0, 7.0]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    x = sorted(v for v in values if v is not None)
    got = T.latency(rows, "v").first()
    assert (got.n, got.p50, got.p95, got.p99, got.most) == (6, float(np.median(x)), x[int(6 * 0.95)], x[int(6 * 0.99)], 9.0)
    empty = T.latency(rows.where("v > 100"), "v").first()
    assert empty.n == 0 and empty.p50 is None and empty.most is None


def test_probes_stay_inside_history(spark):
    frozen = spark.createDataFrame([("a", 100 * T.DAY), ("b", 100 * T.DAY), ("c", None)], "address string, frozen_at long")
    spans = spark.createDataFrame([("a", 40 * T.DAY, 50 * T.DAY, True), ("b", 10 * T.DAY, 20 * T.DAY, None), ("c", 1, 2, False)], "address string, first_seen long, last_seen long, truncated boolean")
    got = {(r.address, r.horizon) for r in T.probes(frozen, spans, [7, 50, 60, 89, 90]).collect()}
    assert got == {("a", 50), ("b", 7), ("b", 50), ("b", 60), ("b", 89)}


def test_head_of_hash_order(spark):
    rows = spark.createDataFrame([(f"e{i}", "xyz"[i % 3]) for i in range(300)], "event_id string, g string")
    need = spark.createDataFrame([("x", 7), ("y", 1000)], "g string, need long")
    got = {r.event_id for r in T.hash_head(rows, "g", need).collect()}
    order = sorted((f"e{i}" for i in range(0, 300, 3)), key=lambda e: hashlib.md5(f"17|{e}".encode()).hexdigest())
    assert got == set(order[:7]) | {f"e{i}" for i in range(1, 300, 3)}


def test_bounds_like_drawing_the_units(spark):
    row = T.resampled(spark.createDataFrame([(30, 100), (0, 0)], "h long, n long"), "h", "n", reps=4000).orderBy("n").collect()
    assert row[0].rate is None and row[0].lo is None and row[0].hi is None
    units = np.r_[np.ones(30), np.zeros(70)]
    rng = np.random.default_rng(1)
    lo, hi = np.percentile([units[rng.integers(0, 100, 100)].mean() for _ in range(4000)], [2.5, 97.5])
    assert abs(row[1].lo - lo) <= 0.011 and abs(row[1].hi - hi) <= 0.011 and row[1].rate == 0.3
