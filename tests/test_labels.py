"""Profiles and controls against plain Python."""

import hashlib
import random
import statistics

from riskweave.operators import labels as B

TX = "chain string, tx_hash string, from_address string, to_address string, cents long, asset string, block_time long"


def transfers(seed, n):
    rng = random.Random(seed)
    return [("c", f"t{i}", f"a{rng.randrange(40)}", f"b{rng.randrange(12)}" if rng.random() < 0.7 else f"a{rng.randrange(40)}", rng.randrange(1, 900), "USD", rng.randrange(1000)) for i in range(n)]


def test_controls_are_the_first_without_a_link(spark):
    rows = transfers(1, 4000)
    scams, excluded = ["b1", "b2", "a3"], [f"a{i}" for i in range(39) if i != 7]  # few are left: more of the order has to be looked at
    got = B.control_events(spark.createDataFrame(rows, TX).repartition(3), spark.createDataFrame([(x,) for x in excluded], "sender string"), spark.createDataFrame([(x,) for x in scams], "address string"), 20)
    left = [r for r in rows if r[2] not in excluded and r[2] not in scams and r[3] not in scams]
    want = sorted((hashlib.md5(f"17|{r[1]}".encode()).hexdigest(), r[1]) for r in left)
    assert sorted(r["event_id"] for r in got.collect()) == sorted(t for _, t in want[:20])
    assert B.control_events(spark.createDataFrame(rows, TX), spark.createDataFrame([], "sender string"), spark.createDataFrame([], "address string"), 5000).count() == 4000


def test_profiles_equal_plain(spark):
    rows = transfers(2, 1500)
    asked = [("b1", "c"), ("a5", "c"), ("b2", "other"), ("nobody", "c")]
    df = B.destination_profiles(spark.createDataFrame(rows, TX), spark.createDataFrame(asked, "address string, chain string"))
    assert "Expand" not in df._jdf.queryExecution().executedPlan().toString()  # no second copy of the rows to count distinct senders
    got = {r["address"]: r.asDict() for r in df.collect()}
    assert set(got) == {"b1", "a5"}
    for x, r in got.items():
        into, out = [t for t in rows if t[3] == x], [t for t in rows if t[2] == x]
        paid = {p: sum(t[4] for t in out if t[3] == p) for p in {t[3] for t in out}}
        assert (r["inbound_count"], r["distinct_inbound_senders"], r["inbound_cents"]) == (len(into), len({t[2] for t in into}), sum(t[4] for t in into))
        assert (r["first_seen"], r["last_inbound"], r["median_inbound_cents"]) == (min(t[6] for t in into), max(t[6] for t in into), statistics.median(t[4] for t in into))
        assert (r["outbound_count"], r["outbound_cents"], r["distinct_outbound_dests"]) == (len(out), sum(paid.values()), len(paid))
        assert abs(r["consolidation_ratio"] - (max(paid.values()) / sum(paid.values()) if paid else 0)) < 1e-12
