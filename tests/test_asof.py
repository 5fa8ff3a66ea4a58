"""Facts of destinations and senders from one shuffle of the legs, also where histories are cut, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from riskweave.operators import asof
from riskweave.operators.legs import legs

DAY = asof.DAY
TX = "tx_hash string, from_address string, to_address string, amount_usd double, cents long, block_time long"


def drawn(seed, n=300):
    rng = random.Random(seed)
    at = lambda: rng.choice([rng.randrange(0, 150 * DAY), rng.randrange(0, 150) * DAY])  # noqa: E731  many of one moment
    ends = ["a", "b", "c", "d"]
    tx = [(f"t{i}", rng.choice(ends), rng.choice(ends), 1.0, rng.choice([1, 7, 900, 3 * 10**9 + i, 2**40 + 3]) if i < 40 else rng.randrange(1, 999), at()) for i in range(n)]
    events = [(f"e{i}", rng.choice([*ends, "new", None]), rng.choice([*ends, "new", None]), 5, at()) for i in range(120)]
    return tx, events


def plain(tx, events):
    for e, sender, dest, _, t in events:
        rows = {end: [(p, s, c, at) for _, f, to, _, c, at in tx for a, p, s in ((f, to, "out"), (to, f, "in")) if a == end and at < t] for end in (sender, dest)}
        d, s = rows[dest], rows[sender]
        of = lambda r, side, days=None: [x for x in r if x[1] == side and (days is None or x[3] >= t - days * DAY)]
        paid = {p: sum(x[2] for x in of(d, "out") if x[0] == p) for p in {x[0] for x in of(d, "out")}}
        yield e, {
            "dest_inbound_count": len(of(d, "in")), "dest_distinct_out": len({x[0] for x in of(d, "out")}), "dest_senders_all": len({x[0] for x in of(d, "in")}),
            **{f"dest_senders_{n}d": len({x[0] for x in of(d, "in", n)}) for n in (1, 7, 30)}, "dest_inbound_count_7d": len(of(d, "in", 7)),
            "dest_top_payee_cents": max(paid.values(), default=None), "dest_first_seen": min((x[3] for x in d), default=None),
        }, {
            "sender_outbound_count": len(of(s, "out")), "sender_out_squares": sum(x[2] ** 2 for x in of(s, "out")), "sender_distinct_counterparties": len({x[0] for x in s}),
            "sender_burst_7d": len(of(s, "out", 7)), "sender_distinct_dests_30d": len({x[0] for x in of(s, "out", 30)}),
            "sender_last_out": max((x[3] for x in of(s, "out")), default=None), "sender_out_hours": sum(x[3] // asof.HOUR % 24 for x in of(s, "out")),
        }


@pytest.mark.parametrize("tuning", [{}, {"hub": 20, "span": 9 * DAY, "bucket_rows": 50}, {"hub": 80, "span": 40 * DAY}], ids=["whole", "cut", "some cut"])
def test_blocks_equal_plain(spark, tuning):
    tx, events = drawn(3)
    ev = spark.createDataFrame(events, "event_id string, sender string, destination string, cents long, event_time long")
    sides = legs(spark.createDataFrame(tx, TX).repartition(3))
    want = {e: (d, s) for e, d, s in plain(tx, events)}
    for i, block in enumerate((asof.destination_block(ev, sides, **tuning), asof.sender_block(ev, sides, **tuning))):
        got = {r["event_id"]: r.asDict() for r in block.collect()}
        assert len(got) == len(events)
        for e, pair in want.items():
            assert {k: got[e][k] for k in pair[i]} == pair[i], e


def test_a_block_deals_out_its_legs_once(spark):
    """Before, each of the dozen sums was a branch of its own, derived and shuffled apart."""
    tx, events = drawn(4, 50)
    ev = spark.createDataFrame(events, "event_id string, sender string, destination string, cents long, event_time long")
    sides = legs(spark.createDataFrame(tx, TX).withColumn("cents", F.col("cents") % 1000))
    for block in (asof.destination_block(ev, sides), asof.sender_block(ev, sides)):
        plan = block._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("LogicalRDD") <= 12


def test_legs_nobody_asks_for_are_not_dealt_out(spark):
    """Before, all legs were ordered by pair in windows and dealt out again, also those of keys without a probe; the events were joined to their facts."""
    tx, events = drawn(5)
    ev = spark.createDataFrame([e for e in events if e[2] in ("a", None)], "event_id string, sender string, destination string, cents long, event_time long")
    sides = legs(spark.createDataFrame(tx, TX).repartition(3))
    block = asof.destination_block(ev, sides, ("sender", "cents"))
    plan = block._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Join") == 1 and "Join LeftSemi" in plan
    want = {e: d for e, d, _ in plain(tx, events)}
    ends = {e[0]: (e[1], e[3]) for e in events}
    rows = block.collect()
    assert len(rows) == sum(e[2] in ("a", None) for e in events)
    for r in rows:
        assert (r["sender"], r["cents"]) == ends[r["event_id"]] and {k: r[k] for k in want[r["event_id"]]} == want[r["event_id"]]


@pytest.mark.parametrize("tuning", [{}, {"hub": 20, "bucket_rows": 50}, {"hub": 3}], ids=["whole", "cut", "all cut"])
def test_pairs_and_payees_equal_plain_loops_and_deal_out_once(spark, tuning):
    """Before, each sum of a pair and each best payee was a delta of its own, ordered in windows over all legs."""
    tx, events = drawn(6)
    ev = spark.createDataFrame(events, "event_id string, sender string, destination string, cents long, event_time long")
    sides = legs(spark.createDataFrame(tx, TX).repartition(3))
    pairs = asof.pair_block(ev, sides, **tuning)
    payees = asof.top_payees(asof.side(sides, "out"), asof.probes_of(ev, "destination"), **tuning)
    if not tuning:
        assert all("Window" not in d._jdf.queryExecution().optimizedPlan().toString() for d in (pairs, payees))
    got, best = {r["event_id"]: r for r in pairs.collect()}, {r["probe"]: r["top_payee"] for r in payees.collect()}
    assert len(got) == len(best) == len(events)
    for e, sender, dest, _, t in events:
        sent = sorted((at, h, c) for h, f, to, _, c, at in tx if (f, to) == (sender, dest) and at < t)
        r, cents = got[e], [c for _, _, c in sent]
        assert (r["sender_prior_sends_to_dest"], r["pair_prior_cents"], r["pair_max_prior_cents"], r["pair_min_prior_cents"]) == (len(sent), sum(cents), max(cents, default=None), min(cents, default=None))
        assert (r["pair_first"], r["pair_last"], r["pair_first_cents"]) == ((sent[0][0], sent[-1][0], sent[0][2]) if sent else (None, None, None))
        assert r["pair_outflow_cents_7d"] == sum(c for at, _, c in sent if at >= t - 7 * DAY)
        paid = {}
        for _, f, to, _, c, at in tx:
            if f == dest and at < t:
                paid[to] = paid.get(to, 0) + c
        assert best[e] == min(paid, key=lambda p: (-paid[p], p), default=None), e


def test_shared_peers_equal_plain_and_what_cannot_be_shared_is_left_out(spark, monkeypatch):
    """Before, all peers of one end of every pair were looked up at the other."""
    tx, events = drawn(7, 60)
    ways = [(h, f"c{f}", f"s{to}", u, c, at) for h, f, to, u, c, at in tx]
    for rows, asked in ((tx, events), (ways, [(e, s and f"c{s}", d and f"s{d}", c, t) for e, s, d, c, t in events])):
        ev = spark.createDataFrame(asked, "event_id string, sender string, destination string, cents long, event_time long")
        looked = []
        monkeypatch.setattr(asof, "looked_up", lambda *a, f=asof.looked_up: looked.append(a) or f(*a))
        got = {r["event_id"]: r["shared_counterparties"] for r in asof.shared_block(ev, legs(spark.createDataFrame(rows, TX))).collect()}
        monkeypatch.undo()
        assert len(got) == len(asked) and bool(looked) == (rows is tx)
        for e, s, d, _, t in asked:
            peers = [{p for _, f, to, _, _, at in rows if at < t for x, p in ((f, to), (to, f)) if x == end} for end in (s, d)]
            assert got[e] == len(peers[0] & peers[1]), e
