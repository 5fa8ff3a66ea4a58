"""Places and first moments within pairs, dealt out packed, against plain Python."""

import random

from riskweave.operators import legs as L


def events_of(spark, seed):
    rng = random.Random(seed)
    rows = [(f"e{i}", rng.choice([None, "a", "b", "c"]), rng.choice(["x", "y", None]), rng.choice([None, *range(8)]), i) for i in range(300)]
    return rows, spark.createDataFrame(rows, "event_id string, sender string, destination string, event_time long, cents long").repartition(4)


def in_pairs(rows):
    pairs = {}
    for r in sorted(rows, key=lambda r: (r[3] is not None, r[3] or 0, r[0])):  # unknown times first, as a window has them
        pairs.setdefault(r[1:3], []).append(r)
    return pairs


def test_position_in_pair(spark):
    rows, df = events_of(spark, 1)
    got = L.transfer_position(df, 7)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()  # rows were moved one by one for it
    want = {(*r, k) for own in in_pairs(rows).values() for k, r in enumerate(own[:7], 1)}
    assert {tuple(r) for r in got.collect()} == want


def test_first_moment_of_a_pair(spark):
    rows, df = events_of(spark, 2)
    rows, df = [r for r in rows if r[3] is not None], df.where("event_time is not null")
    want = {(*r, int(r[3] == own[0][3])) for own in in_pairs(rows).values() for r in own}
    assert {tuple(r) for r in L.first_sends(df).collect()} == want
