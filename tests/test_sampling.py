"""Quota picks and window samples against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from riskweave.operators import sampling


def turn(key):
    return hashlib.md5(f"17|{key}".encode()).hexdigest(), key


def plain_pick(rows, quotas):
    used_s, used_d, out = set(), set(), set()
    for i, (label, k) in enumerate(quotas):
        taken = 0
        for key, s, d, y in sorted((r for r in rows if r[3] == label and r[1] is not None and r[2] is not None), key=lambda r: turn(r[0])):
            if taken == k:
                break
            if s not in used_s and d not in used_d:
                used_s.add(s)
                used_d.add(d)
                out.add((key, i))
                taken += 1
    return out


@pytest.mark.parametrize(("n", "people", "quotas"), [(400, 60, [(1, 5), (0, 8), (2, 3)]), (300, 9, [(0, 50), (1, 50)]), (200, 200, [(1, 1), (0, 1000)]), (60, 1, [(0, 3), (1, 3)])], ids=["few", "scarce", "many", "one"])
def test_quota_pick_equals_taking_one_by_one(spark, n, people, quotas):
    rng = random.Random(n)
    rows = [(f"e{i}", f"s{rng.randrange(people)}", f"d{rng.randrange(people)}", rng.choice([0, 0, 1, 2])) for i in range(n)] + [("x", None, "d", 1), ("y", "s", None, 0)]
    df = spark.createDataFrame(rows, "event_id string, sender string, destination string, label int").repartition(4)
    got = sampling.quota_pick(df, [(F.col("label") == label, k) for label, k in quotas]).collect()
    assert {(r["event_id"], r["quota"]) for r in got} == plain_pick(rows, quotas) and len(got) == len({r["sender"] for r in got}) == len({r["destination"] for r in got})
    assert sampling.quota_pick(df.limit(0), [(F.lit(True), 3)]).count() == 0


def test_firehose_equals_plain(spark):
    rng = random.Random(4)
    day = 1000
    tx = [(f"t{i:03}", f"a{rng.randrange(40)}", f"a{rng.randrange(40)}", rng.randrange(0, 9000)) for i in range(300)]
    windows = [(0, 500, 2500), (1, 2400, 2401), (2, 8000, 8900), (3, 5, 5)]
    got = sampling.firehose(spark.createDataFrame(tx, "tx_hash string, from_address string, to_address string, block_time long"), spark.createDataFrame(windows, "window int, start long, stop long"), spark.createDataFrame([("a1",), ("a2",)], "address string"), 15, most=12, width=day)
    seen = []
    for _, a, b in windows:
        for _, s, d, _ in sorted((t for t in tx if a <= t[3] < b), key=lambda t: (t[3], t[0], t[2]))[:12]:
            seen += [s, d]
    pool = [a for a in dict.fromkeys(seen) if a not in ("a1", "a2")]
    chosen = set(sorted(pool, key=turn)[:15])
    assert [r["address"] for r in sorted(got.collect(), key=lambda r: r["place"])] == [a for a in pool if a in chosen]
