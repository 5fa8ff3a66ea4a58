"""Orders, nearest values and nearest-neighbour matching against plain Python."""

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskweave.operators import nearest, order, probes


def test_numbered(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, 1, 2, 2, 2, 2, 5, rng.randint(0, 50)])) for i in range(400)]
    got = order.numbered(spark.createDataFrame(rows, "i int, v int").repartition(5), ["v"]).collect()
    assert sorted(r["nth"] for r in got) == list(range(400))
    by_place = [r["v"] for r in sorted(got, key=lambda r: r["nth"])]
    assert by_place == sorted((v for _, v in rows), key=lambda v: (v is not None, v or 0))
    assert order.numbered(spark.createDataFrame([], "v int"), ["v"]).count() == 0


def test_quantiles_equal_the_aggregate(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), rng.choice([None, 1.5, 1.5, 2.0, rng.random()])) for _ in range(300)] + [("c", None), ("d", 7.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    shares = [0.0, 0.025, 0.5, 0.9, 1.0]
    want = {r["k"]: r["q"] for r in df.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q")).collect()}
    got = {r["k"]: r["q"] for r in order.quantiles(df, "v", shares, "q", ["k"]).collect()}
    assert got == {k: pytest.approx(q) for k, q in want.items() if q is not None and q[0] is not None}
    whole = order.quantiles(df, "v", shares, "q").first()["q"]
    assert whole == pytest.approx(df.agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q")).first()["q"])
    assert order.quantiles(df.limit(0), "v", [0.5], "q").first()["q"] == [None]


@pytest.mark.parametrize("marks", [25, 1, 0])
def test_nearest_equals_plain(spark, marks):
    rng = random.Random(marks)
    asked = [(i, None if rng.random() < 0.05 else rng.randint(0, 100), None if rng.random() < 0.05 else rng.randint(-20, 100)) for i in range(300)]
    values = [rng.randint(0, 100) for _ in range(marks)]
    out = order.nearest(spark.createDataFrame(asked, "i int, w long, l long").repartition(3), spark.createDataFrame([(x,) for x in values], "value long"), "w", "l")
    got = {r["i"]: r["mark"] for r in out.collect()}
    best = lambda w, low: min((x for x in values if w is not None and low is not None and x > low), key=lambda x: (abs(x - w), x), default=None)
    assert got == {i: best(w, low) for i, w, low in asked}


def test_probes_without_positives(spark):
    controls = spark.createDataFrame([("c", 5)], "address string, first_seen long")
    none = spark.createDataFrame([], "address string, first_seen long, mark long")
    covered = spark.createDataFrame([], "address string, truncated boolean, last_seen long")
    assert probes.probes(none, controls, covered).count() == 0


def rows_of(seed, n, share=0.2):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        label = int(rng.random() < share)
        v = [rng.choice([0.0, 1.0, 1.0, rng.uniform(0, 300)]) for _ in range(3)]  # many equal points
        if rng.random() < 0.05:
            v[1] = None
        out.append((f"e{i}", label, *v, rng.choice(["first", "again", "again"])))
    return out + [("lonely", 1, 1.0, 1.0, 1.0, "no controls"), ("alone", 0, 1.0, 1.0, 1.0, "no positives")]


def turn(key, seed=17):
    return hashlib.md5(f"{seed}|{key}".encode()).hexdigest()


def plain_match(rows, ratio):
    out = set()
    for s in {r[5] for r in rows}:
        own = [(r[0], r[1], [round(math.log1p(max(x or 0.0, 0.0)), 12) for x in r[2:5]]) for r in rows if r[5] == s]
        pos, neg = ([r for r in own if r[1] == k] for k in (1, 0))
        if not pos or not neg:
            continue
        mean = [sum(r[2][i] for r in neg) / len(neg) for i in range(3)]
        sd = [math.sqrt(sum((r[2][i] - mean[i]) ** 2 for r in neg) / len(neg)) or 1.0 for i in range(3)]
        at = {r[0]: [round((r[2][i] - mean[i]) / sd[i], 9) for i in range(3)] for r in own}
        used = set()
        for p in sorted(pos, key=lambda r: (turn(r[0]), r[0])):
            near = sorted(neg, key=lambda r: (round(math.dist(at[p[0]], at[r[0]]), 12), turn(r[0]), r[0]))[: nearest.asked_for(ratio, len(neg))]
            taken = [r[0] for r in near if r[0] not in used][:ratio]
            used |= {*taken}
            out |= {(p[0], c) for c in taken}
    return out


@pytest.mark.parametrize(("n", "ratio", "slab", "task"), [(400, 2, 30, 5000), (300, 5, 1000, 1 << 18), (200, 4, 7, 0)], ids=["slabs", "one", "short"])
def test_match_equals_taking_turns(spark, n, ratio, slab, task):
    rows = rows_of(n, n)
    df = spark.createDataFrame(rows, "event_id string, label int, sender_age_days double, sender_outbound_count double, sender_median_out_usd double, s string").repartition(4)
    got = nearest.match_nearest(df, ratio, stratum=F.col("s"), slab_rows=slab, task_rows=task).collect()
    pairs = {(r["event_id"], r["control"]) for r in got}
    assert len(pairs) == len(got) and max(Counter(c for _, c in pairs).values()) == 1
    assert pairs == plain_match(rows, ratio)


def test_turns_with_few_controls(spark):
    wishes = [(f"{i:03}", f"p{i}", f"c{j}", j + 1) for i in range(30) for j in range(10)]  # all want the same, in the same order
    df = spark.createDataFrame(wishes, "turn string, event_id string, control string, place int").repartition(3)
    for task_rows in (0, 100, 1000):
        got = nearest.in_turns(df, 3, task_rows)
        assert {tuple(r) for r in got.collect()} == {(f"p{i // 3}", f"c{i}") for i in range(10)}


def test_ratio_search_keeps_the_most_that_is_balanced(spark):
    from riskweave.operators import labels, slices

    rng = random.Random(6)
    rows = [(f"p{i}", 1, rng.uniform(0, 3)) for i in range(40)] + [(f"n{i}", 0, rng.uniform(0, 3)) for i in range(90)] + [(f"f{i}", 0, rng.uniform(50, 90)) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id string, label int, v double").repartition(3)
    ratio, worst, pairs = slices.balanced_ratio(df, ["v"], ratios=(5, 2, 1))
    assert ratio in (2, 1) and worst < slices.BALANCED
    values = {k: v for k, _, v in rows}
    matched = [values[r["control"]] for r in pairs.collect()]
    assert len(matched) == 40 * ratio and max(matched) < 50
    worse = spark.createDataFrame([*rows[:40], *rows[130:]], "event_id string, label int, v double")
    ratio, worst, _ = slices.balanced_ratio(worse, ["v"], ratios=(2, 1))
    assert worst > slices.BALANCED  # none is balanced: the best is told with its difference
    assert labels.mean_differences(df, ["v"]).first()["abs_smd"] > worst / 10


def test_what_comes_after_is_looked_at_backwards(spark):
    """A frame up to the end of a piece is summed up anew for each of its rows."""
    asked, marks = spark.createDataFrame([(1,), (5,)], "value long"), spark.createDataFrame([(3,)], "value long")
    got = order.neighbours(asked, marks)
    assert "unboundedfollowing" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert sorted((r["value"], r["below"], r["above"]) for r in got.collect()) == [(1, None, 3), (5, 3, None)]


def test_few_wishes_are_dealt_out_first(spark, monkeypatch):
    """All want the same controls, so that most have to wish again and again; no deal holds all wishes from the start."""
    wishes = [(f"{i:03}", f"e{i}", f"c{j:03}", j + 1) for i in range(25) for j in range(90)]
    sizes, dealt = [], nearest.in_rounds
    monkeypatch.setattr(nearest, "in_rounds", lambda front, *rest: (sizes.append(front.count()), dealt(front, *rest))[1])
    got = sorted(map(tuple, nearest.in_turns(spark.createDataFrame(wishes, "turn string, event_id string, control string, place int"), 3).collect()))
    assert got == sorted((f"e{i}", f"c{j:03}") for i in range(25) for j in range(3 * i, 3 * i + 3))
    assert sizes[0] == 25 * 12 and len(sizes) > 1 and sizes[-1] <= len(wishes)


def test_search_keeps_equally_near_ones_by_turn():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(4)
    points = [[rng.choice([0.0, 1.0, 2.0]), rng.choice([0.0, 0.1, 1 / 3]), rng.choice([0.0, 1.0])] for _ in range(300)]
    controls = pa.table({"event_id": [f"c{i}" for i in range(300)], "turn": [f"{i * 7 % 300:03}" for i in range(300)], "x": points})
    asked = [([1.0, 0.1, 0.0], 20, math.inf), ([0.5, 0.0, 1.0], 400, math.inf), ([2.0, 0.0, 0.0], 50, 0.6)]
    positives = pa.table({"event_id": list("abc"), "turn": list("xyz"), "x": [a[0] for a in asked], "k": [a[1] for a in asked], "within": [a[2] for a in asked]})
    got = nearest.search(positives, controls).to_pylist()
    for who, (x, k, within) in zip("abc", asked, strict=True):
        far = sorted((float(np.round(math.dist(x, p), 12)), f"{i * 7 % 300:03}", f"c{i}") for i, p in enumerate(points))
        mine = [(r["distance"], r["control_turn"], r["control"]) for r in got if r["event_id"] == who]
        assert mine == [t for t in far if t[0] <= within][:k]


def test_only_those_left_short_look_for_more(spark, monkeypatch):
    """Of 200 nearest controls most positives need the first few: no more are looked for, nor moved."""
    rows = [(f"p{i}", 1, float(i % 10), 1.0, 1.0) for i in range(60)] + [(f"n{i}", 0, i / 40, 1.0, 1.0) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id string, label int, sender_age_days double, sender_outbound_count double, sender_median_out_usd double")
    asked, look = [], nearest.candidates
    monkeypatch.setattr(nearest, "candidates", lambda positives, slabs: asked.append([r["k"] for r in positives.select("k").collect()]) or look(positives, slabs))
    got = {(r["event_id"], r["control"]) for r in nearest.match_nearest(df, 2, slab_rows=50).collect()}
    assert asked[0] == [8] * 60 and all(len(k) < 60 for k in asked[1:])
    assert got == plain_match([(*r, "-") for r in rows], 2)


def test_boxes_are_close_on_all_sides():
    import numpy as np

    points, nodes = np.random.default_rng(1).random((4096, 4)), []
    nearest.grown(points, 64, nodes)
    leaves = [n for n in nodes if n[0] < 0]
    assert len(leaves) == 64 and {n[0] for n in nodes} == {-1, 0, 1, 2}
    alike, nodes = np.column_stack([np.ones((100, 3)), np.arange(100)]), []
    nearest.grown(alike, 10, nodes)
    assert {n[0] for n in nodes} == {-1, 3} and sum(n[0] < 0 for n in nodes) >= 10
