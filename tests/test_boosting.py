"""Fitting, walking and explaining ensembles against plain Python."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators import boosting, shapley, trees


def labelled(n=500, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.randint(0, 9), None if rng.random() < 0.3 else rng.randint(0, 40) / 4, rng.choice([0.0, 1.0, math.nan])
        rows.append((f"e{i}", a, b, c, int((a > 6) + (b is None) + (c == 1.0) + rng.random() > 1.7)))
    return [*rows, ("none", 1, 1.0, 1.0, None)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "event_id string, a int, b double, c double, label int").repartition(5)


FEATURES = ["a", "b", "c"]
SMALL = boosting.Params(rounds=3, depth=3, leaves=6, least_rows=25, row_share=1.0, feature_share=1.0, write_every=2, learning_rate=0.3)


def plain_fit(rows, p):
    """The same trees, every split tried on the rows themselves."""
    rows = [r for r in rows if r[4] is not None]
    x = [[None if v is None or v != v else float(v) for v in r[1:4]] for r in rows]
    y = [r[4] for r in rows]
    weight = y.count(0) / y.count(1)
    margin = [0.0] * len(rows)
    out = []
    unit = boosting.UNIT

    def goes_left(v, t, d):
        return bool(d) if v is None else v <= t

    for _ in range(p.rounds):
        g, h = [], []
        for m, label in zip(margin, y, strict=True):
            q, w = 1 / (1 + math.exp(-m)), weight if label else 1.0
            g.append(round(w * (q - label) * unit) / unit)
            h.append(round(w * q * (1 - q) * unit) / unit)
        score = lambda at: sum(g[i] for i in at) ** 2 / (sum(h[i] for i in at) + p.l2)  # noqa: B023, E731
        value = lambda at: -p.learning_rate * sum(g[i] for i in at) / (sum(h[i] for i in at) + p.l2)  # noqa: B023, E731
        tree = {"v": value(range(len(rows))), "n": len(rows)}
        open_, leaves = [(tree, list(range(len(rows))))], 1
        for _ in range(p.depth):
            found = []
            for slot, (_, at) in enumerate(open_):
                best = None
                for f in range(3):
                    values = sorted({x[i][f] for i in range(len(rows)) if x[i][f] is not None})
                    for t in values:
                        for d in (1, 0):
                            left = [i for i in at if goes_left(x[i][f], t, d)]
                            right = [i for i in at if not goes_left(x[i][f], t, d)]
                            if min(len(left), len(right)) >= p.least_rows:
                                gain = score(left) + score(right) - score(at)
                                if best is None or gain > best[0] + 1e-9:
                                    best = gain, f, t, d, left, right
                if best:
                    found.append((-best[0], slot, best))
            following = []
            for _, slot, (gain, f, t, d, left, right) in sorted(found, key=lambda r: r[:2]):
                if gain > 1e-12 and leaves < p.leaves:
                    node = open_[slot][0]
                    node.pop("v")
                    sides = [{"v": value(s), "n": len(s)} for s in (left, right)]
                    node |= {"f": f, "t": t, "d": d, "l": sides[0], "r": sides[1]}
                    following += list(zip(sides, (left, right), strict=True))
                    leaves += 1
            if not following:
                break
            open_ = following
        out.append(tree)
        for i, r in enumerate(x):
            node = tree
            while "v" not in node:
                node = node["l"] if goes_left(r[node["f"]], node["t"], node["d"]) else node["r"]
            margin[i] += node["v"]
    return out


def same(a, b):
    if "v" in a or "v" in b:
        return a["n"] == b["n"] and a["v"] == pytest.approx(b["v"], abs=1e-6)
    return (a["f"], a["t"], a["n"]) == (b["f"], b["t"], b["n"]) and same(a["l"], b["l"]) and same(a["r"], b["r"])


def test_fit_equals_plain(spark):
    rows = labelled()
    model = boosting.exported(boosting.fit(frame(spark, rows), FEATURES, params=SMALL))
    want = plain_fit(rows, SMALL)
    assert len(model["trees"]) == 3 and all(same(a, b) for a, b in zip(model["trees"], want, strict=True))
    again = boosting.exported(boosting.fit(frame(spark, rows[::-1]).repartition(2), FEATURES, params=SMALL))
    assert again == model  # whatever the order of rows
    table = boosting.model_table(spark, model)
    assert table.where("value is not null").count() == sum(str(t).count("'v'") for t in model["trees"])


def test_fit_ranks_held_out_rows(spark):
    rows = labelled(1500, 5)
    df = frame(spark, rows).where("label is not null").withColumn("late", F.crc32("event_id") % 3 == 0)
    model = boosting.fit(df.where("not late"), FEATURES, params=boosting.Params(rounds=6, depth=3, least_rows=20, learning_rate=0.3, bins=9))
    got = sorted(((r["margin"], r["label"]) for r in boosting.score(df.where("late"), model).collect()), reverse=True)
    hits, precision = 0, 0.0
    for i, (_, label) in enumerate(got, 1):
        hits += label
        precision += label * hits / i
    base = hits / len(got)
    assert precision / hits > 2 * base


def test_fit_of_nothing_and_of_one_label(spark):
    df = frame(spark, labelled(60))
    assert boosting.fit(df.limit(0), FEATURES, params=SMALL)["trees"] == []
    one = boosting.fit(df.where("label = 0"), FEATURES, params=SMALL)
    assert boosting.score(df, one).where("margin is null").count() == 0


def random_tree(rng, depth, n=1000, features=3):
    if depth == 0 or n < 4 or rng.random() < 0.1:
        return {"v": rng.uniform(-1, 1), "n": n}
    left = rng.randint(1, n - 1)
    return {"f": rng.randrange(features), "t": rng.randint(0, 8) + 0.5, "d": rng.randint(0, 1), "n": n, "l": random_tree(rng, depth - 1, left, features), "r": random_tree(rng, depth - 1, n - left, features)}


def test_large_ensemble_equals_case_expressions(spark):
    rng = random.Random(1)
    model = {"features": FEATURES, "trees": [random_tree(rng, 4) for _ in range(40)]}
    df = frame(spark, labelled(200))
    out = boosting.score(df.withColumn("cases", trees.margin(model)), model).collect()
    assert all(r["margin"] == pytest.approx(r["cases"], abs=1e-12) for r in out)


def expected(node, x, known):
    if "v" in node:
        return node["v"]
    if node["f"] in known:
        v = x[node["f"]]
        left = bool(node["d"]) if math.isnan(v) else v <= node["t"]
        return expected(node["l" if left else "r"], x, known)
    return sum(node[s]["n"] / node["n"] * expected(node[s], x, known) for s in "lr")


@pytest.mark.parametrize("seed", range(4))
def test_contributions_equal_sum_over_subsets(seed):
    rng = random.Random(seed)
    width = 4
    model = {"features": list("abcd"), "trees": [random_tree(rng, 5, features=width) for _ in range(3)]}
    explainer = shapley.Explainer(model)
    rows = np.array([[rng.choice([math.nan, *range(10)]) for _ in range(width)] for _ in range(25)], float)
    got = explainer.contributions(rows)
    for x, parts in zip(rows, got, strict=True):
        for i in range(width):
            others = [j for j in range(width) if j != i]
            want = 0.0
            for k in range(width):
                for s in itertools.combinations(others, k):
                    w = math.factorial(k) * math.factorial(width - k - 1) / math.factorial(width)
                    want += w * sum(expected(t, x, {*s, i}) - expected(t, x, {*s}) for t in model["trees"])
            assert parts[i] == pytest.approx(want, abs=1e-12)
        assert explainer.base + parts.sum() == pytest.approx(sum(expected(t, x, set(range(width))) for t in model["trees"]), abs=1e-12)


def test_statements_are_guarded_and_ordered(spark):
    features = ["dest_age_days", "dest_senders_7d", "escalation_ratio", "dest_median_hold_secs", "other"]
    rows = [
        ("young", 10.0, 4.0, 1.0, 120.0, 5.0, [0.1, 0.5, 0.4, 0.2, 0.9]),
        ("old", 400.0, 1.0, -1.0, 100_000.0, 5.0, [-0.3, 0.2, -0.1, -0.4, -1.0]),
        ("missing", None, math.nan, 3.0, -1.0, None, [0.5, 0.5, 0.1, 0.3, 0.0]),
        ("tie", 10.0, 4.0, 3.0, 1.0, 0.0, [0.2, 0.2, 0.2, 0.2, 0.2]),
    ]
    df = spark.createDataFrame(rows, "k string, dest_age_days double, dest_senders_7d double, escalation_ratio double, dest_median_hold_secs double, other double, contributions array<double>")
    up = {r["k"]: r["reasons"] for r in shapley.reasons(df, features, most=3).collect()}
    down = {r["k"]: r["reasons"] for r in shapley.reasons(df, features, sign=-1, most=1).collect()}
    assert up["young"] == ["within a week the recipient was paid by 4 wallets", "half of what arrives leaves again in 2 min", "recipient is new: first activity 10 days before"]
    assert up["old"] == [] and up["missing"] == ["amount is 3 times the largest one paid to it so far"] and len(up["tie"]) == 3
    assert up["tie"][0].startswith("recipient is new")
    assert down == {"young": [], "old": ["half of what arrives stays for 28 h"], "missing": [], "tie": []}


def test_contributions_in_spark_add_up(spark):
    rows = labelled(300)
    df = frame(spark, rows)
    model = boosting.exported(boosting.fit(df, FEATURES, params=SMALL))
    base = shapley.base_of(model)
    for r in shapley.contributions(boosting.score(df, model), model).collect():
        assert base + sum(r["contributions"]) == pytest.approx(r["margin"], abs=1e-9)


def test_sets_are_fitted_alike_in_a_task_and_by_levels(spark):
    """One task a set for few rows, a job a level for many: the same trees, as sums are whole numbers."""
    params = boosting.Params(rounds=5, depth=4, leaves=9, least_rows=10, learning_rate=0.3, write_every=2)
    sets = [FEATURES, ["c", "a"]]
    df = frame(spark, labelled(400, 8))
    few, many = (boosting.fit_sets(df, sets, params=params, task_cells=n) for n in (boosting.TASK_CELLS, 0))
    assert few == many and [m["features"] for m in few] == sets and all(len(m["trees"]) == 5 for m in few)
    assert few[1] == boosting.fit(df, sets[1], params=params)
