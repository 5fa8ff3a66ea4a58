"""Arms of the ablation against metrics in plain Python on the scores of models fitted alike."""

import random

from riskweave.operators import ablation, boosting

PARAMS = boosting.Params(rounds=2, depth=2, leaves=4, learning_rate=0.3, row_share=1.0, feature_share=1.0, least_rows=5)
SCHEMA = "event_id string, label int, sender string, destination string, transfer_k int, dest_senders_all long, sender_outbound_count long, amount_usd double, other string"


def world(spark, seed, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.3)
        rows.append((f"e{seed}-{i}", y, f"s{rng.randrange(20)}", f"d{rng.randrange(9)}", rng.randrange(1, 8), rng.randrange(3) + y * rng.randrange(4), rng.choice([None, rng.randrange(9) + 3 * y]), float(rng.randrange(50)), "x"))
    return spark.createDataFrame(rows + [("none", None, "s", "d", 1, 1, 1, 1.0, None)], SCHEMA)


def plain(rows, budget):
    pos, neg = [r for r in rows if r["label"] == 1], [r for r in rows if r["label"] == 0]
    won = sum((p["s"] > n["s"]) + 0.5 * (p["s"] == n["s"]) for p in pos for n in neg)
    ap = sum(sum(q["s"] >= p["s"] for q in pos) / sum(q["s"] >= p["s"] for q in rows) for p in pos) / len(pos)
    fits = [n["s"] for n in neg if sum(m["s"] >= n["s"] for m in neg) <= budget * len(neg)]
    t = min(fits) if fits else max(n["s"] for n in neg)
    hit = [r for r in rows if r["s"] >= t]
    pairs = {}
    for r in pos:
        pairs.setdefault((r["sender"], r["destination"]), []).append(r["transfer_k"] if r["s"] >= t else 99)
    good = sum(r["label"] for r in hit)
    base = len(pos) / len(rows)
    return {"n": len(rows), "n_pos": len(pos), "base_rate": base, "roc_auc": won / len(pos) / len(neg), "average_precision": ap, "lift": ap / base, "fpr": (len(hit) - good) / len(neg), "precision": good / max(len(hit), 1), "recall": good / len(pos), **{f"early_k{k}": sum(min(v) <= k for v in pairs.values()) / len(pairs) for k in (1, 3, 5)}}


def test_family_columns():
    assert ablation.family_columns(("sender", "context"), ["amount_usd", "dest_senders_all", "sender_outbound_count", "other"]) == ["sender_outbound_count", "amount_usd"]
    assert len(ablation.family_columns(ablation.ARMS["full"])) == 75


def test_arms_equal_plain_python(spark):
    train, test = world(spark, 1), world(spark, 2)
    arms = {"destination_only": ablation.ARMS["destination_only"], "sender_side_only": ablation.ARMS["sender_side_only"], "nothing": ("relationship",)}
    got = {r["arm"]: r.asDict() for r in ablation.run_ablation(train, test, PARAMS, arms, 0.1).collect()}
    assert set(got) == {"destination_only", "sender_side_only"}
    for arm, columns in (("destination_only", ["dest_senders_all", "amount_usd"]), ("sender_side_only", ["sender_outbound_count", "amount_usd"])):
        rows = [r.asDict() | {"s": round(r["margin"], 12)} for r in boosting.score(test.where("label is not null"), boosting.fit(train, columns, params=PARAMS)).collect()]
        want = plain(rows, 0.1)
        assert got[arm]["n_features"] == 2 and all(abs(got[arm][k] - v) < 1e-9 for k, v in want.items()), (arm, got[arm], want)


def test_destinations_without_a_past(spark):
    train, test = world(spark, 3), world(spark, 4)
    got = ablation.unseen_destinations(train, test, PARAMS).collect()
    assert [(r["arm"], r["n"]) for r in got] == [("sender_side_only", test.where("dest_senders_all <= 1 and label is not null").count())]
    assert ablation.unseen_destinations(train, test.limit(20), PARAMS).count() == 0


def test_the_query_does_the_whole_job(spark, monkeypatch):
    """All columns, all four arms, the parameters of the ablation itself."""
    from riskweave.operators.features import FEATURE_COLUMNS
    from riskweave.plans import scores

    asked = []

    def run(train, test, *parameters):
        asked.append((train, test, parameters))
        return spark.createDataFrame([("full", 75)], "arm string, n_features int")

    monkeypatch.setattr(scores.ablation, "run_ablation", run)
    assert scores.j11_ablation(spark, "/root/testdata/sf0.001").count() == 1
    train, test, parameters = asked[0]
    assert not parameters and set(FEATURE_COLUMNS) <= set(train.columns) & set(test.columns)
    assert {"label", "sender", "destination", "transfer_k"} <= set(test.columns)
