"""Resampled metrics against resampling in plain Python with the same weights."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators import resampling


def frame(spark, n, seed=1):
    rng = random.Random(seed)
    rows = [(f"u{i // 2}", rng.choice([0.1, 0.5, 0.5, rng.random()]), int(rng.random() < 0.3)) for i in range(n)]
    return spark.createDataFrame([*rows, ("x", None, 1), ("y", float("nan"), 1), ("z", 0.2, None), ("w", 0.2, 7)], "event_id string, score double, label int").repartition(5)


def plain(rows, weight):
    drawn = [(s, y) for u, s, y in rows for _ in range(weight[u])]
    pos, neg = ([s for s, y in drawn if y == k] for k in (1, 0))
    if not pos or not neg:
        return None
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    ap = sum(sum(q >= s for q in pos) / sum(x >= s for x, _ in drawn) for s in pos) / len(pos)
    return len(pos), len(neg), auc, ap


@pytest.mark.parametrize("n", [300, 4])
def test_replicates_equal_plain(spark, n, monkeypatch):
    monkeypatch.setattr(resampling, "PIECE_SCORES", 40)
    df = frame(spark, n)
    got = {r["replicate"]: tuple(r)[1:] for r in resampling.replicate_metrics(df, replicates=12).collect()}
    held = df.where("label in (0, 1) and score = score and not isnan(score)").select("event_id", "score", "label", F.xxhash64("event_id").alias("h")).collect()
    hashes = {r["event_id"]: r["h"] for r in held}
    units = list(hashes)
    w = resampling.weights(np.array([hashes[u] for u in units], np.int64).view(np.uint64), 12, 17)
    for k in range(13):
        want = plain([tuple(r)[:3] for r in held], dict(zip(units, w[:, k].tolist(), strict=True)))
        assert (k in got) == (want is not None)
        if want:
            assert got[k] == pytest.approx(want, abs=1e-12)


def test_weights_are_draws():
    w = resampling.weights(np.arange(20_000, dtype=np.uint64), 20, 3)
    assert (w[:, 0] == 1).all() and abs(w[:, 1:].mean() - 1) < 0.01 and abs(w[:, 1:].var() - 1) < 0.02
    assert abs(np.corrcoef(w[:, 1], w[:, 2])[0, 1]) < 0.03


def test_bounds_hold_the_value(spark):
    got = {r["metric"]: r for r in resampling.bounds(resampling.replicate_metrics(frame(spark, 600), replicates=60)).collect()}
    assert set(got) == {"roc_auc", "average_precision"}
    assert all(r["lo"] < r["value"] < r["hi"] for r in got.values())
    assert resampling.replicate_metrics(frame(spark, 5).limit(0)).count() == 0
