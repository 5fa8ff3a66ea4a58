"""Resampled bounds of ranking metrics: every replicate at once, in one order of the scores.

A unit's weight in a replicate is the number of times that a resample with replacement draws it, a Poisson
number with mean 1 given by a hash of unit and replicate. Weights are added up per score where rows are
read; scores are then range-partitioned, and a piece continues the sums of those above it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import mixed
from .store import written

PIECE_SCORES = 1 << 13
SUMS = "score double, pos array<long>, neg array<long>"
_TAIL = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])


def weights(units: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """(units, replicates + 1) of unit hashes: 1 for replicate 0, the rows as they are, else how often it is drawn."""
    salt = mixed(np.arange(1, replicates + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1_000_003))
    u = (mixed(units.astype(np.uint64)[:, None] ^ salt[None, :]) >> np.uint64(11)) / float(1 << 53)
    return np.concatenate([np.ones((len(units), 1), np.int64), np.searchsorted(_TAIL, u.ravel(), side="right").reshape(u.shape)], axis=1)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), np.ascontiguousarray(x, np.int64).ravel())


def _matrix(column, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _summed(score: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of equal scores added up, highest score first."""
    order = np.argsort(-score, kind="stable")
    score = score[order]
    first = np.flatnonzero(np.append(True, score[1:] != score[:-1]))
    return score[first], np.add.reduceat(pos[order], first), np.add.reduceat(neg[order], first)


def score_sums(rows: DataFrame, unit: str, score: str, label: str, replicates: int, seed: int) -> DataFrame:
    """SUMS of the weights of positives and negatives, by score and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 2048):
                batch = whole.slice(a, 2048)
                w = weights(batch.column(0).to_numpy().view(np.uint64), replicates, seed)
                y = batch.column(2).to_numpy()[:, None]
                s, pos, neg = _summed(batch.column(1).to_numpy(), w * (y == 1), w * (y == 0))
                yield pa.RecordBatch.from_arrays([pa.array(s), _lists(pos), _lists(neg)], names=["score", "pos", "neg"])

    return rows.select(F.xxhash64(F.col(unit).cast("string")), F.col(score).cast("double"), F.col(label).cast("int")).mapInArrow(run, SUMS)


def merged(width: int):
    """Sorted SUMS with a row a score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = [batch.column("score").to_numpy(), _matrix(batch.column("pos"), width), _matrix(batch.column("neg"), width)]
            if kept is not None:
                parts = [np.concatenate([k, p]) for k, p in zip(kept, parts, strict=True)]
            s, pos, neg = _summed(*parts)
            kept = s[-1:], pos[-1:], neg[-1:]
            if len(s) > 1:
                yield pa.RecordBatch.from_arrays([pa.array(s[:-1]), _lists(pos[:-1]), _lists(neg[:-1])], names=["score", "pos", "neg"])
        if kept is not None:
            yield pa.RecordBatch.from_arrays([pa.array(kept[0]), _lists(kept[1]), _lists(kept[2])], names=["score", "pos", "neg"])

    return run


def replicate_metrics(rows: DataFrame, replicates: int = 400, unit: str = "event_id", score: str = "score", label: str = "label", seed: int = 17) -> DataFrame:
    """(replicate, positives, negatives, roc_auc, average_precision); replicate 0 is the rows themselves.

    A unit with several rows is drawn with all of them. Equal scores share their place. Rows with a null or NaN
    score or a label other than 0 and 1 take no part; a replicate without one of the labels is left out.
    """
    width = replicates + 1
    rows = rows.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(label).isin(0, 1))
    spark = rows.sparkSession
    sums = written(score_sums(rows, unit, score, label, replicates, seed))
    pieces = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sums.count() // PIECE_SCORES)
    placed = written(sums.repartitionByRange(pieces, F.desc("score")).sortWithinPartitions(F.desc("score")).mapInArrow(merged(width), SUMS).withColumn("piece", F.spark_partition_id()))

    def totals(group: pa.Table) -> pa.Table:
        both = [_lists(_matrix(group[c], width).sum(axis=0)[None, :]) for c in ("pos", "neg")]
        return pa.table([group["piece"][:1], *both], names=["piece", "pos", "neg"])

    held = sorted(placed.groupBy("piece").applyInArrow(totals, "piece int, pos array<long>, neg array<long>").collect(), key=lambda r: r["piece"])  # a row a piece
    at = {r["piece"]: i for i, r in enumerate(held)}
    pos, neg = (np.array([r[c] for r in held], np.int64).reshape(-1, width) for c in ("pos", "neg"))
    above = spark.sparkContext.broadcast((at, np.cumsum(pos, axis=0) - pos, np.cumsum(neg, axis=0) - neg))

    def parts(group: pa.Table) -> pa.Table:
        where, pos_above, neg_above = above.value
        i = where[group["piece"][0].as_py()]
        _, p, n = _summed(group["score"].to_numpy(), _matrix(group["pos"], width), _matrix(group["neg"], width))
        tp = np.cumsum(p, axis=0) + pos_above[i]
        fp = np.cumsum(n, axis=0) + neg_above[i]
        wins = (n * (tp - p / 2)).sum(axis=0)
        precise = (p * tp / np.maximum(tp + fp, 1)).sum(axis=0)
        return pa.table([pa.array(np.arange(width)), pa.array(p.sum(axis=0)), pa.array(n.sum(axis=0)), pa.array(wins), pa.array(precise)], names=["replicate", "positives", "negatives", "wins", "precise"])

    out = placed.groupBy("piece").applyInArrow(parts, "replicate long, positives long, negatives long, wins double, precise double")
    out = out.groupBy("replicate").agg(*(F.sum(c).alias(c) for c in ("positives", "negatives", "wins", "precise"))).where("positives > 0 and negatives > 0")
    return out.select("replicate", "positives", "negatives", (F.col("wins") / F.col("positives") / F.col("negatives")).alias("roc_auc"), (F.col("precise") / F.col("positives")).alias("average_precision"))


def bounds(replicated: DataFrame, metrics: tuple[str, ...] = ("roc_auc", "average_precision")) -> DataFrame:
    """(metric, value, lo, hi): the value of the rows themselves and the middle 95 % of the replicates' (interpolated)."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics)))
    long = replicated.select("replicate", each.alias("x")).select("replicate", "x.*")
    drawn = F.when(F.col("replicate") > 0, F.col("v"))
    return long.groupBy("metric").agg(F.max(F.when(F.col("replicate") == 0, F.col("v"))).alias("value"), F.percentile(drawn, 0.025).alias("lo"), F.percentile(drawn, 0.975).alias("hi"))
