"""Calibration on the logit of a score, and evidence summed along a relationship."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .legs import sequential_evidence
from .metrics import by_score, early_detection, thresholds_at_fpr
from .store import written

EPS = 1e-6


def logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))
    return F.log(p / (1 - p))


@dataclass(frozen=True)
class LogitModel:
    """posterior logit = slope * logit(score) + intercept; prior_logit is that of the rows it was fitted on."""

    slope: float
    intercept: float
    prior_logit: float

    def calibrated(self, score: Column) -> Column:
        return 1 / (1 + F.exp(-(logit(score) * self.slope + self.intercept)))

    def likelihood_ratio(self, score: Column) -> Column:
        """Logarithm of how much likelier the score is among positives."""
        return logit(score) * self.slope + (self.intercept - self.prior_logit)


def fit_logit(rows: DataFrame, label: str = "label", score: str = "score") -> LogitModel:
    """Logistic regression on the logit, slope penalised by slope^2 / 2 over all rows; fitted on the counts of distinct scores. Needs both labels."""
    counts = written(by_score(rows.where(F.col(label).isin(0, 1) & F.col(score).isNotNull()), label, score))
    each = F.explode(F.array(F.struct(F.lit(1.0).alias("y"), F.col("pos").cast("double").alias("w")), F.struct(F.lit(0.0).alias("y"), F.col("neg").cast("double").alias("w"))))
    data = counts.select(array_to_vector(F.array(logit(F.col("score").cast("double")))).alias("z"), each.alias("x")).select("z", "x.y", "x.w").where("w > 0")
    pos, neg = counts.agg(F.sum("pos"), F.sum("neg")).first()
    if not pos or not neg:
        raise ValueError("calibration needs rows of either label")
    fit = LogisticRegression(featuresCol="z", labelCol="y", weightCol="w", regParam=1.0 / (pos + neg), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-10).fit(data)
    prior = data.sparkSession.range(1).select(logit(F.lit(pos / (pos + neg)))).first()[0]
    return LogitModel(float(fit.coefficients[0]), float(fit.intercept), float(prior))


def sequential_scores(scored: DataFrame, model: LogitModel, decay: float = 1.0, digits: int = 9) -> DataFrame:
    """scored with `evidence` up to and with each transfer of its pair; rounded, so that sums in another order set the same thresholds."""
    rows = sequential_evidence(scored.withColumn("value", model.likelihood_ratio(F.col("score"))), decay)
    return rows.withColumn("evidence", F.round("evidence", digits)).drop("value")


def sequential_sweep(scored: DataFrame, model: LogitModel, budget: float, decays: tuple[float, ...] = (1.0, 0.9, 0.7, 0.5, 0.3, 0.15), ks: tuple[int, ...] = (1, 2, 3, 5)) -> DataFrame:
    """(decay, k, point, sequential, delta): early detection by each transfer's score and by summed evidence, both at the same share of flagged controls."""
    point = early_detection(scored, thresholds_at_fpr(scored, [budget]), ks).select("k", F.col("rate").alias("point"))
    out = None
    for decay in decays:
        rows = sequential_scores(scored, model, decay).withColumn("score", F.col("evidence"))
        got = early_detection(rows, thresholds_at_fpr(rows, [budget]), ks).select(F.lit(float(decay)).alias("decay"), "k", F.col("rate").alias("sequential"))
        out = got if out is None else out.unionByName(got)
    return out.join(F.broadcast(point), "k").select("decay", "k", "point", "sequential", (F.col("sequential") - F.col("point")).alias("delta"))
