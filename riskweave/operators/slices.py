"""Parts of a test set on which a model is judged apart, and the most controls that stay balanced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .asof import looked_up
from .labels import mean_differences
from .nearest import COVARIATES, match_nearest
from .store import written

# Bounds of the slices, ratios that are tried and the difference that counts as balanced.
SLICES = {
    "hard_negatives": "label = 1 or dest_senders_all >= 5",
    "first_sends": "is_first_send_to_dest = 1",
    "new_destinations": "dest_senders_all <= 1",
}
RATIOS, BALANCED = (10, 5, 3, 2, 1), 0.1


def slices(test: DataFrame, train: DataFrame) -> DataFrame:
    """test's rows with `slice`, once for each slice they are in: SLICES, and unseen_destinations, those to a destination that train has not. Unknown facts are in no slice; a null destination counts as unseen."""
    named = F.explode(F.filter(F.array(*(F.when(F.expr(c), F.lit(n)) for n, c in SLICES.items()), F.when(F.col("seen").isNull(), F.lit("unseen_destinations"))), lambda s: s.isNotNull()))
    known = train.select("destination").distinct().withColumn("seen", F.lit(True))
    return looked_up(test, known, ["destination"]).withColumn("slice", named).select(*test.columns, "slice")


def balanced_ratio(rows: DataFrame, covariates: list[str] = COVARIATES, stratum: Column | None = None, seed: int = 17, ratios: tuple[int, ...] = RATIOS) -> tuple[int, float, DataFrame]:
    """(ratio, worst difference, pairs): of the ratios in turn the first whose matched controls differ from the positives by less than BALANCED in every covariate; else the one that differs least.

    rows and pairs as in match_nearest.
    """
    best = None
    for ratio in ratios:
        pairs = written(match_nearest(rows, ratio, covariates, stratum, seed))
        matched = rows.where("label = 1").unionByName(rows.join(pairs.select(F.col("control").alias("event_id")), "event_id").select(*rows.columns))
        worst = mean_differences(matched, covariates).agg(F.max("abs_smd").alias("worst")).first()["worst"]
        worst = float("inf") if worst is None else worst
        if best is None or worst < best[1]:
            best = ratio, worst, pairs
        if worst < BALANCED:
            return ratio, worst, pairs
    return best
