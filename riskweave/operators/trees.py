"""Additive tree ensembles given as JSON, compiled to nested CASE expressions; probabilities and bands of a score."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .order import quantiles

#: A small ensemble with an exact SQL equivalent. A leaf is {"v"}; a split sends value <= t to "l", else to "r", a missing value left if "d" is 1, right if 0.
FIXED_MODEL: dict = {
    "features": ["dest_senders_7d", "dest_age_days", "dest_inbound_count"],
    "trees": [
        {"f": 0, "t": 2.5, "d": 1, "l": {"v": -0.6}, "r": {"f": 1, "t": 300.0, "d": 0, "l": {"v": 1.1}, "r": {"v": 0.4}}},
        {"f": 2, "t": 20.0, "d": 1, "l": {"v": -0.3}, "r": {"v": 0.5}},
        {"f": 1, "t": 90.0, "d": 0, "l": {"v": 0.7}, "r": {"v": -0.2}},
    ],
    "thresholds": {"elevated": 0.5, "high": 0.7},
}


def significant(digits: int):
    """A function of a column: doubles at so many significant digits, so that engines that sum in another order see one value."""

    @F.pandas_udf(DoubleType())
    def rounded(x: pd.Series) -> pd.Series:
        return pd.Series(to_digits(x.to_numpy(np.float64, na_value=np.nan), digits))

    return rounded


def to_digits(x: np.ndarray, digits: int) -> np.ndarray:
    """What float(f"{v:.{digits}g}") gives for each value.

    Scaled by a power of ten that is exact (10^22 at most), the nearest integer is the right one unless the scaled value, off by its
    last bit at most, lies next to the middle of two; integer and power then give the decimal's nearest double. The others are written out.
    """
    with np.errstate(all="ignore"):
        shift = digits - 1 - np.floor(np.log10(np.abs(x)))
        power = 10.0 ** np.clip(np.abs(shift), 0, 22)
        scaled = np.where(shift >= 0, x * power, x / power)
        whole, size = np.rint(scaled), np.abs(scaled)
        sure = (np.abs(shift) <= 22) & (size >= 10.0 ** (digits - 1)) & (size < 10.0**digits) & (np.abs(np.abs(scaled - whole) - 0.5) > 10.0**digits * 2.0**-51)
        out = np.where(shift >= 0, whole / power, whole * power)
    plain = ~np.isfinite(x) | (x == 0)
    out[plain] = x[plain]
    rest = ~sure & ~plain
    out[rest] = [float(f"{v:.{digits}g}") for v in x[rest].tolist()]
    return out


quantise = significant(12)


def compile_tree(node: dict, inputs: list[Column]) -> Column:
    if "v" in node:
        return F.lit(float(node["v"]))
    x = inputs[node["f"]]
    left, right = (compile_tree(node[k], inputs) for k in "lr")
    missing = left if node.get("d") in (1, True, "l") else right
    return F.when(x.isNull() | F.isnan(x), missing).when(x <= F.lit(float(node["t"])), left).otherwise(right)


def margin(model: dict) -> Column:
    """Sum of the trees over the feature columns as they are; a null or NaN is missing. See quantised() for inputs at 12 digits."""
    inputs = [F.col(c).cast("double") for c in model["features"]]
    return reduce(lambda a, b: a + b, (compile_tree(t, inputs) for t in model["trees"]))


def quantised(rows: DataFrame, model: dict) -> DataFrame:
    """rows with the model's features at 12 significant digits."""
    return rows.withColumns({c: quantise(F.col(c).cast("double")) for c in model["features"]})


def probability(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def platt(raw: Column, a: float, b: float) -> Column:
    """Calibrated probability: a logistic of the raw score's logit."""
    p = F.greatest(F.least(raw, F.lit(1 - 1e-9)), F.lit(1e-9))
    return probability(a * F.log(p / (1 - p)) + b)


def bands(score: Column, thresholds: dict) -> Column:
    """Bands of an address score."""
    return F.when(score >= thresholds["high"], "high").when(score >= thresholds["elevated"], "elevated").otherwise("ordinary")


def event_bands(raw: Column, thresholds: dict) -> Column:
    """Bands of a transfer's raw score."""
    return F.when(raw >= thresholds["high_risk"], "high_risk").when(raw >= thresholds["caution"], "caution").otherwise("safe")


#: Quantiles of the controls' scores that bound the bands, by kind of model.
CONTROL_QUANTILES = {"event": (0.95, 0.99), "address": (0.90, 0.99), "legacy address": (0.80, 0.95)}


def band_thresholds(rows: DataFrame, kind: str = "event") -> DataFrame:
    """One row (lower, upper): the bands' bounds from the scores of label 0."""
    return quantiles(rows.where("label = 0"), "score", list(CONTROL_QUANTILES[kind]), "q").select(F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"))


def contributions(rows: DataFrame, model: dict, key: str = "event_id") -> DataFrame:
    """(key, feature, contribution): how far each feature moved the margin from the trees' mean leaf, along the path of each tree.

    A split passes on the difference between the means of the node it leads to and its own to its feature
    (path attribution): the sums over features and the mean of all leaves give the margin. For ensembles without
    numbers of rows; shapley.py has exact values for those with them.
    """

    def mean(node: dict) -> float:
        return float(node["v"]) if "v" in node else (mean(node["l"]) + mean(node["r"])) / 2

    def along(node: dict, feature: int, inputs: list[Column]) -> Column:
        if "v" in node:
            return F.lit(0.0)
        x = inputs[node["f"]]
        left, right = (along(node[k], feature, inputs) + F.lit((mean(node[k]) - mean(node)) * (node["f"] == feature)) for k in "lr")
        return F.when(x.isNull() | F.isnan(x), left if node.get("d") in (1, True, "l") else right).when(x <= F.lit(float(node["t"])), left).otherwise(right)

    inputs = [F.col(c).cast("double") for c in model["features"]]
    each = [F.struct(F.lit(c).alias("feature"), reduce(lambda a, b: a + b, (along(t, i, inputs) for t in model["trees"])).alias("contribution")) for i, c in enumerate(model["features"])]
    return rows.select(key, F.explode(F.array(*each)).alias("x")).select(key, "x.*")


def reasons(parts: DataFrame, key: str = "event_id", most: int = 5, sign: int = 1) -> DataFrame:
    """(key, reasons): the features that raise (sign 1) or lower (-1) the margin, strongest first."""
    rows = parts.where(F.col("contribution") * sign > 0)
    ordered = F.sort_array(F.collect_list(F.struct((-F.abs("contribution")).alias("minus"), "feature")))
    return rows.groupBy(key).agg(F.transform(F.slice(ordered, 1, most), lambda x: x["feature"]).alias("reasons"))
