"""Exact Shapley values of a tree ensemble's margin, and the sentences that follow from them.

The value of a set of features is the mean of the leaves that a row can reach when only these are known: at
a split on another feature both sides count, by their numbers of rows. A leaf then is a game of the few
features on its path, of each of which a row either meets all conditions or not; the values of all such
patterns are worked out once a leaf, and rows only look theirs up.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TINY = 1e-12  #: contributions up to here are rounding
Condition = tuple[float, bool, bool]  # threshold, whether missing values go left, whether the path goes left


def leaf_paths(tree: dict) -> list[tuple[float, dict[int, tuple[float, list[Condition]]]]]:
    """Of each leaf its value and, by feature, the share of rows that pass its splits and their conditions."""
    out, stack = [], [(tree, {})]
    while stack:
        node, path = stack.pop()
        if "v" in node:
            out.append((float(node["v"]), path))
            continue
        for side in "lr":
            share, conditions = path.get(node["f"], (1.0, []))
            condition = (float(node["t"]), node.get("d") in (1, True, "l"), side == "l")
            stack.append((node[side], path | {node["f"]: (share * node[side]["n"] / node["n"], [*conditions, condition])}))
    return out


def patterns(shares: list[float]) -> np.ndarray:
    """(2**k, k): each feature's Shapley value of a leaf of value 1, for every pattern of met conditions (bit i: feature i is met)."""
    k = len(shares)
    weight = [math.factorial(s) * math.factorial(k - s - 1) / math.factorial(k) for s in range(k)]
    out = np.zeros((1 << k, k))
    for met in itertools.product((0.0, 1.0), repeat=k):
        code = sum(1 << i for i in range(k) if met[i])
        for i in range(k):
            ways = np.array([1.0])  # by number of known features among the others
            for j in range(k):
                if j != i:
                    ways = np.append(ways * shares[j], 0.0) + np.append(0.0, ways * met[j])
            out[code, i] = (met[i] - shares[i]) * sum(a * b for a, b in zip(weight, ways, strict=True))
    return out


class Explainer:
    """Contributions of an ensemble whose nodes carry their numbers of rows ("n")."""

    def __init__(self, model: dict) -> None:
        self.width = len(model["features"])
        self.leaves, self.base = [], 0.0
        for tree in model["trees"]:
            for value, path in leaf_paths(tree):
                features = sorted(path)
                shares = [path[f][0] for f in features]
                self.base += value * math.prod(shares)
                if features:
                    self.leaves.append((features, [path[f][1] for f in features], value * patterns(shares)))

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """(rows, features) of rows with NaN for missing."""
        missing = np.isnan(x)

        @functools.cache
        def passes(feature: int, condition: Condition) -> np.ndarray:
            t, missing_left, left = condition
            return np.where(missing[:, feature], missing_left, x[:, feature] <= t) == left

        out = np.zeros((len(x), self.width))
        for features, conditions, values in self.leaves:
            code = np.zeros(len(x), np.int64)
            for i, (f, cs) in enumerate(zip(features, conditions, strict=True)):
                code |= np.logical_and.reduce([passes(f, c) for c in cs]).astype(np.int64) << i
            out[:, features] += values[code]
        return out


def contributions(rows: DataFrame, model: dict, name: str = "contributions") -> DataFrame:
    """rows with an array of contributions in the order of the model's features; with the ensemble's base (see base_of) they add up to the margin. Null and NaN are missing."""
    explainer = Explainer(model)

    @F.arrow_udf("array<double>")
    def explained(*inputs: pa.Array) -> pa.Array:
        x = np.stack([np.asarray(c.fill_null(np.nan)) for c in inputs], axis=1)
        got = explainer.contributions(x)
        return pa.ListArray.from_arrays(np.arange(0, got.size + 1, got.shape[1], dtype=np.int32), got.ravel())

    return rows.withColumn(name, explained(*(F.col(c).cast("double") for c in model["features"])))


def base_of(model: dict) -> float:
    """The ensemble's mean over the rows it was fitted on."""
    return Explainer(model).base


def span(seconds: Column) -> Column:
    """Seconds in the unit that suits them."""
    s = F.greatest(seconds, F.lit(0.0))
    unit = lambda per, name: F.concat(F.format_number(s / per, 0), F.lit(f" {name}"))
    return F.when(s < 90, unit(1, "s")).when(s < 5400, unit(60, "min")).when(s < 172_800, unit(3600, "h")).otherwise(unit(86_400, "d"))


def _number(x: Column) -> Column:
    return F.format_number(x, 0)


def _percent(x: Column) -> Column:
    return F.concat(F.format_number(F.least(x, F.lit(1.0)) * 100, 0), F.lit(" %"))


Template = tuple[Callable[[Column], Column], Callable[[Column], Column]]


def _said(*parts: str | Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: F.concat(*(F.lit(p) if isinstance(p, str) else p(x) for p in parts))


# The features that can be given as reasons and the bounds within which their statement is true.
#: Statements for what raised a score: feature -> (when it may be said, how).
RAISED: dict[str, Template] = {
    "dest_age_days": (lambda x: x <= 90, _said("recipient is new: first activity ", _number, " days before")),
    "dest_senders_7d": (lambda x: x >= 3, _said("within a week the recipient was paid by ", _number, " wallets")),
    "dest_senders_30d": (lambda x: x >= 5, _said("within a month the recipient was paid by ", _number, " wallets")),
    "dest_median_hold_secs": (lambda x: x.between(0, 3600), _said("half of what arrives leaves again in ", span)),
    "dest_consolidation_ratio": (lambda x: x >= 0.6, _said("one payee gets ", _percent, " of the recipient's outflow")),
    "dest_forward_ratio": (lambda x: x.between(0.85, 1.5), _said("the recipient passes on ", _percent, " of its income")),
    "dest_distinct_out": (lambda x: (x > 0) & (x <= 3), _said("number of payees of the recipient: ", _number)),
    "is_first_send_to_dest": (lambda x: x == 1, _said("no earlier payment by this sender to the recipient")),
    "escalation_ratio": (lambda x: x >= 2, _said("amount is ", _number, " times the largest one paid to it so far")),
    "amount_vs_sender_median": (lambda x: x >= 3, _said("amount is ", _number, " times the sender's median payment")),
    "amount_vs_balance": (lambda x: x.between(0.5, 1.5), _said("payment takes ", _percent, " of the estimated balance")),
    "sender_burst_24h": (lambda x: x >= 3, _said("payments by the sender in one day: ", _number)),
    "first_send_to_young_dest": (lambda x: x == 1, _said("first payment goes to a recipient under 30 days of age")),
    "no_shared_counterparties": (lambda x: x == 1, _said("sender and recipient know no wallet in common")),
    "dest_usd_per_sender": (lambda x: x >= 500, _said("mean income from a paying wallet: ", _number, " USD")),
    "dest_funder_fanout": (lambda x: x >= 5, _said("wallets paid by the recipient's first funder: ", _number)),
    "pair_secs_since_last": (lambda x: x.between(0, 86_400), _said("paid before, ", span, " ago")),
}
#: Statements for what lowered it.
LOWERED: dict[str, Template] = {
    "sender_prior_sends_to_dest": (lambda x: x >= 1, _said("earlier payments of the sender to the recipient: ", _number)),
    "dest_forward_ratio": (lambda x: (x >= 0) & (x < 0.7), _said("the recipient holds on to its income")),
    "dest_senders_30d": (lambda x: x <= 2, _said("wallets that paid the recipient within a month: ", _number)),
    "dest_senders_all": (lambda x: (x > 0) & (x <= 25), _said("wallets that ever paid the recipient: ", _number)),
    "dest_median_hold_secs": (lambda x: x >= 86_400, _said("half of what arrives stays for ", span)),
    "dest_age_days": (lambda x: x >= 180, _said("recipient is known for ", _number, " days")),
    "escalation_ratio": (lambda x: (x > 0) & (x <= 1.5), _said("amount is within what was paid to it so far")),
    "amount_vs_sender_median": (lambda x: x.between(0.2, 2.0), _said("amount is usual for the sender")),
    "shared_counterparties": (lambda x: x >= 1, _said("wallets that both ends know: ", _number)),
    "pair_span_days": (lambda x: x >= 30, _said("both ends have dealt with each other for ", _number, " days")),
}


def reasons(explained: DataFrame, features: list[str], sign: int = 1, most: int = 5, name: str = "reasons", contributions: str = "contributions") -> DataFrame:
    """explained with the statements, strongest contribution first, of the features that raised the margin (sign 1: RAISED) or lowered it (-1: LOWERED).

    A statement is made only where it is true of the value; what cannot be said makes room for the next
    feature. Equal contributions go by the features' order. Missing values say nothing.
    """
    templates = RAISED if sign > 0 else LOWERED
    said = []
    for i, f in enumerate(features):
        if f in templates:
            may, how = templates[f]
            x = F.col(f).cast("double")
            part = F.col(contributions)[i] * sign
            said.append(F.when((part > TINY) & x.isNotNull() & ~F.isnan(x) & may(x), F.struct((-part).alias("minus"), F.lit(i).alias("i"), how(x).alias("text"))))
    if not said:
        return explained.withColumn(name, F.array().cast("array<string>"))
    ordered = F.array_sort(F.filter(F.array(*said), lambda s: s.isNotNull()))
    return explained.withColumn(name, F.transform(F.slice(ordered, 1, most), lambda s: s["text"]))
