"""Ranking, threshold, calibration and drift metrics of scored events.

All start from counts per distinct score or from sums per pair. Scores are cumulated in ranges that
carry their totals over, so no window orders all of them in one task. Events have label (0 or 1), score
and, where pairs matter, sender, destination, transfer_k and cents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import quantiles

PARTS = 64
PREVALENCES = (0.01, 0.003, 0.001, 0.0003, 0.0001)
PER = 100_000


def by_score(rows: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(score, pos, neg) of each distinct score."""
    return rows.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))


def cumulated(scores: DataFrame, parts: int = PARTS) -> DataFrame:
    """by_score rows with tp and fp: positives and negatives at this score or above."""
    marks = scores.agg(F.percentile_approx("score", F.array(*(F.lit(i / parts) for i in range(1, parts))), 1000).alias("marks"))
    rows = scores.crossJoin(F.broadcast(marks)).withColumn("part", F.size(F.filter("marks", lambda m: m <= F.col("score")))).drop("marks")
    above = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)  # at most `parts` rows
    carried = rows.groupBy("part").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).select("part", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in "pn"))
    own = Window.partitionBy("part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"tp": F.sum("pos").over(own), "fp": F.sum("neg").over(own)}).join(F.broadcast(carried), "part")
    return rows.select("score", "pos", "neg", (F.col("tp") + F.col("p_above")).alias("tp"), (F.col("fp") + F.col("n_above")).alias("fp"))


def ranking_metrics(rows: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row: n_pos, n_neg, roc_auc (ties count half), average_precision (over distinct thresholds)."""
    runs = cumulated(by_score(rows, label, score))
    total = runs.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("neg") * (2 * F.col("tp") - F.col("pos"))).alias("won"), F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"))
    pairs = F.col("n_pos") * F.col("n_neg")
    return total.select("n_pos", "n_neg", F.when(pairs > 0, F.col("won") / (2.0 * pairs)).alias("roc_auc"), F.when(F.col("n_pos") > 0, F.col("ap") / F.col("n_pos")).alias("average_precision"))


def thresholds_at_fpr(rows: DataFrame, budgets: list[float], label: str = "label", score: str = "score") -> DataFrame:
    """(budget, threshold): the lowest negative score that at most that share of the negatives reach; the top negative score if none, 0.5 without negatives."""
    runs = cumulated(by_score(rows, label, score)).where("neg > 0")
    table = runs.agg(F.sum("neg").alias("every"))
    fits = [F.min(F.when(F.col("fp") <= F.lit(b) * F.col("every"), F.col("score"))).alias(f"t{i}") for i, b in enumerate(budgets)]
    got = runs.crossJoin(F.broadcast(table)).agg(F.max("score").alias("top"), *fits)
    pairs = F.explode(F.array(*(F.struct(F.lit(float(b)).alias("budget"), F.coalesce(f"t{i}", "top", F.lit(0.5)).alias("threshold")) for i, b in enumerate(budgets))))
    return got.select(pairs.alias("x")).select("x.*")


def threshold_at_fpr(rows: DataFrame, budget: float = 0.01, label: str = "label", score: str = "score") -> DataFrame:
    return thresholds_at_fpr(rows, [budget], label, score).select("threshold")


def _ratio(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1))


def confusion(rows: DataFrame, thresholds: DataFrame, keys: list[str] = ["budget"]) -> DataFrame:  # noqa: B006
    """Per row of thresholds (a few): tp, fp, tn, fn, precision, recall, fpr; a score equal to the threshold is flagged."""
    hit, pos = F.col("score") >= F.col("threshold"), F.col("label") == 1
    counts = {"tp": hit & pos, "fp": hit & ~pos, "tn": ~hit & ~pos, "fn": ~hit & pos}
    out = rows.select("label", "score").crossJoin(F.broadcast(thresholds)).groupBy(*keys, "threshold").agg(*(F.count_if(c).alias(n) for n, c in counts.items()))
    c = F.col
    return out.select(*keys, "threshold", *counts, _ratio(c("tp"), c("tp") + c("fp")).alias("precision"), _ratio(c("tp"), c("tp") + c("fn")).alias("recall"), _ratio(c("fp"), c("fp") + c("tn")).alias("fpr"))


def early_detection(rows: DataFrame, thresholds: DataFrame, ks: tuple[int, ...] = (1, 2, 3, 5)) -> DataFrame:
    """(budget, k, victims, flagged, rate): pairs with a flagged transfer among their first k, of all pairs of label 1."""
    first = F.min(F.when(F.col("score") >= F.col("threshold"), F.col("transfer_k")))
    pairs = rows.where("label = 1").crossJoin(F.broadcast(thresholds)).groupBy("budget", "sender", "destination").agg(first.alias("first"))
    out = pairs.groupBy("budget").agg(F.count("*").alias("victims"), *(F.count_if(F.col("first") <= k).alias(f"k{k}") for k in ks))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("flagged")) for k in ks)))
    return out.select("budget", "victims", each.alias("x")).select("budget", "x.k", "victims", "x.flagged", _ratio(F.col("x.flagged"), F.col("victims")).alias("rate"))


def protected(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(budget, threshold, total_cents, protected_cents, victims_ever_flagged, victims_total, events): what moved at or after a pair's first flag."""
    w = Window.partitionBy("budget", "sender", "destination")
    pos = rows.where("label = 1").crossJoin(F.broadcast(thresholds))
    pos = pos.withColumn("first", F.min(F.when(F.col("score") >= F.col("threshold"), F.col("transfer_k"))).over(w))
    pairs = pos.groupBy("budget", "threshold", "sender", "destination").agg(F.sum("cents").alias("cents"), F.sum(F.when(F.col("transfer_k") >= F.col("first"), F.col("cents")).otherwise(0)).alias("saved"), F.first("first").alias("first"), F.count("*").alias("n"))
    return pairs.groupBy("budget", "threshold").agg(F.sum("cents").alias("total_cents"), F.sum("saved").alias("protected_cents"), F.count("first").alias("victims_ever_flagged"), F.count("*").alias("victims_total"), F.sum("n").alias("events"))


def cost_curve(rows: DataFrame, budgets: list[float]) -> DataFrame:
    """Per budget: fpr, interruptions, protected_usd, protected_share, usd_per_interruption."""
    marks = thresholds_at_fpr(rows, budgets)
    both = protected(rows, marks).join(confusion(rows, marks).select("budget", "fp", "fpr"), "budget")
    usd = F.col("protected_cents") / 100.0
    return both.select("budget", "fpr", F.col("fp").alias("interruptions"), usd.alias("protected_usd"), (F.col("protected_cents") / F.greatest(F.col("total_cents"), F.lit(1))).alias("protected_share"), F.when(F.col("fp") > 0, usd / F.col("fp")).alias("usd_per_interruption"))


def precision_at(tpr: Column, fpr: Column, prevalence: Column) -> Column:
    """Precision under another class balance."""
    found = tpr * prevalence
    all_ = found + fpr * (1 - prevalence)
    return F.when(all_ > 0, found / all_).otherwise(0.0)


def deployment_table(points: DataFrame, prevalences: tuple[float, ...] = PREVALENCES, per: int = PER) -> DataFrame:
    """points (budget, recall, fpr) at each prevalence: precision and alerts per `per` sends."""
    rows = points.select("budget", "recall", "fpr", F.explode(F.array(*map(F.lit, prevalences))).alias("prevalence"))
    true, false = F.col("recall") * F.col("prevalence") * per, F.col("fpr") * (1 - F.col("prevalence")) * per
    return rows.select("budget", "prevalence", precision_at(F.col("recall"), F.col("fpr"), F.col("prevalence")).alias("precision"), (true + false).alias("alerts_per_n"), true.alias("true_alerts_per_n"), false.alias("false_alerts_per_n"), F.when(true > 0, false / true).alias("false_per_true"))


def economics(rows: DataFrame, budgets: list[float], prevalence: float, per: int = PER) -> DataFrame:
    """What an operating point protects and costs on real traffic; relationships, not events, are the unit."""
    marks = thresholds_at_fpr(rows, budgets)
    c = F.col
    both = protected(rows, marks).join(confusion(rows, marks).select("budget", "recall", "fpr"), "budget")
    each = c("events") / F.greatest(c("victims_total"), F.lit(1))
    per_rel = c("protected_cents") / 100.0 / F.greatest(c("victims_ever_flagged"), F.lit(1))
    true, false = c("recall") * prevalence * per / F.greatest(each, F.lit(1e-9)), c("fpr") * (1 - prevalence) * per
    return both.select("budget", "recall", "fpr", c("victims_ever_flagged").alias("relationships_caught"), per_rel.alias("usd_per_relationship"), precision_at(c("recall"), c("fpr"), F.lit(prevalence)).alias("precision_at_prevalence"), true.alias("true_alerts_per_n"), false.alias("false_alerts_per_n"), (true * per_rel).alias("usd_protected_per_n"), (true * per_rel / F.greatest(false, F.lit(1e-9))).alias("usd_per_false_alert"))


def shifted_prior(p: Column, eval_prior: float, deploy_prior: float) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
    odds = p / (1 - p) * ((deploy_prior / (1 - deploy_prior)) / (eval_prior / (1 - eval_prior)))
    return odds / (1 + odds)


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The interval of a proportion; null without rows."""
    p = F.when(n > 0, hits / n)
    mid, half, base = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return F.when(n > 0, (mid - half) / base), F.when(n > 0, (mid + half) / base)


def _edges(rows: DataFrame, column: str, bins: int, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """(keys, edges): the distinct quantiles 0, 1/bins, .., 1 of a column; none with fewer than 3."""
    points = quantiles(rows, column, [i / bins for i in range(bins + 1)], "points", keys)
    return points.select(*keys, F.array_distinct("points").alias("edges")).where(F.size("edges") >= 3)


def brier(rows: DataFrame) -> DataFrame:
    gap = F.col("score") - F.col("label")
    return rows.agg(F.avg(gap * gap).alias("brier"), F.max("score").alias("max_prob"), F.avg("score").alias("mean_prob"))


def reliability(rows: DataFrame, bins: int = 5) -> DataFrame:
    """(bin, lo, hi, n, predicted, observed) of quantile bins whose both ends belong to them."""
    held = rows.select("score", "label").crossJoin(F.broadcast(_edges(rows, "score", bins)))
    spans = F.transform(F.sequence(F.lit(1), F.size("edges") - 1), lambda i: F.struct(i.alias("bin"), F.element_at("edges", i).alias("lo"), F.element_at("edges", i + 1).alias("hi")))
    mine = F.filter(spans, lambda s: (F.col("score") >= s["lo"]) & (F.col("score") <= s["hi"]))
    return held.select("score", "label", F.explode(mine).alias("s")).groupBy("s.bin", "s.lo", "s.hi").agg(F.count("*").alias("n"), F.avg("score").alias("predicted"), F.avg("label").alias("observed"))


def calibration_error(rows: DataFrame, bins: int = 10) -> DataFrame:
    """One row: ece and max_gap over quantile bins that hold their lower edge."""
    held = rows.select("score", "label").crossJoin(F.broadcast(_edges(rows, "score", bins)))
    inner = F.slice("edges", 2, F.size("edges") - 2)
    per = held.groupBy(F.size(F.filter(inner, lambda e: e <= F.col("score"))).alias("bin")).agg(F.count("*").alias("n"), F.abs(F.avg("score") - F.avg("label")).alias("gap"))
    return per.agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"), F.max("gap").alias("max_gap"))


def stability(train: DataFrame, test: DataFrame, features: list[str], bins: int = 10) -> DataFrame:
    """(feature, psi, verdict): shift between two sets, on the train set's quantile bins; test values beyond them do not count."""
    def long(rows: DataFrame) -> DataFrame:
        each = F.array(*(F.struct(F.lit(f).alias("feature"), F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias("v")) for f in features))
        return rows.select(F.explode(each).alias("x")).select("x.*")

    edges = F.broadcast(_edges(long(train), "v", bins, ["feature"]))

    def shares(rows: DataFrame, name: str) -> DataFrame:
        last = F.element_at("edges", -1)
        at = F.least(F.size(F.filter("edges", lambda e: e <= F.col("v"))), F.size("edges") - 1)
        inside = long(rows).join(edges, "feature").where((F.col("v") >= F.element_at("edges", 1)) & (F.col("v") <= last))
        return inside.groupBy("feature", at.alias("bin")).agg(F.count("*").alias(name))

    grid = edges.select("feature", F.explode(F.sequence(F.lit(1), F.size("edges") - 1)).alias("bin"))
    rows = grid.join(shares(train, "a"), ["feature", "bin"], "left").join(shares(test, "b"), ["feature", "bin"], "left")
    total = Window.partitionBy("feature")  # a row a bin
    p = {c: F.greatest(F.coalesce(c, F.lit(0)) / F.greatest(F.sum(F.coalesce(c, F.lit(0))).over(total), F.lit(1)), F.lit(1e-6)) for c in "ab"}
    out = rows.select("feature", p["a"].alias("pa"), p["b"].alias("pb")).groupBy("feature").agg(F.sum((F.col("pb") - F.col("pa")) * F.log(F.col("pb") / F.col("pa"))).alias("psi"))
    return out.withColumn("verdict", F.when(F.col("psi") < 0.1, "stable").when(F.col("psi") < 0.25, "moderate shift").otherwise("material shift"))
