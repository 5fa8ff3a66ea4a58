"""Places in a total order and nearest values, without one task that sees all rows.

Rows are range-partitioned into pieces of about equal size and written; what a piece needs to know of those
before and after it is a row a piece.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

PIECE_ROWS = 1 << 18


def pieces(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows, written in the order of keys, with `piece` and `at`, an ascending number. Equal keys may be cut anywhere, so that no value is too frequent."""
    spark = rows.sparkSession
    held = written(rows.withColumn("tie", F.monotonically_increasing_id()))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), held.count() // PIECE_ROWS)
    sorted_ = held.repartitionByRange(n, *keys, "tie").sortWithinPartitions(*keys, "tie")
    return written(sorted_.withColumn("at", F.monotonically_increasing_id()).withColumn("piece", F.shiftright("at", 33)).drop("tie"))


def _all():
    """Over a row a piece."""
    return Window.orderBy("piece")


def numbered(rows: DataFrame, keys: list[str], name: str = "nth") -> DataFrame:
    """rows with their place (from 0) in the order of keys."""
    placed = pieces(rows, keys)
    counts = placed.groupBy("piece").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = counts.select("piece", "first", (F.sum("n").over(_all()) - F.col("n")).alias("before"))
    return placed.join(before, "piece").withColumn(name, F.col("before") + F.col("at") - F.col("first")).drop("piece", "at", "first", "before")


def values_at(rows: DataFrame, column: str, ranks: dict[str, Callable[[Column], Column]], keys: list[str] | None = None) -> DataFrame:
    """A row per keys (one row without keys) with `n` and the values at zero-based ascending ranks, each given as a function of n. Nulls do not count; no group's values meet in one task."""
    keys = keys or []
    counts = rows.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("value")).agg(F.count("*").alias("same"))
    placed = pieces(counts, [*keys, "value"])
    w = Window.partitionBy(*keys)
    totals = placed.groupBy(*keys, "piece").agg(F.sum("same").alias("held"))
    totals = totals.select(*keys, "piece", F.sum("held").over(w).alias("n"), (F.sum("held").over(w.orderBy("piece")) - F.col("held")).alias("before"))  # a row a piece
    run = F.sum("same").over(Window.partitionBy(*keys, "piece").orderBy("at"))
    upto = placed.withColumn("run", run).join(totals, [*keys, "piece"]).withColumn("upto", F.col("before") + F.col("run"))
    found = (F.min(F.when(F.col("upto") > rank(F.col("n")), F.col("value"))).alias(name) for name, rank in ranks.items())
    return upto.groupBy(*keys).agg(F.max("n").alias("n"), *found)


def quantiles(rows: DataFrame, column: str, shares: list[float], name: str = "quantiles", keys: list[str] | None = None) -> DataFrame:
    """(keys, name): an array of interpolated quantiles, as F.percentile has them."""
    place = lambda q, n: F.lit(float(q)) * (n - 1)
    ranks = {f"{side}{i}": (lambda n, q=q, f=f: f(place(q, n))) for i, q in enumerate(shares) for side, f in (("low", F.floor), ("high", F.ceil))}
    got = values_at(rows, column, ranks, keys)
    between = []
    for i, q in enumerate(shares):
        at, low, high = place(q, F.col("n")), F.col(f"low{i}").cast("double"), F.col(f"high{i}").cast("double")
        between.append(F.when(F.col(f"low{i}") == F.col(f"high{i}"), low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high))
    return got.select(*(keys or []), F.array(*between).alias(name))


def neighbours(asked: DataFrame, marks: DataFrame, value: str = "value") -> DataFrame:
    """asked with `below`, the greatest mark not above its value, and `above`, the smallest one above it; null where there is none, or no value."""
    both = asked.withColumn("mark", F.lit(None).cast(marks.schema[value].dataType)).unionByName(marks.select(value, F.col(value).alias("mark")), allowMissingColumns=True)
    placed = pieces(both.where(F.col(value).isNotNull()).withColumn("turn", F.col("mark").isNull().cast("int")), [value, "turn"])  # a mark comes before those that ask for its value
    ends = placed.groupBy("piece").agg(F.max("mark").alias("last"), F.min("mark").alias("first"))
    carried = ends.select("piece", F.max("last").over(_all().rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.min("first").over(Window.orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)).alias("after"))
    # what comes after is looked at backwards: a frame to the end of a piece would be summed up anew for each row, the square of a piece
    upto = lambda at: Window.partitionBy("piece").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    found = placed.withColumn("b", F.max("mark").over(upto("at"))).withColumn("a", F.min("mark").over(upto(F.desc("at"))))
    out = found.where("mark is null").join(carried, "piece", "left").withColumns({"below": F.coalesce("b", "before"), "above": F.coalesce("a", "after")})
    names = [*asked.columns, "below", "above"]
    nothing = F.lit(None).cast(marks.schema[value].dataType)
    return out.select(*names).unionByName(asked.where(F.col(value).isNull()).withColumns({"below": nothing, "above": nothing}).select(*names))


def nearest(asked: DataFrame, marks: DataFrame, want: str, least: str, name: str = "mark") -> DataFrame:
    """asked with the mark nearest to `want` of those above `least` (null if none); of two equally near the smaller one. marks: (value)."""
    key = [F.col(c) for c in asked.columns]
    values = F.explode(F.array(F.struct(F.lit("want").alias("kind"), F.col(f"row.{want}").alias("value")), F.struct(F.lit("least").alias("kind"), F.col(f"row.{least}").alias("value"))))
    rows = asked.select(F.struct(*key).alias("row"), F.monotonically_increasing_id().alias("id"))
    rows = written(rows)  # the ids stay
    both = rows.select("id", values.alias("v")).select("id", "v.*")  # only values are ordered, not the rows that ask
    got = neighbours(both, marks.distinct())
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    sides = got.groupBy("id").agg(of("want", "below").alias("below"), of("want", "above").alias("above"), of("least", "above").alias("next"))
    out = rows.join(sides, "id").select("row.*", "below", "above", "next")
    w, lower = F.col(want), F.col(least)
    below = F.when(F.col("below") > lower, F.col("below"))
    above = F.when(F.col("above") > lower, F.col("above")).when(below.isNull(), F.col("next"))
    nearer: Column = F.when(below.isNull(), above).when(above.isNull(), below).when(w - below <= above - w, below).otherwise(above)
    return out.withColumn(name, F.when(lower.isNotNull() & w.isNotNull(), nearer)).drop("below", "above", "next")
