"""Samples: quotas with one row a relationship, and addresses seen in windows of time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .labels import hash_order
from .store import written


def quota_pick(rows: DataFrame, quotas: list[tuple[Column, int]], key: str = "event_id", ends: tuple[str, str] = ("sender", "destination"), seed: int = 17) -> DataFrame:
    """rows with `quota`: for each (condition, k) in turn up to k rows in hash order, no two of all picked with a sender or a destination in common.

    A row that is first among those of its sender and first among those of its destination is picked whatever
    comes after; the others of both then go. Rounds of that give what going through the rows one by one
    gives. Once k are picked, rows behind the k-th can't be wanted any more and go too. Rows with a null end
    are not picked.
    """
    plain = written(rows.where(F.col(ends[0]).isNotNull() & F.col(ends[1]).isNotNull()).withColumn("turn", F.struct(hash_order(F.col(key).cast("string"), seed=seed).alias("h"), F.col(key).alias("k"))))
    done: list[DataFrame] = []
    for i, (condition, k) in enumerate(quotas):
        alive = plain.where(condition)
        for end in ends:
            if done:
                alive = alive.join(reduce(DataFrame.unionByName, (d.select(end) for d in done)), end, "left_anti")
        alive, picked = written(alive), None
        while not alive.isEmpty():
            first = alive
            for end in ends:
                first = first.join(alive.groupBy(end).agg(F.min("turn").alias(f"first_{end}")), end)
            new = written(first.where((F.col("turn") == F.col(f"first_{ends[0]}")) & (F.col("turn") == F.col(f"first_{ends[1]}"))).select(*alive.columns))
            picked = new if picked is None else written(picked.unionByName(new).orderBy("turn").limit(k))
            held = picked.orderBy("turn").limit(k).agg(F.count("*").alias("n"), F.max("turn").alias("last"))
            alive = alive.join(F.broadcast(held), F.when(F.col("n") >= k, F.col("turn") < F.col("last")).otherwise(True)).select(*alive.columns)  # one row
            for end in ends:
                alive = alive.join(new.select(end), end, "left_anti")
            alive = written(alive)
        if picked is not None:
            done.append(written(picked.orderBy("turn").limit(k).withColumn("quota", F.lit(i))))
    out = [d.select(*rows.columns, "quota") for d in done]
    return reduce(DataFrame.unionByName, out) if out else rows.limit(0).withColumn("quota", F.lit(0))


def firehose(transfers: DataFrame, windows: DataFrame, exclude: DataFrame, n: int, most: int = 400, width: int = 86_400_000, seed: int = 17) -> DataFrame:
    """(address, place) of n addresses, in hash order, that the first `most` transfers of some window show, without those to exclude.

    windows: (window, start, stop), stop not included; transfers meet them by buckets of `width` ms, so
    that no window is compared with all of them. place: from 0, by the first showing (window, time, hash,
    sender before receiver) among those sampled from.
    """
    bucket = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("stop") - 1) / width))).alias("bucket")
    asked = windows.where("start < stop").select("window", "start", "stop", bucket)
    met = transfers.withColumn("bucket", F.floor(F.col("block_time") / width)).join(asked, "bucket").where("block_time >= start and block_time < stop")
    # the first of each window and bucket, then of the window
    order = ["block_time", "tx_hash", "to_address"]
    for keys in (["window", "bucket"], ["window"]):
        met = met.withColumn("row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("row") <= most)
    sides = F.explode(F.array(*(F.struct(F.col(c).alias("address"), F.lit(i).alias("side")) for i, c in enumerate(("from_address", "to_address")))))
    shown = met.select("window", "row", sides.alias("s")).select("s.address", F.struct("window", "row", "s.side").alias("seen")).where("address is not null")
    first = shown.groupBy("address").agg(F.min("seen").alias("seen")).join(exclude.select("address").distinct(), "address", "left_anti")
    chosen = first.orderBy(hash_order(F.col("address"), seed=seed), "address").limit(n)
    # a row an address of a sample of a stated size
    return chosen.withColumn("place", F.row_number().over(Window.orderBy("seen")) - 1).select("address", "place")
