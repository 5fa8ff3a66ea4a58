"""Cleaning, the two-sided long form, hold times, spans, deduplication and coverage of transfers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .asof import coded, runs
from .packed import in_buckets

COMPLETE = 2**62  #: "complete until" of an address whose history was not cut
COUNTERFEIT_USD = 1e10
PAIR_BUCKETS = 1 << 8  #: in which events meet those of their pair


def clean(transfers: DataFrame) -> DataFrame:
    """Transfers with a positive amount."""
    return transfers.where("amount_usd is not null and amount_usd > 0")


def legs(transfers: DataFrame) -> DataFrame:
    """One row per (address, side); a self-transfer gives both."""
    sides = F.explode(
        F.array(
            F.struct(F.col("from_address").alias("address"), F.col("to_address").alias("peer"), F.lit("out").alias("side")),
            F.struct(F.col("to_address").alias("address"), F.col("from_address").alias("peer"), F.lit("in").alias("side")),
        )
    )
    return transfers.select(sides.alias("x"), "cents", "block_time", "tx_hash").select("x.*", "cents", "block_time", "tx_hash")


def sweep(legs_: DataFrame) -> DataFrame:
    """Of each outbound leg the time since the address last received; an inbound leg of the same moment counts (0)."""
    w = Window.partitionBy("address").orderBy("block_time", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    arrived = F.last(F.when(F.col("side") == "in", F.col("block_time")), ignorenulls=True).over(w)
    return legs_.withColumn("arrived", arrived).where("side = 'out'").select("address", "peer", "cents", "block_time", "tx_hash", (F.col("block_time") - F.col("arrived")).alias("hold_ms"))


def dedupe(transfers: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: the smallest whole row, so that the choice does not depend on the order of reading."""
    rest = [c for c in transfers.columns if c not in keys]
    return transfers.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("x")).select(*keys, "x.*").select(*transfers.columns)


def warehouse(parts: list[DataFrame], keys: list[str] = ["tx_hash", "to_address"]) -> DataFrame:  # noqa: B006
    """Union of transfer sets over the columns of the first, deduplicated, without counterfeit amounts."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p.select(*parts[0].columns))
    return dedupe(out, keys).where(F.col("amount_usd") < COUNTERFEIT_USD)


def spans(legs_: DataFrame) -> DataFrame:
    return legs_.groupBy("address").agg(F.min("block_time").alias("first_seen"), F.max("block_time").alias("last_seen"), F.count("*").alias("n_legs"))


def coverage(legs_: DataFrame, truncated: DataFrame) -> DataFrame:
    """(address, truncated, last_fetched, complete_until) of every address seen; one that `truncated` (address, truncated) does not list counts as complete."""
    rows = spans(legs_).select("address", F.col("last_seen").alias("last_fetched")).join(truncated, "address", "left").withColumn("truncated", F.coalesce("truncated", F.lit(False)))
    return rows.select("address", "truncated", "last_fetched", F.when(F.col("truncated"), F.col("last_fetched")).otherwise(F.lit(COMPLETE)).alias("complete_until"))


def within_coverage(events: DataFrame, covered: DataFrame) -> DataFrame:
    """Events no later than what is known of both ends; an unknown address counts as complete."""
    until = covered.select("address", "complete_until")
    out = events
    for end in ("sender", "destination"):
        out = out.join(until.withColumnsRenamed({"address": end, "complete_until": f"{end}_until"}), end, "left")
    ok = [F.col("event_time") <= F.coalesce(F.col(f"{end}_until"), F.lit(COMPLETE)) for end in ("sender", "destination")]
    return out.where(ok[0] & ok[1]).select(*events.columns)


def payments_as_events(transfers: DataFrame) -> DataFrame:
    """Every payment of a customer as an event to score."""
    return transfers.where("from_address like 'C%' and cents > 0").select(F.col("tx_hash").alias("event_id"), F.col("from_address").alias("sender"), F.col("to_address").alias("destination"), "cents", F.col("block_time").alias("event_time"))


def head_per_group(rows: DataFrame, group: str, k: int, *order) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def _by_pair(events: DataFrame, tell: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], name: str) -> DataFrame:
    """events, packed by their pair, with a whole number that `tell` gives, and those rows it keeps: it gets where each row's pair begins and the times, both in order of pair, event_time and event_id."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema) + f", `{name}` int"

    def run(table: pa.Table) -> pa.Table:
        pair = [coded(table[c].combine_chunks())[0] for c in ("sender", "destination", "event_id")]
        time = pc.fill_null(table["event_time"], np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        order = np.lexsort((pair[2], time, pair[1], pair[0]))
        new = runs(pair[0][order], pair[1][order])
        value, kept = tell(np.flatnonzero(new)[np.cumsum(new) - 1], time[order])
        return table.take(pa.array(order[kept])).append_column(name, pa.array(value[kept], pa.int32()))

    return in_buckets(events, F.pmod(F.xxhash64("sender", "destination"), F.lit(PAIR_BUCKETS)), run, kinds, ("sender", "destination", "event_time"))


def transfer_position(events: DataFrame, most: int = 10) -> DataFrame:
    """1-based position of an event in its (sender, destination) pair; the first `most`."""

    def place(start: np.ndarray, _: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.arange(len(start)) - start + 1
        return k, k <= most

    return _by_pair(events, place, "transfer_k")


def first_sends(events: DataFrame) -> DataFrame:
    """events with is_first_send_to_dest: 1 at the first moment of their (sender, destination) pair, else 0."""
    return _by_pair(events, lambda start, time: (time == time[start], np.ones(len(time), bool)), "is_first_send_to_dest")


def sequential_evidence(scored: DataFrame, decay: float = 1.0) -> DataFrame:
    """Accumulated evidence acc_k = decay * acc_(k-1) + value_k per pair; a window fold over at most transfer_k terms."""
    w = Window.partitionBy("sender", "destination").orderBy("transfer_k").rowsBetween(Window.unboundedPreceding, 0)
    if decay == 1.0:
        return scored.withColumn("evidence", F.sum("value").over(w))
    fold = F.aggregate(F.collect_list("value").over(w), F.lit(0.0), lambda acc, v: acc * decay + v)
    return scored.withColumn("evidence", fold)
