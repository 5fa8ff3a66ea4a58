"""Nearest-neighbour matching of controls to positives, without replacement.

Candidates are the k nearest controls of each positive in its stratum. Controls lie in slabs, boxes that cuts through
all covariates leave of them. A positive first looks into the slabs next to its own place, as many as
hold k controls; the k-th distance found there bounds which further slabs can hold a nearer one. A slab is
searched by blocks of positives, which are dealt out if there are many. Only those whom their nearest few leave short look for more.

Taking turns (a positive takes the nearest controls that those before it left) needs no turns to compute: all
propose at once, a control keeps the earliest proposer, whoever is refused proposes to the next. The outcome
is that of the turns, as all controls prefer the same order; it is reached when nobody is refused.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .labels import hash_order
from .packed import packs, table_of, unpack
from .store import sent, written

# The covariates of a match, and how many neighbours are asked for.
COVARIATES = ["sender_age_days", "sender_outbound_count", "sender_median_out_usd"]
SLAB_ROWS, SAMPLED, DEAL_ROWS, BLOCK, TASK_ROWS = 1 << 13, 64, 1 << 13, 256, 1 << 18
ROUNDED, FIRST_WISHES = 2e-12, 4  #: what rounding a distance can add, and more; wishes dealt out first, times those to be met
FOUND = "turn string, event_id string, control string, distance double, control_turn string, k long"


def asked_for(ratio: int, n: int) -> int:
    return min(n, max(20 * ratio, 200))


def standardised(rows: DataFrame, covariates: list[str], stratum: Column, seed: int) -> DataFrame:
    """(event_id, label, stratum, turn, x): log1p of the covariates by mean and deviation of the stratum's controls, at nine digits so that no order of summing shows."""
    v = lambda c: F.log1p(F.greatest(F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), F.lit(0.0)), F.lit(0.0)))
    plain = rows.select("event_id", "label", stratum.cast("string").alias("stratum"), *(F.round(v(c), 12).alias(f"v{i}") for i, c in enumerate(covariates)))
    plain = written(plain.withColumn("stratum", F.coalesce("stratum", F.lit("-"))))  # read for means, deviations and points
    n = range(len(covariates))
    # exact sums, so that means do not depend on the order of rows
    wide = lambda x: x.cast("decimal(30,12)")
    sums = plain.where("label = 0").groupBy("stratum").agg(F.count("*").alias("n"), *(F.sum(wide(F.col(f"v{i}"))).alias(f"s{i}") for i in n))
    mean = sums.select("stratum", "n", *((F.col(f"s{i}").cast("double") / F.col("n")).alias(f"m{i}") for i in n))
    spread = plain.where("label = 0").join(mean, "stratum").groupBy("stratum").agg(*(F.sum(wide(F.pow(F.col(f"v{i}") - F.col(f"m{i}"), 2))).alias(f"q{i}") for i in n))
    mean = sent(mean.join(spread, "stratum"))
    sd = [F.sqrt(F.col(f"q{i}").cast("double") / F.col("n")) for i in n]
    x = F.array(*(F.round((F.col(f"v{i}") - F.col(f"m{i}")) / F.when(sd[i] > 0, sd[i]).otherwise(1.0), 9) for i in n))
    return plain.join(mean, "stratum").select("event_id", "label", "stratum", hash_order(F.col("event_id"), seed=seed).alias("turn"), x.alias("x"))


def _points(table: pa.Table) -> np.ndarray:
    return np.array(table["x"].to_pylist(), float).reshape(table.num_rows, -1)


def search(positives: pa.Table, controls: pa.Table) -> pa.Table:
    """Of each positive of a slab (with its k, and the distance beyond which it needs none) its nearest controls of the slab."""
    controls = controls.sort_by("turn")
    c, p = _points(controls), _points(positives)
    k, within = positives["k"].to_numpy(), positives["within"].to_numpy()
    mine, theirs, distances = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for a in range(0, len(p) if len(c) else 0, BLOCK):
        squares = sum((p[a : a + BLOCK, i, None] - c[None, :, i]) ** 2 for i in range(p.shape[1]))
        for i, row in enumerate(squares, a):
            most = np.sqrt(np.partition(row, k[i] - 1)[k[i] - 1]) if k[i] < len(row) else np.inf
            near = np.flatnonzero(row <= (min(most, within[i]) + ROUNDED) ** 2)  # all that can be among them, equally near ones too
            d = np.round(np.sqrt(row[near]), 12)
            order = np.argsort(d, kind="stable")[: k[i]]  # ties by turn
            order = order[d[order] <= within[i]]
            mine.append(np.full(len(order), i))
            theirs.append(near[order])
            distances.append(d[order])
    own, other = pa.array(np.concatenate(mine)), pa.array(np.concatenate(theirs))
    found = [positives["turn"].take(own), positives["event_id"].take(own), controls["event_id"].take(other), pa.array(np.concatenate(distances)), controls["turn"].take(other), positives["k"].take(own)]
    return pa.table(found, names=[x.split()[0] for x in FOUND.split(", ")])


def grown(points: np.ndarray, most: float, nodes: list[tuple[int, float, int, int]]) -> int:
    """A tree of cuts through the middle of points (their last column is for points alike in all others), down to `most` of them; nodes get (column or -1, cut, left, right or the leaf's number). The place of its root."""
    place = len(nodes)
    nodes.append((-1, 0.0, 0, 0))
    spread = np.ptp(points, axis=0) if len(points) else np.zeros(1)
    column = int(np.argmax(spread[:-1])) if spread[:-1].any() else len(spread) - 1
    if len(points) > most and spread[column] > 0:
        x = points[:, column]
        cut = np.sort(x)[(len(x) - 1) // 2]
        cut = cut if cut < x.max() else x[x < cut].max()
        left = grown(points[x <= cut], most, nodes)
        nodes[place] = (column, float(cut), left, grown(points[x > cut], most, nodes))
    return place


class Slabs(NamedTuple):
    """Controls dealt out to boxes of points close to each other: packed, a bucket a box; and of each stratum the boxes' numbers, bounds and sizes."""

    packs: DataFrame
    schema: pa.Schema
    boxes: Broadcast


def _chance(turn: Column) -> Column:
    return F.conv(F.substring(turn, 1, 13), 16, 10).cast("double")


def slabs_of(rows: DataFrame, slab_rows: int = SLAB_ROWS) -> Slabs:
    """Slabs of the controls of standardised rows. Where they are cut follows from some of them, about SAMPLED a slab; what is found does not depend on it."""
    controls = rows.where("label = 0")
    width = controls.select(F.size("x").alias("n")).first()
    width = width["n"] if width else 0
    xs = [F.col("x")[i].alias(f"x{i}") for i in range(width)]
    step = max(1, slab_rows // SAMPLED)
    table = controls.where(F.pmod(F.xxhash64("turn"), F.lit(step)) == 0).select("stratum", *xs, _chance(F.col("turn")).alias("chance")).toArrow()
    strata, points = np.array(table["stratum"].to_pylist(), object), np.stack([table[c].to_numpy() for c in table.column_names[1:]], axis=1)
    nodes: list[tuple[int, float, int, int]] = []
    roots = {}
    for r in controls.select("stratum").distinct().orderBy("stratum").collect():  # a row a stratum
        mine = points[strata == r["stratum"]]
        roots[r["stratum"]] = grown(mine[np.lexsort(mine.T)], slab_rows / step, nodes)
    column, cut, left, right = (np.array(c) for c in zip(*nodes, strict=True)) if nodes else (np.zeros(0),) * 4
    tree = rows.sparkSession.sparkContext.broadcast((roots, column, cut, left, right))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots, column, cut, left, right = tree.value
        for batch in batches:
            x = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3, batch.num_columns)], axis=1)
            at, row = np.array([roots[s] for s in batch.column(0).to_pylist()], np.int64), np.arange(batch.num_rows)
            while len(row):
                row = row[column[at[row]] >= 0]
                node = at[row]
                at[row] = np.where(x[row, column[node]] <= cut[node], left[node], right[node])
            yield pa.RecordBatch.from_arrays([pa.array(at), *batch.columns[1:-1]], names=["slab", *batch.schema.names[1:-1]])

    plain = controls.select("stratum", "event_id", "turn", *xs, _chance(F.col("turn")).alias("chance"))
    dealt = plain.mapInArrow(placed, "slab long, event_id string, turn string" + "".join(f", x{i} double" for i in range(width)))
    schema = to_arrow_schema(dealt.schema)
    packed = written(packs(dealt, F.col("slab"), ("x0",) if width else ()))

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x = unpack(r["rows"], r["size"], r["packed"], schema)
                low, high = ([float(f(x.column(f"x{i}").to_numpy())) for i in range(width)] for f in (np.min, np.max))
                yield pa.RecordBatch.from_pylist([{"slab": r["bucket"], "low": low, "high": high, "n": r["rows"]}], pa.schema([("slab", pa.int32()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("n", pa.int64())]))

    each = packed.mapInArrow(bounds, "slab int, low array<double>, high array<double>, n long")
    merged = each.groupBy("slab").agg(F.sum("n").alias("n"), *(f(F.col(c)[i]).alias(f"{c}{i}") for c, f in (("low", F.min), ("high", F.max)) for i in range(width))).collect()  # a row a slab
    of = {}
    for stratum, root in roots.items():
        under = [root]
        for node in under:  # grows as it goes
            under += [int(left[node]), int(right[node])] if column[node] >= 0 else []
        of |= dict.fromkeys(under, stratum)
    boxes: dict[str, list] = {}
    for r in sorted(merged):
        boxes.setdefault(of[r["slab"]], []).append((r["slab"], [r[f"low{i}"] for i in range(width)], [r[f"high{i}"] for i in range(width)], r["n"]))
    return Slabs(packed, schema, rows.sparkSession.sparkContext.broadcast({s: tuple(map(np.array, zip(*b, strict=True))) for s, b in boxes.items()}))


def reached(boxes: Broadcast, bounded: bool) -> Callable:
    """Of positives the slabs next to their place, as many as hold the k controls they ask for; bounded: those besides them that their bound reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                slab, low, high, n = boxes.value[r["stratum"]]
                x, k = np.array(r["x"]), r["k"]
                far = np.sqrt((np.maximum(np.maximum(low - x, x - high), 0) ** 2).sum(axis=1))
                first = [int(np.argmin(far))]
                if n[first[0]] < k:
                    order = np.argsort(far, kind="stable")
                    first = order[: 1 + int(np.searchsorted(np.cumsum(n[order]), k))].tolist()
                within = r["within"] if bounded else np.inf
                chosen = set(np.flatnonzero(far <= within + 1e-9).tolist()) - set(first) if bounded else first  # distances are rounded
                out += [(int(slab[i]), r["turn"], r["event_id"], r["x"], k, within) for i in chosen]
            if out:
                types = [pa.int32(), pa.string(), pa.string(), pa.list_(pa.float64()), pa.int64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["bucket", "turn", "event_id", "x", "k", "within"])

    return run


def candidates(positives: DataFrame, slabs: Slabs) -> DataFrame:
    """(turn, event_id, control, distance, control_turn, place): the k nearest controls of positives (stratum, turn, event_id, x, k); equally near ones by turn. k is what the stratum has at most."""
    by, schema = ["bucket", "deal"], slabs.schema

    def run(mine: pa.Table, others: pa.Table) -> pa.Table:
        table = table_of(others, schema)
        xs = [table[c].to_numpy() for c in table.column_names[3:]]
        x = pa.ListArray.from_arrays(np.arange(0, table.num_rows * len(xs) + 1, max(len(xs), 1), dtype=np.int32), np.stack(xs, axis=1).ravel())
        return search(mine, pa.table({"event_id": table["event_id"], "turn": table["turn"], "x": x}))

    def found(asked: DataFrame) -> DataFrame:
        asked = written(asked)
        deals = sent(asked.groupBy("bucket").agg(F.ceil(F.count("*") / DEAL_ROWS).cast("int").alias("deals")))
        asked = asked.join(deals, "bucket").withColumn("deal", F.pmod(F.xxhash64("turn"), F.col("deals")).cast("int")).drop("deals")
        met = slabs.packs.join(deals, "bucket").withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).drop("deals")
        return written(asked.groupBy(*by).cogroup(met.groupBy(*by)).applyInArrow(run, FOUND))

    kinds = "bucket int, turn string, event_id string, x array<double>, k long, within double"
    first = found(positives.mapInArrow(reached(slabs.boxes, False), kinds))
    order = Window.partitionBy("turn", "event_id").orderBy("distance", "control_turn", "control")
    best = lambda df: df.withColumn("place", F.row_number().over(order)).where("place <= k")
    bound = best(first).where("place = k").select("event_id", F.col("distance").alias("within"))
    more = found(positives.join(bound, "event_id").mapInArrow(reached(slabs.boxes, True), kinds))
    return best(first.unionByName(more)).select("turn", "event_id", "control", "distance", "control_turn", "place")


def taken(wishes: pa.Table, ratio: int) -> pa.Table:
    """The turns themselves, for wishes that fit a task."""
    wishes = wishes.sort_by([("turn", "ascending"), ("event_id", "ascending"), ("place", "ascending")])
    used: set[str] = set()
    counts: dict[str, int] = {}
    out = []
    for who, control in zip(wishes["event_id"].to_pylist(), wishes["control"].to_pylist(), strict=True):
        if counts.get(who, 0) < ratio and control not in used:
            used.add(control)
            counts[who] = counts.get(who, 0) + 1
            out.append((who, control))
    return pa.table({"event_id": pa.array([w for w, _ in out], pa.string()), "control": pa.array([c for _, c in out], pa.string())})


def in_turns(wishes: DataFrame, ratio: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """(event_id, control) of wishes (turn, event_id, control, place): in order of turn (then event_id) each takes its first `ratio` controls that are left."""
    who = ["turn", "event_id"]
    wishes = written(wishes)
    reach = wishes.groupBy(*who).agg(F.max("place").alias("last"))
    return settled_among(reach, lambda reach, _: wishes.join(sent(reach.select(*who, "most")), who).where("place <= most").select(*who, "control", "place"), ratio, task_rows)


def settled_among(reach: DataFrame, wished: Callable[[DataFrame, DataFrame], DataFrame], ratio: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """The turns of all who have wishes, (turn, event_id, last, ...): how many at most.

    Most get what they want among their first wishes, so that these are dealt out first. Whoever is left short and
    has further ones wishes for more, and all is dealt out again: when nobody is short, further wishes change nothing.
    `wished` gets who wishes for how many (`most`), and those of them whose number has grown, and gives the wishes of all.
    """
    reach = written(reach.withColumn("most", F.least(F.lit(FIRST_WISHES * ratio), F.col("last"))))
    grew, kept = reach, reach.columns
    while True:
        got = written(in_rounds(wished(reach, grew), ratio, task_rows))
        had = got.groupBy("event_id").agg(F.count("*").alias("had"))
        short = (F.coalesce("had", F.lit(0)) < ratio) & (F.col("most") < F.col("last"))
        reach = written(reach.join(had, "event_id", "left").withColumn("short", short).select(*kept[:-1], F.when(F.col("short"), F.least(F.col("most") * 4, F.col("last"))).otherwise(F.col("most")).alias("most"), "short"))
        grew = reach.where("short").drop("short")
        if grew.isEmpty():
            return got
        reach = reach.drop("short")


def in_rounds(wishes: DataFrame, ratio: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """The turns of these wishes.

    Rounds go on until nobody is refused, or until the wishes that are left, with the same outcome, fit a task.
    """
    alive = written(wishes.select(F.struct("turn", "event_id").alias("who"), "control", "place"))
    w = Window.partitionBy("who").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    while True:
        if alive.count() <= task_rows:
            left = alive.select("who.turn", "who.event_id", "control", "place")
            return left.groupBy(F.lit(0).alias("all")).applyInArrow(lambda t: taken(t, ratio), "event_id string, control string")
        proposed = written(alive.withColumn("asks", F.count("*").over(w) <= ratio))
        keeps = proposed.where("asks").groupBy("control").agg(F.min("who").alias("keeps"))
        # a control that has been asked never goes to a later one: those wishes are gone
        settled = written(proposed.join(sent(keeps), "control", "left").where(F.col("keeps").isNull() | (F.col("who") <= F.col("keeps"))))
        refused = proposed.where("asks").count() - settled.where(F.col("asks") & (F.col("who") == F.col("keeps"))).count()
        if not refused:
            return settled.where("asks").select("who.event_id", "control")
        alive = settled.select("who", "control", "place")


def match_nearest(rows: DataFrame, ratio: int = 10, covariates: list[str] = COVARIATES, stratum: Column | None = None, seed: int = 17, slab_rows: int = SLAB_ROWS, task_rows: int = TASK_ROWS) -> DataFrame:
    """(event_id, control, distance) of rows (event_id, a unique string; label 1 or 0; the covariates): `ratio` nearest controls of each positive within its stratum.

    Positives choose in hash order, without replacement, each among its max(20 ratio, 200) nearest. Missing and
    negative covariates count as 0. A positive whose candidates are all taken stays with fewer.
    """
    plain = standardised(rows, covariates, stratum if stratum is not None else F.lit("-"), seed)
    slabs = slabs_of(plain, slab_rows)
    sizes = [(s, asked_for(ratio, int(b[3].sum()))) for s, b in slabs.boxes.value.items()]
    last = F.broadcast(plain.sparkSession.createDataFrame(sizes, "stratum string, last long"))
    positives = plain.where("label = 1").join(last, "stratum").select("stratum", "turn", "event_id", "x", "last")
    found: list[DataFrame] = []

    def wished(_: DataFrame, grew: DataFrame) -> DataFrame:
        """Only those who wish for more look again; what they found before is the beginning of what they find now."""
        got = candidates(grew.select("stratum", "turn", "event_id", "x", F.col("most").alias("k")), slabs).select("turn", "event_id", "control", "distance", "place")
        if found:
            got = found[-1].join(sent(grew.select("event_id")), "event_id", "left_anti").select(*got.columns).unionByName(got)
        found.append(written(got))
        return found[-1].select("turn", "event_id", "control", "place")

    got = settled_among(positives, wished, ratio, task_rows)
    return got.join(found[-1].select("event_id", "control", "distance"), ["event_id", "control"])
