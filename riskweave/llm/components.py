"""Connected components by alternating large-star and small-star steps over an edge table.

Tasks contract their own edges before each shuffle and after the last of a round: a long chain then costs
as many rounds as it takes to meet across tasks, not as it is long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, tidy

CHUNK_EDGES = 1 << 20  #: edges that a task contracts at once: some 150 MB of working arrays


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as edges (node, smallest node of its component here), nodes that are not the smallest once each."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while len(a):
        a, b = parent[a], parent[b]
        open_ = a != b
        a, b = a[open_], b[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))  # both are roots: each hangs below its smallest neighbour
        up = parent[parent]
        while not np.array_equal(up, parent):
            parent, up = up, up[up]
    child = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[child], nodes[parent[child]]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v), u > v, with the components of these edges; each task joins up its own, CHUNK_EDGES at a time."""

    def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, v = (np.concatenate([x.column(i).to_numpy() for x in held]) for i in (0, 1))
        return pa.record_batch([pa.array(x, pa.int64()) for x in stars(u, v)], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK_EDGES:
                yield star(held)
                held, n = [], 0
        if n:
            yield star(held)

    return edges.mapInArrow(tidy(run), "u long, v long")


def settled(edges: DataFrame) -> bool:
    """Is every node either below one other node or above some?"""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(edges.select("v", F.lit(0), F.lit(1)))
    ends = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return (ends.agg(F.max(F.col("below") + F.col("above"))).first()[0] or 0) <= 1


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node reachable. Nodes without an edge are not listed.

    Every step is a min aggregation joined back to the edges, so a star's centre with very many edges
    is summed map-side and its join can be split. Null ends and loops are no edges; an empty table has
    no nodes. Raises if max_rounds do not suffice.
    """
    pair = [F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")]
    edges = contracted(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v"))
    edges = materialize(contracted(edges.distinct()))
    for _ in range(max_rounds):
        if settled(edges):
            break
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = materialize(contracted(small.where("u <> v").select(*pair).distinct()))
    else:
        raise RuntimeError("components did not converge")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
