"""Exact top-k search by distributed histogram selection.

Every query is scored against all rows, block by block, once per pass. A pass refines, for all queries
at once, a histogram of scores over the bin that holds a query's k-th best score; after the last pass
that score is known exactly. Then rows above it, and the smallest ids at it, are filtered and ranked.
A task reports at most as many bins, and at the end rows, per query as the query still lacks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

QUERY_BLOCK, BIN_BITS, SHARD_ROWS = 1024, 12, 16384
LARGEST = 2**62 - 1  #: components and scores are cut to that, so that sums of two scores are longs
BLOCK = "salt long, dim long, ids binary, mat binary"


def _vectors(column: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that take part, their dimensions, floor(scale * x) of all their components in order)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    offsets = column.offsets.to_numpy()
    values = column.values.cast(pa.float64())
    flat = values.to_numpy(zero_copy_only=False)  # nulls become nan
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.clip(np.floor(scale * flat), -(2.0**62), 2.0**62)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    valid = np.asarray(column.is_valid()) & (bad[offsets[1:]] == bad[offsets[:-1]])
    rows = np.flatnonzero(valid)
    dims = (offsets[1:] - offsets[:-1])[rows]
    take = np.repeat(offsets[:-1][rows], dims) + np.arange(dims.sum()) - np.repeat(np.cumsum(dims) - dims, dims)
    assert n == len(valid)
    return rows, dims, scaled[take].astype(np.int64)


def _blocks(ids: np.ndarray, column: pa.Array, scale: float, salt: int) -> list[tuple]:
    rows, dims, flat = _vectors(column, scale)
    starts = np.cumsum(dims) - dims
    out = []
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        mat = flat[(starts[at][:, None] + np.arange(d)).ravel()]
        out.append((salt, int(d), ids[rows[at]].tobytes(), mat.tobytes()))
    return out


def _table(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = {"ids": pa.binary(), "mat": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types.get(c, pa.int64())) for i, c in enumerate(names)], names=names)


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    if not q.size or not c.size:
        return np.zeros((len(q), len(c)), np.int64)
    most = float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1]
    if most < 2.0**53:
        return (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    if most < 2.0**62:
        return q @ c.T
    exact = q.astype(object) @ c.T.astype(object)
    return np.clip(exact, -LARGEST, LARGEST).astype(np.int64)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of every query, ties to the smaller vec_id.

    Score: inner product of floor(scale * x) as integers, exact; components and scores of 2**62 and beyond are
    cut to that, so that such vectors take part and their scores tie. A query's own vec_id is no candidate of it. Vectors that are null, or hold null or non-finite
    components, and rows with a null vec_id take no part; neither do candidates of another length than
    the query. A repeated query id counts once, with its smallest vector; repeated candidate rows stay
    repeated. With fewer than k candidates all are returned; an empty table gives no rows. Other columns
    are ignored.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where("vec_id is not null")
    queries = queries.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where("vec_id is not null")
    n, n_queries = rows.count(), queries.count()
    query_blocks = max(1, -(-n_queries // QUERY_BLOCK))
    salts = max(16, -(-n // SHARD_ROWS))
    names = [x.split()[0] for x in BLOCK.split(", ")]

    def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() * 7919
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                out = _blocks(part.column(0).to_numpy(zero_copy_only=False), part.column(1), scale, at % salts)
                at += 1
                if out:
                    yield _table(out, names)

    def pack_queries(table: pa.Table) -> pa.Table:
        out = _blocks(table["vec_id"].to_numpy(), table["v"], scale, table["qb"][0].as_py())
        return pa.Table.from_batches([_table(out, ["qb", "dim", "ids", "mat"])]) if out else pa.table({"qb": pa.array([], pa.int64()), "dim": pa.array([], pa.int64()), "ids": pa.array([], pa.binary()), "mat": pa.array([], pa.binary())})

    candidates = materialize(rows.mapInArrow(pack_rows, BLOCK))
    packed = queries.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)))
    packed = materialize(packed.groupBy("qb").applyInArrow(pack_queries, "qb long, dim long, ids binary, mat binary"))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = [max([0.0, *np.sqrt((np.frombuffer(m.as_buffer(), np.int64).reshape(-1, max(1, d.as_py())).astype(float) ** 2).sum(axis=1))]) for m, d in zip(batch.column(0), batch.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([max(most, default=0.0)], pa.float64())], names=["x"])

    longest = [x.select("mat", "dim").mapInArrow(bound, "x double").agg(F.max("x")).first()[0] or 0.0 for x in (packed, candidates)]
    limit = min(int(min(longest[0] * longest[1] * (1 + 1e-9) + 2, 2.0**63)), LARGEST)  # Cauchy-Schwarz: no score lies beyond
    bits = (2 * limit).bit_length()

    pairs = candidates.withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long")))).withColumnRenamed("ids", "cids").withColumnRenamed("mat", "cmat")
    salted = packed.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))

    def scored(batches: Iterator[pa.RecordBatch], shift: int | None, before: int) -> Iterator[pa.RecordBatch]:
        """The histogram of one refinement, or with shift None the rows at or above each k-th score."""
        for batch in batches:
            for dim, qids, qmat, cids, cmat, state in zip(*(batch.column(i) for i in range(6)), strict=True):
                d = dim.as_py()
                qids, cids = (np.frombuffer(x.as_buffer(), np.int64) for x in (qids, cids))
                qmat, cmat = (np.frombuffer(x.as_buffer(), np.int64).reshape(-1, d) if d else np.zeros((len(i), 0), np.int64) for x, i in ((qmat, qids), (cmat, cids)))
                known = {s["query_id"]: (s["prefix"], s["need"]) for s in state.as_py() or []}
                rows: list[tuple] = []
                for a in range(0, len(qids), 128):
                    u = _scores(qmat[a : a + 128], cmat) + limit
                    for q, line in zip(qids[a : a + 128].tolist(), u, strict=True):
                        prefix, need = known.get(q, (0, k))
                        mine = cids != q
                        if shift is None:
                            above = np.flatnonzero(mine & (line > prefix))
                            ties = np.flatnonzero(mine & (line == prefix))
                            ties = ties[np.argsort(cids[ties], kind="stable")[:need]]
                            at = np.concatenate([above, ties])
                            rows += zip([q] * len(at), cids[at].tolist(), (line[at] - limit).tolist(), strict=True)
                        elif prefix >= 0:
                            x = line[mine & (line >> before == prefix)]
                            if len(x) > need:
                                x = np.partition(x, len(x) - need)[len(x) - need :]
                            bins, counts = np.unique(x >> shift, return_counts=True)
                            rows += zip([q] * len(bins), bins.tolist(), counts.tolist(), strict=True)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["query_id", "x", "y"])

    state = None
    shifts = list(range(bits, 0, -BIN_BITS))[1:] + [0]

    def blocks(state: DataFrame | None) -> DataFrame:
        right = salted.withColumn("state", F.lit(None).cast("array<struct<query_id:long,prefix:long,need:long>>"))
        if state is not None:
            by_block = state.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).alias("qb")).agg(F.collect_list(F.struct("query_id", "prefix", "need")).alias("state"))
            right = salted.join(by_block, "qb", "left")
        return pairs.join(right, ["qb", "salt", "dim"]).select("dim", "ids", "mat", "cids", "cmat", "state")

    before = bits
    ids = packed.select("ids").mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_buffer(), np.int64))], names=["query_id"]) for b in batches for x in b.column(0)), "query_id long")
    for shift in shifts:
        counted = blocks(state).mapInArrow(lambda it, s=shift, b=before: scored(it, s, b), "query_id long, x long, y long").groupBy("query_id", "x").agg(F.sum("y").alias("y"))
        last = state if state is not None else ids.select("query_id", F.lit(0).cast("long").alias("prefix"), F.lit(k).cast("long").alias("need"))
        counted = counted.join(last.select("query_id", "need"), "query_id")
        w = Window.partitionBy("query_id").orderBy(F.desc("x"))
        counted = counted.withColumn("upto", F.sum("y").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        found = counted.where("upto >= need and upto - y < need").select("query_id", F.col("x").alias("prefix"), (F.col("need") - F.col("upto") + F.col("y")).alias("need"))
        # too few candidates: -1 stands for all
        state = materialize(last.select("query_id", F.col("need").alias("all")).join(found, "query_id", "left").select("query_id", F.coalesce("prefix", F.lit(-1)).alias("prefix"), F.coalesce("need", "all").alias("need")))
        before = shift
    hits = blocks(state).mapInArrow(lambda it: scored(it, None, 0), "query_id long, x long, y long")
    w = Window.partitionBy("query_id").orderBy(F.desc("y"), "x")
    ranked = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("x").alias("vec_id"), F.col("y").alias("score"))
