"""Exact deduplication with a two-pass Bloom filter.

Pass 1 sets, for every row, the positions of its text hash, and keeps the positions that were hit at
least twice (by whichever rows, in whichever tasks). Pass 2 calls a row possibly repeated if all its
positions are among these; only such rows shuffle, to be grouped by the SHA-256 of their texts. A row
that is called so wrongly forms a group of one, so the filter's size changes the cost, never the result.
The filter has 16 bits a row up to `max_bits` in all (32 MB), which is what is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, pow2_at_least, spare_name, tidy
from .textblocks import U64, mix

BITS_PER_ROW, MAX_BITS, PROBES = 16, 28, 2
FLUSH = 1 << 21
_SALTS = mix(np.arange(1, 9))


def _positions(hashes: np.ndarray, bits: int, probes: int) -> np.ndarray:
    return np.stack([mix(hashes.view(U64) + _SALTS[i]) >> U64(64 - bits) for i in range(probes)])


def repeat_filter(rows: DataFrame, hash_column: str, n_rows: int, probes: int = PROBES, bits_per_row: int = BITS_PER_ROW, max_bits: int = MAX_BITS, least: int = 2) -> tuple[np.ndarray, int]:
    """(bit array, log2 of its bits): set where at least `least` rows (1 or 2) have a position."""
    bits = min(max_bits, max(16, pow2_at_least(n_rows * bits_per_row).bit_length() - 1))
    bucket_bits = min(bits - 3, max(3, pow2_at_least(n_rows * probes / (1 << 19)).bit_length() - 1))
    width = bits - bucket_bits

    def packed(parts: list[np.ndarray]) -> pa.RecordBatch:
        at, counts = np.unique(np.concatenate(parts), return_counts=True)
        cut = np.searchsorted(at, np.arange((1 << bucket_bits) + 1, dtype=U64) << U64(width))
        full = np.flatnonzero(np.diff(cut))
        low = (at & U64((1 << width) - 1)).astype(np.uint32)
        spans = [slice(cut[k], cut[k + 1]) for k in full]
        return pa.record_batch([pa.array(full, pa.int64()), pa.array([low[s].tobytes() for s in spans], pa.binary()), pa.array([low[s][counts[s] > 1].tobytes() for s in spans], pa.binary())], names=["bucket", "once", "twice"])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            parts.append(_positions(batch.column(0).to_numpy(zero_copy_only=False), bits, probes).ravel())
            n += len(parts[-1])
            if n >= FLUSH:
                yield packed(parts)
                parts, n = [], 0
        if n:
            yield packed(parts)

    def merged(rows: pa.Table) -> pa.Table:
        once, twice = np.zeros(1 << width, bool), np.zeros(1 << width, bool)
        for a, b in zip(rows["once"], rows["twice"], strict=True):
            a = np.frombuffer(a.as_py(), np.uint32)
            twice[a[once[a]]] = True
            twice[np.frombuffer(b.as_py(), np.uint32)] = True
            once[a] = True
        return pa.table({"bucket": pa.array([rows["bucket"][0].as_py()], pa.int64()), "bits": pa.array([np.packbits(twice if least == 2 else once).tobytes()], pa.binary())})

    parts = rows.select(hash_column).mapInArrow(tidy(local), "bucket long, once binary, twice binary")
    array, size = np.zeros(1 << (bits - 3), np.uint8), 1 << (width - 3)
    for row in parts.groupBy("bucket").applyInArrow(merged, "bucket long, bits binary").toLocalIterator(prefetchPartitions=True):
        array[row["bucket"] * size : (row["bucket"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return array, bits


def possibly_repeated(df: DataFrame, hash_column: str, built: tuple[np.ndarray, int], probes: int = PROBES) -> Column:
    held = df.sparkSession.sparkContext.broadcast(built)

    @F.arrow_udf("boolean")
    def test(h: pa.Array) -> pa.Array:
        array, bits = held.value
        at = _positions(h.to_numpy(zero_copy_only=False).astype(np.int64), bits, probes).astype(np.int64)
        return pa.array(((array[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0))

    return test(F.col(hash_column))


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", normalise=None, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after `normalise` (a function of a Column; none by default); null
    counts as empty. The row with the largest doc_id of a group stays; a null doc_id is the smallest.
    Of rows that repeat both text and doc_id one is kept. Other columns are ignored; an empty table gives
    no rows. With more than 2**max_bits / 16 rows the filter clears ever fewer of them; then ids and hashes
    of the others, never texts, shuffle as well, and the result is the same.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    body = normalise(body) if normalise else body
    rows = materialize(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.sha2(body.cast("binary"), 256).alias("text_sha256"), F.xxhash64(body).alias("h")))
    built = repeat_filter(rows, "h", rows.count(), max_bits=max_bits)
    rows = rows.withColumn("again", possibly_repeated(rows, "h", built))
    alone = rows.where("not again").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    # both sides of the join are tables, so that adaptive execution can split a hot text's rows
    again = materialize(rows.where("again").groupBy("text_sha256", "doc_id").agg(F.count("*").alias("times")))
    groups = materialize(again.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.sum("times").alias("group_size")))
    again = again.join(groups, "text_sha256").withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return alone.union(again.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)).alias("kept"), "text_sha256"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that exact_duplicates drops, all columns kept. Rows the filter clears pass straight through; an empty table stays empty."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    hashes = materialize(docs.select(F.xxhash64(body).alias("h")))
    built = repeat_filter(hashes, "h", hashes.count())
    columns = docs.columns
    h, again, row = (spare_name(columns, c) for c in ("h", "again", "row"))
    marked = docs.withColumn(h, F.xxhash64(body))
    marked = marked.withColumn(again, possibly_repeated(marked, h, built))
    alone = marked.where(~F.col(again)).select(*columns)
    whole = F.struct(*columns)
    best = F.max_by(whole, F.struct(F.col(doc_id), F.xxhash64(F.to_json(whole))))
    kept = marked.where(F.col(again)).groupBy(F.sha2(body.cast("binary"), 256)).agg(best.alias(row))
    return alone.union(kept.select(f"{row}.*"))


def drop_ids(docs: DataFrame, ids: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """docs without the rows whose doc_id is among ids (one long column of the same name). Rows with a null doc_id stay.

    Only rows that a Bloom filter of the ids may hold shuffle; the others pass straight through. No ids, or
    an empty table, leave docs as it is.
    """
    hashed = materialize(ids.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias(doc_id), F.xxhash64(F.col(doc_id).cast("long")).alias("h")))
    columns = docs.columns
    h, may = (spare_name(columns, c) for c in ("h", "may"))
    marked = docs.withColumn(h, F.xxhash64(F.col(doc_id).cast("long")))
    marked = marked.withColumn(may, possibly_repeated(marked, h, repeat_filter(hashed, "h", hashed.count(), least=1)))
    straight = marked.where(~F.col(may)).select(*columns)
    return straight.union(marked.where(F.col(may)).join(hashed.select(doc_id).distinct(), doc_id, "left_anti").select(*columns))
