"""Rows dealt out to buckets as packed columns.

A shuffle of rows moves each of them with all its fields, null ones too, and texts as they are. Here a task sorts what it
has by bucket and packs each bucket's columns: numbers by their bytes' places, texts end to end, all of it
compressed. What is dealt out are these packs, a few a task and bucket; whoever gets a bucket sees its rows as a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

PACK_ROWS, PACK_BYTES = 1 << 20, 1 << 27  #: rows and bytes that a task holds until it packs them
PACKS = "bucket int, rows long, size long, packed binary"


def _blocks(column: pa.Array) -> list[bytes]:
    """A column's validity, then its values: fixed ones by the places of their bytes, texts as lengths and bytes, others as Arrow has them."""
    if pa.types.is_timestamp(column.type):
        column = column.view(pa.int64())
    kind, n = column.type, len(column)
    valid = b"" if not column.null_count else np.packbits(column.is_valid().to_numpy(zero_copy_only=False)).tobytes()
    if pa.types.is_boolean(kind):
        return [valid, np.packbits(pc.fill_null(column, False).to_numpy(zero_copy_only=False)).tobytes()]
    if pa.types.is_integer(kind) or pa.types.is_floating(kind):
        values = (pc.fill_null(column, 0) if column.null_count else column).to_numpy(zero_copy_only=False)
        return [valid, values.view(np.uint8).reshape(n, -1).T.tobytes()]
    if pa.types.is_string(kind) or pa.types.is_binary(kind):
        full = pc.fill_null(column, b"" if pa.types.is_binary(kind) else "") if column.null_count else column
        ends = np.frombuffer(full.buffers()[1], np.int32)[full.offset : full.offset + n + 1]
        data = full.buffers()[2]
        return [valid, np.diff(ends).view(np.uint8).reshape(n, -1).T.tobytes(), data.slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes() if data else b""]
    return [pa.record_batch([column], names=["x"]).serialize().to_pybytes()]


def _column(kind: pa.DataType, n: int, blocks: Iterator[bytes]) -> pa.Array:
    if pa.types.is_timestamp(kind):
        return _column(pa.int64(), n, blocks).view(kind)
    if not _plain(kind):
        return pa.ipc.read_record_batch(pa.py_buffer(next(blocks)), pa.schema([("x", kind)])).column(0)
    bits = lambda x: np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool)
    valid = next(blocks)
    mask = ~bits(valid) if valid else None
    if pa.types.is_boolean(kind):
        return pa.array(bits(next(blocks)), mask=mask)
    places = lambda width: np.ascontiguousarray(np.frombuffer(next(blocks), np.uint8).reshape(width, n).T)
    if pa.types.is_integer(kind) or pa.types.is_floating(kind):
        width = kind.bit_width // 8
        return pa.array(places(width).view(kind.to_pandas_dtype()).reshape(n), kind, mask=mask)
    ends = np.zeros(n + 1, np.int32)
    np.cumsum(places(4).view(np.int32).reshape(n), out=ends[1:])
    present = None if mask is None else pa.py_buffer(np.packbits(~mask, bitorder="little"))
    return pa.Array.from_buffers(kind, n, [present, pa.py_buffer(ends), pa.py_buffer(next(blocks))])


def _plain(kind: pa.DataType) -> bool:
    return any(f(kind) for f in (pa.types.is_boolean, pa.types.is_integer, pa.types.is_floating, pa.types.is_timestamp, pa.types.is_string, pa.types.is_binary))


def pack(table: pa.RecordBatch) -> tuple[int, bytes]:
    """A batch as bytes, and how many they are before compression."""
    blocks = [b for c in table.columns for b in _blocks(c)]
    raw = np.array([len(b) for b in blocks], np.int64).tobytes() + b"".join(blocks)
    return len(raw), pa.compress(raw, codec="zstd", asbytes=True)


def unpack(rows: int, size: int, packed: bytes, schema: pa.Schema) -> pa.RecordBatch:
    raw = pa.decompress(packed, decompressed_size=size, codec="zstd", asbytes=True)
    count = sum((2 if not pa.types.is_string(f.type) and not pa.types.is_binary(f.type) else 3) if _plain(f.type) else 1 for f in schema)
    ends = 8 * count + np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.int64, count))])
    blocks = iter([raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)])
    return pa.RecordBatch.from_arrays([_column(f.type, rows, blocks) for f in schema], schema=schema)


def packs(rows: DataFrame, bucket: Column, order: tuple[str, ...] = ()) -> DataFrame:
    """PACKS of rows, with those alike in the columns of `order` next to each other, as far as a task holds them at once."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        buckets = table["bucket"].to_numpy()
        by = []
        for c in order:
            column = table[c].combine_chunks()
            codes = column.dictionary_encode().indices if pa.types.is_string(column.type) else column
            by.append(pc.fill_null(codes, False if pa.types.is_boolean(codes.type) else -1).to_numpy(zero_copy_only=False))
        at = np.lexsort((*by[::-1], buckets))
        plain, buckets = table.drop_columns("bucket").take(pa.array(at)).combine_chunks(), buckets[at]
        starts = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1]))
        ends = np.append(starts[1:], len(buckets))
        whole = plain.to_batches()[0]
        got = [pack(whole.slice(a, b - a)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(buckets[starts], pa.int32()), pa.array(ends - starts, pa.int64()), pa.array([s for s, _ in got], pa.int64()), pa.array([p for _, p in got], pa.binary())], names=["bucket", "rows", "size", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, size = [], 0, 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n, size = n + batch.num_rows, size + batch.nbytes
            if n >= PACK_ROWS or size >= PACK_BYTES:
                yield flush(held)
                held, n, size = [], 0, 0
        if held:
            yield flush(held)

    return rows.withColumn("bucket", bucket.cast("int")).mapInArrow(run, PACKS)


def table_of(got: pa.Table, schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches([unpack(n, size, p, schema) for n, size, p in zip(*(got[c].to_pylist() for c in ("rows", "size", "packed")), strict=True)], schema).combine_chunks()


def in_buckets(rows: DataFrame, bucket: Column, run: Callable[[pa.Table], pa.Table], kinds: str, order: tuple[str, ...] = ()) -> DataFrame:
    """What `run` makes of each bucket's rows (a table of them, in any order)."""
    schema = to_arrow_schema(rows.schema)
    return packs(rows, bucket, order).groupBy("bucket").applyInArrow(lambda t: run(table_of(t, schema)), kinds)


def matched(left: DataFrame, right: DataFrame, on: tuple[str, str], buckets: int) -> DataFrame:
    """The inner join of two tables on a whole number: the columns of left, then those of right but its key. Null keys meet nothing."""
    a, b = on
    left, right = left.where(F.col(a).isNotNull()), right.where(F.col(b).isNotNull())
    schemas = to_arrow_schema(left.schema), to_arrow_schema(right.schema)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*left.schema, *(f for f in right.schema if f.name != b)])

    def run(mine: pa.Table, others: pa.Table) -> pa.Table:
        mine, others = table_of(mine, schemas[0]), table_of(others, schemas[1]).sort_by(b)
        keys, theirs = mine[a].to_numpy().astype(np.int64), others[b].to_numpy().astype(np.int64)
        start = np.searchsorted(theirs, keys)
        n = np.searchsorted(theirs, keys, side="right") - start
        row = np.repeat(np.arange(len(keys)), n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)
        found, facts = mine.take(pa.array(row)), others.drop_columns(b).take(pa.array(place))
        return pa.table([*found.columns, *facts.columns], names=[*found.column_names, *facts.column_names])

    packed = [packs(rows, F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(max(1, buckets))), (key,)).groupBy("bucket") for rows, key in ((left, a), (right, b))]
    return packed[0].cogroup(packed[1]).applyInArrow(run, kinds)
