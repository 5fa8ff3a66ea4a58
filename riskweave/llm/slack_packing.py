"""Best-fit packing by minimum bin slack.

Documents are tokenized where they are read; a longer one than a sequence is cut into whole sequences and
one shorter first piece. What is left to pack is a table of lengths below the capacity, so the plan needs
no more than the number of pieces of each length: `capacity` counts, whatever the table. Per bin, a bitset
of the reachable sums over the lengths still there gives the fullest combination, which is removed; as it
stays the fullest while its lengths last, it is taken as often as they do at once, so that there are about
as many different combinations as lengths. A second plan has the largest length left in each bin; the one
with fewer bins is used.

The n-th piece of a length then has its place in the plan by n alone. Pieces get their n from counts per
length and task, added up over the tasks, so that no task sees all pieces of a length.
"""

from __future__ import annotations

import base64
import functools
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices, tidy
from .packing import ChunkEncoder
from .textblocks import U64, fold, string_buffers

CAPACITY = 1024
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
PLACES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: White space beyond ASCII: a run of it may go over into ASCII white space, where a text is else cut.
_WIDE_SPACE = re.compile("[" + "".join(map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])) + "]")
_SPACES = b" \t\n\r\f\v"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(_SPACES)] = True


class ByteEncoder(ChunkEncoder):
    """ids of whole texts for byte-level BPE, each distinct chunk encoded once.

    A chunk is a run of ASCII white space with the word after it; byte-level BPE never joins across its
    edges. Known chunks are kept by two 64-bit hashes. With `ranks_path`, the same vocabulary as ranks and its
    split pattern, new chunks are encoded as one text, which is several times faster; the bytes of each id
    say where a chunk ends. Texts with other white space than ASCII's, and chunks with a special token, go to
    the tokenizer as they are.
    """

    def __init__(self, path: str, ranks_path: str | None = None, pattern: str = "") -> None:
        super().__init__(path)
        self.fast = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(x): int(i) for x, i in map(bytes.split, f)}
            self.fast = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.width = np.zeros(max(ranks.values()) + 1, np.int64)
            self.width[list(ranks.values())] = list(map(len, ranks))

    def clear(self) -> None:
        """Forget all chunks. table: their two hashes, first id in flat and number of ids, sorted by the first hash."""
        self.table = np.empty((4, 0), U64)
        self.flat, self.used = np.empty(1 << 16, np.int32), 0

    def _store(self, h: np.ndarray, again: np.ndarray, chunks: list[bytes], apart: np.ndarray) -> None:
        if self.mark and self.mark.encode() in b"".join(chunks):
            apart &= np.array([self.mark.encode() not in c for c in chunks])
        for some, joined in ((np.flatnonzero(apart), True), (np.flatnonzero(~apart), False)):
            if len(some):
                ids, lens = self._joined([chunks[i] for i in some]) if joined and self.fast else self._encoded([chunks[i] for i in some])
                while self.used + len(ids) > len(self.flat):
                    self.flat = np.resize(self.flat, 2 * len(self.flat))
                self.flat[self.used : self.used + len(ids)] = ids
                new = np.stack([h[some], again[some], (self.used + np.cumsum(lens) - lens).astype(U64), lens.astype(U64)])
                self.table = np.concatenate([self.table, new], axis=1)
                self.used += len(ids)
        self.table = self.table[:, np.argsort(self.table[0], kind="stable")]

    def _joined(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.fast.encode_ordinary(b"".join(chunks).decode()), np.int32)
        ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(list(map(len, chunks)))) + 1
        return ids, np.diff(ends, prepend=0)

    def _found(self, h: np.ndarray, again: np.ndarray) -> np.ndarray:
        """Column of each chunk in the table, -1 if it is not there."""
        if not self.table.shape[1]:
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.table[0], h), self.table.shape[1] - 1)
        return np.where((self.table[0, at] == h) & (self.table[1, at] == again), at, -1)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        data, off = string_buffers(texts)
        if self.table.nbytes + self.flat.nbytes > self.cache_bytes:
            self.clear()
        space = _IS_SPACE[data]
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[off[:-1][off[:-1] < off[1:]]] = True
        starts = np.flatnonzero(begins)
        lens = np.diff(np.append(starts, len(data)))
        h, first, of = np.unique(fold(data, starts, lens), return_index=True, return_inverse=True)
        again = fold(data, starts[first], lens[first], 1)
        at = self._found(h, again)
        if len(new := np.flatnonzero(at < 0)):
            raw, a = data.tobytes(), starts[first[new]]
            b = a + lens[first[new]]
            self._store(h[new], again[new], [raw[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)], space[a] & ~space[b - 1])
            at = self._found(h, again)
        place, count = self.table[2:, at].astype(np.int64)[:, of]
        ends = np.cumsum(count)
        ids = self.flat[np.repeat(place - ends + count, count) + np.arange(int(ends[-1]) if len(ends) else 0)]
        bounds = np.append(0, ends)[np.searchsorted(starts, off)]
        out = [ids[a:b] for a, b in itertools.pairwise(bounds.tolist())]
        for i in np.flatnonzero(np.logical_or.reduceat(np.append(data > 127, False), off[:-1]) & (off[1:] > off[:-1])) if len(off) > 1 else ():
            if _WIDE_SPACE.search(text := data[off[i] : off[i + 1]].tobytes().decode()):
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
        return out


@functools.lru_cache(1)
def byte_encoder(*args: str | None) -> ByteEncoder:
    """One encoder for the tasks that a Python worker runs one after another; what it holds is bounded by bytes."""
    return ByteEncoder(*args)


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences, and what does not fill one at the front."""
    if length <= capacity:
        return [(0, length)]
    edges = [0, *range(length % capacity or capacity, length + 1, capacity)]
    return [(a, b - a) for a, b in itertools.pairwise(edges)]


def fullest(left: dict[int, int], capacity: int) -> list[int]:
    """The lengths, descending, of a combination of greatest sum up to capacity; of these the one with the largest lengths."""
    full = (1 << capacity + 1) - 1
    order = sorted(left)  # ascending, so that walking back takes the largest first
    reach, states = 1, []
    for x in order:
        states.append(reach)
        times, step = min(left[x], capacity // x), 1
        while times:  # any number of copies up to `times`, by doubling
            step = min(step, times)
            reach |= reach << x * step & full
            times, step = times - step, 2 * step
    total, taken = reach.bit_length() - 1, []
    for x, before in zip(reversed(order), reversed(states), strict=True):
        most = max(k for k in range(min(left[x], total // x) + 1) if before >> total - k * x & 1)
        taken += [x] * most
        total -= most * x
    return taken


def plan(counts: dict[int, int], capacity: int, largest: bool = False) -> list[tuple[int, list[int]]]:
    """(times, lengths of a bin in descending order) until no piece is left. largest: each bin holds the largest length there is, and what goes best with it."""
    left, bins = {x: n for x, n in counts.items() if n}, []
    while left:
        held = [max(left)] if largest else []
        rest = {x: n - (x in held) for x, n in left.items() if x + sum(held) <= capacity and n > (x in held)}
        best = held + fullest(rest, capacity - sum(held))
        uses = {x: best.count(x) for x in set(best)}
        times = min(left[x] // k for x, k in uses.items())
        bins.append((times, best))
        for x, k in uses.items():
            left[x] -= times * k
            if not left[x]:
                del left[x]
    return bins


def best_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """The plan with fewer bins of the two."""
    return min((plan(counts, capacity, x) for x in (False, True)), key=lambda bins: sum(times for times, _ in bins))


def tokenized(docs: DataFrame, tokenizer: tuple[str | None, ...], doc_id: str, text: str, end_id: int, capacity: int) -> DataFrame:
    """PIECES: nth counts the pieces of a length within the task that made them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = byte_encoder(*tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], np.int32)
        names = [x.split()[0] for x in PIECES.split(", ")]
        types = [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()]
        for batch in (part for whole in batches for part in slices(whole, 1)):
            rows = []
            for k, got in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), strict=True):
                got = np.concatenate([got, end]).astype("<u4")
                for i, (start, length) in enumerate(cut(len(got), capacity)):
                    rows.append((k, i, start, length, zlib.crc32(got[start : start + length]), task, int(seen[length])))
                    seen[length] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(tidy(run), PIECES)


def slots(bins: list[tuple[int, list[int]]], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each length, rows): a row an entry of a combination, with the first n it serves, its copies a bin, the first bin and its offset there."""
    rows, served, first_bin = {x: [] for x in range(capacity + 2)}, {}, 0
    for times, lengths in bins:
        offset = 0
        for x, same in itertools.groupby(lengths):
            copies = len(list(same))
            rows[x].append((served.get(x, 0), copies, first_bin, offset))
            served[x] = served.get(x, 0) + times * copies
            offset += copies * x
        first_bin += times
    flat = [r for x in range(capacity + 1) for r in rows[x]]
    return np.cumsum([0, *(len(rows[x]) for x in range(capacity + 1))]), np.array(flat, np.int64).reshape(-1, 4)


def pack_full(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, pattern: str = "", doc_id: str = "doc_id", text: str = "text", end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece (PLACES) of docs in as few sequences of at most `capacity` tokens as the method finds.

    A null text counts as empty and gives the end id alone; a null doc_id is kept; repeated rows are packed
    once each; texts of any length are tokenized whole. Only documents longer than a sequence are cut: into
    whole ones, with what is over in front. Other columns are ignored; an empty table gives no rows. Ids of
    sequences filled by one piece are negative. ranks_path, pattern: see ByteEncoder.
    """
    pieces = materialize(tokenized(docs, (tokenizer_path, ranks_path, pattern), doc_id, text, end_id, capacity))
    short = pieces.where(F.col("length") < capacity)
    held = short.groupBy("length", "task").agg(F.count("*").alias("rows"))
    w = Window.partitionBy("length").orderBy("task")
    before = materialize(held.withColumn("before", F.sum("rows").over(w) - F.col("rows")))
    counts = {r["length"]: r["n"] for r in before.groupBy("length").agg(F.sum("rows").alias("n")).collect()}  # a row a length
    first, rows = slots(best_plan(counts, capacity), capacity)
    shared = docs.sparkSession.sparkContext.broadcast((first, rows))  # some rows a length of the plan

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, rows = shared.value
        key = np.repeat(np.arange(len(first) - 1), np.diff(first)) * (1 << 48) + rows[:, 0]
        for batch in batches:
            length, n = (batch.column(c).to_numpy() for c in ("length", "n"))
            r = rows[np.searchsorted(key, length * (1 << 48) + n, side="right") - 1]
            of_bin, copy = np.divmod(n - r[:, 0], np.maximum(r[:, 1], 1))
            got = [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(r[:, 2] + of_bin), pa.array(r[:, 3] + copy * length)]
            yield pa.RecordBatch.from_arrays(got, names=[x.split()[0] for x in PLACES.split(", ")])

    numbered = short.join(before, ["length", "task"]).withColumn("n", F.col("before") + F.col("nth"))
    whole = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.col("nth") - F.shiftleft(F.col("task").cast("long"), 40), "offset": F.lit(0).cast("long")})
    names = [x.split()[0] for x in PLACES.split(", ")]
    return numbered.select(*names[:5], "n").mapInArrow(place, PLACES).union(whole.select(*names))
