"""Cost-balanced packing of tokenized documents into sequences.

A task tokenizes its documents as they stream by and packs them a window at a time, so nothing
shuffles and memory is bounded by the window. Documents of a sequence's length or more are first cut
to whole sequences. What remains is taken in descending length; each goes to the sequence of lowest
cost (tokens plus `quadratic` times the square of each piece's length, as attention within a document
costs) that has room for it, and only when none has room is it cut. A window opens as many sequences
as its tokens fill; tokens beyond that go on to the next window. A task's last tokens fill sequences
of powers of two, which need no padding.
"""

from __future__ import annotations

import functools
import itertools
import os
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

CAPACITY, WINDOW, CACHE_BYTES = 4096, 1 << 20, 128 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


class ChunkEncoder:
    """ids of whole texts, each distinct chunk between ASCII white space encoded once.

    Right for tokenizers that drop white space and never join across it (word_bpe_49k: its normaliser
    and its splitter act on each side of a white space alone).
    """

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cache_bytes = Tokenizer.from_file(path), cache_bytes
        special = [(i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word)]
        self.mark_id, self.mark = max(special, default=(-1, ""))
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.held = 0  # bytes of the memo: chunks with a dictionary entry each, and their ids
        self.flat, self.used = np.empty(1 << 16, np.int32), 0
        self.starts, self.lens = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def _each(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _encoded(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks in order, number of ids of each). A special token between them, which the tokenizer splits at first, keeps chunks apart in one call."""
        words = [c.decode() for c in chunks]
        if not self.mark or any(self.mark in w for w in words):
            got = self._each(words)
            return np.array([i for x in got for i in x], np.int32), np.array([len(x) for x in got], np.int64)
        runs = self._each([self.mark.join([*words[a : a + 1000], ""]) for a in range(0, len(words), 1000)])
        flat = np.concatenate([np.empty(0, np.int32), *(np.array(x, np.int32) for x in runs)])
        ends = np.flatnonzero(flat == self.mark_id)
        return flat[flat != self.mark_id], np.diff(np.append(-1, ends)) - 1

    def _learn(self, chunks: list[bytes]) -> None:
        ids, lens = self._encoded(chunks)
        n, m = len(self.known), len(self.known) + len(chunks)
        while m > len(self.starts):
            self.starts, self.lens = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lens, 2 * len(self.lens))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.lens[n:m] = lens
        self.starts[n:m] = self.used + np.cumsum(lens) - lens
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.known.update(zip(chunks, range(n, m), strict=True))
        self.held += sum(map(len, chunks)) + 150 * len(chunks) + 4 * len(ids)

    def encode(self, texts: list[str | bytes]) -> list[np.ndarray]:
        if self.held > self.cache_bytes:
            self.clear()
        words: list[bytes] = []
        cut = [0]
        for t in texts:
            words += (t if isinstance(t, bytes) else t.encode()).split()
            cut.append(len(words))
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            self._learn(sorted({words[i] for i in missing}))
            at[missing] = [self.known[words[i]] for i in missing]
        lens = self.lens[at]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.starts[at] - ends + lens, lens) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[cut]
        return [ids[a:b] for a, b in itertools.pairwise(bounds.tolist())]


@functools.lru_cache(1)
def encoder_of(path: str) -> ChunkEncoder:
    """One encoder for the tasks that a Python worker runs one after another; its memo is bounded by bytes."""
    return ChunkEncoder(path)


class Packer:
    def __init__(self, capacity: int, quadratic: float, first_id: int) -> None:
        self.capacity, self.quadratic, self.next_id = capacity, quadratic, first_id
        self.pool: list[tuple[int, tuple, int]] = []  # (length, (doc_id, ids), start)
        self.rows: list[tuple] = []

    def _piece(self, doc: tuple, start: int, length: int, sequence: int, offset: int, size: int) -> None:
        ids = doc[1][start : start + length]
        self.rows.append((doc[0], start, length, zlib.crc32(ids.astype("<u4").tobytes()), len(doc[1]), sequence, offset, size))

    def _new(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        doc, at = (doc_id, ids), 0
        while len(ids) - at >= self.capacity:
            self._piece(doc, at, self.capacity, self._new(), 0, self.capacity)
            at += self.capacity
        if at < len(ids):
            self.pool.append((len(ids) - at, doc, at))

    def pack(self, last: bool = False) -> None:
        total = sum(x[0] for x in self.pool)
        n = total // self.capacity
        order = sorted(range(len(self.pool)), key=lambda i: (-self.pool[i][0], i))
        cost, room = np.zeros(n), np.full(n, self.capacity)
        ids = [self._new() for _ in range(n)]
        left: list[tuple[int, tuple, int]] = []
        for i in order:
            length, doc, start = self.pool[i]
            while length:
                fits = np.flatnonzero(room >= length)
                if not len(fits) and not len(fits := np.flatnonzero(room)):
                    left.append((length, doc, start))
                    break
                k = fits[np.argmin(cost[fits])]
                take = min(length, int(room[k]))
                self._piece(doc, start, take, ids[k], self.capacity - int(room[k]), self.capacity)
                room[k] -= take
                cost[k] += take + self.quadratic * take * take
                length, start = length - take, start + take
        self.pool = left
        if last:
            self._finish()

    def _finish(self) -> None:
        rest = sum(x[0] for x in self.pool)
        sizes = [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]
        used, sequence = 0, -1
        for length, doc, start in self.pool:
            while length:
                if sequence < 0:
                    sequence = self._new()
                take = min(length, sizes[0] - used)
                self._piece(doc, start, take, sequence, used, sizes[0])
                used, length, start = used + take, length - take, start + take
                if used == sizes[0]:
                    del sizes[0]
                    used, sequence = 0, -1
        self.pool = []


def pack(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 2, capacity: int = CAPACITY, window: int = WINDOW, quadratic: float = 1 / CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens.

    A null text counts as empty and gives the end id alone; repeated rows are packed once each. Each
    sequence is full or has a power of two of tokens; capacity must be a power of two. Other columns
    are ignored; an empty table gives no rows. Costs are balanced within a window of `window` tokens of one
    task; whole sequences cut from long documents cost the most and are left as they are.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path)
        packer = Packer(capacity, quadratic, TaskContext.get().partitionId() << 40)
        end = np.array([end_id], np.int32)
        held = 0

        def flush() -> pa.RecordBatch:
            rows, packer.rows = packer.rows, []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            a = 0
            while a < len(ids):
                b, size = a, 0
                part = []
                while b < len(ids) and size < 1 << 20:
                    x = texts[b]
                    part.append(x.as_buffer().to_pybytes() if x.is_valid else b"")
                    size += len(part[-1])
                    b += 1
                for k, got in zip(ids[a:b], encoder.encode(part), strict=True):
                    got = np.concatenate([got, end])
                    packer.add(k, got)
                    held += len(got)
                if held >= window:
                    packer.pack()
                    held = sum(x[0] for x in packer.pool)
                    if packer.rows:
                        yield flush()
                a = b
        packer.pack(last=True)
        if packer.rows:
            yield flush()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(tidy(run), SCHEMA)
