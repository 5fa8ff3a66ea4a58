"""Line deduplication by pairwise alignment.

Documents are compared as lists of line hashes. A line of at least `min_words` words that several
documents have pairs each of them with the first (smallest id) that has it; lines of at most `rare`
documents pair them all, later with earlier. Each pair is aligned by patience diff: anchors are lines
of `min_words` words that occur once in both, the longest run of anchors in the same order is kept, and
blocks grow from them over equal neighbouring lines. The stretches between blocks are aligned in the
same way; where no line occurs once in both, repeated ones are matched occurrence by occurrence. What
the order leaves out (moved lines, further occurrences) starts blocks of its own, so that every line of
`min_words` words that an earlier document has is deleted from the later one. The first document of a
line always keeps it, so no line is lost altogether.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, tidy
from .textblocks import U64, mix


def _in_order(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of (new, old) pairs, sorted by new, in which old ascends too."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(pairs)
    for n, (_, i) in enumerate(pairs):
        k = bisect_left(tops, i)
        before[n] = at[k - 1] if k else -1
        tops[k : k + 1] = [i]
        at[k : k + 1] = [n]
    chain = []
    n = at[-1] if at else -1
    while n >= 0:
        chain.append(pairs[n])
        n = before[n]
    return chain[::-1]


def _places(lines: list[int], span: range, wanted) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for k in span:
        if wanted(k):
            out.setdefault(lines[k], []).append(k)
    return out


def patience_blocks(old: np.ndarray, new: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Positions of `new` in blocks aligned in order with `old`; only lines flagged in `anchor` (by position of new) start a block."""
    a, b, flags = old.tolist(), new.tolist(), anchor.tolist()
    taken = np.zeros(len(b), bool)
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        in_new = _places(b, range(b0, b1), flags.__getitem__)
        in_old = _places(a, range(a0, a1), lambda k: a[k] in in_new) if in_new else {}
        pairs = [(in_new[v][0], x[0]) for v, x in in_old.items() if len(x) == len(in_new[v]) == 1]
        pairs = pairs or [pair for v, x in in_old.items() for pair in zip(in_new[v], x, strict=False)]
        if not pairs:
            continue
        for j, i in _in_order(sorted(pairs)):
            if j < b0 or i < a0:
                continue  # already inside the block before
            x, y = j, i
            while x > b0 and y > a0 and b[x - 1] == a[y - 1]:
                x, y = x - 1, y - 1
            todo.append((a0, y, b0, x))
            b0, a0 = j + 1, i + 1
            while b0 < b1 and a0 < a1 and b[b0] == a[a0]:
                b0, a0 = b0 + 1, a0 + 1
            taken[x:b0] = True
        todo.append((a0, a1, b0, b1))
    return np.flatnonzero(taken)


def shared_positions(old: np.ndarray, new: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """The blocks of patience_blocks, and those around the flagged lines of `old` that are left: moved, or repeated more often in `new`."""
    taken = np.zeros(len(new), bool)
    taken[patience_blocks(old, new, anchor)] = True
    left = np.flatnonzero(anchor & ~taken & np.isin(new, old)).tolist()
    if left:
        a, b = old.tolist(), new.tolist()
        lines = {b[j] for j in left}
        in_old = _places(a, range(len(a)), lambda k: a[k] in lines)
        turn = dict.fromkeys(lines, 0)
        for j in left:
            if taken[j]:
                continue
            i = in_old[b[j]][turn[b[j]] % len(in_old[b[j]])]
            turn[b[j]] += 1
            x, y = j, i
            while x > 0 and y > 0 and not taken[x - 1] and b[x - 1] == a[y - 1]:
                x, y = x - 1, y - 1
            c, d = j + 1, i + 1
            while c < len(b) and d < len(a) and not taken[c] and b[c] == a[d]:
                c, d = c + 1, d + 1
            taken[x:c] = True
    return np.flatnonzero(taken)


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, h, text): h tells apart the texts of a repeated doc_id."""
    body = F.col(text).cast("string")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(body, F.lit(""))).alias("h"), body.alias("text"))


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 5, rare: int = 4) -> DataFrame:
    """(doc_id, h, removed): the positions of the lines to delete, for documents with any; h is xxhash64 of the text.

    Lines are compared without surrounding white space. A document is a doc_id and a text, ordered by id
    and h: rows that repeat both are one document, another text under the same id is another one. Rows
    with a null doc_id take no part. Which lines of `min_words` words go does not depend on `rare`.
    """
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.trim(F.regexp_replace(x, r"[\t\r\x0b\x0c]", " ")))
    rows = _keyed(docs, doc_id, text).where("doc_id is not null").select("doc_id", "h", lines.alias("l"))
    rows = rows.select(F.struct("doc_id", "h").alias("doc"), F.transform("l", lambda x: F.xxhash64(x)).alias("hashes"), F.transform("l", lambda x: F.size(F.split(x, " +")) >= min_words).alias("long"))
    rows = materialize(rows.groupBy("doc").agg(F.first(F.struct("hashes", "long")).alias("x")).select("doc", "x.*"))
    each = rows.select("doc", F.explode(F.array_distinct(F.filter("hashes", lambda x, i: F.element_at(F.col("long"), i + 1)))).alias("line"))
    # written, so that the join is of plain tables and a hot line's rows can be split
    held = materialize(each.groupBy("line").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1"))
    shared = materialize(each.join(held, "line"))
    firsts = shared.where("doc > first").select(F.col("first").alias("old"), F.col("doc").alias("new"))
    few = shared.where(F.col("n") <= rare).where("n > 2").select("line", "doc")
    closer = few.select("line", F.col("doc").alias("old")).join(few.select("line", F.col("doc").alias("new")), "line").where("old < new").select("old", "new")
    pairs = materialize(firsts.union(closer).distinct())

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, lists = [], [], []
            for k, h, old, new, anchor in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *batch.columns[2:], strict=True):
                got = shared_positions(old.values.to_numpy(), new.values.to_numpy(), anchor.values.to_numpy(zero_copy_only=False))
                if len(got):
                    ids.append(k)
                    texts.append(h)
                    lists.append(got.astype(np.int32))
            if ids:
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(texts, pa.int64()), pa.array(lists, pa.list_(pa.int32()))], names=["doc_id", "h", "lines"])

    left = rows.select(F.col("doc").alias("old"), F.col("hashes").alias("a"))
    right = rows.select(F.col("doc").alias("new"), F.col("hashes").alias("b"), "long")
    found = pairs.join(right, "new").join(left, "old").select("new.doc_id", "new.h", "a", "b", "long").mapInArrow(tidy(align), "doc_id long, h long, lines array<int>")
    single = found.select("doc_id", "h", F.explode("lines").alias("line")).distinct()
    return single.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list("line")).alias("removed"))


def deduplicate_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 5, rare: int = 4) -> DataFrame:
    """One row per row of docs: doc_id, text (without the deleted lines), n_lines, removed (positions; empty if none).

    A null text stays null and has no lines. Rows with a null doc_id are returned as they are. A very long
    text is aligned as a whole; an empty table gives no rows. Other columns are ignored.
    """
    cut = repeated_lines(docs, doc_id, text, min_words, rare)
    rows = _keyed(docs, doc_id, text).join(cut, ["doc_id", "h"], "left").withColumn("l", F.split("text", "\n", -1))
    none = F.array().cast("array<int>")
    left = F.filter("l", lambda x, i: ~F.array_contains(F.col("removed"), i))
    return rows.select("doc_id", F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("text"), F.when(F.col("text").isNull(), 0).otherwise(F.size("l")).cast("long").alias("n_lines"), F.coalesce("removed", none).alias("removed"))
