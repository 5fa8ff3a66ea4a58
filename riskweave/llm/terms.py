"""Sparse term features of bounded labelled samples, shared by the text classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, tidy
from .exact_dedup import possibly_repeated, repeat_filter
from .textblocks import LETTERS_FOLDED, U64, word_chunks


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_label: int, doc_id: str = "doc_id", text: str = "text", n_labels: int = 16) -> tuple[DataFrame, dict[int, int]]:
    """((doc_id, label, text) of at most per_label labelled documents a label, those of the smallest id hash; documents of each label).

    `labels` has one integer label a document below n_labels; of contradicting labels the largest
    counts. Labels of documents that docs does not have count nowhere: only ids are compared, and a Bloom
    filter of the labelled ones keeps most others from being shuffled. A repeated doc_id counts once, with its
    smallest text. What is broadcast to find the texts has n_labels * per_label ids at most.
    """
    rows = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    rows = materialize(rows.where(F.col("label").between(0, n_labels - 1)).withColumn("h", F.xxhash64("doc_id")))
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id")).where("doc_id is not null").withColumn("h", F.xxhash64("doc_id"))
    ids = ids.where(possibly_repeated(ids, "h", repeat_filter(rows, "h", rows.count(), least=1))).select("doc_id").distinct()
    rows = materialize(rows.select("doc_id", "label").join(ids, "doc_id", "left_semi"))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    picked = None
    for k in sorted(counts):
        part = rows.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        picked = part if picked is None else picked.union(part)
    body = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    if picked is None:
        return materialize(body.limit(0).select("doc_id", F.lit(0).alias("label"), "text")), {}
    found = body.join(F.broadcast(materialize(picked)), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return materialize(found.select("doc_id", "label", "text")), counts


def term_rows(texts: pa.Array, terms: np.ndarray, classes=LETTERS_FOLDED) -> tuple[np.ndarray, np.ndarray]:
    """(document, term) index pairs, distinct, of those terms (sorted hashes) that a document has."""
    docs, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    if len(terms):
        for a, _, words, off in word_chunks(texts, classes):
            at = np.searchsorted(terms, words)
            at[at == len(terms)] = 0
            hit = np.flatnonzero(terms[at] == words)
            key = np.unique((np.searchsorted(off, hit, side="right") - 1 + a) * len(terms) + at[hit])
            docs.append(key // len(terms))
            found.append(key % len(terms))
    return np.concatenate(docs), np.concatenate(found)


def telling_terms(sample: DataFrame, least_z: float = 4.0, max_terms: int = 2000, classes=LETTERS_FOLDED) -> np.ndarray:
    """Sorted hashes of the words whose share of documents differs most between a label and the rest (log odds ratio over its standard error)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            keys, labels = [], []
            for a, b, words, off in word_chunks(batch.column(1), classes):
                for d in range(b - a):
                    w = np.unique(words[off[d] : off[d + 1]])
                    keys.append(w)
                    labels.append(np.full(len(w), label[a + d]))
            if keys:
                keys, labels = np.concatenate(keys), np.concatenate(labels)
                order = np.lexsort((labels, keys))
                keys, labels = keys[order], labels[order]
                head = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (labels[1:] != labels[:-1]))) if len(keys) else np.empty(0, np.int64)
                n = np.diff(np.append(head, len(keys)))
                yield pa.record_batch([pa.array(keys[head].view(np.int64)), pa.array(labels[head]), pa.array(n)], names=["term", "label", "n"])

    totals = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(totals) < 2:
        return np.empty(0, U64)
    every = sum(totals.values())
    sums = sample.select(F.col("label").cast("long"), "text").mapInArrow(tidy(count), "term long, label long, n long")
    by = sums.groupBy("term").agg(F.sum("n").alias("df"), *(F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in totals)).where("df >= 3")
    best = F.lit(0.0)
    for k, n in totals.items():
        a, b = F.col(f"n{k}") + 0.5, F.lit(n) - F.col(f"n{k}") + 0.5
        c, d = F.col("df") - F.col(f"n{k}") + 0.5, F.lit(every - n) - F.col("df") + F.col(f"n{k}") + 0.5
        best = F.greatest(best, F.abs(F.log(a * d / (b * c))) / F.sqrt(1 / a + 1 / b + 1 / c + 1 / d))
    rows = by.select("term", best.alias("z")).where(F.col("z") >= least_z).orderBy(F.desc("z"), "term").limit(max_terms).collect()
    return np.sort(np.array([r["term"] for r in rows], np.int64).view(U64))


def sample_matrix(sample: DataFrame, terms: np.ndarray, extra=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(label, row pointers, term indexes, extra columns) of a bounded sample, gathered for a fit. extra: texts -> float matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, found = term_rows(batch.column(2), terms)
            cut = np.searchsorted(docs, np.arange(batch.num_rows + 1))
            more = extra(batch.column(2)) if extra else np.zeros((batch.num_rows, 0))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([found[cut[i] : cut[i + 1]].astype(np.int32).tobytes() for i in range(batch.num_rows)], pa.binary()), pa.array([x.tobytes() for x in more], pa.binary())], names=["doc_id", "label", "terms", "extra"])

    rows = sample.select("doc_id", F.col("label").cast("long"), "text").mapInArrow(run, "doc_id long, label long, terms binary, extra binary").orderBy("doc_id").toArrow()
    label = rows["label"].to_numpy()
    each = [np.frombuffer(x.as_py(), np.int32) for x in rows["terms"]]
    more = np.stack([np.frombuffer(x.as_py(), float) for x in rows["extra"]]) if len(label) else np.zeros((0, 0))
    pointers = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
    return label, pointers, np.concatenate([np.empty(0, np.int32), *each]), more
