"""Toxicity by cumulative-link ordinal regression over sparse text features.

P(grade >= k | x) = sigmoid(x . w - theta_k) with one weight vector for all ordered thresholds; the
expected severity is the sum of these over k. Features say which of a bounded list of telling words a
text has; the list and the weights come from a bounded sample of the labelled documents, weighted back
to the labels' own shares. Every document is then scored whole, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy
from .terms import labelled_sample, sample_matrix, telling_terms, term_rows


@dataclass
class OrdinalModel:
    terms: np.ndarray  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one less than the grades
    grades: np.ndarray

    def beyond(self, x: np.ndarray) -> np.ndarray:
        """P(grade index >= 1, 2, ...) for scores x."""
        return 1 / (1 + np.exp(-np.clip(x[:, None] - self.thresholds, -500, 500)))


def fit_ordinal(label: np.ndarray, pointers: np.ndarray, index: np.ndarray, n_terms: int, weight: np.ndarray, l2: float = 1e-4, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by Adam on the weighted cumulative-link likelihood; label: 0 .. K-1, all present."""
    k = int(label.max()) + 1
    weight = weight / weight.sum()
    share = np.array([weight[label >= j].sum() for j in range(1, k)])
    start = -np.log(np.clip(share, 1e-6, 1 - 1e-6) / (1 - np.clip(share, 1e-6, 1 - 1e-6)))
    params = np.concatenate([np.zeros(n_terms), start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    row = np.repeat(np.arange(len(label)), np.diff(pointers))
    m = v = np.zeros_like(params)
    n = np.arange(len(label))
    for t in range(1, steps + 1):
        w, theta = params[:n_terms], params[n_terms] + np.concatenate([[0], np.cumsum(np.exp(params[n_terms + 1 :]))])
        x = np.bincount(row, w[index], len(label)) if len(index) else np.zeros(len(label))
        s = np.ones((len(label), k + 1))
        s[:, 1:k] = 1 / (1 + np.exp(-np.clip(x[:, None] - theta, -500, 500)))
        s[:, k] = 0
        lo, hi = s[n, label], s[n, label + 1]
        p = np.maximum(lo - hi, 1e-12)
        dx = weight * (1 - lo - hi)
        g_theta = np.zeros(k + 1)
        np.add.at(g_theta, label, -weight * lo * (1 - lo) / p)
        np.add.at(g_theta, label + 1, weight * hi * (1 - hi) / p)
        g_theta = g_theta[1:k]
        tail = np.cumsum(g_theta[::-1])[::-1]
        grad = np.concatenate([(np.bincount(index, dx[row], n_terms) if len(index) else np.zeros(n_terms)) - l2 * w, tail[:1], tail[1:] * np.exp(params[n_terms + 1 :])])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        params = params + 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-10)
    return params[:n_terms], params[n_terms] + np.concatenate([[0], np.cumsum(np.exp(params[n_terms + 1 :]))])


def fit(docs: DataFrame, grades: DataFrame, grade: str = "grade", doc_id: str = "doc_id", text: str = "text", per_grade: int = 8000) -> OrdinalModel | None:
    """A model from at most per_grade documents of each grade (0 .. 15); None with fewer than two grades."""
    sample, counts = labelled_sample(docs, grades, grade, per_grade, doc_id, text)
    terms = telling_terms(sample)
    label, pointers, index, _ = sample_matrix(sample, terms)
    known = np.unique(label)
    if len(known) < 2:
        return None
    y = np.searchsorted(known, label)
    had = np.bincount(y)
    weight = np.array([counts[int(g)] for g in known])[y] / had[y]
    weights, thresholds = fit_ordinal(y, pointers, index, len(terms), weight)
    return OrdinalModel(terms, weights, thresholds, known)


def severity(docs: DataFrame, model: OrdinalModel | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, expected_severity, grade (the likeliest), toxic (P(grade above the lowest) >= 0.5).

    A null or empty text has no features and gets the labels' base rates. Without a model all
    severities are 0.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            n = batch.num_rows
            if m is None:
                expected, grade, toxic = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, bool)
            else:
                row, term = term_rows(batch.column(1), m.terms)
                beyond = m.beyond(np.bincount(row, m.weights[term], n) if len(row) else np.zeros(n))
                steps = np.diff(m.grades)
                expected = m.grades[0] + beyond @ steps
                each = np.hstack([np.ones((n, 1)), beyond]) - np.hstack([beyond, np.zeros((n, 1))])
                grade, toxic = m.grades[each.argmax(axis=1)], beyond[:, 0] >= 0.5
            yield pa.record_batch([batch.column(0), pa.array(expected, pa.float64()), pa.array(grade, pa.int64()), pa.array(toxic)], names=["doc_id", "expected_severity", "grade", "toxic"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(tidy(run), "doc_id long, expected_severity double, grade long, toxic boolean")


def grades_of(labels: DataFrame) -> DataFrame:
    """Ordered grades from two flags: 0 not toxic, 1 toxic, 2 toxic and of low quality."""
    return labels.select("doc_id", F.when(F.col("toxic") == 0, 0).when(F.col("toxic") == 1, F.when(F.col("quality") == 0, 2).otherwise(1)).alias("grade"))
