"""Mixing documents to target weights by soft domain membership.

A softmax classifier fitted on a bounded sample of the labelled table gives every document its
posterior over domains. Rates r_i >= 0 then minimise

    1/2 sum_k (x_k - tau_k)^2 / tau_k + ridge/2 sum_i (t_i / W) (r_i - 1)^2,   x_k = sum_i r_i t_i p_ik / W

for token counts t_i, W tokens in all and target shares tau_k of W. The minimum has
r_i = max(0, 1 - sum_k p_ik g_k / ridge) with pulls g_k = (x_k - tau_k) / tau_k, so that only the pulls are
sought: where the convex function sum_k (tau_k g_k^2 / 2 + tau_k g_k) + ridge/2 sum_i (t_i / W) r_i^2 is least,
by Newton steps. A step needs a few sums over all documents, and a document's rate follows from its
posterior and the pulls, so no state but these few numbers moves between steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, tidy
from .terms import labelled_sample, sample_matrix, telling_terms, term_rows
from .textblocks import string_buffers, word_chunks

SHAPES = 6


def shapes(texts: pa.Array) -> np.ndarray:
    """Per text: shares of upper-case, symbol and digit bytes, words per distinct word, repeated neighbours, bytes per word (scaled)."""
    data, off = string_buffers(texts)
    n = len(off) - 1
    size = np.maximum(np.diff(off), 1)

    def share(flags: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (c[off[1:]] - c[off[:-1]]) / size

    upper = (data >= 65) & (data <= 90)
    digit = (data >= 48) & (data <= 57)
    lower = (data >= 97) & (data <= 122)
    symbol = (data > 32) & (data < 128) & ~upper & ~lower & ~digit
    out = np.zeros((n, SHAPES))
    out[:, 0], out[:, 1], out[:, 2] = 4 * share(upper), 4 * share(symbol), 4 * share(digit)
    for a, b, words, word_off in word_chunks(texts):
        lens = np.diff(word_off)
        for d in np.flatnonzero(lens):
            w = words[word_off[d] : word_off[d + 1]]
            out[a + d, 3] = 1 - len(np.unique(w)) / len(w)
        again = np.concatenate([[0], np.cumsum(np.append(words[1:] == words[:-1], False))])
        out[a:b, 4] = (again[word_off[1:]] - again[word_off[:-1]]) / np.maximum(lens, 1)
    counts = token_counts(texts)
    out[:, 5] = np.minimum(size / np.maximum(counts, 1), 40) / 10
    return out


def token_counts(texts: pa.Array) -> np.ndarray:
    """Words between white space."""
    parts = [np.diff(off) for _, _, _, off in word_chunks(texts)]
    return np.concatenate([np.empty(0, np.int64), *parts])


@dataclass
class DomainModel:
    terms: np.ndarray
    weights: np.ndarray  # (terms + shapes + 1, domains)
    labels: np.ndarray

    def posterior(self, texts: pa.Array) -> np.ndarray:
        n, v = len(texts), len(self.terms)
        more = shapes(texts)
        x = more @ self.weights[v:-1] + self.weights[-1]
        row, term = term_rows(texts, self.terms)
        for k in range(x.shape[1]):
            x[:, k] += np.bincount(row, self.weights[term, k], n) if len(row) else 0
        p = np.exp(x - x.max(axis=1, keepdims=True)) if n else x
        return p / p.sum(axis=1, keepdims=True) if n else p


def fit_domains(docs: DataFrame, labels: DataFrame, label: str = "domain", doc_id: str = "doc_id", text: str = "text", per_domain: int = 4000, l2: float = 1e-4, steps: int = 300) -> DomainModel | None:
    """A softmax classifier from at most per_domain labelled documents a domain (integers 0 .. 15); None with fewer than two domains."""
    sample, counts = labelled_sample(docs, labels, label, per_domain, doc_id, text)
    terms = telling_terms(sample, max_terms=1000)
    y, pointers, index, more = sample_matrix(sample, terms, shapes)
    known = np.unique(y)
    if len(known) < 2:
        return None
    y = np.searchsorted(known, y)
    weight = (np.array([counts[int(g)] for g in known]) / np.bincount(y))[y]
    weight = weight / weight.sum()
    n, v, k = len(y), len(terms), len(known)
    row = np.repeat(np.arange(n), np.diff(pointers))
    dense = np.hstack([more, np.ones((n, 1))])
    w = np.zeros((v + dense.shape[1], k))
    hot = np.eye(k)[y]
    m = s = np.zeros_like(w)
    for t in range(1, steps + 1):
        x = dense @ w[v:]
        for j in range(k):
            x[:, j] += np.bincount(row, w[index, j], n) if len(index) else 0
        p = np.exp(x - x.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = weight[:, None] * (p - hot)
        grad = np.vstack([np.stack([np.bincount(index, g[row, j], v) if len(index) else np.zeros(v) for j in range(k)], axis=1).reshape(v, k), dense.T @ g]) + l2 * w
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad * grad
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-10)
    return DomainModel(terms, w, known)


@dataclass
class Mix:
    """The pulls of the domains: enough to compute any document's rate from its posterior."""

    ridge: float
    pulls: np.ndarray

    @property
    def domains(self) -> int:
        return len(self.pulls)

    def rates(self, p: np.ndarray) -> np.ndarray:
        return np.maximum(0.0, 1 - p @ self.pulls / self.ridge)


def with_posteriors(docs: DataFrame, model: DomainModel | None, domains: int, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` of docs with tokens and p (one posterior a domain; all in the first without a model)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in (part for whole in batches for part in slices(whole, len(keep))):
            texts = batch.column(len(keep))
            p = np.zeros((batch.num_rows, domains))
            if m is None:
                p[:, 0] = 1
            else:
                p[:, m.labels] = m.posterior(texts)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, domains, dtype=np.int32)), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(token_counts(texts), pa.int64()), lists], names=[*keep, "tokens", "p"])

    rows = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return rows.mapInArrow(tidy(run), f"{schema}, tokens long, p array<double>")


def fit_rates(members: DataFrame, target: list[float], ridge: float = 1e-3, steps: int = 40, tolerance: float = 1e-5) -> Mix:
    """The pulls that bring members (tokens, p) to the target shares of all tokens. Domains that no document belongs to have no pull.

    Ends when (x - tau) / tau and the pulls differ by less than tolerance; raises if `steps` passes do not suffice.
    """
    k = len(target)
    tau = np.array(target, float) / sum(target)
    scale = np.where(tau > 0, tau, 1e-3)

    def sums(tried: list[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray, np.ndarray, float]]:
        """For each vector of pulls: tokens, tokens by domain, tokens by domain at the rates, products of posteriors where the rate is not 0, squared rates."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    t = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
                    p = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                    out = []
                    for g in tried:
                        r = Mix(ridge, g).rates(p)
                        out += [[t.sum()], t @ p, (t * r) @ p, ((p * (t * (r > 0))[:, None]).T @ p).ravel(), [t @ (r * r)]]
                    out = np.concatenate(out)
                    yield pa.record_batch([pa.array(np.arange(len(out))), pa.array(out)], names=["i", "x"])

        size = 2 + 2 * k + k * k
        out = np.zeros((len(tried), size))
        for r in members.select("tokens", "p").mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
            out[divmod(r["i"], size)] = r["x"]
        return [(o[0], o[1 : 1 + k], o[1 + k : 1 + 2 * k], o[1 + 2 * k : -1].reshape(k, k), o[-1]) for o in out]

    pulls, value, newton, reach = np.zeros(k), np.inf, np.zeros(k), 1.0
    for step in range(steps):
        tried = [pulls + reach / 4**n * newton for n in range(4)] if step else [pulls]
        best = None
        for g, (total, has, x, square, squares) in zip(tried, sums(tried), strict=True):
            if total <= 0:
                return Mix(ridge, np.zeros(k))
            slope = np.where(has > 0, scale * g + tau - x / total, 0.0)
            if np.abs(slope / scale).max() < tolerance:
                return Mix(ridge, g)
            at = (scale * g * g / 2 + tau * g)[has > 0].sum() + ridge / 2 * squares / total
            if best is None or at < best[0]:
                best = at, g, slope, square / total
        if best[0] < value:
            value, pulls, slope, square = best
            newton, reach = -np.linalg.solve(np.diag(scale) + square / ridge, slope), 1.0
        else:
            reach /= 4 ** len(tried)
    raise RuntimeError(f"the rates have not converged after {steps} passes")


def with_rates(members: DataFrame, mix: Mix, doc_id: str = "doc_id") -> DataFrame:
    """members with rate and copies: the rate rounded up or down by a hash of the id, so that its mean is kept."""
    held = members.sparkSession.sparkContext.broadcast(mix)
    names = members.columns
    at = names.index("p")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in members.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, held.value.domains)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held.value.rates(p))], names=[*names, "rate"])

    chance = F.pmod(F.xxhash64(F.lit("copies"), doc_id), F.lit(1 << 40)) / float(1 << 40)
    return members.mapInArrow(run, f"{schema}, rate double").withColumn("copies", F.floor(F.col("rate") + chance).cast("long"))


def domains_of(labels: DataFrame) -> DataFrame:
    """Domains from two flags: 0 good, 1 of low quality, 2 toxic."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0).alias("domain"))


def mixed(docs: DataFrame, labels: DataFrame, target: list[float], doc_id: str = "doc_id", text: str = "text", per_domain: int = 4000, keep: list[str] | None = None) -> DataFrame:
    """One row per row of docs: doc_id (or the columns `keep`), tokens, p, rate, copies.

    target: the wanted share of tokens for each domain of `labels` (doc_id, domain). tokens are words
    between white space: none for a null or empty text, whose posterior is that of a text without
    features. Null and repeated doc_ids count as any other row, very long texts are read whole. Labels
    outside the targets' domains are ignored. An empty table gives no rows; without two labelled domains
    all documents belong to the first.
    """
    keep = keep or [doc_id]
    if taken := {"tokens", "p", "rate", "copies", "__text"} & {c.lower() for c in keep}:
        raise ValueError(f"columns to keep must not be called {sorted(taken)}")
    labels = labels.where(F.col("domain").between(0, len(target) - 1))
    model = fit_domains(docs, labels, "domain", doc_id, text, per_domain)
    members = materialize(with_posteriors(docs, model, len(target), [doc_id], text))
    mix = fit_rates(members, target)
    rows = members if keep == [doc_id] else with_posteriors(docs, model, len(target), keep, text)
    return with_rates(rows, mix, doc_id)
