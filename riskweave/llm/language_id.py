"""Language identification by word-first backoff.

A known word scores its log frequency in each language. An unseen word falls back to the longest
character n-grams (with word ends marked) of which the model knows any, then to shorter ones. The
model's tables come from a bounded number of training documents a language and are themselves bounded,
so that they can be broadcast; every text is scored whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, tidy

ORDERS = 5
UNDETERMINED = "und"


@dataclass
class LanguageModel:
    languages: list[str]
    prior: np.ndarray
    words: list[str]
    word_scores: np.ndarray
    grams: dict[str, int]
    gram_scores: np.ndarray


def words_of(texts: pa.Array) -> pa.ListArray:
    """Lower-cased runs of letters (and marks) of each text; null counts as empty."""
    return pc.split_pattern_regex(pc.utf8_lower(texts.fill_null("")), r"[^\p{L}\p{M}]+")


def grams_of(word: str, n: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def training_rows(docs: DataFrame, doc_id: str, text: str, lang: str, per_language: int) -> DataFrame:
    """(text, lang) of about per_language documents a language at most, by a hash of the id; held-out ones and those without id or lang left out."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("doc_id is not null and lang is not null").where(~held_out("doc_id"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    share = F.lit(0.0)
    for k, n in counts.items():
        share = F.when(F.col("lang") == k, per_language / n).otherwise(share)
    return rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30)).select("text", "lang")


def held_out(doc_id: str):
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 4000, max_words: int = 60_000, max_grams: int = 20_000) -> LanguageModel | None:
    """Tables of the max_words most frequent words and, for each length up to 5, max_grams most frequent n-grams; None without training rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in (part for whole in batches for part in slices(whole, 0)):
            for lang in pc.unique(batch.column(1)).to_pylist():
                words = words_of(batch.column(0).filter(pc.equal(batch.column(1), lang))).flatten()
                for x in pc.value_counts(words).to_pylist():
                    word, n = x["values"], x["counts"]
                    if word:
                        seen[0, word, lang] += n
                        for size in range(1, ORDERS + 1):
                            for gram in grams_of(word, size):
                                seen[size, gram, lang] += n
        keys = list(seen)
        for a in range(0, len(keys), 100_000):
            part = keys[a : a + 100_000]
            yield pa.record_batch([pa.array([k[0] for k in part], pa.int64()), pa.array([k[1] for k in part]), pa.array([k[2] for k in part]), pa.array([seen[k] for k in part], pa.int64())], names=["size", "piece", "lang", "n"])

    sums = training_rows(docs, doc_id, text, lang, per_language).mapInArrow(tidy(count), "size long, piece string, lang string, n long").groupBy("size", "piece", "lang").agg(F.sum("n").alias("n"))
    pieces = sums.groupBy("size", "piece").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"), F.sum("n").alias("total"))
    pieces = pieces.where("total > 1 or size > 0").persist()
    rows = [r for size in range(ORDERS + 1) for r in pieces.where(F.col("size") == size).orderBy(F.desc("total"), "piece").limit(max_grams if size else max_words).collect()]
    pieces.unpersist()
    languages = sorted({k for r in rows for k in r["by"]})
    if not languages:
        return None
    at = {k: i for i, k in enumerate(languages)}
    table = np.zeros((len(rows), len(languages)))
    for i, r in enumerate(rows):
        for k, n in r["by"].items():
            table[i, at[k]] = n
    sizes = np.array([r["size"] for r in rows])
    scores = np.zeros_like(table)
    for size in np.unique(sizes):
        part = table[sizes == size]
        scores[sizes == size] = np.log((part + 0.1) / (part.sum(axis=0) + 0.1 * (len(part) + 1)))
    is_word = sizes == 0
    prior = np.full(len(languages), -np.log(len(languages)))
    return LanguageModel(languages, prior, [r["piece"] for r in rows if r["size"] == 0], scores[is_word], {r["piece"]: i for i, r in enumerate(r for r in rows if r["size"])}, scores[~is_word])


def backed_off(word: str, model: LanguageModel) -> np.ndarray:
    """Mean score of the known n-grams of the greatest length that has any."""
    for size in range(ORDERS, 0, -1):
        at = [i for g in grams_of(word, size) if (i := model.grams.get(g)) is not None]
        if at:
            return model.gram_scores[at].mean(axis=0)
    return np.zeros(len(model.languages))


def identify(docs: DataFrame, model: LanguageModel | None, doc_id: str = "doc_id", text: str = "text", cache: int = 500_000) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score (posterior of lang_pred, 0 to 1).

    lang_pred is `und` with score 0 if the text is null or has no letter, or there is no model. Ties
    go to the language first in the alphabet.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        vocabulary = pa.array(m.words if m else [], pa.string())
        unseen: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in slices(whole, 2):
                texts = batch.column(2)
                n = batch.num_rows
                some = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                pred, score = np.full(n, UNDETERMINED, object), np.zeros(n)
                if m is not None and some.any():
                    lists = words_of(texts)
                    flat = pc.dictionary_encode(lists.flatten())
                    unique = flat.dictionary
                    known = pc.index_in(unique, value_set=vocabulary)
                    table = m.word_scores[pc.fill_null(known, 0).to_numpy(zero_copy_only=False)] if len(m.words) else np.zeros((len(unique), len(m.languages)))
                    if len(unseen) > cache:
                        unseen.clear()
                    for i in np.flatnonzero(known.is_null().to_numpy(zero_copy_only=False)):
                        word = unique[i].as_py()
                        if (x := unseen.get(word)) is None:
                            x = unseen[word] = backed_off(word, m) if word else np.zeros(len(m.languages))
                        table[i] = x
                    empty = pc.fill_null(pc.equal(unique, ""), False).to_numpy(zero_copy_only=False)
                    table[empty] = 0
                    rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
                    index = flat.indices.to_numpy(zero_copy_only=False)
                    total = m.prior + np.stack([np.bincount(rows, table[index, j], n) for j in range(len(m.languages))], axis=1)
                    best = total.argmax(axis=1)
                    share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                    pred[some] = np.array(m.languages, object)[best[some]]
                    score[some] = share[some]
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "text").mapInArrow(tidy(run), "doc_id long, held_out boolean, lang_pred string, score double")
