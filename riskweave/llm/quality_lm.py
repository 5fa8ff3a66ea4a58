"""Quality classifier: perplexity under an interpolated modified Kneser-Ney bigram model of trusted text.

Trusted documents are those labelled of good quality. Half of them (by a hash of the id) train the
model, the other half, with the documents labelled bad, set each language's threshold. Words are runs
between white space, as written; a word is a 32-bit hash and a bigram the 64 bits of its two words, so
the vocabulary has no bound and the model grows with the text (words of one hash count as one).

With P(w|v) = max(c(vw) - D(c(vw)), 0) / c(v) + gamma(v) P1(w), P1 the same over continuation counts, a
document's log probability is a sum of values of its n-grams, which is what is looked up:

    of each word            log P1(w) - log P1(unknown) + log gamma(w)
    of each modelled bigram log P(w|v) - log gamma(v) - log P1(w)

and log P1(unknown) for each position. All bigrams are modelled, those seen once too. Training bigrams are
counted in shards by their hash, which also tell what discounts their words need. Values of bigrams are
derived from those counts where they are read, so that no further copy of them is written: facts of
words are sent everywhere while few, joined beyond. The values of the most frequent `hot` n-grams are broadcast, the
others joined: a document sends only n-grams that a Bloom filter of bounded size lets pass, and of the
model only those are sent that such a filter of what documents ask for lets pass. A training document
has no bigram that the model lacks: one that was not seen more often was seen once, which needs no
look-up. Values are fixed-point numbers, so sums do not depend on their order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, pow2_at_least, release, text_bytes, tidy
from .exact_dedup import _positions, possibly_repeated, repeat_filter
from .textblocks import U64, WHITESPACE_RAW, mix, word_chunks

START, END, FIRST_WORD = 1, 2, 3  #: codes below FIRST_WORD are no words; 0 as first word marks a single word's key
HOT, MAX_BITS, PROBES = 1 << 21, 27, 2  #: broadcast: HOT keys and values (25 MB) and 2**MAX_BITS bits (16 MB) at most
BROADCAST_IDS = 1 << 21  #: up to so many training ids are broadcast to find their texts
SENT_WORDS = 1 << 21  #: words whose facts are sent everywhere (28 bytes each)
SHARD_BYTES, FLUSH = 16 << 20, 1 << 20
LOW_COUNTS = 4
UNIT = float(1 << 20)
QUANTILES = (0.98, 0.985, 0.99, 0.995)  #: of good text, to choose a threshold from


def sequences(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first doc, end doc, word codes with START and END around each document, offsets, number of words)."""
    for a, b, hashes, off in word_chunks(texts, WHITESPACE_RAW):
        lens = np.diff(off)
        new = off + 2 * np.arange(len(off))
        x = np.empty(new[-1], U64)
        x[np.arange(len(hashes)) + 2 * np.repeat(np.arange(b - a), lens) + 1] = np.maximum(hashes >> U64(32), U64(FIRST_WORD))
        x[new[:-1]], x[new[1:] - 1] = START, END
        yield a, b, x, new, lens


def trusted_ids(labels: DataFrame, doc_id: str, quality: str) -> DataFrame:
    """(doc_id, q, half) by label: q 1 if every label is good; half 0 trains, 1 sets thresholds."""
    rows = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(quality).cast("int").alias("q")).where("doc_id is not null and q is not null").groupBy("doc_id").agg(F.min("q").alias("q"))
    return rows.select("doc_id", "q", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).alias("half"))


def training_text(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts of these documents. Few ids are broadcast; of more a Bloom filter keeps most other texts from being shuffled."""
    n = ids.count()
    if n <= BROADCAST_IDS:
        return docs.join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi").select("text")
    hashed = materialize(ids.select("doc_id", F.xxhash64("doc_id").alias("h")))
    near = docs.withColumn("h", F.xxhash64("doc_id"))
    near = near.where(possibly_repeated(near, "h", repeat_filter(hashed, "h", n, least=1))).select("doc_id", "text")
    return materialize(near.join(hashed.select("doc_id"), "doc_id", "left_semi").select("text"))


ROWS = "kind int, key long, a long, b long, kept long, n1 long, n2 long, n3 long"
PAIR, WORD, TOTAL = 0, 1, 2  #: rows of the n-gram table: (pair, count, -), (word, distinct words before it, occurrences as context, of its modelled pairs the occurrences and how many were counted once, twice, more often), (count of 1 to 4, number of such pairs, -)


def ngram_table(texts: DataFrame, shards: int, least_count: int = 1) -> DataFrame:
    """ROWS of the training text; those of words and totals are partial, one a shard. Pairs below `least_count` are counted, not modelled."""
    packed_kind = "shard long, hi binary, lo binary, n binary"
    schema = pa.schema([("shard", pa.int64()), ("hi", pa.binary()), ("lo", pa.binary()), ("n", pa.binary())])

    def packed(parts: list[np.ndarray]) -> pa.RecordBatch:
        pairs, n = np.unique(np.concatenate(parts), return_counts=True)
        shard = (mix(pairs) % U64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        cut = np.searchsorted(shard[order], np.arange(shards + 1))
        rows = []
        for k in np.flatnonzero(np.diff(cut)):
            p, c = pairs[order[cut[k] : cut[k + 1]]], n[order[cut[k] : cut[k + 1]]]
            rows.append((int(k), (p >> U64(32)).astype(np.uint32).tobytes(), p.astype(np.uint32).tobytes(), c.astype(np.uint32).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for _, _, x, _, lens in sequences(batch.column(0)):
                keep = x[:-1] != END
                if not lens.all():
                    keep &= ~((x[:-1] == START) & (x[1:] == END))
                parts.append((x[:-1] << U64(32) | x[1:])[keep])
                size += len(parts[-1])
                if size > FLUSH:
                    yield packed(parts)
                    parts, size = [], 0
        if size:
            yield packed(parts)

    out_schema = pa.schema([("kind", pa.int32()), *((c, pa.int64()) for c in ("key", "a", "b", "kept", "n1", "n2", "n3"))])

    def merged(rows: pa.Table) -> pa.Table:
        parts = [np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in rows[c]]) for c in ("hi", "lo", "n")]
        pairs = parts[0].astype(U64) << U64(32) | parts[1]
        order = np.argsort(pairs, kind="stable")
        pairs, n = pairs[order], parts[2][order].astype(np.int64)
        head = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
        pairs, n = pairs[head], np.add.reduceat(n, head)
        kept = n >= least_count
        first, second = (pairs >> U64(32)).astype(np.int64), (pairs & U64(0xFFFFFFFF)).astype(np.int64)
        words, where = np.unique(np.concatenate([first, second]), return_inverse=True)
        total = np.bincount(where[: len(n)], n, len(words)).astype(np.int64)
        before = np.bincount(where[len(n) :], minlength=len(words))
        low = np.arange(1, LOW_COUNTS + 1)
        of_words = lambda some, weights=None: np.bincount(where[: len(n)][some], None if weights is None else weights[some], len(words)).astype(np.int64)
        modelled = [of_words(kept, n), *(of_words(kept & x) for x in (n == 1, n == 2, n >= 3))]
        cols = [
            np.repeat([PAIR, WORD, TOTAL], [kept.sum(), len(words), LOW_COUNTS]).astype(np.int32),
            np.concatenate([pairs[kept].view(np.int64), words, low]),
            np.concatenate([n[kept], before, [(n == k).sum() for k in low]]),
            *(np.concatenate([np.zeros(kept.sum(), np.int64), x, np.zeros(LOW_COUNTS, np.int64)]) for x in (total, *modelled)),
        ]
        out = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out_schema, strict=True)], schema=out_schema)
        release()
        return out

    return materialize(texts.mapInArrow(tidy(local), packed_kind).groupBy("shard").applyInArrow(merged, ROWS))


def discounts(n: list[float]) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2, 3 or more, from the numbers of items counted 1, 2, 3, 4 times."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    exact = (1 - 2 * y * n2 / max(n1, 1e-9), 2 - 3 * y * n3 / max(n2, 1e-9), 3 - 4 * y * n4 / max(n3, 1e-9))
    return [float(np.clip(d, 0.05, 0.95 * (i + 1))) if have >= 1 else 0.5 * (i + 1) for i, (d, have) in enumerate(zip(exact, (n1, n2, n3), strict=True))]


def _discount(c: Column, d: list[float]) -> Column:
    return F.when(c <= 0, 0.0).when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])


def values(table: DataFrame) -> tuple[DataFrame, float]:
    """((key, freq, value) of each n-gram of the model, log probability of an unknown word)."""
    return model_of(table)[:2]


def model_of(table: DataFrame) -> tuple[DataFrame, float, Broadcast | None]:
    """The same, and the facts of words, if they are few."""
    low = {r["key"]: r["n"] for r in table.where(F.col("kind") == TOTAL).groupBy("key").agg(F.sum("a").alias("n")).collect()}
    d2 = discounts([low.get(k, 0) for k in range(1, LOW_COUNTS + 1)])
    pairs = table.where(F.col("kind") == PAIR).select("key", F.col("a").alias("c"))
    sums = {"before": "a", "total": "b", **{c: c for c in ("kept", "n1", "n2", "n3")}}
    words = materialize(table.where(F.col("kind") == WORD).groupBy(F.col("key").alias("v")).agg(*(F.sum(c).alias(n) for n, c in sums.items())))
    own = F.col("kept") - d2[0] * F.col("n1") - d2[1] * F.col("n2") - d2[2] * F.col("n3")
    c = F.col("before")
    facts = words.agg(F.sum(c).alias("every"), F.count_if(c > 0).alias("types"), *(F.count_if(c == k).alias(f"n{k}") for k in range(1, LOW_COUNTS + 1)), F.count_if(c >= 3).alias("more"), F.count("*").alias("words")).first()
    every, d1 = float(facts["every"] or 0), discounts([facts[f"n{k}"] for k in range(1, LOW_COUNTS + 1)])
    left = (facts["n1"] * d1[0] + facts["n2"] * d1[1] + facts["more"] * d1[2]) or 1.0
    unknown = left / max(every, 1.0) / (facts["types"] + 1)
    gamma = F.when(F.col("total") > 0, F.greatest(1 - own / F.col("total"), F.lit(1e-9))).otherwise(1.0)
    words = words.select("v", "before", "total", F.log(gamma).alias("log_gamma"), F.log((c - _discount(c, d1)) / F.lit(max(every, 1.0)) + F.lit(unknown)).alias("log_p1"))
    fixed = lambda x: F.round(x * UNIT).cast("long").alias("value")
    single = words.select(F.col("v").alias("key"), F.greatest("total", "before").alias("freq"), fixed(F.col("log_gamma") + F.when(F.col("v") == START, 0.0).otherwise(F.col("log_p1") - float(np.log(unknown)))))
    if facts["words"] <= SENT_WORDS:
        held = sent_facts(words, d2)
        return single.union(valued(pairs, held)), float(np.log(unknown)), held
    context = words.select("v", "total", "log_gamma")
    word = words.select(F.col("v").alias("w"), "log_p1")
    joined = pairs.withColumn("v", F.shiftrightunsigned("key", 32)).join(context, "v").drop("v").withColumn("w", F.col("key").bitwiseAND(0xFFFFFFFF)).join(word, "w")
    own = (F.col("c") - _discount(F.col("c"), d2)) / F.col("total")
    double = joined.select("key", F.col("c").alias("freq"), fixed(F.log1p(own * F.exp(-F.col("log_gamma") - F.col("log_p1")))))
    return materialize(single.union(double)), float(np.log(unknown)), None


def pair_values(key: np.ndarray, c: np.ndarray, facts: tuple[np.ndarray, ...]) -> np.ndarray:
    """Values of bigrams counted c times, by the sent facts of words."""
    words, context, log_p1, d = facts
    first, second = (np.searchsorted(words, x.astype(np.uint32)) for x in (key >> U64(32), key & U64(0xFFFFFFFF)))
    own = np.log(c - d[np.minimum(c, 3)])
    return np.round(np.log1p(np.exp(own - context[first] - log_p1[second])) * UNIT).astype(np.int64)


def sent_facts(words: DataFrame, d: list[float]) -> Broadcast:
    """Facts of few words (v, total, log_gamma, log_p1), and the discounts."""
    rows = words.select("v", F.log("total").alias("log_total"), "log_gamma", "log_p1").toArrow()
    v = rows["v"].to_numpy()
    order = np.argsort(v)
    facts = [rows[c].to_numpy()[order] for c in ("log_total", "log_gamma", "log_p1")]
    return words.sparkSession.sparkContext.broadcast((v[order].astype(np.uint32), facts[0] + facts[1], facts[2], np.array([0.0, *d])))


def valued(pairs: DataFrame, held: Broadcast) -> DataFrame:
    """(key, freq, value) of pairs (key, c), each time that they are read."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = pair_values(batch.column(0).to_numpy().view(U64), batch.column(1).to_numpy(), held.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(value)], names=["key", "freq", "value"])

    return pairs.mapInArrow(tidy(local), "key long, freq long, value long")


def hot_values(table: DataFrame, most: int) -> tuple[Column, np.ndarray, np.ndarray, int]:
    """(condition, keys, values, how many are left) of the about `most` most frequent n-grams; of the last frequency that has room those of the smallest key hash."""
    by = table.groupBy(F.least("freq", F.lit(1 << 16)).alias("f")).count().orderBy("f").collect()  # one row a frequency
    least, n, share = (1 << 16) + 1, 0, 0
    for r in reversed(by):
        if n + r["count"] > most:
            share = (most - n) * 4096 // r["count"]
            break
        least, n = r["f"], n + r["count"]
    hot = (F.col("freq") >= least) | ((F.col("freq") >= least - 1) & (F.pmod(F.xxhash64("key"), F.lit(4096)) < share))
    rows = table.where(hot).select("key", F.col("value").cast("int")).toArrow()
    keys, got = rows["key"].to_numpy().view(U64), rows["value"].to_numpy()
    order = np.argsort(keys)
    return hot, keys[order], got[order], sum(r["count"] for r in by) - len(keys)


def log_probabilities(docs: DataFrame, model: DataFrame, unknown: float, hot: int = HOT, facts: Broadcast | None = None, training: DataFrame | None = None) -> DataFrame:
    """(doc_id, lang, n_words, log_prob) per row of docs (doc_id, text, lang; a long column key is handed on).

    `facts` of words and the ids of the `training` documents, both few, spare these the look-up of what was seen once; the model then has all their bigrams.
    """
    chosen, keys, got, left = hot_values(model, hot)
    tail = model.where(~chosen).select("key", "value")
    filters = [repeat_filter(tail, "key", left, PROBES, max_bits=MAX_BITS, least=1)]
    trained = np.empty(0, np.int64)
    if facts is not None and training is not None:
        more = model.where(~chosen & ((F.col("freq") > 1) | (F.shiftrightunsigned("key", 32) == 0))).select("key")
        filters.append(repeat_filter(more, "key", more.count(), PROBES, max_bits=MAX_BITS, least=1))
        trained = np.sort(training.toArrow()["doc_id"].to_numpy())
    held = docs.sparkSession.sparkContext.broadcast((keys, got, filters, trained))
    more = [c for c in docs.columns if c == "key"]
    kind = "row long, doc_id long, lang string, " + "".join(f"{c} long, " for c in more) + "n_words long, base long, keys array<long>, many array<int>"
    lists = {"keys": pa.int64(), "many": pa.int32()}

    def grouped(doc: np.ndarray, key: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
        """Lists of each document's distinct keys and how often it has them."""
        order = np.lexsort((key, doc))
        doc, key = doc[order], key[order]
        head = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))) if len(doc) else np.empty(0, np.int64)
        many = np.diff(np.append(head, len(doc))).astype(np.int32)
        at = pa.array(np.searchsorted(doc[head], np.arange(n + 1)).astype(np.int32))
        return pa.ListArray.from_arrays(at, pa.array(key[head].view(np.int64))), pa.ListArray.from_arrays(at, pa.array(many))

    def passes(key: np.ndarray, bits: tuple[np.ndarray, int]) -> np.ndarray:
        spot = _positions(key, bits[1], PROBES).astype(np.int64)
        return ((bits[0][spot >> 3] >> (7 - (spot & 7)).astype(np.uint8)) & 1).astype(bool).all(axis=0)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, got, filters, trained = held.value
        for batch in batches:
            at = np.searchsorted(trained, ids := pc.fill_null(batch.column(1), 0).to_numpy())
            at[at == len(trained)] = 0
            trains = (trained[at] == ids) & pc.is_valid(batch.column(1)).to_numpy(zero_copy_only=False) if len(trained) else np.zeros(len(ids), bool)
            for a, b, x, off, lens in sequences(batch.column(2)):
                doc = np.repeat(np.arange(b - a), lens + 2)
                inside = x[:-1] != END
                key = np.concatenate([x, (x[:-1] << U64(32) | x[1:])[inside]])
                doc = np.concatenate([doc, doc[:-1][inside]])
                order = np.argsort(key)  # look-ups in order stay in the cache
                key, doc = key[order], doc[order]
                at = np.searchsorted(keys, key)
                at[at == len(keys)] = 0
                hit = keys[at] == key if len(keys) else np.zeros(len(key), bool)
                base = np.bincount(doc[hit], got[at[hit]], b - a).astype(float)
                rest, where = key[~hit], doc[~hit]
                may = passes(rest, filters[0])
                if trains[a:b].any():
                    once = np.flatnonzero(trains[a:b][where] & (rest >> U64(32) > 0))
                    once = once[~passes(rest[once], filters[1])]
                    base += np.bincount(where[once], pair_values(rest[once], np.ones(len(once), np.int64), facts.value), b - a)
                    may[once] = False
                base += np.round(unknown * UNIT) * (lens + 1)
                arrays = [*(batch.column(i).slice(a, b - a) for i in (0, 1, 3, *range(4, 4 + len(more)))), pa.array(lens.astype(np.int64)), pa.array(base.astype(np.int64)), *grouped(where[may], rest[may], b - a)]
                yield pa.RecordBatch.from_arrays(arrays, names=["row", "doc_id", "lang", *more, "n_words", "base", *lists])

    asked = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "lang", *more)
    asked = materialize(asked.mapInArrow(tidy(score), kind))
    each = asked.select("row", F.explode(F.arrays_zip("keys", "many")).alias("x")).select("row", F.col("x.keys").alias("key"), F.col("x.many").alias("many"))
    n = asked.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0)).alias("n")).first()["n"]
    if 2 * n < left:  # few ask: only what they may ask for is dealt out
        tail = tail.where(possibly_repeated(tail, "key", repeat_filter(each.select("key"), "key", n, PROBES, max_bits=MAX_BITS, least=1), PROBES))
    rest = each.join(tail, "key").groupBy("row").agg(F.sum(F.col("many") * F.col("value")).alias("rest"))
    out = asked.select("row", "doc_id", "lang", *more, "n_words", "base").join(rest, "row", "left")
    return out.select("doc_id", "lang", *more, "n_words", ((F.col("base") + F.coalesce("rest", F.lit(0).cast("long"))) / UNIT).alias("log_prob"))


def thresholds(judged: DataFrame, quantiles: tuple[float, ...], default: float, least: int) -> DataFrame:
    """(lang, hi) of the labelled rows (lang, q, x): that quantile of good text, of those given, which parts good from bad best.

    The quantile with the largest share of bad rows above it, less that of good rows, is taken; of equal
    ones the highest. Without bad rows it is `default`. Nothing is rejected for a low perplexity: that is
    what the training documents and their copies have.
    """
    order = sorted(quantiles, reverse=True)
    points = F.percentile_approx(F.when(F.col("q") == 1, F.col("x")), F.array(*map(F.lit, [*order, default])), F.lit(10_000))
    marks = judged.groupBy("lang").agg(points.alias("p"), F.count_if(F.col("q") == 1).alias("good"), F.count_if(F.col("q") == 0).alias("bad")).where(F.col("good") >= least)
    share = lambda i, q, of: F.count_if((F.col("x") > F.col("p")[i]) & (F.col("q") == q)) / F.greatest(F.first(of), F.lit(1))
    gains = judged.join(marks, "lang").groupBy("lang").agg(F.first("p").alias("p"), F.first("bad").alias("bad"), F.array(*(share(i, 0, "bad") - share(i, 1, "good") for i in range(len(order)))).alias("gain"))
    return gains.select("lang", F.when(F.col("bad") > 0, F.get("p", F.array_position("gain", F.array_max("gain")).cast("int") - 1)).otherwise(F.col("p")[len(order)]).alias("hi"))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", quality: str = "quality", quantile: float = 0.99, quantiles: tuple[float, ...] = QUANTILES, least: int = 30, hot: int = HOT, keep: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id (or the long column `keep`), lang, n_words, log_perplexity (per word and the end), threshold, kept.

    Kept are documents with words whose log perplexity is at most its language's threshold (see
    thresholds(); `quantile` without bad rows). A language with fewer than `least` good threshold
    documents, or a null one, uses the threshold over all. A document without words (null, empty or white
    text) is not kept; without any trusted document the threshold is null and all documents with words are
    kept. Rows with a null or repeated doc_id are scored each. A very long text is read in whole; an
    empty table gives no rows.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), F.col(keep or doc_id).cast("long").alias("key"))
    ids = materialize(trusted_ids(labels, doc_id, quality))
    texts = training_text(docs, ids.where("q = 1 and half = 0"))
    shards = pow2_at_least(max(4, text_bytes(texts) / SHARD_BYTES))
    model, unknown, facts = model_of(ngram_table(texts, shards))
    training = ids.where("q = 1 and half = 0").select("doc_id")
    training = training if training.count() <= BROADCAST_IDS else None
    scored = materialize(log_probabilities(docs, model, unknown, hot, facts, training).withColumn("log_perplexity", -F.col("log_prob") / (F.col("n_words") + 1)))
    judge = ids.where("half = 1 or q = 0").select("doc_id", "q")
    judge = materialize(scored.where("n_words > 0").join(judge, "doc_id").select("lang", "q", F.col("log_perplexity").alias("x")))
    by_lang = thresholds(judge.where("lang is not null"), quantiles, quantile, least).withColumnRenamed("lang", "language")
    every = thresholds(judge.withColumn("lang", F.lit("")), quantiles, quantile, 1).first()
    out = scored.join(by_lang, F.col("lang") == F.col("language"), "left").withColumn("threshold", F.coalesce("hi", F.lit(every["hi"] if every else None).cast("double")))
    kept = (F.col("n_words") > 0) & (F.col("threshold").isNull() | (F.col("log_perplexity") <= F.col("threshold")))
    return out.select(F.col("key").alias(keep or "doc_id"), "lang", "n_words", "log_perplexity", "threshold", kept.alias("kept"))
