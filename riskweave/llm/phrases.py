"""Phrase collocation mining by growing contiguous patterns from the prefixes they begin with.

Words are counted first, then pairs of neighbours: only frequent ones can be part of a phrase. Each
occurrence of a frequent pair is then projected: a pointer with the words that follow, as far as each two
of them are a frequent pair, goes to the task of its prefix. Equal pointers of a task travel as one with
their number. A prefix's task counts the words that follow it and grows each frequent extension to the
right, depth first, over the pointers that have it.

Prefixes share buckets. A bucket with more pointers than a task should hold is dealt out again, first by
further bits of its prefixes' hash, then, as then a single prefix must be what fills it, by ever longer
prefixes; occurrences of the shorter ones are added up beside it. So no task holds a hot prefix, and no
pointer is dropped. What is frequent is told to the tasks by Bloom filters of bounded size, whose errors
only send pointers in vain.

Words are known by 64-bit ids in between; that no two words share one where it could matter is checked on
the counts, and another seed is taken otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, pow2_at_least, slices, tidy
from .exact_dedup import PROBES, _positions, repeat_filter
from .textblocks import U64, fold, mix, string_buffers

LONGEST, LEAST, MOST = 5, 100, 2000
#: A projection deals each FLUSH of pointers over 2**MAX_BUCKET_BITS buckets at most, whatever the input, so that its rows grow as the pointers do; finer buckets are dealt from gathered ones.
BUCKET_POINTERS, MAX_BUCKET_BITS, AGAIN_BITS, TASK_POINTERS = 1 << 20, 8, 12, 1 << 21
FLUSH = 1 << 19
SALTS = 64
#: By which prefix a round deals pointers out.
ROUNDS = [2, 2, 3, 4, 5]
WORD = "lang string, id long, word string, n long"
BUCKET = "lang string, bucket long, pointers long, packed binary, words array<long>, n long"
PHRASE = "lang string, words array<long>, a long"
_WORD, _BREAK = np.ones(256, bool), np.zeros(256, bool)
_WORD[[9, 32]] = False
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD &= ~_BREAK
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32


def word_ids(texts: pa.Array, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with A-Z lowered, start and length of each word, its id (never 0), the number of its piece)."""
    data, off = string_buffers(texts)
    data = _FOLDED[data]
    inside = _WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    own = off[:-1][off[:-1] < off[1:]]
    begins[own] = inside[own]
    starts = np.flatnonzero(begins)
    gaps = np.append(np.flatnonzero(~inside), len(data))
    ends = gaps[np.searchsorted(gaps, starts)]
    texts_of = np.searchsorted(off, starts, side="right")
    lens = np.minimum(ends, off[texts_of]) - starts if len(starts) else ends
    pieces = np.cumsum(_BREAK[data])[starts] + texts_of
    return data, starts, lens, np.maximum(fold(data, starts, lens, seed), U64(1)), pieces


def by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array]]:
    """Texts of a language at a time, a MB or one text of them."""
    for whole in batches:
        for batch in slices(whole, 1):
            langs = batch.column(0).dictionary_encode()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                yield lang, batch.column(1).filter(pa.compute.equal(langs.indices, i))


def count_words(docs: DataFrame, seed: int) -> DataFrame:
    """WORD: how often each word of a language occurs. docs: lang, text without nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in by_lang(batches):
            data, starts, lens, ids, _ = word_ids(texts, seed)
            known, first, of, n = np.unique(ids, return_index=True, return_inverse=True, return_counts=True)
            again = fold(data, starts, lens, seed + 1)
            odd = np.flatnonzero(again != again[first][of])  # another word with the same id: both are told
            shown = np.concatenate([first, odd])
            raw = data.tobytes()
            words = [raw[a : a + m].decode(errors="replace") for a, m in zip(starts[shown].tolist(), lens[shown].tolist(), strict=True)]
            ids, n = np.concatenate([known, ids[odd]]), np.concatenate([n, np.zeros(len(odd), np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(ids.view(np.int64)), pa.array(words, pa.string()), pa.array(n)], names=["lang", "id", "word", "n"])

    return docs.mapInArrow(tidy(run), WORD).groupBy("lang", "id", "word").agg(F.sum("n").alias("n"))


def may_hold(built: tuple[np.ndarray, int], hashes: np.ndarray) -> np.ndarray:
    array, size = built
    at = _positions(hashes.view(np.int64), size, PROBES).astype(np.int64)
    return ((array[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)


def pointers(ids: np.ndarray, joined: np.ndarray, width: int) -> np.ndarray:
    """A column a word, in `width` rows it and the words after it as far as each is joined to the one before (0 beyond)."""
    out = np.zeros((width, len(ids)), U64)
    out[0], valid = ids, np.ones(len(ids), bool)
    joined = np.append(joined, np.zeros(width, bool))
    for k in range(1, width):
        valid &= joined[k - 1 : k - 1 + len(ids)]
        at = np.flatnonzero(valid)
        out[k, at] = ids[at + k]
    return out


def prefix_hash(rows: np.ndarray, depth: int) -> np.ndarray:
    h = rows[0]
    for k in range(1, depth):
        h = mix(h * U64(0x9E3779B97F4A7C15) + rows[k])
    return mix(h)


def dealt(lang: str, rows: np.ndarray, n: np.ndarray, depth: int, used: int, bits: int) -> Iterator[tuple]:
    """(lang, bucket, pointers, packed) of pointers, equal ones merged, by `bits` bits of the hash of their first `depth` words after the first `used`."""
    bucket = (prefix_hash(rows, depth) << U64(used)) >> U64(64 - bits) if bits else np.zeros(rows.shape[1], U64)
    order = np.lexsort([*rows[::-1], bucket])
    rows, n, bucket = rows[:, order], n[order], bucket[order]
    first = np.flatnonzero(np.append(True, (rows[:, 1:] != rows[:, :-1]).any(axis=0)))
    n, rows, bucket = np.add.reduceat(n, first), rows[:, first], bucket[first]
    edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist() + [len(n)]
    for a, b in zip(edges, edges[1:], strict=False):
        packed = pa.compress(rows[:, a:b].tobytes() + n[a:b].astype(np.int64).tobytes(), codec="zstd", asbytes=True)
        yield lang, int(bucket[a]), b - a, packed


def unpacked(sizes: list[int], packed: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.frombuffer(pa.decompress(x, 8 * (width + 1) * m, codec="zstd", asbytes=True), np.int64).reshape(width + 1, m) for m, x in zip(sizes, packed, strict=True)]
    both = np.concatenate(parts, axis=1)
    return both[:width].view(U64), both[width]


def _buckets(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*(r + (None,) * (6 - len(r)) for r in rows), strict=True), types, strict=True)], names=[x.split()[0] for x in BUCKET.split(", ")])


def project(docs: DataFrame, seed: int, built: tuple[np.ndarray, int], width: int, bits: int) -> DataFrame:
    """BUCKET rows of pointers: of width 2 to neighbours that may both be among the words of the filter, of more to three words and more of which each two may be among its pairs."""
    held = docs.sparkSession.sparkContext.broadcast(built)  # 2**28 bits at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[np.ndarray]] = {}

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(waiting.pop(lang), axis=1)
            if rows.shape[1]:
                out = list(dealt(lang, rows, np.ones(rows.shape[1], np.int64), 2, 0, bits))
                yield from (_buckets(out[i : i + 500]) for i in range(0, len(out), 500))

        for lang, texts in by_lang(batches):
            *_, ids, pieces = word_ids(texts, seed)
            same = pieces[1:] == pieces[:-1]
            if width == 2:
                may = may_hold(held.value, ids)
                rows = pointers(ids, same & may[1:] & may[:-1], width)
                rows = rows[:, rows[1] != 0]
            else:
                rows = pointers(ids, same & may_hold(held.value, prefix_hash(np.stack([ids[:-1], ids[1:]]), 2)), width)
                rows = rows[:, rows[2] != 0]
            waiting.setdefault(lang, []).append(rows)
            if sum(x.shape[1] for x in waiting[lang]) >= FLUSH:
                yield from flush(lang)
            if len(waiting) > 64 or sum(x.shape[1] for xs in waiting.values() for x in xs) >= 2 * FLUSH:
                for k in list(waiting):
                    yield from flush(k)
        for k in list(waiting):
            yield from flush(k)

    return docs.mapInArrow(tidy(run), BUCKET)


def dealt_again(buckets: DataFrame, width: int, depth: int, used: int, bits: int, before: int) -> DataFrame:
    """Pointers of buckets by a longer prefix or further bits of its hash, and as rows of (lang, words, n) the occurrences of the prefixes shorter than that.

    The parts of a bucket are gathered first and dealt out FLUSH pointers at a time, not each part alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sizes, parts = None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            rows, n = unpacked(sizes, parts, width)
            sizes.clear()
            parts.clear()
            out = [] if before in (2, depth) else [(key[0], None, None, None, words, int(m)) for _, words, m in _runs(rows, n, np.flatnonzero(rows[before - 1]), range(before), 1)]
            deep = rows[depth - 1] != 0
            out += list(dealt(key[0], rows[:, deep], n[deep], depth, used, bits)) if deep.any() else []
            yield from (_buckets(out[i : i + 500]) for i in range(0, len(out), 500))

        for batch in batches:
            for lang, bucket, size, packed in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if sizes and (key != (lang, bucket) or sum(sizes) >= FLUSH):
                    yield from flush()
                key = (lang, bucket)
                sizes.append(size)
                parts.append(packed)
        if sizes:
            yield from flush()

    gathered = buckets.select("lang", "bucket", "pointers", "packed").repartition("lang", "bucket").sortWithinPartitions("lang", "bucket")
    return gathered.mapInArrow(tidy(run), BUCKET)


def _runs(rows: np.ndarray, n: np.ndarray, at: np.ndarray, depths: range, least: int) -> Iterator[tuple[np.ndarray, list[int], int]]:
    """(pointers, their words at `depths`, occurrences) of the pointers `at` by these words, where there are at least `least`."""
    if not len(at):
        return
    order = at[np.lexsort([rows[k, at] for k in reversed(depths)])]
    keys = rows[depths.start : depths.stop, order]
    first = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
    total = np.add.reduceat(n[order], first)
    ends = np.append(first[1:], len(order))
    for i in np.flatnonzero(total >= least):
        yield order[first[i] : ends[i]], keys[:, first[i]].view(np.int64).tolist(), int(total[i])


def grown(rows: np.ndarray, n: np.ndarray, depth: int, least: int) -> Iterator[tuple[list[int], int]]:
    """All phrases of `depth` words or more with at least `least` occurrences, depth first: a stack of prefixes with the pointers that have them."""
    stack = list(_runs(rows, n, np.flatnonzero(rows[depth - 1]), range(depth), least))
    while stack:
        at, words, m = stack.pop()
        yield words, m
        k = len(words)
        if k < len(rows):
            at = at[rows[k, at] != 0]
            if n[at].sum() >= least:
                stack += [(found, words + more, m) for found, more, m in _runs(rows, n, at, range(k, k + 1), least)]


def mined(buckets: DataFrame, width: int, depth: int, least: int) -> DataFrame:
    """PHRASE: what a task finds among the pointers of its bucket's prefixes; of wider pointers, what is longer than a pair."""

    def run(group: pa.Table) -> pa.Table:
        rows, n = unpacked(group["pointers"].to_pylist(), group["packed"].to_pylist(), width)
        found = [(w, m) for w, m in grown(rows, n, depth, least) if width == 2 or len(w) > 2]
        lang = group["lang"][0].as_py()
        return pa.table({"lang": pa.array([lang] * len(found), pa.string()), "words": pa.array([w for w, _ in found], pa.list_(pa.int64())), "a": pa.array([m for _, m in found], pa.int64())})

    return buckets.select("lang", "bucket", "pointers", "packed").groupBy("lang", "bucket").applyInArrow(run, PHRASE)


def frequent_words(docs: DataFrame, least: int) -> tuple[DataFrame, int]:
    """(WORD, the seed of its ids)."""
    for seed in range(0, 16, 2):
        words = materialize(count_words(docs, seed))
        shared = words.groupBy("lang", "id").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
        if shared.where((F.col("k") > 1) & (F.col("n") >= least)).isEmpty():
            return words, seed
    raise ValueError("words share ids under every seed")


def frequent_pairs(docs: DataFrame, words: DataFrame, seed: int, least: int, bits: int) -> DataFrame:
    """PHRASE of two words. Pairs of a task travel once, so that their buckets are even; with more buckets than a task should write at once, they are dealt out in two steps."""
    often = words.where(F.col("n") >= least).select("id").distinct()
    first = min(bits, MAX_BUCKET_BITS)
    pairs = project(docs, seed, repeat_filter(often, "id", often.count(), least=1), 2, first)
    if bits > first:
        pairs = dealt_again(pairs, 2, 2, 0, bits, 2)  # by all bits: by the further ones alone the buckets would meet again
    return materialize(mined(pairs, 2, 2, least))


def longer_phrases(docs: DataFrame, pairs: DataFrame, seed: int, least: int, bits: int, task_pointers: int) -> DataFrame:
    """PHRASE of three words and more."""

    @F.arrow_udf("long")
    def pair_hash(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(prefix_hash(np.stack([x.to_numpy(zero_copy_only=False).astype(np.int64).view(U64) for x in (a, b)]), 2).view(np.int64))

    often = materialize(pairs.select(pair_hash(F.col("words")[0], F.col("words")[1]).alias("h")).distinct())
    bits = min(bits, MAX_BUCKET_BITS)
    left, parts = materialize(project(docs, seed, repeat_filter(often, "h", often.count(), least=1), LONGEST, bits)), []
    for i, depth in enumerate(ROUNDS):
        held = left.where("bucket is not null")
        full = held.groupBy("lang", "bucket").agg(F.sum("pointers").alias("held")).where(F.col("held") > task_pointers).select("lang", "bucket")
        if i + 1 == len(ROUNDS) or (full := materialize(full)).isEmpty():
            parts.append(mined(held, LONGEST, depth, least))
            break
        parts.append(mined(held.join(full, ["lang", "bucket"], "left_anti"), LONGEST, depth, least))
        # buckets of different old ones may meet, prefixes never part
        left = materialize(dealt_again(held.join(full, ["lang", "bucket"], "left_semi"), LONGEST, ROUNDS[i + 1], bits if ROUNDS[i + 1] == depth else 0, AGAIN_BITS, depth))
        parts.append(left.where("bucket is null").groupBy("lang", "words").agg(F.sum("n").alias("a")).where(F.col("a") >= least))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def frequent_phrases(docs: DataFrame, least: int = LEAST, bucket_pointers: int = BUCKET_POINTERS, task_pointers: int = TASK_POINTERS) -> tuple[DataFrame, DataFrame]:
    """(words, phrases) of docs (lang, text without nulls): WORD for all words, PHRASE for the phrases of 2 to 5 words with at least `least` occurrences."""
    words, seed = frequent_words(docs, least)
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    bits = pow2_at_least(total / bucket_pointers).bit_length() - 1
    pairs = frequent_pairs(docs, words, seed, least, bits)
    return words, materialize(pairs.unionByName(longer_phrases(docs, pairs, seed, least, bits, task_pointers)))


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, share: int = 100, most: int = MOST, **tuning: int) -> DataFrame:
    """The first `most` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase is 2 to 5 words in a row that occur at least `least` times; its score is that of its weakest
    cut into two. Phrases inside a longer one with at least `share` % of their occurrences are left out. Texts
    are lower-cased (A-Z) and used whole; null texts and texts without words say nothing, a null language
    counts as `und`, repeated rows count each. Ties go by occurrences, then by the phrase's bytes. Other
    columns are ignored; an empty table gives no rows.
    """
    plain = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull())
    words, phrases = frequent_phrases(plain, least, **tuning)
    often = words.where(F.col("n") >= least)
    parts = materialize(phrases.unionByName(often.select("lang", F.array("id").alias("words"), F.col("n").alias("a"))))
    size = F.size("words")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1))).withColumns({"left": F.slice("words", F.lit(1), F.col("k")), "right": F.slice("words", F.col("k") + 1, size - F.col("k"))})
    for side, n in (("left", "l"), ("right", "r")):
        cuts = cuts.join(parts.select("lang", F.col("words").alias(side), F.col("a").alias(n)), ["lang", side])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    scored = cuts.join(totals, "lang").withColumns({"up": F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n"), "down": wide("l") * wide("r")}).withColumn("score", F.expr("up div down"))
    weakest = scored.groupBy("lang", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "words", "a", "n", "cut.score", "cut.l", "cut.r")
    # if a longer phrase covers one, so does each phrase between the two: one word longer is enough to look at
    inner = F.explode(F.array(F.slice("words", F.lit(1), size - 1), F.slice("words", F.lit(2), size - 1)))
    longer = phrases.where(size > 2).select("lang", inner.alias("words"), F.col("a").alias("longer")).groupBy("lang", "words").agg(F.max("longer").alias("longer"))
    kept = weakest.join(longer, ["lang", "words"], "left").where(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True))).drop("longer")
    # first in slices of a language, so that no task ranks all its phrases
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("words"), F.lit(SALTS)))
    some = Window.partitionBy("lang", "salt").orderBy(F.desc("score"), F.desc("a"))
    near = materialize(salted.withColumn("rank", F.rank().over(some)).where(F.col("rank") <= most).drop("rank"))
    spelt = near.select("lang", "words", F.posexplode("words").alias("pos", "id")).join(often.select("lang", "id", "word"), ["lang", "id"])
    spelt = spelt.groupBy("lang", "words").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    named = near.join(spelt, ["lang", "words"])
    order = [F.desc("score"), F.desc("a"), "phrase"]
    first = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= most)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
