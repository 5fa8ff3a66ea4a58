"""N-gram Jaccard join with token-combination prefixes.

A document's set holds its distinct word shingles as 64-bit hashes; two documents link when
100 * |A and B| >= percent * |A or B|. Steps:

1. Count shingles over all texts. Each task sorts its shingles and sends them as packed 32-bit
   residues to hash buckets; a bucket returns two bit arrays of fixed total size: shingles counted at
   least twice, and more than `frequent` times. A set bit that is wrong (a collision) only moves a
   shingle to a more frequent class; classes need not be right, only the same everywhere.
2. Order each set by (unique, repeated, frequent; hash). With o = ceil(percent * n / 100), linked sets
   share at least 1 + B shingles among the first n - o + 1 + B of either. A repeated shingle in that
   prefix is a signature by itself; frequent ones are dealt to B subclasses, and each pair within a
   subclass is a signature: 1 + B shared shingles leave a shared rare one or two of one subclass. B
   grows with the set size (one B per band of sizes that can link), so a set has about as many
   signatures as shingles however frequent these are. Unique shingles need no signature.
3. Sets that share a signature are candidates. Per signature all are verified against two leaders;
   then whatever shares a signature and is still not connected is verified too: pair by pair where few
   sets share it, else each such set against indexed blocks of the others. No connection is lost, and
   a large group of near copies costs a few comparisons a member, not all pairs.
4. Components of the verified links. Equal texts are read once, equal sets count as one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, pow2_at_least, text_bytes, tidy
from .components import connected_components
from .exact_dedup import possibly_repeated, repeat_filter
from .textblocks import U64, mix, shingle_sets

FREQUENT = 32  #: a shingle counted more often is indexed in combinations
MAX_BITS = 27  #: log2 of the size of each bit array: 16 MB at most
FLUSH = 1 << 19
SMALL_BUCKET = 16  #: sets of a signature up to which all its unconnected pairs are listed
BLOCK_TOKENS, BLOCK_QUERIES = 200_000, 1000
_SOLO, _SUB, _SET = U64(0x51ED270B9F2B5A1D), U64(0x2545F4914F6CDD1D), U64(0x9FB21C651E98DF25)


def _levels(limit: int = 1 << 40, percent: int = 75) -> np.ndarray:
    """Bounds of size levels; sets that can link are at most one level apart."""
    bounds = [1]
    while bounds[-1] < limit:
        bounds.append(bounds[-1] * 100 // percent + 1)
    return np.array(bounds, dtype=np.int64)


def count_shingles(docs: DataFrame, text: str, width: int, bucket_bits: int, bitmap_bits: int, frequent: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bit arrays of 2**bitmap_bits bits over the top bits of the hash: counted twice or more, counted more than `frequent` times."""
    low = U64(32 - bucket_bits)

    def packed(parts: list[np.ndarray]) -> pa.RecordBatch:
        x = np.sort(np.concatenate(parts) >> low)  # bucket and a residue of 32 bits
        head = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
        counts = np.diff(np.append(head, len(x))).astype(np.uint32)
        x = x[head]
        cut = np.searchsorted(x, np.arange((1 << bucket_bits) + 1, dtype=U64) << U64(32))
        full = np.flatnonzero(np.diff(cut))
        keys, more = [], []
        for k in full:
            c = counts[cut[k] : cut[k + 1]]
            many = np.flatnonzero(c > 1).astype(np.uint32)
            keys.append((x[cut[k] : cut[k + 1]] & U64(0xFFFFFFFF)).astype(np.uint32).tobytes())
            more.append(np.concatenate([many, c[many]]).tobytes())
        return pa.record_batch([pa.array(full, pa.int64()), pa.array(keys, pa.binary()), pa.array(more, pa.binary())], names=["bucket", "keys", "more"])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            for s in shingle_sets(batch.column(0), width):
                parts.append(s)
                n += len(s)
                if n >= FLUSH:
                    yield packed(parts)
                    parts, n = [], 0
        if n:
            yield packed(parts)

    def merged(rows: pa.Table) -> pa.Table:
        keys, counts = [], []
        for k, m in zip(rows["keys"], rows["more"], strict=True):
            k, m = np.frombuffer(k.as_py(), np.uint32), np.frombuffer(m.as_py(), np.uint32)
            c = np.ones(len(k), np.int64)
            c[m[: len(m) // 2]] = m[len(m) // 2 :]
            keys.append(k)
            counts.append(c)
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        total = np.add.reduceat(counts[order], head)
        at = keys[head] >> np.uint32(32 - (bitmap_bits - bucket_bits))
        out = []
        for least in (2, frequent + 1):
            bits = np.zeros(1 << (bitmap_bits - bucket_bits), bool)
            bits[at[total >= least]] = True
            out.append(np.packbits(bits).tobytes())
        return pa.table({"bucket": pa.array([rows["bucket"][0].as_py()], pa.int64()), "twice": pa.array([out[0]], pa.binary()), "often": pa.array([out[1]], pa.binary())})

    parts = docs.select(text).mapInArrow(tidy(local), "bucket long, keys binary, more binary")
    size = 1 << (bitmap_bits - bucket_bits - 3)
    arrays = [np.zeros(1 << (bitmap_bits - 3), np.uint8) for _ in range(2)]
    for row in parts.groupBy("bucket").applyInArrow(merged, "bucket long, twice binary, often binary").toLocalIterator(prefetchPartitions=True):
        for array, got in zip(arrays, (row["twice"], row["often"]), strict=True):
            array[row["bucket"] * size : (row["bucket"] + 1) * size] = np.frombuffer(got, np.uint8)
    return arrays[0], arrays[1]


def signatures(tokens: np.ndarray, kind: np.ndarray, bounds: np.ndarray, percent: int) -> np.ndarray:
    """Signatures of one sorted set. kind: 0 unique, 1 repeated, 2 frequent."""
    n = len(tokens)
    level = int(np.searchsorted(bounds, n, side="right")) - 1
    base = n - -(-percent * n // 100) + 1
    bands = [(j, max(1, int(bounds[max(0, j - 1)]) // 16)) for j in (level, level + 1)]
    n_unique = int(np.count_nonzero(kind == 0))
    longest = min(n, base + bands[1][1])
    if n_unique >= longest:
        return np.empty(0, U64)
    rare = tokens[kind == 1][: longest - n_unique]
    out = [mix(rare ^ _SOLO)]
    frequent = tokens[kind == 2]
    before = n - len(frequent)
    for j, b in bands:
        f = frequent[: max(0, min(n, base + b) - before)]
        if len(f) < 2:
            continue
        group = (mix(f ^ _SUB) % U64(b)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        f, group = mix(f[order] + U64(j)), group[order]
        ends = np.searchsorted(group, group, side="right")
        many = ends - np.arange(len(f)) - 1  # later members of the same subclass
        i = np.repeat(np.arange(len(f)), many)
        k = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
        out.append(mix(f[i] * _SUB + f[k]))
    return np.unique(np.concatenate(out))


def shingled(texts: DataFrame, width: int, percent: int, bitmap_bits: int, bitmaps: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(sha, n, ckey, sigs, tokens) of (sha, text): sigs and tokens only where a set has signatures and is the first of its class in its task."""
    held = texts.sparkSession.sparkContext.broadcast(bitmaps)
    schema = pa.schema([("sha", pa.binary()), ("n", pa.int64()), ("ckey", pa.int64()), ("sigs", pa.list_(pa.int64())), ("tokens", pa.binary())])
    bounds = _levels(percent=percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice, often = held.value
        seen: set[int] = set()
        shift = U64(64 - bitmap_bits)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows: list[tuple] = []
            size = 0
            for doc, s in zip(ids, shingle_sets(batch.column(1), width), strict=True):
                n = len(s)
                key = int((np.sum(mix(s ^ _SET), dtype=U64) + U64(n)).view(np.int64)) if n else 0
                sigs = tokens = None
                if n >= 3 and key not in seen:
                    seen.add(key)
                    at = (s >> shift).astype(np.int64)
                    byte, bit = at >> 3, (7 - (at & 7)).astype(np.uint8)
                    kind = ((twice[byte] >> bit) & 1) + ((often[byte] >> bit) & 1)
                    got = signatures(s, kind, bounds, percent)
                    if len(got):
                        sigs, tokens = got.view(np.int64), s.tobytes()
                        size += got.nbytes + s.nbytes
                rows.append((doc, n, key, sigs, tokens))
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return texts.select("sha", "text").mapInArrow(tidy(run), "sha binary, n long, ckey long, sigs array<long>, tokens binary")


def verified(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose sets pass the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                z = np.sort(np.concatenate([x, y]), kind="stable")
                both = int(np.count_nonzero(z[1:] == z[:-1]))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = tokens.select(F.col("ckey").alias("b"), F.col("tokens").alias("y"))
    right = tokens.select(F.col("ckey").alias("a"), F.col("tokens").alias("x"))
    return pairs.join(left, "b").join(right, "a").select("a", "b", "x", "y").mapInArrow(tidy(run), "a long, b long")


def distinct_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc_id, sha) of every row, (sha, text) once a text). Only texts that a Bloom filter calls possibly repeated shuffle.

    The texts are written once: both passes over them then run one Python worker a task and probe nothing again.
    """
    body = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", body.alias("text"), F.unhex(F.sha2(body.cast("binary"), 256)).alias("sha"), F.xxhash64(body).alias("h"))
    rows = materialize(docs.select("doc_id", "sha", "h"))
    docs = docs.withColumn("again", possibly_repeated(docs, "h", repeat_filter(rows, "h", rows.count())))
    again = docs.where("again").groupBy("sha").agg(F.first("text").alias("text"))
    return rows.select("doc_id", "sha"), materialize(docs.where("not again").select("sha", "text").union(again))


def signature_rows(table: DataFrame) -> DataFrame:
    """(sig, ckey, n) of every signature that at least two sets have, partitioned by signature."""
    rows = table.where("sigs is not null").select(F.explode("sigs").alias("sig"), "ckey", "n").repartition("sig").distinct()
    return rows.withColumn("members", F.count("*").over(Window.partitionBy("sig"))).where("members > 1").select("sig", "ckey", "n")


def leader_pairs(members: DataFrame, seeds: tuple[int, ...], percent: int) -> DataFrame:
    """Distinct pairs (a, b) of a signature's leaders, its first sets by seeded hashes, with its other sets, where sizes allow a link."""
    rows, w = members, Window.partitionBy("sig")
    for seed in seeds:
        rows = rows.withColumn(f"lead{seed}", F.min(F.struct(F.xxhash64(F.lit(seed), "ckey"), F.col("ckey").alias("a"), F.col("n").alias("na"))).over(w))
    pairs = rows.select("ckey", "n", F.explode(F.array(*(f"lead{s}" for s in seeds))).alias("x")).select("x.*", "ckey", "n")
    pairs = pairs.where("a <> ckey").where(F.least("na", "n") * 100 >= F.greatest("na", "n") * percent)
    return pairs.select(F.least("a", "ckey").alias("a"), F.greatest("a", "ckey").alias("b")).distinct()


def family_links(rows: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between sets of different labels in the same large bucket; one for each set and label it links to.

    rows: (sig, ckey, n, label). Sets that share buckets, directly or by others, form a family. All sets
    of a family but those of its most frequent label are looked up in all its sets, which are dealt to
    blocks of bounded size with an index of their shingles. So a family of near copies meets as queries
    times blocks, not as pairs.
    """
    head = rows.groupBy("sig").agg(F.min("ckey").alias("b"))
    family = connected_components(rows.select("sig", F.col("ckey").alias("a")).join(head, "sig").select("a", "b").distinct())
    sets = materialize(rows.select("ckey", "n", "label").distinct().join(family.withColumnRenamed("node", "ckey").withColumnRenamed("component", "family"), "ckey"))
    top = sets.groupBy("family", "label").agg(F.count("*").alias("k")).groupBy("family").agg(F.max(F.struct("k", "label")).alias("x")).select("family", F.col("x.label").alias("top"))
    size = sets.join(top, "family").groupBy("family", "top").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).cast("long").alias("blocks"), F.ceil(F.count_if(F.col("label") != F.col("top")) / BLOCK_QUERIES).cast("long").alias("lots"))
    full = sets.join(size, "family").join(tokens, "ckey")
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    lots = F.pmod(F.xxhash64(F.lit("lot"), "ckey"), F.col("lots"))
    blocks = F.pmod(F.xxhash64(F.lit("block"), "ckey"), F.col("blocks"))
    full = full.where("lots > 0")
    target = full.withColumn("block", blocks).withColumn("lot", span("lots")).select("family", "block", "lot", "ckey", "label", "tokens")
    query = full.where("label <> top").withColumn("lot", lots).withColumn("block", span("blocks"))
    query = query.select(*(F.col(c).alias(f"q_{c}") for c in ("family", "block", "lot", "ckey", "label", "tokens")))

    def look_up(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        if left.num_rows and right.num_rows:
            sets = [np.frombuffer(x.as_buffer(), U64) for x in left["tokens"]]
            ids, labels = left["ckey"].to_numpy(), left["label"].to_numpy()
            lens = np.array([len(x) for x in sets])
            flat = np.concatenate(sets)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], np.repeat(np.arange(len(sets)), lens)[order]
            for a, label, x in zip(right["q_ckey"].to_pylist(), right["q_label"].to_pylist(), right["q_tokens"], strict=True):
                x = np.frombuffer(x.as_buffer(), U64)
                lo, hi = np.searchsorted(flat, x, side="left"), np.searchsorted(flat, x, side="right")
                many = hi - lo
                at = np.repeat(hi - np.cumsum(many), many) + np.arange(many.sum())
                both = np.bincount(owner[at], minlength=len(sets))
                hit = np.flatnonzero((100 * both >= percent * (lens + len(x) - both)) & (labels != label))
                _, one = np.unique(labels[hit], return_index=True)
                found += [(a, int(ids[i])) for i in hit[one]]
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    keys = ["family", "block", "lot"]
    return target.groupBy(*keys).cogroup(query.groupBy(*(f"q_{c}" for c in keys))).applyInArrow(look_up, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75, frequent: int = FREQUENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    Null, empty and white-space texts have n_shingles 0 and are linked with nothing: component_id is
    their own doc_id. A null doc_id is no component_id unless no member of the component has another.
    Repeated rows stay repeated. Other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows, texts = distinct_texts(docs)
    scale = text_bytes(docs)
    bitmap_bits = min(MAX_BITS, max(16, pow2_at_least(scale).bit_length() - 1))
    bucket_bits = min(20, bitmap_bits - 3, max(4, pow2_at_least(scale / (4 << 20)).bit_length() - 1))
    bitmaps = count_shingles(texts, "text", width, bucket_bits, bitmap_bits, frequent)
    table = materialize(shingled(texts, width, percent, bitmap_bits, bitmaps))
    members = materialize(signature_rows(table))
    tokens = table.where("tokens is not null").join(members.select("ckey").distinct(), "ckey", "left_semi").groupBy("ckey").agg(F.first("tokens").alias("tokens"))

    pairs = materialize(leader_pairs(members, (1, 2), percent))
    links = materialize(verified(pairs, tokens, percent))
    label = materialize(members.select("ckey", "n").distinct().join(connected_components(links).withColumnRenamed("node", "ckey"), "ckey", "left").select("ckey", "n", F.coalesce("component", "ckey").alias("label")))
    w = Window.partitionBy("sig")
    unsettled = members.select("sig", "ckey").join(label, "ckey").withColumn("lo", F.min("label").over(w)).withColumn("hi", F.max("label").over(w)).withColumn("size", F.count("*").over(w)).where("lo < hi")
    unsettled = materialize(unsettled.select("sig", "ckey", "n", "label", "size"))
    few = unsettled.where(F.col("size") <= SMALL_BUCKET)
    left = few.select("sig", F.col("ckey").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"))
    right = few.select("sig", F.col("ckey").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"))
    more = left.join(right, "sig").where("a < b and la <> lb").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    more = materialize(more.select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti"))
    links = links.union(verified(more, tokens, percent)).union(family_links(unsettled.where(F.col("size") > SMALL_BUCKET), tokens, percent))
    label = connected_components(links)

    out = rows.join(table.select("sha", "n", "ckey"), "sha").join(label.withColumnRenamed("node", "ckey"), "ckey", "left").withColumn("group", F.coalesce("component", "ckey"))
    out = materialize(out.select("doc_id", "n", "group"))
    first = materialize(out.where("n > 0").groupBy("group").agg(F.min("doc_id").alias("component_id")))  # a table, so that the join can split a large group
    out = out.join(first, "group", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
