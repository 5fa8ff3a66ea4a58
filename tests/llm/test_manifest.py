"""Manifest, best-fit packing and phrases against plain Python."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskweave.llm import manifest_queries, merkle, phrases, slack_packing
from riskweave.llm.textblocks import fold

from .data import documents, frame, sentence

LEAF = manifest_queries.LEAF


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, lower=False):
    values = dict(zip(("doc_id", "text", "lang", "source", "n_chars"), row, strict=False))
    if lower and values["text"]:
        values["text"] = re.sub("[A-Z]", lambda m: m[0].lower(), values["text"])
    return sha(*("-" if values[c] is None else f"{len(str(values[c]).encode())}:{values[c]}" for c in LEAF))


def climb(nodes):
    """All levels of a tree, from its leaves to its top."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def steps(levels, i):
    for level in levels[:-1]:
        run = i // 8 * 8
        yield "".join(level[run:i]), "".join(level[i + 1 : run + 8])
        i //= 8


def plain_proofs(rows):
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, plain_leaf(r), r))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: climb([x[2] for x in sorted(langs[lang], key=lambda x: x[:3])]) for lang in order}
    crown = climb([trees[lang][-1][0] for lang in order])
    root = crown[-1][0] if order else None
    out = []
    for k, lang in enumerate(order):
        for i, (_, _, leaf, r) in enumerate(sorted(langs[lang], key=lambda x: x[:3])):
            path = [*steps(trees[lang], i), *steps(crown, k)]
            x = plain_leaf(r, lower=r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0)
            for a, b in path:
                x = sha(a, x, b)
            out.append((r[0], leaf, trees[lang][-1][0], root, sha(*(a + b for a, b in path)), x, x == root))
    return sorted(out, key=str)


def many(n, langs):
    rng = random.Random(n)
    return [(i, sentence(rng, 4).title() if i % 5 else sentence(rng, 4), langs[min(i % 7, len(langs) - 1)], "s", i) for i in rng.sample(range(3 * n), n)]


@pytest.mark.parametrize("rows", [documents()[:20], documents(), many(1, ["en"]), many(8, ["en"]), many(9, [None]), many(700, ["en", None, "é", "zz"]), many(90, [f"l{i}" for i in range(7)])], ids=["few", "odd", "one", "run", "nine", "pieces", "langs"])
def test_manifest_equals_plain(spark, rows, monkeypatch):
    monkeypatch.setattr(merkle, "LEAVES_A_PIECE", 50)  # pieces whose edges are not aligned
    monkeypatch.setattr("riskweave.llm.manifest_queries.table", lambda *_: spark.createDataFrame([r[:5] + ("x",) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, digest string").repartition(3))
    got = manifest_queries.op11_merkle_manifest(spark, "").collect()
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r[c] for c in names) for r in got), key=str) == plain_proofs(rows)


def test_manifest_of_nothing_and_records(spark):
    rows = spark.createDataFrame([r[:5] for r in many(300, ["en"])], "doc_id long, text string, lang string, source string, n_chars long")
    assert merkle.proofs(merkle.manifest(rows.limit(0), LEAF)).count() == 0
    made = merkle.manifest(rows, LEAF)
    levels = climb([x[1] for x in sorted((r["doc_id"], plain_leaf((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]))) for r in rows.collect())])
    want = {("=en", h, i, x) for h, level in enumerate(levels) if h for i, x in enumerate(level)}
    assert {(r["part"], r["level"], r["idx"], r["digest"]) for r in made.nodes().where("level > 0").collect()} == want
    assert merkle.proofs(made).where("not verified").count() == 0  # without claims each leaf proves itself


def test_mountains_in_any_pieces():
    leaves = [sha(str(i)) for i in range(75)]
    levels = climb(leaves)
    import pyarrow as pa

    batch = lambda a, b: pa.record_batch([pa.array(["p"] * (b - a)), pa.array([75] * (b - a)), pa.array(range(a, b)), pa.array(leaves[a:b])], names=["part", "n", "idx", "digest"])
    got = [r for b in merkle.mountains(iter([batch(40, 75), batch(3, 5), batch(5, 40)])) for r in b.to_pylist()]
    assert all(r["digest"] == levels[r["level"]][r["idx"]] for r in got)
    assert {(r["level"], r["idx"]) for r in got if not r["open"]} == set()  # no piece has a whole run of runs
    assert {r["idx"] for r in got if r["level"] == 1} == set(range(1, 9))


# packing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 14), st.integers(1, 3), min_size=1, max_size=4), st.integers(14, 40))
def test_fullest_is_fullest(left, capacity):
    items = [x for x, n in left.items() for _ in range(n)]
    best = max(sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k) if sum(c) <= capacity)
    got = slack_packing.fullest(left, capacity)
    assert sum(got) == best and not Counter(got) - Counter(items) and got == sorted(got, reverse=True)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=80))
def test_plan_packs_each_piece_once(lengths):
    bins = slack_packing.best_plan(dict(Counter(lengths)), 60)
    assert sum((Counter({x: n * c for x, c in Counter(b).items()}) for n, b in bins), Counter()) == Counter(lengths)
    assert all(sum(b) <= 60 for _, b in bins)
    assert sum(n for n, _ in bins) <= max(1, 2 * sum(lengths) / 60 + 1)


@pytest.mark.parametrize("capacity", [16, 1024])
def test_best_fit_packing_round_trip(spark, capacity):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    odd = [(900 + i, t) for i, t in enumerate(["a  b", "　  x", " a", "a ", "\n\n a\t\tb 's don't  <|endoftext|> x<|endoftext|>  y", "z\x85 q\xa0  w", "a\x1c b", "1 2  33\r\n\r\n x"])]
    rows = [(r[0], r[1], *r[2:]) for r in documents()] + [(i, t, *(None,) * 9) for i, t in odd]
    docs = frame(spark, rows).repartition(3).withColumnRenamed("sha", "length").withColumnRenamed("tokens", "task")
    for ranks in ((P.path("byte_bpe_50k.tiktoken"), P.PATTERN), (None, "")):
        got = slack_packing.pack_full(docs, P.path("byte_bpe_50k.json"), *ranks, capacity=capacity).collect()
        want = Counter()
        for doc_id, text, *_ in rows:
            ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
            for i, (a, m) in enumerate(slack_packing.cut(len(ids), capacity)):
                want[(doc_id, i, a, m, zlib.crc32(ids[a : a + m].tobytes()))] += 1
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
        bins = {}
        for r in got:
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for pieces in bins.values():
            ends = 0
            for offset, length in sorted(pieces):
                assert offset == ends
                ends += length
            assert ends <= capacity
        least = -(-sum(r["length"] for r in got) // capacity)
        assert least <= len(bins) <= 1.1 * least + 1
    assert slack_packing.pack_full(docs.limit(0), P.path("byte_bpe_50k.json")).count() == 0


# phrases


def plain_phrases(rows, least, share=100, most=2000):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, 6):
                for i in range(len(words) - m + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + m])] += 1
    out = set()
    for lang, f in counts.items():
        kept = []
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items()):
                continue
            score, _, left, right = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:most], 1):
            out.add((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return out


def prose(seed, n):
    rng = random.Random(seed)
    vocabulary = ["aa", "Bb", "cc", "dd", "ée", "wordlongerthaneight", "wordlongerthanNine"]
    rows = [(rng.choice(["en", "en", None, "de"]), " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ".", "\n", " \t"]) for _ in range(rng.randint(0, 40)))) for _ in range(n)]
    return rows + [("en", "the same hot words again and again " * 60), ("en", "x " * 300), ("en", None), (None, ""), ("en", " \t.,;")] + rows[:3]


@pytest.mark.parametrize("tuning", [{}, {"bucket_pointers": 300, "task_pointers": 40}, {"bucket_pointers": 1 << 20, "task_pointers": 1}], ids=["plain", "deals", "deepest"])
def test_phrases_equal_plain(spark, tuning):
    rows = prose(1, 60)
    docs = spark.createDataFrame([(*r, 1, "w") for r in rows], "lang string, text string, n int, words string").repartition(3)
    got = phrases.collocations(docs, least=8, **tuning).collect()
    assert {tuple(r) for r in got} == plain_phrases(rows, 8)
    assert len(got) == len({tuple(r) for r in got}) > 30


def test_phrases_share_most_and_nothing(spark):
    rows = prose(2, 40)
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert {tuple(r) for r in phrases.collocations(docs, least=5, share=80, most=7).collect()} == plain_phrases(rows, 5, 80, 7)
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_two_deals_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(phrases, "MAX_BUCKET_BITS", 2)
    rows = prose(3, 40)
    got = phrases.collocations(spark.createDataFrame(rows, "lang string, text string").repartition(2), least=6, bucket_pointers=64, task_pointers=30).collect()
    assert {tuple(r) for r in got} == plain_phrases(rows, 6)


def test_second_deal_of_pairs_parts_their_buckets(spark, monkeypatch):
    """By the one further bit alone there would be two buckets a language, whatever the size."""
    monkeypatch.setattr(phrases, "MAX_BUCKET_BITS", 3)
    seen = []
    monkeypatch.setattr(phrases, "mined", lambda b, *a, f=phrases.mined: seen.append(b.select("bucket").distinct().count()) or f(b, *a))
    docs = spark.createDataFrame([("en", f"a{i} b{i} c{i}") for i in range(40)] * 2, "lang string, text string").repartition(2)
    words, seed = phrases.frequent_words(docs, 2)
    pairs = phrases.frequent_pairs(docs, words, seed, 2, 4)
    assert pairs.count() == 80 and seen[0] > 8


def test_words_that_share_an_id_take_another_seed(spark, monkeypatch):
    real = phrases.fold
    monkeypatch.setattr(phrases, "fold", lambda data, starts, lens, seed=0: lens.astype(np.uint64) if seed == 0 else real(data, starts, lens, seed))
    found, texts = [], ["aa bb cc dd", "aa bb cc"] * 4
    docs = spark.createDataFrame([("en", t) for t in texts], "lang string, text string")
    monkeypatch.setattr(phrases, "count_words", lambda d, seed, f=phrases.count_words: found.append(seed) or f(d, seed))
    from pyspark import cloudpickle  # the patched module's functions go to the tasks by value

    cloudpickle.register_pickle_by_value(phrases)
    try:
        words, seed = phrases.frequent_words(docs, 4)
        assert found == [0, 2] and seed == 2
        assert {(r["word"], r["n"]) for r in words.collect()} == {("aa", 8), ("bb", 8), ("cc", 8), ("dd", 4)}
    finally:
        cloudpickle.unregister_pickle_by_value(phrases)


def test_fold_tells_words_apart():
    def thue(n, flip):
        return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n)).encode()

    words = [thue(2**k, f) for k in range(12) for f in (0, 1)] + [b"", b"\0", b"\0\0", b"a" * 8, b"a" * 9, b"a" * 16] + [str(i).encode() for i in range(20000)]
    starts = np.cumsum([0, *map(len, words)])[:-1]
    lens = np.array(list(map(len, words)))
    data = np.frombuffer(b"".join(words), np.uint8)
    assert len(set(fold(data, starts, lens).tolist())) == len({*words})


def test_half_a_surrogate_pair_is_no_record(spark):
    from riskweave.llm import chat_format

    half, whole = "\\ud800", "\\ud83d\\ude00"
    raw = [f'{{"prompt": "{half}", "response": "a"}}', f'{{"messages": [{{"role": "{half}", "content": "a"}}]}}', f'{{"{half}": 1}}', f'{{"prompt": "{whole}", "response": "b"}}', f'{{"prompt": "\\\\{half[1:]}", "response": "c"}}']
    records = spark.createDataFrame(list(enumerate(raw)), "conv_id long, record string").repartition(2)
    got = {r["conv_id"]: r["layout"] for r in chat_format.format_chats(records).collect()}
    assert got == {0: None, 1: None, 2: None, 3: "prompt", 4: "prompt"}


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op13_phrases"])
def test_registered_query_equals_its_sql(spark, name):
    import os

    import duckdb

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    got = manifest_queries.queries()[name](spark, sf).toPandas()
    want = con.execute(manifest_queries.oracle_sql()[name]).df()
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    assert sorted(map(tuple, got[names].astype(str).values)) == sorted(map(tuple, want[names].astype(str).values))


def test_registered_packing(spark):
    import os

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    out = manifest_queries.op12_best_fit_packing(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert out.select("doc_id").distinct().count() == docs.count()
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
