import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskweave.llm import chat_format, language_id, mixing, quality_lm, toxicity
from riskweave.llm.exact_dedup import deduplicate, drop_ids, exact_duplicates
from riskweave.llm.jaccard_join import near_duplicates
from riskweave.llm.line_dedup import deduplicate_lines, patience_blocks, shared_positions
from riskweave.llm.packing import ChunkEncoder, pack
from riskweave.llm.queries import TARGET, word_bpe
from riskweave.llm.terms import labelled_sample
from riskweave.llm.topk_search import top_k

from .data import SCHEMA, documents, frame, near_components, sentence

LABELS = "doc_id long, quality int, toxic int"


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def vectors(seed, n, dim):
    rng = random.Random(seed)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(dim)], "x", 1) for i in range(n)]
    rows += [(n, rows[5][1], "x", 1), (n + 1, rows[5][1], "x", 1), (7, rows[7][1], "x", 1)]  # ties, a repeated row
    odd = [None, [None] * dim, [math.nan] * dim, [math.inf] * dim, [0.5] * (dim + 1), []]
    return rows + [(n + 10 + i, v, None, None) for i, v in enumerate(odd)] + [(None, rows[0][1], None, None)]


@pytest.mark.parametrize("scale", [1024.0, 2.0**29])
def test_topk_equals_brute_force(spark, scale):
    rows = vectors(1, 300, 6)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, ids string, score int").repartition(3)
    got = top_k(table, table.where("vec_id % 50 = 0"), k=10, scale=scale)
    good = [(i, [math.floor(scale * x) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    for q, v in good:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v))
            want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best[:10])}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows_of(got)} == want


def test_topk_few_and_none(spark):
    table = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["rank"], r["vec_id"]) for r in rows_of(top_k(table, table.where("vec_id = 0")))}
    assert got == {(0, 1, 1), (0, 2, 2)}
    assert top_k(table.limit(0), table.limit(0)).count() == 0


def test_exact_duplicates(spark):
    rows = documents()
    got = rows_of(exact_duplicates(frame(spark, rows)))
    by = {}
    for r in rows:
        by.setdefault(r[1] or "", []).append(r[0])
    top = {t: max(ids, key=lambda i: -1 if i is None else i) for t, ids in by.items()}
    want = sorted((str(r[0]), str(top[r[1] or ""]), len(by[r[1] or ""]), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows)
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(by)
    kept = deduplicate(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept.collect()) == sorted((str(top[t]), t) for t in by)
    assert exact_duplicates(frame(spark, [])).count() == deduplicate(frame(spark, [])).count() == 0


def test_drop_ids(spark):
    docs = frame(spark, documents())
    left = drop_ids(docs, spark.createDataFrame([(0,), (3,), (3,), (None,)], "doc_id long"))
    assert {r["doc_id"] for r in left.collect()} == {r[0] for r in documents()} - {0, 3}


def test_near_duplicates_equal_brute_force(spark):
    rows = documents()
    rng = random.Random(4)
    for k in range(40):  # chains of ever more different copies
        words = (rows[-1][1] if k % 10 else sentence(rng, 70)).split()
        words[rng.randrange(len(words))] = f"y{k}"
        rows.append((1000 + k, " ".join(words), *rows[0][2:]))
    got = rows_of(near_duplicates(frame(spark, rows)))
    component, sizes = near_components([r[1] for r in rows])
    ids = {}
    for r, c in zip(rows, component, strict=True):
        ids.setdefault(c, []).append(r[0])
    want = []
    for r, c, n in zip(rows, component, sizes, strict=True):
        known = [i for i in ids[c] if i is not None]
        want.append((str(r[0]), n, str(r[0] if not n else min(known) if known else None)))
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == sorted(want)


@pytest.mark.parametrize("small, frequent", [(0, 1), (16, 1), (2, 32)])
def test_near_duplicates_by_either_path(spark, monkeypatch, small, frequent):
    """Every shingle frequent, every bucket large: the same components."""
    monkeypatch.setattr("riskweave.llm.jaccard_join.SMALL_BUCKET", small)
    rows = [r for r in documents(3) if r[0] is not None]
    got = {r["doc_id"]: r["component_id"] for r in rows_of(near_duplicates(frame(spark, rows), frequent=frequent))}
    component, sizes = near_components([r[1] for r in rows])
    assert got == {r[0]: rows[c][0] if n else r[0] for r, c, n in zip(rows, component, sizes, strict=True)}


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates(frame(spark, [])).count() == 0


def test_patience_blocks():
    old, new = np.array([1, 2, 3, 4, 5, 6]), np.array([9, 2, 3, 4, 8, 6, 1])
    assert patience_blocks(old, new, np.ones(7, bool)).tolist() == [1, 2, 3, 5]
    assert patience_blocks(old, new, np.zeros(7, bool)).tolist() == []


def test_blocks_between_anchors_and_moved_lines():
    every = lambda x: np.ones(len(x), bool)
    old, new = np.array([1, 7, 2, 7, 3]), np.array([1, 7, 9, 2, 8, 7, 3])
    assert patience_blocks(old, new, every(new)).tolist() == [0, 1, 3, 5, 6]
    old, new = np.array([5, 5, 6]), np.array([5, 9, 5, 9, 5])
    assert patience_blocks(old, new, every(new)).tolist() == [0, 2]
    assert shared_positions(old, new, every(new)).tolist() == [0, 2, 4]
    old, new = np.array([1, 2, 3, 4]), np.array([3, 4, 9, 1, 2])
    assert shared_positions(old, new, np.array([1, 0, 0, 1, 0], bool)).tolist() == [0, 1, 3, 4]


def test_no_long_line_of_an_earlier_document_stays(spark):
    """Every order, repeats on either side, lines of few and of many documents: what stays is in no earlier document."""
    rng = random.Random(6)
    lines = [sentence(rng, 7) + f" l{i}" for i in range(40)]
    texts = [[rng.choice(lines[: 6 if d % 3 else 40]) if rng.random() < 0.6 else rng.choice(["short one", f"only here of d{d} {rng.random()}"]) for _ in range(rng.randint(1, 14))] for d in range(60)]
    got = {r["doc_id"]: r for r in rows_of(deduplicate_lines(frame(spark, [(d, "\n".join(t), *documents()[0][2:]) for d, t in enumerate(texts)])))}
    seen = set()
    for d, t in enumerate(texts):
        long = [i for i, x in enumerate(t) if len(x.split()) >= 5]
        assert [i for i in got[d]["removed"] if i in long] == [i for i in long if t[i] in seen]
        seen |= set(t)
    assert {x for t in texts for x in t} == {x for r in got.values() for x in r["text"].split("\n")} - {""}


def test_line_dedup(spark):
    rng = random.Random(2)
    block = [sentence(rng, 9) + f" b{i}" for i in range(4)]
    own = [[sentence(rng, 8) + f" o{d}{i}" for i in range(5)] for d in range(6)]
    texts = {d: "\n".join(own[d][:2] + (block if d in (1, 3, 4) else []) + own[d][2:]) for d in range(6)}
    rows = [(d, t, None, None, None) for d, t in texts.items()] + [(7, None, None, None, None), (8, "", None, None, None), (None, texts[1], None, None, None), (0, texts[0], None, None, None)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, lines int, removed string")
    got = rows_of(deduplicate_lines(docs))
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] in (3, 4):
            assert r["text"] == "\n".join(own[r["doc_id"]]) and r["removed"] == [2, 3, 4, 5]
        elif r["doc_id"] is not None:
            assert r["text"] == texts.get(r["doc_id"], "" if r["doc_id"] == 8 else None) and r["removed"] == []
    assert deduplicate_lines(docs.limit(0)).count() == 0


def labelled(n=400, seed=5):
    """Documents of which a fifth are toxic and a tenth junk, with labels for half of them."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        toxic, junk = i % 5 == 0, i % 10 == 1
        words = [f"w{rng.randrange(3000)}" for _ in range(40)] if junk else sentence(rng, 40).split()
        if toxic:
            words[rng.randrange(40)] = "vileword"
        docs.append((i, " ".join(words), "en", "s", 1, "x", 1, 2, 0.5, True, "y"))
        if i % 4 < 2:
            labels.append((i, 0 if junk else 1, int(toxic)))
    return docs, labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled()
    docs += [(900, None, *docs[0][2:]), (901, "", *docs[0][2:]), (None, "vileword", *docs[0][2:])]
    model = toxicity.fit(frame(spark, docs), toxicity.grades_of(spark.createDataFrame([*labels, (None, 1, 1), (3, None, None), labels[0]], LABELS)))
    assert (np.diff(model.thresholds) > 0).all()
    got = {r["doc_id"]: r for r in rows_of(toxicity.severity(frame(spark, docs), model))}
    assert all(got[i]["toxic"] == (i % 5 == 0) for i in range(400) if i % 4 >= 2)
    assert len(got) == len(docs) and not got[900]["toxic"] and got[900]["expected_severity"] == got[901]["expected_severity"]
    assert got[None]["toxic"]


def test_labelled_sample_is_of_the_documents_there_are(spark):
    """Labels of absent documents take no place in the sample and no part in the counts."""
    docs = frame(spark, [r for r in documents() if r[0] is None or r[0] < 20])
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(5000)] + [(None, 1), (2, None), (3, 99), (10**6, 2)], "doc_id long, label int")
    sample, counts = labelled_sample(docs, labels, "label", 5)
    assert counts == {0: 14, 1: 5}  # 3's largest label is out of range
    by = {}
    for r in sample.collect():
        by.setdefault(r["label"], set()).add(r["doc_id"])
    assert len(by[0]) == 5 and by[1] == {0, 4, 8, 12, 16}
    assert labelled_sample(docs, labels.where("doc_id >= 20"), "label", 5)[1] == {}


def test_toxicity_without_labels_or_rows(spark):
    docs, _ = labelled(20)
    assert toxicity.fit(frame(spark, docs), toxicity.grades_of(spark.createDataFrame([], LABELS))) is None
    assert {r["expected_severity"] for r in rows_of(toxicity.severity(frame(spark, docs), None))} == {0.0}
    assert toxicity.severity(frame(spark, []), None).count() == 0


def test_ordinal_gradient():
    """The fit ends where the likelihood's numerical gradient vanishes."""
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 60)
    index = (y > 0).astype(np.int64) * rng.integers(0, 2, 60)
    w, theta = toxicity.fit_ordinal(y, np.arange(61), index, 2, np.ones(60), l2=0.0, steps=3000)

    def loss(w, theta):
        s = np.column_stack([np.ones(60), 1 / (1 + np.exp(-(w[index][:, None] - theta))), np.zeros(60)])
        return -np.log(s[np.arange(60), y] - s[np.arange(60), y + 1]).mean()

    best = loss(w, theta)
    assert all(loss(w + d, theta + e) >= best - 1e-5 for d in (-0.05, 0, 0.05) for e in (-0.05, 0, 0.05))


def test_language_id(spark):
    rng = random.Random(1)
    words = {"en": WORD_EN, "de": WORD_DE}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(20)), k, "s", 1, "x", 1, 2, 0.5, True, "y") for i in range(300) for k in [("en", "de")[i % 2]]]
    rows += [(900, None, "en", *rows[0][3:]), (901, "", "en", *rows[0][3:]), (902, "12 34 !", "en", *rows[0][3:]), (903, "the letters", None, *rows[0][3:]), (None, "und der", "de", *rows[0][3:]), rows[4]]
    docs = frame(spark, rows)
    got = rows_of(language_id.identify(docs, language_id.fit(docs)))
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        if r["doc_id"] in (900, 901, 902):
            assert r["lang_pred"] == "und"
        elif r["doc_id"] is not None and r["doc_id"] < 300:
            assert r["lang_pred"] == ("en", "de")[r["doc_id"] % 2]
    assert {r["lang_pred"] for r in rows_of(language_id.identify(docs, language_id.fit(docs.limit(0))))} == {"und"}
    assert language_id.identify(docs.limit(0), None).count() == 0


WORD_EN = "the quick brown fox jumps over lazy dogs while three ships sail through evening weather".split()
WORD_DE = "der schnelle braune fuchs springt über faule hunde während drei schiffe durch abendwetter segeln".split()


def test_backoff_to_shorter_ngrams():
    grams = {"^ab": 0, "b": 1}
    model = language_id.LanguageModel(["x", "y"], np.zeros(2), [], np.zeros((0, 2)), grams, np.array([[-1.0, -2.0], [-3.0, -1.0]]))
    assert language_id.backed_off("abc", model).tolist() == [-1.0, -2.0]
    assert language_id.backed_off("zb", model).tolist() == [-3.0, -1.0]
    assert language_id.backed_off("zz", model).tolist() == [0.0, 0.0]


def test_mixing_reaches_its_targets(spark):
    docs, labels = labelled()
    docs += [(900, None, *docs[0][2:]), (None, "river stone", *docs[0][2:])]
    got = rows_of(mixing.mixed(frame(spark, docs), mixing.domains_of(spark.createDataFrame(labels, LABELS)), TARGET))
    assert len(got) == len(docs)
    tokens = np.array([r["tokens"] for r in got], float)
    p, rate = np.array([r["p"] for r in got]), np.array([r["rate"] for r in got])
    assert (rate >= 0).all() and np.allclose(p.sum(axis=1), 1)
    share = (tokens * rate) @ p / tokens.sum()
    assert np.abs(share - np.array(TARGET)).max() < 0.01
    assert np.abs(np.array([r["copies"] for r in got]) - rate).max() < 1
    assert mixing.mixed(frame(spark, []), mixing.domains_of(spark.createDataFrame([], LABELS)), TARGET).count() == 0


@pytest.mark.parametrize("shares", [[0.93, 0.002, 0.068], [0.99989, 0.0001, 0.00001], [0.2, 0.1, 0.7], [0.5, 0.5, 0.0]])
def test_rates_of_scarce_domains_converge(spark, shares):
    """Each document in one domain: the minimum is known, r = (1 + ridge) / (share / target + ridge)."""
    members = spark.createDataFrame([(round(1e5 * s), [float(j == k) for j in range(3)]) for k, s in enumerate(shares) if s], "tokens long, p array<double>")
    got = mixing.fit_rates(members, TARGET).rates(np.eye(3))
    want = [1.001 / (s / t + 0.001) if s else 1.0 for s, t in zip(shares, TARGET, strict=True)]
    assert np.allclose(got, want, rtol=1e-2)


def test_rates_of_soft_members_are_the_minimum(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([2, 0.05, 0.02], 400)
    t = rng.integers(1, 90, 400)
    r = mixing.fit_rates(spark.createDataFrame([(int(n), x.tolist()) for n, x in zip(t, p, strict=True)], "tokens long, p array<double>"), TARGET).rates(p)
    tau = np.array(TARGET)
    slope = p @ (((t * r) @ p / t.sum() - tau) / tau) + 1e-3 * (r - 1)
    assert np.abs(slope[r > 0]).max() < 1e-4 and (slope[r == 0] > -1e-4).all() and 0 < (r > 0).mean()
    with pytest.raises(RuntimeError):
        mixing.fit_rates(spark.createDataFrame([(1, [0.9, 0.1, 0.0])], "tokens long, p array<double>"), TARGET, steps=1)


def plain_kneser_ney(train, texts, least_count):
    """log probability of each text by the textbook formulas; bigrams below least_count leave their mass to the lower order."""
    from collections import Counter

    clean = lambda t: ["<s>", *t.split(), "</s>"]
    count = Counter(b for t in train if t.split() for b in zip(clean(t), clean(t)[1:], strict=False))
    after = Counter(w for _, w in count)
    low = lambda values: [0.0, *quality_lm.discounts([sum(v == k for v in values) for k in (1, 2, 3, 4)])]
    d2, d1 = low(count.values()), low(after.values())
    every = sum(after.values())
    unknown = sum(d1[min(n, 3)] for n in after.values()) / every / (len(after) + 1)
    p1 = lambda w: (after[w] - d1[min(after[w], 3)]) / every + unknown if after[w] else unknown
    total, own, out = Counter(), Counter(), []
    for (h, _), c in count.items():
        total[h] += c
        own[h] += c - d2[min(c, 3)] if c >= least_count else 0
    for t in texts:
        words = clean(t)
        x = 0.0
        for h, w in zip(words, words[1:], strict=False):
            c = count[h, w] if count[h, w] >= least_count else 0
            gamma = 1 - own[h] / total[h] if total[h] else 1.0
            x += math.log((c - d2[min(c, 3)]) / max(total[h], 1) + gamma * p1(w))
        out.append(x)
    return out


@pytest.mark.parametrize("least_count, hot", [(1, 1 << 20), (2, 1 << 20), (1, 30), (2, 0)])
def test_kneser_ney_equals_textbook(spark, least_count, hot):
    """Whatever share of the n-grams is broadcast and whatever share joined."""
    rng = random.Random(3)
    train = ["", *(sentence(rng, rng.randint(1, 25)) for _ in range(60))]
    texts = [*(sentence(rng, 12) for _ in range(20)), "", "river stone", "river river river", "never seen words", None]
    model, unknown = quality_lm.values(quality_lm.ngram_table(spark.createDataFrame([(t,) for t in train], "text string"), 4, least_count))
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["log_prob"] for r in rows_of(quality_lm.log_probabilities(docs, model, unknown, hot))}
    assert np.allclose([got[i] for i in range(len(texts))], plain_kneser_ney(train, [t or "" for t in texts], least_count), atol=1e-3)


def test_thresholds_part_good_from_bad(spark):
    rows = [("a", 1, float(x)) for x in range(1000)] + [("a", 0, 991.5), ("b", 1, 5.0)]
    got = {r["lang"]: r for r in rows_of(quality_lm.thresholds(spark.createDataFrame(rows, "lang string, q int, x double"), (0.98, 0.99, 0.995), 0.9, 30))}
    assert got.keys() == {"a"} and 985 < got["a"]["hi"] < 991.5
    plain = quality_lm.thresholds(spark.createDataFrame(rows[:1000], "lang string, q int, x double"), (0.98, 0.99), 0.9, 30).first()
    assert 895 < plain["hi"] < 905


def test_quality_keeps_trusted_text_and_drops_junk(spark):
    docs, labels = labelled()
    docs += [(900, None, *docs[0][2:]), (901, "", *docs[0][2:]), (None, "river stone market", *docs[0][2:])]
    got = {r["doc_id"]: r for r in rows_of(quality_lm.classify(frame(spark, docs), spark.createDataFrame(labels, LABELS), least=5))}
    assert len(got) == len(docs) and not got[900]["kept"] and not got[901]["kept"]
    clean = [got[i]["kept"] for i in range(400) if i % 10 != 1 and i % 5]
    assert sum(clean) >= 0.97 * len(clean) and not any(got[i]["kept"] for i in range(400) if i % 10 == 1)
    none = quality_lm.classify(frame(spark, docs), spark.createDataFrame([], LABELS))
    assert {r["kept"] for r in rows_of(none.where("n_words > 0"))} == {True}
    assert quality_lm.classify(frame(spark, []), spark.createDataFrame([], LABELS)).count() == 0


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing_round_trip(spark, capacity):
    from tokenizers import Tokenizer

    rows = [r for r in documents() if r[0] is not None][:-1]
    plain = Tokenizer.from_file(word_bpe())
    ids = {r[0]: [*plain.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in rows}
    got = rows_of(pack(frame(spark, rows).repartition(3), word_bpe(), capacity=capacity, window=4 * capacity))
    by, sequences = {}, {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert by.keys() == ids.keys()
    for k, parts in by.items():
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[k])
            piece = np.array(ids[k][at : at + r["length"]], "<u4")
            assert r["ids_crc32"] == zlib.crc32(piece.tobytes())
            at += r["length"]
        assert at == len(ids[k])
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity and at & (at - 1) == 0
    assert pack(frame(spark, []), word_bpe()).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("   \x85<|>'é")), max_size=60), max_size=6))
def test_chunk_encoder_equals_tokenizer(texts):
    encoder = ChunkEncoder(word_bpe())
    texts = [*texts, "a<|endoftext|>b", "<|startoftext|> c"] if len(texts) > 4 else texts
    assert [x.tolist() for x in encoder.encode(texts)] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool\n<|im_end|>"]), st.one_of(st.text(st.characters(codec="utf-8")), st.lists(st.sampled_from([*chat_format.CONTROLS, "\\", "\n", "a"])).map("".join)))))
def test_chat_template_round_trip(turns):
    text, spans = chat_format.template(turns)
    assert chat_format.read_back(text) == turns
    assert [chat_format.unescape(text[s["start"] : s["end"]]) for s in spans] == [t for r, t in turns if r == "assistant"]
    body = chat_format.escape("".join(t for _, t in turns))
    assert not any(c in body for c in chat_format.CONTROLS)


def test_chat_layouts(spark):
    import json

    said = [("user", "a"), ("assistant", "b")]
    layouts = [
        {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]},
        {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]},
        {"prompt": "a", "response": "b"},
        {"prompt": "a", "completion": "b"},
        {"instruction": "a", "output": "b"},
        {"question": "a", "answer": "b"},
    ]
    rows = [(i, json.dumps(x), 1) for i, x in enumerate(layouts)] + [(90, None, 1), (91, "[1]", 1), (92, "{bad", 1), (93, '{"other": 1}', 1), (None, json.dumps(layouts[2]), 1)]
    got = {r["conv_id"]: r for r in rows_of(chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, record string, layout int")))}
    assert len(got) == len(rows)
    for i in [*range(len(layouts)), None]:
        assert chat_format.read_back(got[i]["formatted"]) == said
    assert all(got[i]["formatted"] is None for i in (90, 91, 92, 93)) and got[93]["fingerprint"]
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.digests(chat_format.format_chats(chat_format.records_of(empty))).count() == 0
    odd = spark.createDataFrame([(1, 0, None, None, "z"), (1, None, "user", "hi", "z"), (None, 0, "user", "x" * 100_000, "z")], "conv_id long, turn long, role string, text string, t string")
    back = {r["conv_id"]: r for r in rows_of(chat_format.digests(chat_format.format_chats(chat_format.records_of(odd))))}
    assert back[1]["n_turns"] == 2 and back[1]["turns_sha256"] == hashlib.sha256(b"user\nhi\n\n\n").hexdigest() and back[None]["n_turns"] == 1


def test_topk_huge_components(spark):
    """Components beyond a long are cut, not left out."""
    rows = [(0, [1.0, 0.0]), (1, [1e17, 0.0]), (2, [2.0, 5.0]), (3, [-1e300, 0.0]), (4, [3e17, 1.0])]
    got = rows_of(top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), spark.createDataFrame(rows[:1], "vec_id long, embedding array<double>")))
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 2**62 - 1), (4, 2**62 - 1), (2, 2 * 1024 * 1024), (3, 1 - 2**62)]


def test_topk_several_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr("riskweave.llm.topk_search.QUERY_BLOCK", 7)
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(120)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = top_k(table, table.where("vec_id % 3 = 0"), k=3)
    good = {i: [math.floor(1024 * x) for x in v] for i, v in rows}
    want = {(q, n + 1, i, -s) for q in good if q % 3 == 0 for n, (s, i) in enumerate(sorted((-sum(a * b for a, b in zip(good[q], v, strict=True)), i) for i, v in good.items() if i != q)[:3])}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows_of(got)} == want


@pytest.mark.parametrize("rare", [1, 2, 4, 50])
def test_line_dedup_whatever_is_rare(spark, rare):
    """Repeated ids with other texts are documents of their own, and which long lines go does not depend on `rare`."""
    rng = random.Random(11)
    lines = [sentence(rng, 7) + f" l{i}" for i in range(12)]
    texts = [[rng.choice(lines) if rng.random() < 0.5 else f"only here in line {rng.random()} of it" for _ in range(rng.randint(1, 9))] for _ in range(50)]
    docs = spark.createDataFrame([(d // 2, "\n".join(t)) for d, t in enumerate(texts)], "doc_id long, text string")
    order = {r["text"]: (r["doc_id"], r["h"]) for r in docs.withColumn("h", F.xxhash64("text")).collect()}
    seen, want = set(), []
    for t in sorted(texts, key=lambda t: order["\n".join(t)]):
        want.append((order["\n".join(t)][0], "\n".join(x for x in t if x not in seen)))
        seen |= set(t)
    got = sorted((r["doc_id"], r["text"]) for r in rows_of(deduplicate_lines(docs, rare=rare)))
    assert got == sorted(want)


def test_labelled_sample_of_repeated_ids(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "other")], "doc_id long, text string")
    sample, counts = labelled_sample(docs, spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, label int"), "label", 10)
    assert sorted((r["doc_id"], r["text"]) for r in sample.collect()) == [(1, "text 0"), (2, "other")] and counts == {0: 1, 1: 1}


def test_severity_equals_plain_formula(spark):
    """The distributed scores against the model's formula on Python sets of words."""
    from riskweave.llm.textblocks import LETTERS_FOLDED, word_chunks
    import pyarrow as pa

    docs, labels = labelled(200)
    model = toxicity.fit(frame(spark, docs), toxicity.grades_of(spark.createDataFrame(labels, LABELS)))
    code = {w: int(next(word_chunks(pa.array([w]), LETTERS_FOLDED))[2][0]) for w in {w for d in docs for w in "".join(c if c.isalpha() else " " for c in d[1]).split()}}
    weight = dict(zip(model.terms.tolist(), model.weights.tolist(), strict=True))
    got = {r["doc_id"]: r for r in rows_of(toxicity.severity(frame(spark, docs), model))}
    for d in docs:
        x = sum(weight.get(code[w], 0.0) for w in set("".join(c if c.isalpha() else " " for c in d[1]).split()))
        beyond = [1 / (1 + math.exp(-(x - t))) for t in model.thresholds]
        assert abs(got[d[0]]["expected_severity"] - sum(beyond)) < 1e-9 and got[d[0]]["toxic"] == (beyond[0] >= 0.5)


def test_mixing_equals_plain_minimum(spark):
    """Rates from the documents' posteriors by plain projected gradient over all rates at once."""
    docs, labels = labelled(120)
    got = rows_of(mixing.mixed(frame(spark, docs), mixing.domains_of(spark.createDataFrame(labels + [(1, 0, 0)], LABELS)).union(spark.createDataFrame([(2, 9)], "doc_id long, domain int")), TARGET))
    t, p, tau = np.array([r["tokens"] for r in got], float), np.array([r["p"] for r in got]), np.array(TARGET)
    share, rate = t / t.sum(), np.ones(len(t))
    for _ in range(200_000):
        rate_next = np.maximum(0, rate - 0.05 * (p @ (((share * rate) @ p - tau) / tau) + 1e-3 * (rate - 1)))
        if np.abs(rate_next - rate).max() < 1e-9:
            break
        rate = rate_next
    assert np.allclose([r["rate"] for r in got], rate, atol=2e-2)


def test_language_scores_equal_plain_python(spark):
    """identify() against the model applied word by word in plain Python."""
    rng = random.Random(2)
    words = {"en": WORD_EN, "de": WORD_DE}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(8)), k) for i in range(200) for k in [("en", "de")[i % 2]]] + [(900, "fuchsbau quickly SCHNELLER", None), (901, "zzz", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    known = dict(zip(model.words, model.word_scores, strict=True))
    for r in rows_of(language_id.identify(docs, model)):
        text = next(x[1] for x in rows if x[0] == r["doc_id"])
        total = model.prior + sum(known[w] if w in known else language_id.backed_off(w, model) for w in text.lower().split())
        share = np.exp(total - total.max())
        assert r["lang_pred"] == model.languages[int(total.argmax())] and abs(r["score"] - 1 / share.sum()) < 1e-9


def test_chat_records_of_any_shape(spark):
    import json

    deep = "[" * 100_000 + "]" * 100_000
    nest = {"messages": [{"role": "user", "content": {"a": {}}}]}
    x = nest["messages"][0]["content"]
    for _ in range(200):
        x["a"] = {"a": {}}
        x = x["a"]
    shapes = ['{"messages": ["hi"]}', '{"messages": 5}', '{"messages": "abc"}', '{"messages": [{"role": "user", "content": "a"}, "b"]}', '{"conversations": [null, {"from": "gpt", "value": "b"}]}', '{"messages": null}', '{"messages": []}', f'{{"messages": {deep}}}', json.dumps(nest), '{"prompt": ["x"], "response": null}']
    got = {r["conv_id"]: r for r in rows_of(chat_format.format_chats(spark.createDataFrame(list(enumerate(shapes)), "conv_id long, record string")))}
    assert len(got) == len(shapes) and all(got[i]["formatted"] is None for i in (0, 1, 2, 3, 4, 7, 8))
    assert got[5]["n_turns"] == got[6]["n_turns"] == 0 and got[9]["n_turns"] == 2
    turns = spark.createDataFrame([(1, 0, "human", "a"), (1, 1, "gpt", "b"), (2, 0, "rôle\n", "c")], "conv_id long, turn long, role string, text string")
    back = {r["conv_id"]: r for r in rows_of(chat_format.digests(chat_format.format_chats(chat_format.records_of(turns))))}
    assert back[1]["turns_sha256"] == hashlib.sha256(b"human\na\ngpt\nb\n").hexdigest() and back[1]["loss_chars"] == 0
    assert back[2]["turns_sha256"] == hashlib.sha256("rôle\n\nc\n".encode()).hexdigest()
