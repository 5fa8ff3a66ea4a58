"""The quality model has all bigrams of the trusted text."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.llm import quality_lm

SCHEMA = "doc_id long, text string, lang string"


def test_bigrams_seen_once_are_modelled(spark):
    """Before, those seen once (most of the types) were left out, so that a trusted text counted as little as its words in any order."""
    rows = [(i, " ".join(f"w{(7 * i + j * j) % 61}x{i % 3}" for j in range(20)), "en") for i in range(80)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 1) for i in range(80)], "doc_id long, quality int")
    trained = [r["doc_id"] for r in quality_lm.trusted_ids(labels, "doc_id", "quality").where("half = 0").collect()]
    once = [i + 1000 for i in trained]
    more = spark.createDataFrame([(1000 + i, " ".join(f"new{i}a{j}" for j in range(20)), "en") for i in trained], SCHEMA).unionByName(spark.createDataFrame([(5000 + i, " ".join(f"new{i}a{j}" for j in range(19, -1, -1)), "en") for i in trained], SCHEMA))
    train = docs.where(F.col("doc_id").isin(trained)).unionByName(more.where("doc_id < 5000")).select("text")
    model, unknown = quality_lm.values(quality_lm.ngram_table(train, 4))
    got = {r["doc_id"]: r["log_prob"] for r in quality_lm.log_probabilities(more, model, unknown).collect()}
    assert all(got[i] > got[i + 4000] + 10 for i in once)
    seen = []
    table = quality_lm.ngram_table
    patch = pytest.MonkeyPatch()
    patch.setattr(quality_lm, "ngram_table", lambda *a: seen.append(table(*a)) or seen[-1])
    quality_lm.classify(docs, labels, least=5).count()
    patch.undo()
    words = [["", *t.split(), "."] for i, t, _ in rows if i in trained]
    assert seen[0].where(F.col("kind") == quality_lm.PAIR).count() == len({p for w in words for p in zip(w, w[1:])})


def test_values_are_the_same_sent_and_joined(spark, monkeypatch):
    train = spark.createDataFrame([(" ".join(f"w{(i * j) % 37}" for j in range(25)),) for i in range(30)], "text string").repartition(3)
    table = quality_lm.ngram_table(train, 4)
    sent, unknown = quality_lm.values(table)
    monkeypatch.setattr(quality_lm, "SENT_WORDS", 0)
    joined, same = quality_lm.values(table)
    one, two = ({r["key"]: (r["freq"], r["value"]) for r in x.collect()} for x in (sent, joined))
    assert unknown == same and one.keys() == two.keys() and len(one) > 100
    assert all(one[k][0] == two[k][0] and np.isclose(one[k][1], two[k][1], atol=1) for k in one)


@pytest.mark.parametrize("hot", [0, 40])
def test_training_documents_need_no_look_up_of_what_was_seen_once(spark, hot):
    """Before, every bigram of a training document was sent through a join, most of them to say that they were seen once."""
    rows = [(i, " ".join(f"w{(7 * i + j * j) % 61}x{i % 3}" for j in range(20)), "en") for i in range(60)]
    docs = spark.createDataFrame([*rows, (None, rows[1][1], "en"), (2, rows[2][1], "en"), (99, None, "en")], SCHEMA).repartition(3)
    training = spark.createDataFrame([(i,) for i in range(0, 60, 2)], "doc_id long")
    model, unknown, facts = quality_lm.model_of(quality_lm.ngram_table(docs.join(training, "doc_id").select("text"), 4))
    key = lambda r: (str(r["doc_id"]), r["n_words"], r["log_prob"])
    plain, spared = (sorted(map(key, quality_lm.log_probabilities(docs, model, unknown, hot, *more).collect())) for more in ((), (facts, training)))
    assert plain == spared and len(plain) == 63
