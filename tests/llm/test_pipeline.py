"""The pipeline's stages on one small corpus, each against plain Python on its own input."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from .data import SCHEMA, documents, near_components, sentence  # noqa: E402


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    rng = random.Random(8)
    top = str(tmp_path_factory.mktemp("corpus"))
    rows = documents(2)[:-2] + [(2000 + i, sentence(rng, 40), "en", "hot", 1, "x", 1, 2, 0.5, True, "y") for i in range(200)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{top}/documents.parquet")
    labels = [(2000 + i, int(i % 9 != 0), int(i % 11 == 0)) for i in range(150)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return top


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns = docs.columns
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, corpus)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns, name
            path = f"{corpus}/out{k}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
        seen[name] = [r.asDict() for r in docs.collect()]
    quality, exact, near, mixed, packed = seen.values()
    best = {}
    for r in quality:
        best[r["text"] or ""] = max(best.get(r["text"] or "", -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in exact) == sorted(best.values())
    ordered = sorted(exact, key=lambda r: r["doc_id"])
    component, _ = near_components([r["text"] for r in ordered])
    assert sorted(r["doc_id"] for r in near) == sorted({ordered[c]["doc_id"] for c in component})
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in near} and mixed
    copies = {}
    for r in mixed:
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    tokens = {}
    for r in packed:
        tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["length"]
    assert tokens == {k: n * next(r["doc_tokens"] for r in packed if r["doc_id"] == k) for k, n in copies.items()}


def test_run_counts_every_row(spark, corpus):
    assert corpus_pipeline.run(spark, corpus).count() > 0
