"""The corpus pipeline: documents in, packed training sequences out.

Every stage gets what its predecessor kept, as a Parquet table, and all but the last return the
columns of `documents`. SQL cannot express the first stage's language model, the fitted mixing rates
or the tokenizer, so there is no ORACLE_SQL; tests/llm compares the run with a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import mixing, quality_lm
from riskweave.llm.common import materialize, spare_name, table
from riskweave.llm.exact_dedup import deduplicate, drop_ids
from riskweave.llm.jaccard_join import near_duplicates
from riskweave.llm.packing import pack
from riskweave.llm.queries import TARGET, word_bpe

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under trusted text is within their language's quantile; decided for each text and language, whatever its doc_id."""
    key = spare_name(docs.columns, "key")
    keyed = docs.withColumn(key, F.xxhash64("text", "lang"))
    scored = quality_lm.classify(keyed, table(spark, sf_dir, "labels"), keep=key)
    return drop_ids(keyed, scored.where("not kept").select(key), key).drop(key)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest doc_id; one without an id only if no other has one."""
    key, own = spare_name(docs.columns, "key"), F.col("doc_id")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    group = near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text")).where("n_shingles > 0").select(F.col("doc_id").alias(key), "component_id").distinct()
    several = group.where(f"component_id <> {key}").select("component_id").distinct()
    members = materialize(group.join(several, "component_id", "left_semi").join(keyed.select(key, own.alias("own")), key))
    first = materialize(members.groupBy("component_id").agg(F.min(F.struct(F.col("own").isNull(), "own", key)).alias("first")).select("component_id", F.col(f"first.{key}").alias("stays")))
    return drop_ids(keyed, members.join(first, "component_id").where(f"{key} <> stays").select(key), key).drop(key)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate towards the target weights says; a row a copy."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # whatever the columns are called
    doc_id, text = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    labels = mixing.domains_of(table(spark, sf_dir, "labels")).withColumnRenamed("doc_id", doc_id)
    rated = mixing.mixed(plain, labels, TARGET, doc_id, text, keep=plain.columns)
    copies = F.explode(F.sequence(F.lit(1).cast("long"), "copies"))
    return rated.where("copies > 0").withColumn("copy", copies).select(*plain.columns).toDF(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, word_bpe())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("mixing sources to target weights", mix),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
