"""The operators as registered queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, manifest_queries, mixing, quality_lm, toxicity
from .chat_format import digests, format_chats, records_of
from .common import table
from .exact_dedup import exact_duplicates
from .jaccard_join import near_duplicates
from .line_dedup import deduplicate_lines
from .packing import pack
from .topk_search import top_k


def word_bpe() -> str:
    """Where the installed package of public vocabularies keeps its word-level BPE."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where("vec_id % 100 = 0"), k=10)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.fit(docs, toxicity.grades_of(table(spark, sf_dir, "labels"))))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: Wanted shares of words: good, of low quality, toxic.
TARGET = [0.88, 0.07, 0.05]


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixed(table(spark, sf_dir, "documents"), mixing.domains_of(table(spark, sf_dir, "labels")), TARGET)
    names = ("p_good", "p_low", "p_toxic")
    return out.select("doc_id", "tokens", *(F.col("p")[i].alias(n) for i, n in enumerate(names)), "rate", "copies")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicate_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), word_bpe())


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", both), (-7, 1, "assistant", both)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return digests(format_chats(records_of(turns.unionByName(extra))))


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.c, r.c), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id % 100 = 0 AND r.vec_id <> q.vec_id AND len(q.c) = len(r.c)
), k AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 10
"""

OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' '))
                                      WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS s
  FROM w WHERE words IS NOT NULL
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)
), reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r
)
SELECT d.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r) AS component_id
FROM documents d JOIN reach ON reach.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
GROUP BY d.doc_id
"""

OP7_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text) AS kept, sha256(text) AS text_sha256
FROM t
"""


OP10_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), r AS (
  SELECT conv_id, turn, text, role,
         regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|startoftext\|>|s>|/s>|<SYS>>|</SYS>>)', '<\\\1', 'g'), '\[(INST\]|/INST\])', '[\\\1', 'g') AS escaped
  FROM t
), g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
         sum(length('<|im_start|>') + length(url_encode(role)) + 1 + length(escaped) + length('<|im_end|>') + 1) AS chars,
         list(role ORDER BY turn, role, text) AS roles
  FROM r GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars,
       CASE WHEN roles = ['user', 'assistant'] THEN 'prompt' WHEN roles = ['system', 'user', 'assistant'] THEN 'instruction' ELSE 'messages' END AS layout
FROM g
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_topk_search, op2_toxicity, op3_ngram_jaccard_join, op4_source_mixing, op5_line_dedup, op6_language_id, op7_exact_dedup, op8_quality_classifier, op9_packing, op10_chat_format)} | manifest_queries.queries()


def oracle_sql() -> dict[str, str]:
    return {"op1_topk_search": OP1_SQL, "op3_ngram_jaccard_join": OP3_SQL, "op7_exact_dedup": OP7_SQL, "op10_chat_format": OP10_SQL} | manifest_queries.oracle_sql()
