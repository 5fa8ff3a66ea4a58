"""Queries of the manifest, best-fit packing and phrase operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import merkle
from .common import table
from .phrases import collocations
from .slack_packing import pack_full

LEAF = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    changed = merkle.leaf_digest(*(F.translate(c, UPPER, LOWER) if c == "text" else F.col(c) for c in LEAF))
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return merkle.proofs(merkle.manifest(docs, LEAF, F.when(tampered, changed))).drop("lang", "part_size", "position")


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return pack_full(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({x}) || ':' || {x}, '-')" for x in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)) + ")"


OP11_SQL = f"""
WITH RECURSIVE bits(i, c, s) AS (
  SELECT i, CAST(i AS UBIGINT), 0 FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END, s + 1 FROM bits WHERE s < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE s = 8
), d AS (
  SELECT *, coalesce('=' || lang, '') AS part, {_leaf_sql("text")} AS leaf,
    CASE WHEN xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(range(1, strlen(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS UBIGINT))),
      lambda x, b: xor(x >> 8, t[CAST(xor(x, b) % 256 AS BIGINT) + 1])), CAST(4294967295 AS UBIGINT)) % 3 = 0
      THEN {_leaf_sql(f"translate(text, '{UPPER}', '{LOWER}')")} END AS changed
  FROM documents CROSS JOIN crc
), l AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM d
), tree(part, level, idx, digest) AS (
  SELECT part, 0, idx, leaf FROM l
  UNION ALL SELECT part, level + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER (PARTITION BY part) AS c FROM tree) WHERE c > 1 GROUP BY part, level, idx // 8
), top AS (SELECT part, arg_max(digest, level) AS subroot, max(level) AS height, row_number() OVER (ORDER BY part) - 1 AS place FROM tree GROUP BY part
), crown(level, idx, digest) AS (
  SELECT 0, place, subroot FROM top
  UNION ALL SELECT level + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER () AS c FROM crown) WHERE c > 1 GROUP BY level, idx // 8
), whole AS (SELECT arg_max(digest, level) AS root, max(level) AS height FROM crown
), node AS (
  SELECT t.part, t.level, t.idx, t.digest FROM tree t JOIN top USING (part) WHERE t.level < height
  UNION ALL SELECT top.part, top.height + c.level, c.idx, c.digest FROM crown c CROSS JOIN whole JOIN top ON c.level < whole.height AND top.place >> (3 * (c.level + 1)) = c.idx >> 3
), step AS (
  SELECT part, level, x.idx AS own, coalesce(string_agg(y.digest, '' ORDER BY y.idx) FILTER (y.idx < x.idx), '') AS a, coalesce(string_agg(y.digest, '' ORDER BY y.idx) FILTER (y.idx > x.idx), '') AS b
  FROM node x JOIN node y USING (part, level) WHERE x.idx // 8 = y.idx // 8 GROUP BY part, level, x.idx
), way AS (
  SELECT l.part, l.idx, s.level, s.a, s.b FROM l JOIN top USING (part) JOIN step s ON s.part = l.part AND s.own = CASE WHEN s.level < top.height THEN l.idx >> (3 * s.level) ELSE top.place >> (3 * (s.level - top.height)) END
), fold(part, idx, level, x) AS (
  SELECT part, idx, 0, coalesce(changed, leaf) FROM l
  UNION ALL SELECT f.part, f.idx, f.level + 1, sha256(w.a || f.x || w.b) FROM fold f JOIN way w ON w.part = f.part AND w.idx = f.idx AND w.level = f.level
), folded AS (SELECT part, idx, arg_max(x, level) AS folded_root FROM fold GROUP BY 1, 2
), proof AS (SELECT l.part, l.idx, sha256(coalesce(string_agg(w.a || w.b, '' ORDER BY w.level), '')) AS proof_sha256 FROM l LEFT JOIN way w ON w.part = l.part AND w.idx = l.idx GROUP BY 1, 2
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM l JOIN top USING (part) CROSS JOIN whole JOIN folded f ON f.part = l.part AND f.idx = l.idx JOIN proof p ON p.part = l.part AND p.idx = l.idx
"""


OP13_SQL = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents
), g AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, w[i:i + m - 1] AS ws, count(*) AS f
  FROM p CROSS JOIN range(1, 6) t(m) CROSS JOIN LATERAL (SELECT unnest(range(1, len(w) - m + 2)) AS i) GROUP BY ALL
), total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE m = 1 GROUP BY 1
), c AS (SELECT * FROM g WHERE m > 1 AND f >= 100
), cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, n, k, CAST(1000 * CAST(c.f AS HUGEINT) * n // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM c CROSS JOIN range(1, 5) t(k) JOIN total USING (lang)
  JOIN g x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:k], ' ') JOIN g y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[k + 1:], ' ') WHERE k < c.m
), best AS (SELECT lang, phrase, a, n, arg_min(struct_pack(l, r, score), (score, k)) AS b FROM cuts GROUP BY 1, 2, 3, 4
), kept AS (SELECT * FROM best WHERE NOT EXISTS (SELECT 1 FROM c q WHERE q.lang = best.lang AND q.phrase <> best.phrase AND contains(' ' || q.phrase || ' ', ' ' || best.phrase || ' ') AND 100 * q.f >= 100 * best.a)
), ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY b.score DESC, a DESC, phrase) AS rank, phrase, a, b.l AS l, b.r AS r, n, b.score AS score FROM kept)
SELECT * FROM ranked WHERE rank <= 2000
"""


def queries() -> dict:
    return {f.__name__: f for f in (op11_merkle_manifest, op12_best_fit_packing, op13_phrases)}


def oracle_sql() -> dict[str, str]:
    return {"op11_merkle_manifest": OP11_SQL, "op13_phrases": OP13_SQL}
