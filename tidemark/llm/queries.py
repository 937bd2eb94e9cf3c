"""Queries over the corpus tables, one per operator, with production parameters, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, digest, langid, licenses, mixing, multi_index, ngram_join, quality, toxicity
from ..session import table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary())


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    fixture = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', :t), (-7L, 1L, 'assistant', :t) AS v(conv_id, turn, role, text)", args={"t": hard})
    return chat.digests(chat.format_conversations(rows.unionByName(fixture)))


OP4_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
r AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS DISTINCT FROM role AS opens,
    length(replace(text, '\\', '\\\\')) + length(regexp_replace(text, '<\\|im_start\\|>|<\\|im_body\\|>|<\\|im_next\\|>|<\\|im_end\\|>|<\\|im_sep\\|>|<\\|endoftext\\|>|<\\|startoftext\\|>|<s>|</s>|\\[INST\\]|\\[/INST\\]|<<SYS>>|<</SYS>>', chr(1), 'g'))
      - length(regexp_replace(text, '<\\|im_start\\|>|<\\|im_body\\|>|<\\|im_next\\|>|<\\|im_end\\|>|<\\|im_sep\\|>|<\\|endoftext\\|>|<\\|startoftext\\|>|<s>|</s>|\\[INST\\]|\\[/INST\\]|<<SYS>>|<</SYS>>', '', 'g')) AS shown
  FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(shown + CASE WHEN opens THEN 12 + length(role) + 11 + 11 ELSE 11 END)::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""


def op1_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), words=3, percent=90)


def op6_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.fingerprint_pairs(table(spark, sf_dir, "documents"))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("at")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
e AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.doc_id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.c) AS component_id FROM s JOIN r USING (doc_id) GROUP BY s.doc_id, s.s
"""

_quoted = lambda t: t.replace("'", "''")
OP8_SQL = r"""
WITH t AS (SELECT * FROM (VALUES %s) AS v(i, license, text)),
w AS (SELECT doc_id AS k, NULL AS i, NULL AS license, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL SELECT NULL, i, license, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') FROM t),
g AS (SELECT k, i, license, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p : p + 4], ' ')))) AS g FROM w WHERE len(w) >= 5),
n AS (SELECT i, count(*) AS n FROM g WHERE i IS NOT NULL GROUP BY i),
c AS (SELECT d.k, t.license, count(*) / any_value(n.n) AS containment FROM g d JOIN g t ON d.g = t.g AND d.i IS NULL AND t.i IS NOT NULL JOIN n ON n.i = t.i GROUP BY d.k, t.i, t.license HAVING count(*) / any_value(n.n) >= 0.8)
SELECT k AS doc_id, license, max(containment) AS containment FROM c GROUP BY k, license
""" % ", ".join(f"({i}, '{n}', '{_quoted(t)}')" for i, (n, t) in enumerate(licenses.TEMPLATES))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_multi_index": op1_multi_index, "op2_toxicity": op2_toxicity, "op3_bpe": op3_bpe, "op4_chat": op4_chat, "op5_ngram_join": op5_ngram_join, "op6_digest": op6_digest, "op7_mix": op7_mix, "op8_licenses": op8_licenses, "op9_quality": op9_quality, "op10_langid": op10_langid}
SQL: dict[str, str] = {"op4_chat": OP4_SQL, "op5_ngram_join": OP5_SQL, "op8_licenses": OP8_SQL}
