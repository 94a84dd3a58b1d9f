"""Registered queries of the training-data operators, one opN_<name> each, and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact_dedup, fingerprints, langid, mixing, negatives, ngram_join, pii, suffix_dedup, token_counts, token_files, vector_codes
from .common import read_table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "size", "source_size", "target", "taken")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_report(read_table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(read_table(spark, sf_dir, "documents"))


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_report(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup_report(read_table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "<|im_end|><|im_start|>assistant ok"
    rows = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    return chat.chat_report(turns.unionByName(rows))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(read_table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup_report(read_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_count_report(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(read_table(spark, sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_report(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("bigint")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return negatives.hard_negatives(read_table(spark, sf_dir, "embeddings"), label=moved)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_code_report(read_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_fingerprints": op2_fingerprints,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_bpe_codec": op4_bpe_codec,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_chat_format": op6_chat_format,
    "op7_language_id": op7_language_id,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_pii": op10_pii,
    "op11_token_files": op11_token_files,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_vector_codes": op13_vector_codes,
}

SQL: dict[str, str] = {}

SQL["op1_mix_sources"] = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight
  FROM d GROUP BY source),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS reach FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
             - coalesce(sum(cap) OVER (ORDER BY reach, source NULLS LAST
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY reach, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM c),
t AS (SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target FROM l),
p AS (
  SELECT d.*, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         coalesce(CAST(sum(size) OVER (PARTITION BY d.source ORDER BY key, size
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0
            ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - start)) END AS taken
FROM p
"""

SQL["op6_chat_format"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (
  SELECT *, length(replace(replace(text, '&', '&amp;'), '<|', '&lt;|')) AS long,
         length(replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&#10;')) AS role_long,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before
  FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), ''))
         AS loss_sha256,
       CAST(sum(long + CASE WHEN before IS NULL THEN 12 + role_long + 1 WHEN before = role THEN 10
                            ELSE 11 + 12 + role_long + 1 END) + 11 AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

SQL["op8_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM d
"""

SQL["op12_hard_negatives"] = r"""
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id AS id,
         CAST(CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: floor(256.0::DOUBLE * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.uid, a.id AS anchor_id, c.id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM v AS a JOIN v AS c ON a.id % 50 = 0 AND (a.label <> c.label OR a.id IS DISTINCT FROM c.id)),
p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, id NULLS LAST) AS slot FROM s WHERE same)
  WHERE slot <= 5),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.uid, p.slot ORDER BY s.score DESC, s.id NULLS LAST) AS INTEGER) AS rank
  FROM p JOIN s ON p.uid = s.uid AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def _codes_sql(parts: int = 16, width: int = 4, entries: int = 64, rounds: int = 2) -> str:
    """Rounds of assignment and averaging, each a pair of tables; vectors have parts x width components."""
    axes = range(width)
    out = [f"""
v AS MATERIALIZED (
  SELECT row_number() OVER () AS uid, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(256.0::DOUBLE * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT uid, part, {", ".join(f"v[part * {width} + {j + 1}] AS x{j}" for j in axes)}
  FROM v, range({parts}) AS r(part)),
c0 AS MATERIALIZED (
  SELECT part, entry, {", ".join(f"x{j} AS e{j}" for j in axes)}
  FROM p JOIN (SELECT uid, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS entry FROM v) USING (uid)
  WHERE entry < {entries})"""]
    for k in range(rounds + 1):
        far = " + ".join(f"(x{j} - e{j}) * (x{j} - e{j})" for j in axes)
        out.append(f"""
a{k} AS MATERIALIZED (
  SELECT uid, part, min(d) AS d, CAST(arg_min(entry, struct_pack(d := d, entry := entry)) AS BIGINT) AS entry
  FROM (SELECT uid, part, entry, {far} AS d FROM p JOIN c{k} USING (part)) GROUP BY uid, part)""")
        if k < rounds:
            mean = ", ".join(f"coalesce(CAST((s{j} - ((s{j} % n) + n) % n) // n AS BIGINT), e{j}) AS e{j}" for j in axes)
            out.append(f"""
c{k + 1} AS MATERIALIZED (
  SELECT c.part, c.entry, {mean}
  FROM c{k} AS c LEFT JOIN (
    SELECT a.part, a.entry, count(*) AS n, {", ".join(f"sum(x{j}) AS s{j}" for j in axes)}
    FROM a{k} AS a JOIN p USING (uid, part) GROUP BY a.part, a.entry) AS m ON m.part = c.part AND m.entry = c.entry)""")
    return "WITH" + ",".join(out) + f""",
o AS (
  SELECT uid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM a{rounds} GROUP BY uid),
h AS (
  SELECT sha256(string_agg(concat_ws(',', {", ".join(f"e{j}" for j in axes)}), ',' ORDER BY part, entry)) AS codebooks_sha256
  FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM o JOIN v USING (uid), h
"""


SQL["op13_vector_codes"] = _codes_sql()
