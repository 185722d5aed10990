"""One query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontam, filter_audit, fingerprint, hamming_index, html_extract, language_id, lm_score, near_dedup, packing, spelling, suffix_dedup, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES["op4_near_duplicates"] = op4_near_duplicates


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


QUERIES["op2_pack"] = op2_pack


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents")).drop("text")


QUERIES["op3_suffix_dedup"] = op3_suffix_dedup


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_table(spark, sf_dir, "documents"))


QUERIES["op5_fingerprint"] = op5_fingerprint

_REHEARSAL = "</s>[INST] ok [/INST]"


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_REHEARSAL).alias("text"))
    return chat_format.digests(chat_format.format_chats(rows.unionByName(extra)))


QUERIES["op6_chat_format"] = op6_chat_format
ORACLE["op6_chat_format"] = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, r, CASE r WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) x(r)),
m AS (SELECT *, length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) + length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) AS escaped FROM t),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS masked,
        bool_or(contains(text, '</s>') OR contains(role, ' [/INST]')) AS clash,
        sum(length(role) + length(text)) AS plain, sum(escaped) AS escaped FROM m GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(masked) AS loss_chars, sha256(masked) AS loss_sha256,
       CAST(4 + n_turns * 22 + CASE WHEN clash THEN escaped ELSE plain END AS BIGINT) AS formatted_chars
FROM g
"""


def _split(docs: DataFrame, parts: int, held: int) -> DataFrame:
    """The rows with held_out: the CRC-32 of doc_id as text leaves the remainder ``held``."""
    crc = F.crc32(F.col("doc_id").cast("string"))
    return docs.withColumn("held_out", F.coalesce(crc % parts == held, F.lit(False)))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _split(_table(spark, sf_dir, "documents"), 3, 1)
    return language_id.identify(docs.select("doc_id", "text", "held_out"), docs.filter("not held_out").select("doc_id", "text", "lang"))


QUERIES["op1_language_id"] = op1_language_id


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _split(_table(spark, sf_dir, "documents").select("doc_id", "text"), 4, 2)
    labels = _split(_table(spark, sf_dir, "labels").select("doc_id", "toxic"), 4, 2).filter("not held_out").drop("held_out")
    learn = docs.drop("held_out").join(labels, "doc_id")
    return toxicity.score(docs, learn).select("doc_id", "held_out", "score", "predicted", "n_sentences", F.size("offending").alias("n_offending"))


QUERIES["op7_toxicity"] = op7_toxicity


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_split(_table(spark, sf_dir, "documents"), 7, 2).select("doc_id", "text", "held_out"))


QUERIES["op8_lm_score"] = op8_lm_score


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES["op9_decontaminate"] = op9_decontaminate


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(_table(spark, sf_dir, "pages"))


QUERIES["op10_html_extract"] = op10_html_extract


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("filter")


QUERIES["op11_filter_audit"] = op11_filter_audit
ORACLE["op11_filter_audit"] = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^ \t\n\x0B\f\r]+') AS ws FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b,
        100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, coalesce(w.doc_id > first_id, false) AS e FROM w LEFT JOIN l USING (doc_id)),
m AS (SELECT part, good, toxic, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS bits, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS s, unnest([1, 2, 4, 8, 16]) AS v),
o AS (SELECT p.s || q.s || r.s || t.s || u.s AS filter_order, [p.v, q.v, r.v, t.v, u.v] AS vs FROM x p, x q, x r, x t, x u WHERE p.v + q.v + r.v + t.v + u.v = 31 AND (p.v | q.v | r.v | t.v | u.v) = 31),
z AS (SELECT filter_order, step, vs[step] AS f, coalesce(list_sum(vs[1:step - 1]), 0)::INT AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
y AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER ((bits & (before | f)) = 0), 0) AS kept, coalesce(sum(n) FILTER ((bits & before) = 0 AND (bits & f) > 0), 0) AS removed,
        coalesce(sum(n) FILTER ((bits & before) > 0 AND (bits & f) > 0), 0) AS redundant, coalesce(sum(n) FILTER (bits = f), 0) AS unique_fails,
        coalesce(sum(n) FILTER ((bits & before) = 0 AND (bits & f) > 0 AND good), 0) AS good_lost, coalesce(sum(n) FILTER ((bits & before) = 0 AND (bits & f) > 0 AND toxic), 0) AS toxic_lost
      FROM m, z GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM y
"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(_table(spark, sf_dir, "documents"))


QUERIES["op12_spelling_variants"] = op12_spelling_variants


def op13_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_index.nearest(_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


QUERIES["op13_nearest_vectors"] = op13_nearest_vectors
