"""The engine's logical tables, made from the driver's: the same definitions in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import alnum_key, length_bucket, task_bucket
from quillon.operators.quality import inspected
from quillon.plans.registry import table

#: The driver's texts have none of the default markers: buckets by markers of their own syllables.
RULES = [("code", ["thble", "ûe"]), ("math_reasoning", ["shwh", "keitkeit"]), ("translation", ["queque", "ññ"]), ("rewrite_summary", ["andand", "ungung"]), ("knowledge_qa", ["oner", "mente", "lich"])]

SFT_SQL = """
sft AS (
  SELECT d.doc_id AS ord, CAST(d.doc_id AS VARCHAR) AS id, d.source, split_part(d.text, chr(10), 1) AS question,
    CASE WHEN strpos(d.text, chr(10)) > 0 THEN substr(d.text, strpos(d.text, chr(10)) + 1) ELSE '' END AS answer,
    CAST(CASE WHEN d.doc_id % 17 = 0 THEN NULL ELSE (d.doc_id % 11) - 4 + 0.5 * coalesce(l.quality, 0) - 2.0 * coalesce(l.toxic, 0) END AS DOUBLE) AS reward
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
)"""

_HAS = " OR ".join
ANNOTATED_SQL = (
    SFT_SQL
    + """,
keyed AS (
  SELECT *, regexp_replace(lower(question), '[^\\pL\\pN]', '', 'g') AS k, regexp_replace(lower(answer), '[^\\pL\\pN]', '', 'g') AS ka,
    length(question) + length(answer) AS n, lower(question) AS lq,
    regexp_replace(question, '^\\s+|\\s+$', '', 'g') AS q1, regexp_replace(answer, '^\\s+|\\s+$', '', 'g') AS a1
  FROM sft
), flagged AS (
  SELECT *,
    list_filter([CASE WHEN q1 = '' THEN 'empty_question' END, CASE WHEN a1 = '' THEN 'empty_answer' END, CASE WHEN reward IS NULL THEN 'invalid_reward' END], lambda x: x IS NOT NULL) AS stage1,
    list_filter([CASE WHEN k = ka THEN 'question_equals_answer' END, CASE WHEN contains(question || answer, chr(65533)) THEN 'invalid_unicode_replacement' END,
      CASE WHEN regexp_matches(answer, '__[A-Z][A-Z0-9_]*__') THEN 'unresolved_placeholder' END], lambda x: x IS NOT NULL) AS stage2,
    list_filter([CASE WHEN reward < 0 THEN 'negative_reward' WHEN reward < 1 THEN 'low_reward' END,
      CASE WHEN length(a1) < 8 AND length(q1) > 24 THEN 'very_short_answer' END, CASE WHEN length(q1) + length(a1) > 4000 THEN 'very_long_sample' END,
      CASE WHEN ka <> '' AND contains(k, ka) THEN 'answer_copied_from_prompt' END], lambda x: x IS NOT NULL) AS soft
  FROM keyed
), annotated AS (
  SELECT *, CASE WHEN len(stage1) > 0 THEN stage1 ELSE stage2 END AS hard, CASE WHEN len(stage1) > 0 THEN [] ELSE soft END AS flags,
    CASE WHEN len(stage1) > 0 THEN 0.0 ELSE round(50 + 2 * greatest(-5, least(5, reward))
      - CASE WHEN list_contains(soft, 'negative_reward') THEN 12 ELSE 0 END - CASE WHEN list_contains(soft, 'low_reward') THEN 4 ELSE 0 END
      - CASE WHEN list_contains(soft, 'very_short_answer') THEN 8 ELSE 0 END - CASE WHEN list_contains(soft, 'very_long_sample') THEN 3 ELSE 0 END
      - CASE WHEN list_contains(soft, 'answer_copied_from_prompt') THEN 10 ELSE 0 END, 3) END AS score,
    CASE """
    + " ".join(f"WHEN {_HAS(f"contains(lq, '{m}')" for m in ms)} THEN '{name}'" for name, ms in RULES)
    + """ ELSE 'general_instruction' END AS bucket,
    CASE WHEN n <= 256 THEN 'le_256' WHEN n <= 512 THEN 'le_512' WHEN n <= 1024 THEN 'le_1024' WHEN n <= 2048 THEN 'le_2048' ELSE 'gt_2048' END AS length_bucket
  FROM flagged
), usable AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ord) AS nth FROM annotated WHERE len(hard) = 0) WHERE nth = 1 AND k <> ''
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY bucket, length_bucket ORDER BY score DESC, sha256(k), ord) AS rn, count(*) OVER (PARTITION BY bucket, length_bucket) AS n_stratum FROM usable
)"""
)


def sft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 in columns: ord, id, source, question (the first line), answer (the rest), reward."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l"), "quality", "toxic")
    joined = d.join(lab, d["doc_id"] == F.col("l"), "left")
    reward = (F.col("doc_id") % 11 - 4 + 0.5 * F.coalesce("quality", F.lit(0)) - 2.0 * F.coalesce("toxic", F.lit(0))).cast("double")
    at = F.instr("text", "\n")
    return joined.select(
        F.col("doc_id").alias("ord"),
        F.col("doc_id").cast("string").alias("id"),
        "source",
        F.substring_index("text", "\n", 1).alias("question"),
        F.when(at > 0, F.substr("text", at + 1)).otherwise("").alias("answer"),
        F.when(F.col("doc_id") % 17 != 0, reward).alias("reward"),
    )


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sft with key, hard codes, soft flags, score and buckets. The driver's texts are NFKC already."""
    own = inspected(sft(spark, sf_dir), normal=True)
    return own.withColumn("k", alnum_key(F.col("question"), True)).withColumn("bucket", task_bucket(F.col("question"), RULES)).withColumn("length_bucket", length_bucket(F.length("question") + F.length("answer")))
