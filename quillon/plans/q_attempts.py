"""The attempt loop over the documents, with a generator that SQL can say as well."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillon.functions.checkers import SEP, passes
from quillon.operators import attempts
from quillon.plans.registry import query, table
from quillon.sources.spread import folder

# what the generator does with a prompt and a seed: luck = (characters + seed) % 7
_SQL = """
tried AS (
  SELECT doc_id, k, length(coalesce(text, '')) + 42 + 100 * doc_id + k AS luck, coalesce(regexp_extract(text, '[a-z]+'), '') AS w, doc_id % 13 = 0 AS broken
  FROM documents, (SELECT unnest(range(0, 3)) AS k)
), judged AS (
  SELECT doc_id, k, CASE WHEN luck % 7 IN (0, 3) OR w = '' THEN NULL WHEN luck % 7 = 1 THEN w || ', it says' ELSE w || ' it is' END AS answer,
    CASE WHEN luck % 7 IN (0, 3) OR w = '' THEN 'missing_or_empty_thinking_delimiter' WHEN broken THEN 'checker_error' WHEN luck % 7 = 2 THEN 'max_new_tokens_reached' WHEN luck % 7 = 1 THEN 'constraint_check_failed' ELSE 'accepted' END AS verdict
  FROM tried
), ended AS (
  SELECT *, min(k) FILTER (verdict IN ('accepted', 'checker_error')) OVER (PARTITION BY doc_id) AS stop FROM judged
), made AS (
  SELECT * FROM ended WHERE k <= coalesce(stop, 2)
)"""


class Echo:
    """Answers with the first word of a prompt; now and then without closing its thoughts, without an end, or with a comma."""

    def __call__(self, prompts, seeds):
        import re

        out = []
        for p, s in zip(prompts, seeds):
            luck, w = (len(p or "") + s) % 7, (re.search("[a-z]+", p or "") or [""])[0]
            text = f"<think>about {w}" if luck in (0, 3) or not w else f"<think>about {w}</think>{w}, it says" if luck == 1 else f"<think>about {w}</think>{w} it is"
            out.append((text, 64 if luck == 2 else 8, luck != 2))
        return out


def _records(spark, sf_dir, path=None):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("prompt"), (F.col("doc_id") % 13 == 0).alias("broken"))
    args = F.create_map(F.lit("keywords"), F.lit(f"it{SEP}is"))

    def results(answer):
        kinds = ("punctuation:no_comma", "keywords:existence")
        return F.when(~F.col("broken"), F.array(*(passes(F.lit(k), args, answer) for k in kinds)))

    return attempts.attempts(rows, Echo, results, path or f"{folder(spark, 'quillon-attempts-')}/attempts-{uuid.uuid4().hex}", "doc_id", place="doc_id", max_tokens=64)


@query(f"WITH {_SQL} SELECT doc_id, arg_max(verdict, k) = 'accepted' AS accepted, max(k) + 1 AS attempts, max(k) = 0 AND max(verdict) = 'accepted' AS first_pass, nullif(arg_max(verdict, k), 'accepted') AS reason, arg_max(answer, k) FILTER (answer IS NOT NULL) AS answer FROM made GROUP BY doc_id")
def attempt_loop(spark, sf_dir):
    """Three attempts at every document; each asks again only what no attempt before has ended."""
    return attempts.outcomes(_records(spark, sf_dir), "doc_id").select("doc_id", "accepted", F.col("attempts").cast("long").alias("attempts"), "first_pass", "reason", "answer")


@query(f"WITH {_SQL}, last AS (SELECT doc_id, count(*) AS n, count(*) FILTER (luck = 2 AND answer IS NOT NULL OR luck = 2) AS n_cut, arg_max(verdict, k) AS v FROM (SELECT made.*, (SELECT luck % 7 FROM tried WHERE tried.doc_id = made.doc_id AND tried.k = made.k) AS luck FROM made) GROUP BY doc_id) SELECT CAST(sum(n) AS BIGINT) AS attempts, count(*) AS rows, count(*) FILTER (v = 'accepted') AS accepted, count(*) FILTER (v = 'checker_error') AS checker_errors, CAST(sum(n_cut) AS BIGINT) AS cut, count(*) FILTER (v <> 'accepted') AS rejected, round((sum(n) - count(*)) / sum(n), 6) AS retry_rate FROM last")
def attempt_audit(spark, sf_dir):
    return attempts.attempt_audit(_records(spark, sf_dir), "doc_id").withColumn("retry_rate", F.round("retry_rate", 6))


class Terse:
    """The second sampler: the first letter, nothing where that is a vowel."""

    def __call__(self, prompts, seeds):
        import re

        return [((re.search("[b-df-hj-np-tv-z]", (p or "")[:1]) or [""])[0], 5, True) for p in prompts]


@query(
    """WITH a AS (
  SELECT doc_id, (length(coalesce(text, '')) + doc_id) % 7 AS luck, coalesce(regexp_extract(text, '[a-z]+'), '') AS w, regexp_extract(left(coalesce(text, ''), 1), '[b-df-hj-np-tv-z]') AS again FROM documents
), b AS (
  SELECT *, CASE WHEN luck IN (0, 3) OR w = '' THEN '<think>about ' || w WHEN luck = 1 THEN '<think>about ' || w || '</think>' || w || ', it says' ELSE '<think>about ' || w || '</think>' || w || ' it is' END AS t FROM a
)
SELECT doc_id, CASE WHEN wants AND again <> '' THEN again ELSE t END AS answer, wants AND again <> '' AS fallback, CAST(CASE WHEN luck = 2 THEN 64 ELSE 8 END + CASE WHEN wants THEN 5 ELSE 0 END AS BIGINT) AS tokens
FROM (SELECT *, luck = 2 OR luck IN (0, 3) OR w = '' AS wants FROM b)"""
)
def asked_again(spark, sf_dir):
    """Answers that were cut off or not closed, asked again of another sampler."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("prompt"), F.col("doc_id").alias("seed"))
    return attempts.asked_again(rows, Echo, Terse, f"{folder(spark, 'quillon-attempts-')}/again-{uuid.uuid4().hex}", "doc_id", max_tokens=64)
