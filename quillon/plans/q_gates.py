"""Eligibility counts, second answers and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import gates
from quillon.plans.fixtures import ANNOTATED_SQL, annotated
from quillon.plans.registry import query, table

_QUOTAS = ["code", "knowledge_qa", "math_reasoning", "general_instruction"]
_IN = "('code', 'knowledge_qa', 'math_reasoning', 'general_instruction')"


@query(f"WITH {ANNOTATED_SQL}, m AS (SELECT DISTINCT k FROM annotated WHERE ord % 10 = 0) SELECT reason, count(*) AS n FROM (SELECT CASE WHEN bucket NOT IN {_IN} THEN 'task' WHEN score < 52 THEN 'score' WHEN k IN (SELECT k FROM m) THEN 'boundary' ELSE 'eligible' END AS reason FROM annotated) GROUP BY reason")
def source_eligibility(spark, sf_dir):
    rows = annotated(spark, sf_dir)
    return gates.reason_counts(gates.source_reason(rows, _QUOTAS, rows.filter("ord % 10 = 0")))


@query(f"WITH {ANNOTATED_SQL} SELECT reason, count(*) AS n FROM (SELECT CASE WHEN bucket NOT IN {_IN} THEN 'task' WHEN ord % 10 = 0 THEN 'in use' WHEN id IN ('11', '12') THEN 'excluded' WHEN length(q1) NOT BETWEEN 20 AND 1500 THEN 'length' WHEN k = '' THEN 'no key' WHEN contains(q1, chr(65533)) THEN 'broken characters' WHEN score < 52 THEN 'score' ELSE 'eligible' END AS reason FROM annotated) GROUP BY reason")
def guardrail_eligibility(spark, sf_dir):
    rows = annotated(spark, sf_dir)
    return gates.reason_counts(gates.guardrail_reason(rows, _QUOTAS, rows.filter("ord % 10 = 0"), {"11": "by hand", "12": "by hand"}))


@query("WITH f AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE source END AS a, n_chars > 5000 AS clipped, doc_id % 11 = 0 AS unclosed, n_chars AS t, CASE WHEN doc_id % 14 = 0 THEN '' ELSE lang END AS b FROM documents), w AS (SELECT *, a = '' OR clipped OR unclosed AS want FROM f) SELECT doc_id, CASE WHEN want AND coalesce(b, '') <> '' THEN b ELSE a END AS answer, want AND coalesce(b, '') <> '' AS fallback, t + CASE WHEN want THEN 100 ELSE 0 END AS tokens FROM w")
def answer_fallback(spark, sf_dir):
    d = F.col("doc_id")
    first = F.struct(F.when(d % 7 == 0, "").otherwise(F.col("source")).alias("answer"), (F.col("n_chars") > 5000).alias("clipped"), (d % 11 == 0).alias("unclosed"), F.col("n_chars").alias("tokens"))
    second = F.struct(F.when(d % 14 == 0, "").otherwise(F.col("lang")).alias("answer"), F.lit(100).cast("long").alias("tokens"))
    return table(spark, sf_dir, "documents").select("doc_id", gates.chosen_answer(first, second).alias("x")).select("doc_id", "x.*")


@query("WITH r AS (SELECT l_quantity AS b, l_quantity * (1 - l_discount) AS a, CASE WHEN l_tax > 0.06 THEN 'tax' END AS reason FROM lineitem) SELECT count(*) AS n, count(*) FILTER (reason IS NULL) AS n_accepted, sum(b) FILTER (reason IS NULL) AS before, round(sum(a) FILTER (reason IS NULL), 2) AS after, round(sum(a) FILTER (reason IS NULL) / sum(b) FILTER (reason IS NULL), 6) AS ratio FROM r")
def compression_audit(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("before"), (F.col("l_quantity") * (1 - F.col("l_discount"))).alias("after"), F.when(F.col("l_tax") > 0.06, "tax").alias("reason"))
    return gates.compression_audit(rows).withColumn("after", F.round("after", 2)).withColumn("ratio", F.round("ratio", 6))


@query("SELECT o_orderpriority, arg_min(o_orderkey, o_orderkey) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_orderpriority")
def first_of_each_class(spark, sf_dir):
    return gates.first_of_each(table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_orderstatus"), "o_orderpriority", "o_orderkey")


@query("SELECT conv_id, len(list_distinct(list(regexp_replace(text, '\\s+', ' ', 'g')) FILTER (turn % 2 = 0))) AS n FROM conversations GROUP BY conv_id")
def prompt_sets(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    n = (rows.agg(F.max("turn")).first()[0] or 0) // 2 + 1
    cell = lambda t: F.to_json(F.struct(F.max(F.when(F.col("turn") == t, F.col("text"))).alias("content")))
    wide = rows.groupBy("conv_id").agg(*(cell(2 * i).alias(f"t{i}") for i in range(n)))
    return wide.select("conv_id", F.size(gates.prompt_set([F.col(f"t{i}") for i in range(n)], True)).cast("long").alias("n"))
