"""Summaries and group statistics over lineitem, events and documents."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions import scores
from quillon.operators import metrics, rewards
from quillon.plans.registry import query, table

# rollouts: an order is a group of completions, a line one of them
_REWARD = "round(l_discount * 10 - l_tax * 5, 6)"


def _rollouts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", F.round(F.col("l_discount") * 10 - F.col("l_tax") * 5, 6).alias("reward"), F.col("l_quantity").alias("q"))


@query(f"SELECT l_orderkey, l_linenumber, round(coalesce((r - avg(r) OVER w) / (stddev_samp(r) OVER w + 1e-4), 0), 6) + 0.0 AS advantage FROM (SELECT *, {_REWARD} AS r FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey)")
def group_advantages(spark, sf_dir):
    rows = rewards.group_advantages(_rollouts(spark, sf_dir), ["l_orderkey"])
    return rows.select("l_orderkey", "l_linenumber", (F.round("advantage", 6) + 0.0).alias("advantage"))


@query(f"SELECT l_orderkey, count(*) < 2 OR max(r) - min(r) < 1e-8 AS flat, count(*) AS n FROM (SELECT *, {_REWARD} AS r FROM lineitem) GROUP BY l_orderkey")
def zero_variance_groups(spark, sf_dir):
    return _rollouts(spark, sf_dir).groupBy("l_orderkey").agg(rewards.zero_variance().alias("flat"), F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, round(-least((0.5 + l_quantity / 50) * a, greatest(0.8, least(1.28, 0.5 + l_quantity / 50)) * a), 6) + 0.0 AS loss FROM (SELECT *, l_discount * 20 - 1 AS a FROM lineitem)")
def clip_higher_loss(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", (F.round(scores.clip_higher(0.5 + F.col("l_quantity") / 50, F.col("l_discount") * 20 - 1), 6) + 0.0).alias("loss"))


@query("SELECT l_orderkey, round(CASE WHEN sum(l_discount) <= 0 THEN 0 ELSE sum(l_tax * l_discount) / sum(l_discount) END, 9) AS loss FROM lineitem GROUP BY l_orderkey")
def token_level_loss(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_tax", "l_discount")).alias("x"))
    side = lambda c: F.transform("x", lambda x: F.array(x[c]))
    return rows.select("l_orderkey", F.round(rewards.token_loss(side("l_tax"), side("l_discount")), 9).alias("loss"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity <= 30 THEN 0.0 ELSE -least((l_quantity - 30) / 10, 1.0) END, 6) + 0.0 AS penalty FROM lineitem")
def soft_overlong(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", (F.round(scores.soft_overlong(F.col("l_quantity"), 40, 10), 6) + 0.0).alias("penalty"))


@query("SELECT l_returnflag AS run, round(avg(o), 6) AS mean, round(avg(o) - (SELECT avg(o) FROM (SELECT avg(l_discount) AS o FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_linenumber)), 6) + 0.0 AS delta FROM (SELECT l_returnflag, l_linenumber, avg(l_discount) AS o FROM lineitem GROUP BY ALL) GROUP BY l_returnflag")
def run_delta_pivot(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("run"), F.col("l_linenumber").alias("turn")).agg(F.avg("l_discount").alias("overall"))
    return metrics.run_deltas(rows, "A").select("run", F.round("mean", 6).alias("mean"), (F.round("delta", 6) + 0.0).alias("delta"))


@query("SELECT count(*) AS n_turns, round(sum(l_extendedprice), 2) AS seconds, round(avg(l_extendedprice), 4) AS mean_seconds, sum(l_quantity) AS tokens, round(avg(l_quantity), 6) AS mean_tokens, round(sum(l_quantity) / sum(l_extendedprice), 9) AS tokens_per_second, count(*) FILTER (l_quantity >= 50) AS n_clipped, count(*) FILTER (l_discount = 0) AS n_empty, count(*) FILTER (l_tax = 0) AS n_fallback, count(*) FILTER (l_returnflag = 'R') AS n_unclosed FROM lineitem")
def generation_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("seconds"), F.col("l_quantity").alias("tokens"), (F.col("l_quantity") >= 50).alias("clipped"), (F.col("l_discount") == 0).alias("empty"), (F.col("l_tax") == 0).alias("fallback"), (F.col("l_returnflag") == "R").alias("unclosed"))
    out = metrics.generation_summary(rows)
    for c, d in (("seconds", 2), ("mean_seconds", 4), ("mean_tokens", 6), ("tokens_per_second", 9)):
        out = out.withColumn(c, F.round(c, d))
    return out


@query("SELECT p_brand AS category, count(*) AS n, count(*) FILTER (p_size > 25) AS n_passed, round(avg(CASE WHEN p_size > 25 THEN 1 ELSE 0 END), 6) AS pass_rate FROM part GROUP BY ROLLUP (p_brand)")
def suite_summary(spark, sf_dir):
    out = metrics.suite_summary(table(spark, sf_dir, "part").select(F.col("p_brand").alias("category"), (F.col("p_size") > 25).alias("passed")))
    return out.withColumn("pass_rate", F.round("pass_rate", 6))


@query("WITH b AS (SELECT event_type, date_trunc('hour', ts) AS step, value, CASE WHEN value > 50 THEN 1 ELSE 0 END AS ok FROM events) SELECT step, round(avg(value), 6) AS mean, round(avg(ok), 6) AS ok_share, max(ok) = 1 AS any_ok FROM b GROUP BY step")
def batch_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.date_trunc("hour", "ts").alias("step"), "value", (F.col("value") > 50).cast("int").alias("ok"))
    return rows.groupBy("step").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.avg("ok"), 6).alias("ok_share"), (F.max("ok") == 1).alias("any_ok"))


@query("WITH f AS (SELECT user_id, min(event_id // 100) AS step FROM events GROUP BY user_id), n AS (SELECT step, count(*) AS n_new FROM f GROUP BY step) SELECT step, n_new, round(sum(n_new) OVER (ORDER BY step) / (SELECT count(DISTINCT user_id) FROM events), 6) AS coverage FROM n")
def coverage_running(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.floor(F.col("event_id") / 100).alias("step"))
    pool = rows.agg(F.count_distinct("user_id")).first()[0]
    return metrics.coverage(rows, pool, "user_id", "step").withColumn("coverage", F.round("coverage", 6))


@query("WITH s AS (SELECT event_id // 20 AS step, max(value) AS v FROM events GROUP BY 1), g AS (SELECT *, sum(CASE WHEN v < 95 THEN 0 ELSE 1 END) OVER (ORDER BY step) AS grp FROM s) SELECT step, CAST(sum(CASE WHEN v < 95 THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY step) AS BIGINT) AS run FROM g")
def zero_signal_runs(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 20).alias("step")).agg(F.max("value").alias("v"))
    return rewards.runs(rows, F.col("v") < 95, "step").select("step", "run")


@query("WITH c AS (SELECT l_quantity AS v, count(*) AS e FROM lineitem GROUP BY 1), p AS (SELECT v, (2 * sum(e) OVER (ORDER BY v) - e - 1) / 2.0 / (sum(e) OVER () - 1) AS p FROM c) SELECT l_orderkey, l_linenumber, round(p, 9) AS percentile FROM lineitem JOIN p ON v = l_quantity")
def midrank_percentile(spark, sf_dir):
    rows = metrics.midrank_percentile(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity")
    return rows.select("l_orderkey", "l_linenumber", F.round("percentile", 9).alias("percentile"))


_PLAN = "pct AS (SELECT v, (2 * sum(e) OVER (ORDER BY v) - e - 1) / 2.0 / (sum(e) OVER () - 1) AS p FROM (SELECT p_size AS v, count(*) AS e FROM part GROUP BY 1)), plan AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p, CAST(greatest(128, least(512, ceil(round(CASE WHEN p <= 0.5 THEN 128 + 128 * p * 2 ELSE 256 + 256 * (p - 0.5) * 2 END, 9) / 32) * 32)) AS BIGINT) AS budget, CASE WHEN p < 1 / 3.0 THEN 'easy' WHEN p < 2 / 3.0 THEN 'medium' ELSE 'hard' END AS band, p_retailprice / 5 AS tokens FROM part JOIN pct ON v = p_size)"


def _plan(spark, sf_dir):
    rows = metrics.midrank_percentile(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), "p_size")
    p = F.col("percentile")
    return rows.select(F.col("p_partkey").cast("string").alias("id"), scores.interpolated_budget(p).alias("budget"), scores.band(p).alias("band"), (F.col("p_retailprice") / 5).alias("tokens")).withColumn("action", F.when(F.col("tokens") > F.col("budget"), "rewrite").otherwise("keep"))


@query(f"WITH {_PLAN} SELECT id, budget, band FROM plan")
def budget_plan(spark, sf_dir):
    return _plan(spark, sf_dir).select("id", F.col("budget").cast("long").alias("budget"), "band")


@query(f"WITH {_PLAN}, a AS (SELECT *, CASE WHEN tokens > budget THEN 'rewrite' ELSE 'keep' END AS action FROM plan), o AS (SELECT *, row_number() OVER (PARTITION BY band, action ORDER BY id) AS rn FROM a) SELECT band, action, count(*) AS n, round(avg(budget), 6) AS mean_budget, count(*) FILTER (tokens > budget) AS n_over, string_agg(id, ',' ORDER BY id) FILTER (rn <= 5) AS examples FROM o GROUP BY band, action")
def plan_summary(spark, sf_dir):
    return metrics.plan_summary(_plan(spark, sf_dir)).withColumn("mean_budget", F.round("mean_budget", 6))


@query("SELECT o_orderkey, CASE WHEN s <= 2 THEN 'easy' WHEN s <= 4 THEN 'medium' ELSE 'hard' END AS difficulty FROM (SELECT o_orderkey, n + greatest(0, d - 1) + greatest(0, k - 1) + CASE WHEN NOT ok THEN 1 ELSE 0 END + least(n, 2) AS s FROM (SELECT o_orderkey, count(l_orderkey) AS n, count(DISTINCT l_suppkey) AS d, count(DISTINCT l_returnflag) AS k, coalesce(bool_and(l_discount > 0.02), true) AS ok FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey))")
def difficulty_bucket(spark, sf_dir):
    o, x = table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_discount")
    rows = o.join(x, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_orderkey").agg(F.count("l_orderkey").alias("n"), F.count_distinct("l_suppkey").alias("d"), F.count_distinct("l_returnflag").alias("k"), F.coalesce(F.bool_and(F.col("l_discount") > 0.02), F.lit(True)).alias("ok"))
    return rows.select("o_orderkey", scores.difficulty(F.col("n"), F.col("d"), F.col("k"), F.col("ok"), F.col("n")).alias("difficulty"))


@query("WITH a AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS attempt, l_discount > 0.07 AS passed, l_tax = 0.08 AS broken, CASE WHEN l_quantity > 5 THEN CAST(l_quantity AS VARCHAR) END AS t FROM lineitem), e AS (SELECT id, min(attempt) FILTER (passed OR broken) AS e, count(*) AS n FROM a GROUP BY id), l AS (SELECT id, arg_max(t, attempt) FILTER (t IS NOT NULL) AS last FROM a GROUP BY id) SELECT e.id, coalesce(a.passed, false) AS accepted, CAST(coalesce(e.e + 1, n) AS INTEGER) AS attempts, coalesce(a.t, last) AS text FROM e LEFT JOIN a ON a.id = e.id AND a.attempt = e.e LEFT JOIN l ON l.id = e.id")
def first_success_attempt(spark, sf_dir):
    place = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.row_number().over(place) - 1).alias("attempt"), (F.col("l_discount") > 0.07).alias("passed"), (F.col("l_tax") == 0.08).alias("broken"), F.when(F.col("l_quantity") > 5, F.col("l_quantity").cast("string")).alias("text"))
    return metrics.first_success(rows)


@query("WITH l AS (SELECT CASE WHEN quality = 1 THEN 'good' WHEN toxic = 1 THEN 'major' ELSE 'minor' END AS decision FROM labels) SELECT count(*) AS n, count(decision) AS n_reviewed, count(*) FILTER (decision = 'major') AS n_major, count(*) >= 100 AND count(decision) = count(*) AND count(*) FILTER (decision = 'major') = 0 AS approved FROM l")
def review_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(F.when(F.col("quality") == 1, "good").when(F.col("toxic") == 1, "major").otherwise("minor").alias("decision"))
    return metrics.review_gate(rows, 100)
