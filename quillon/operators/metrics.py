"""Counts, summaries and per-turn metrics. All are one aggregate, with partial sums before the shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.operators.ranks import running
from quillon.sources.spread import written


def distribution(rows: DataFrame, *fields: str) -> DataFrame:
    """A1, A25."""
    return rows.groupBy(*fields).agg(F.count("*").alias("n"))


def manifest_counts(rows: DataFrame, fields: list[str]) -> DataFrame:
    """A2: counts by each field in one pass: field, value, n."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields)))
    return rows.select(pairs.alias("x")).groupBy("x.field", "x.value").agg(F.count("*").alias("n"))


def medians(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """by and `median`, the exact one of each group (null values are none; a group without others has null). Distinct values are counted first and their
    counts summed range by range, so no task holds a group's values."""
    counts = written(rows.groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c")), "counts")
    places = running(counts.filter("_v is not null"), by, ["_v"], F.col("_c"), "_le")
    n = counts.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("_v").isNotNull(), F.col("_c"))), F.lit(0)).alias("_n"))
    n = n.select(*(F.col(c).alias(f"_{c}_") for c in by), "_n")
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in by), F.lit(True))
    # the values at the two middle places, the same one where their number is odd
    low, high = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    within = lambda k: F.max(F.when((F.col("_le") - F.col("_c") < k) & (k <= F.col("_le")), F.col("_v")))
    found = n.join(places, same, "left").groupBy(*(f"_{c}_" for c in by)).agg(((within(low) + within(high)) / 2).alias("median"))
    return found.select(*(F.col(f"_{c}_").alias(c) for c in by), "median")


def score_summary(rows: DataFrame, *values: str, by: list[str] | None = None) -> DataFrame:
    """A4: mean and exact median."""
    by = by or []
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), *(F.avg(v).alias(f"{v}_mean") for v in values))
    for v in values:
        m = medians(rows, v, by).select(*(F.col(c).alias(f"_{c}_of") for c in by), F.col("median").alias(f"{v}_median"))
        same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{c}_of")) for c in by), F.lit(True))
        out = out.join(m, same, "left").drop(*(f"_{c}_of" for c in by))
    return out.select(*by, "n", *(x for v in values for x in (f"{v}_mean", f"{v}_median")))


def uniqueness(rows: DataFrame, key: str) -> DataFrame:
    """A19, S18."""
    return rows.agg(F.count("*").alias("n"), F.count_distinct(key).alias("n_distinct"), (F.count(key) - F.count_distinct(key)).alias("n_again"))


def turn_metrics(answers: DataFrame, turn: str = "turn", strict: str = "strict", loose: str = "loose") -> DataFrame:
    """Per turn the prompts, instructions, the four accuracies and their mean. A prompt without instructions counts as right; a
    turn without any gives null for the instruction accuracies."""
    met = lambda c: F.size(F.filter(c, lambda x: x))
    parts = []
    for name, c in (("strict", strict), ("loose", loose)):
        parts += [F.avg(F.forall(c, lambda x: x).cast("int")).alias(f"{name}_prompt"), F.try_divide(F.sum(met(c)), F.sum(F.size(c))).alias(f"{name}_instruction")]
    out = answers.groupBy(turn).agg(F.count("*").alias("n_prompts"), F.sum(F.size(strict)).alias("n_instructions"), *parts)
    return out.withColumn("overall", (F.col("strict_prompt") + F.col("strict_instruction") + F.col("loose_prompt") + F.col("loose_instruction")) / 4)


def run_deltas(metrics: DataFrame, base: str, run: str = "run", turn: str = "turn", value: str = "overall") -> DataFrame:
    """Each run's mean over turns, and its distance from the base run."""
    means = metrics.groupBy(run).agg(F.avg(value).alias("mean"))
    return means.withColumn("delta", F.col("mean") - F.max(F.when(F.col(run) == base, F.col("mean"))).over(W.partitionBy()))  # one row a run


def generation_summary(turns: DataFrame) -> DataFrame:
    """Rows of seconds, tokens, clipped, empty, fallback, unclosed."""
    flags = ("clipped", "empty", "fallback", "unclosed")
    return turns.agg(F.count("*").alias("n_turns"), F.sum("seconds").alias("seconds"), F.avg("seconds").alias("mean_seconds"), F.sum("tokens").alias("tokens"), F.avg("tokens").alias("mean_tokens"), F.try_divide(F.sum("tokens"), F.sum("seconds")).alias("tokens_per_second"), *(F.count_if(f).alias(f"n_{f}") for f in flags))


def suite_summary(cases: DataFrame, category: str = "category", passed: str = "passed") -> DataFrame:
    """By category, and all together as the row with a null category, in one pass."""
    return cases.rollup(category).agg(F.count("*").alias("n"), F.count_if(passed).alias("n_passed"), F.avg(F.col(passed).cast("int")).alias("pass_rate"))


def plan_summary(plan: DataFrame) -> DataFrame:
    """By band and action: rows, mean budget, rows over it, the first five ids."""
    first = F.slice(F.array_sort(F.collect_set(F.when(F.col("place") <= 5, F.col("id")))), 1, 5)
    placed = plan.withColumn("place", F.row_number().over(W.partitionBy("band", "action").orderBy("id")))
    return placed.groupBy("band", "action").agg(F.count("*").alias("n"), F.avg("budget").alias("mean_budget"), F.count_if(F.col("tokens") > F.col("budget")).alias("n_over"), F.array_join(first, ",").alias("examples"))


def retry_audit(attempts: Column, accepted: Column, rejected: Column) -> Column:
    """Share of attempts that were retries; null without attempts."""
    return F.try_divide(attempts - accepted - rejected, attempts)


def midrank_percentile(rows: DataFrame, value: str) -> DataFrame:
    """Column percentile, (ranks below + ranks up to - 1) / 2 / (n - 1); 0.5 for a single row.

    Ranks come from the counts of distinct values, and those are summed range by range: no task sees them all.
    """
    counts = written(rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_eq")), "counts")
    places = running(counts, [], [value], F.col("_eq"), "_le")
    n = counts.agg(F.sum("_eq").alias("_n"))
    p = F.when(F.col("_n") == 1, 0.5).otherwise((2 * F.col("_le") - F.col("_eq") - 1) / 2 / (F.col("_n") - 1))
    return rows.join(places.crossJoin(n).select(value, p.alias("percentile")), value)  # one row beside each place


def percentile_of(scores: DataFrame, reference: DataFrame, value: str) -> DataFrame:
    """W7 for scores that the reference may not have: an unseen one takes its insertion place; clamped to 0..1."""
    counts = reference.groupBy(value).agg(F.count("*").alias("_c")).withColumn("_own", F.lit(0))
    asked = scores.select(value).distinct().withColumn("_c", F.lit(0).cast("long")).withColumn("_own", F.lit(1))
    all_ = counts.unionByName(asked).groupBy(value).agg(F.sum("_c").alias("_eq"), F.max("_own").alias("_own"))
    all_ = running(all_, [], [value], F.col("_eq"), "_le").filter("_own = 1").crossJoin(reference.agg(F.count("*").alias("_n")))
    p = F.when(F.col("_n") == 1, 0.5).when(F.col("_eq") == 0, F.col("_le") / (F.col("_n") - 1)).otherwise((2 * F.col("_le") - F.col("_eq") - 1) / 2 / (F.col("_n") - 1))
    return scores.join(all_.select(value, F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)).alias("percentile")), value)


def first_success(attempts: DataFrame, key: str = "id") -> DataFrame:
    """Attempts (attempt, passed, broken, text) to one row: the first that passed or broke ends the search; its text, else the last one's."""
    ended = F.col("passed") | F.col("broken")
    r = attempts.groupBy(key).agg(F.min(F.when(ended, F.struct("attempt", "passed", "text"))).alias("end"), F.max(F.when(F.col("text").isNotNull(), F.struct("attempt", "text"))).alias("last"), F.count("*").alias("n"))
    return r.select(key, F.coalesce(F.col("end")["passed"], F.lit(False)).alias("accepted"), F.coalesce(F.when(F.col("end").isNotNull(), F.col("end")["attempt"] + 1), F.col("n")).cast("int").alias("attempts"), F.coalesce(F.when(F.col("end").isNotNull(), F.col("end")["text"]), F.col("last")["text"]).alias("text"))


def review_gate(decisions: DataFrame, wanted: int) -> DataFrame:
    """Approved only if all are reviewed and none is major."""
    r = decisions.agg(F.count("*").alias("n"), F.count("decision").alias("n_reviewed"), F.count_if(F.col("decision") == "major").alias("n_major"))
    return r.withColumn("approved", (F.col("n") >= wanted) & (F.col("n_reviewed") == F.col("n")) & (F.col("n_major") == 0))


def coverage(rows: DataFrame, pool: int, key: str, step: str) -> DataFrame:
    """Per step, the share of the pool seen so far: the first step of each key, then a running sum over steps."""
    first = rows.groupBy(key).agg(F.min(step).alias(step))
    new = first.groupBy(step).agg(F.count("*").alias("n_new"))
    upto = W.orderBy(step).rowsBetween(W.unboundedPreceding, 0)
    return new.withColumn("coverage", F.sum("n_new").over(upto) / pool)
