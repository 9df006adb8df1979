"""Rewards from check results, group statistics, and the state of adaptive sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.scores import learnability, progress_signal, soft_overlong
from quillon.functions.text import parse_reasoning, strip
from quillon.operators.ranks import Series

# The parts of the core reward.
INSTRUCTION_SHARE, PROMPT_SHARE = 0.7, 0.3


def reward_parts(results: Column) -> tuple[Column, Column, Column]:
    """A5: share of instructions met, 1 if all are (and there is one), and the core of both."""
    n, met = F.coalesce(F.size(results), F.lit(0)), F.coalesce(F.size(F.filter(results, lambda x: x)), F.lit(0))
    one = F.when(n > 0, met / n).otherwise(0.0)
    all_ = F.when((n > 0) & (met == n), 1.0).otherwise(0.0)
    return one, all_, INSTRUCTION_SHARE * one + PROMPT_SHARE * all_


def completion_parts(completion: Column) -> Column:
    """Struct of answer, reasoning_missing and answer_only_fallback. An unparsable text counts as an answer alone unless it shows a tag of reasoning."""
    parsed = parse_reasoning(completion)
    bare = parsed.isNull() & ~F.coalesce(completion, F.lit("")).contains("think>") & (strip(F.coalesce(completion, F.lit(""))) != "")
    return F.struct(F.when(parsed.isNotNull(), parsed["answer"]).when(bare, strip(completion)).alias("answer"), parsed.isNull().alias("reasoning_missing"), bare.alias("answer_only_fallback"))


def reward(core: Column, tokens: Column, most: int, buffer: int, penalised: bool) -> Column:
    """With the penalty of overlong completions where asked for."""
    return core + soft_overlong(tokens, most, buffer) if penalised else core


def category_rates(rows: DataFrame, ids: str, results: str, by: list[str] | None = None) -> DataFrame:
    """Share of checks met for each category (the prefix of its ids)."""
    by = by or []
    flat = rows.select(*by, F.explode(F.arrays_zip(F.col(ids).alias("i"), F.col(results).alias("r"))).alias("x"))
    return flat.groupBy(*by, F.split_part("x.i", F.lit(":"), F.lit(1)).alias("category")).agg(F.avg(F.col("x.r").cast("int")).alias("rate"), F.count("*").alias("n"))


def group_advantages(rows: DataFrame, group: list[str], value: str = "reward", eps: float = 1e-4) -> DataFrame:
    """Advantage, 0 in a group of one."""
    w = W.partitionBy(*group)
    return rows.withColumn("advantage", F.coalesce((F.col(value) - F.avg(value).over(w)) / (F.stddev_samp(value).over(w) + eps), F.lit(0.0)))


def zero_variance(value: str = "reward", tolerance: float = 1e-8) -> Column:
    """A10, an aggregate."""
    return (F.count("*") < 2) | (F.max(value) - F.min(value) < tolerance)


def has_signal(advantages: Column, tolerance: float = 1e-8) -> Column:
    """A22, of nested arrays."""
    return F.exists(F.flatten(advantages), lambda a: F.abs(a) > tolerance)


def token_loss(losses: Column, weights: Column) -> Column:
    """A21 of nested arrays: the weighted mean over all tokens, 0 without weight; the query fails where lengths differ."""
    same = F.forall(F.zip_with(losses, weights, lambda a, b: F.size(a).eqNullSafe(F.size(b))), lambda x: x) & (F.size(losses) == F.size(weights))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    w = F.flatten(weights)
    return F.when(F.assert_true(same, "losses and weights differ in number").isNull(), F.when(total(w) <= 0, 0.0).otherwise(total(F.zip_with(F.flatten(losses), w, lambda x, y: x * y)) / total(w)))


def structure_weighted_mean(loss: Column, structure: Column, n: Column, k: Column, m: float) -> Column:
    """Mean of a loss in which k structure tokens weigh m times."""
    return (loss * n + structure * (m - 1) * k) / (n + (m - 1) * k)


def emas(rows: DataFrame, category: str = "category", step: str = "step", rate: str = "rate", slow: float = 0.9, fast: float = 0.5, tolerance: float = 0.02) -> DataFrame:
    """Category, step, rate, and slow, fast, stagnant of each category after every step, by scans over ranges of its series: a series may be of any length.

    Steps must be unique in a category. For an endless series see streaming.state."""
    own = rows.select(category, F.col(step).cast("bigint").alias(step), F.col(rate).cast("double").alias("rate"))
    x = F.col("rate")
    series = Series(own, [category], [step]).before("was", "rate")
    still = F.when(F.abs(x - F.col("was")) <= tolerance, 1).otherwise(0)
    averages = {n: (F.lit(k), (1 - k) * x, x) for n, k in (("slow", slow), ("fast", fast))}
    return series.affine(**averages, stagnant=(still, still, F.lit(0))).frame().withColumn("stagnant", F.col("stagnant").cast("int")).drop("was")


def category_signals(state: DataFrame, patience: int = 3, scale: float = 0.25) -> DataFrame:
    """M1, M2 over state rows: learnability of the slow rate and progress of the fast one."""
    return state.withColumn("learnability", learnability(F.col("slow"))).withColumn("progress", progress_signal(F.col("slow"), F.col("fast"), F.col("stagnant"), patience, scale))


def prompt_weights(prompts: DataFrame, signals: DataFrame, key: str = "id", cats: str = "categories", signal: str = "learnability", blend: float = 0.5) -> DataFrame:
    """M4, M5: weight of each prompt, from the mean signal of its categories that have been seen."""
    flat = prompts.select(key, F.explode(cats).alias("category")).join(signals.select("category", F.col(signal).alias("v")), "category", "left")
    means = flat.groupBy(key).agg(F.avg("v").alias("value"))
    # bounds of the whole pool are one small aggregate, not a window over all prompts
    low, high = means.agg(F.min("value"), F.max("value")).first()
    v = F.col("value")
    scaled = F.lit(0.5) if low is None or high - low < 1e-12 else (v - low) / (high - low)
    inside = F.greatest(F.lit(0.5), F.least(F.lit(2.0), (1 - blend) + blend * scaled))
    return means.withColumn("weight", F.lit(1.0) if high is None or high <= 1e-12 else F.when(v.isNull(), 1.0).otherwise(inside))


def refresh_step(step: Column, every: int = 20) -> Column:
    """T-4: the step whose state the weights at this step are of; null before the first refresh."""
    return F.when(step >= every, F.floor(step / every) * every)


def runs(rows: DataFrame, flag: Column, order: str, by: list[str] | None = None) -> DataFrame:
    """Run, the number of rows in a row up to this one for which flag holds (a null does not). The order must be total; ranges of rows are counted side by side."""
    one = F.when(flag, 1).otherwise(0)
    return Series(rows.withColumn("_flag", one), by or [], [order]).affine(run=(F.col("_flag"), F.col("_flag"), F.col("_flag"))).frame().withColumn("run", F.col("run").cast("long")).drop("_flag")


def smoke_health(rows: DataFrame) -> DataFrame:
    """Rows of batches (parse_ok, signal, at_limit shares) to one verdict, the first gate that fails."""
    r = rows.agg(F.max("parse_ok").alias("best_parse"), F.bool_or("signal").alias("any_signal"), F.avg("at_limit").alias("limit_share"))
    verdict = F.coalesce(F.when(F.col("best_parse") <= 0, "nothing parsed"), F.when(~F.col("any_signal"), "no learning signal"), F.when(F.col("limit_share") >= 1, "all at the limit"), F.lit("healthy"))
    return r.withColumn("verdict", verdict)

