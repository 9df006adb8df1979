"""Eligibility with reasons, gates before a run, and the choice between a first answer and a second."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import EXPLICIT_CONSTRAINT, cased_prompt_key, strip
from quillon.operators.restructure import parse_message
from quillon.operators.validate import first_reason

# Bounds of prompts that a guardrail set takes.
LEAST_CHARS, MOST_CHARS, LEAST_SCORE = 20, 1500, 52.0


def source_reason(rows: DataFrame, quotas: list[str], boundary: DataFrame, least: float = LEAST_SCORE, key: str = "k") -> DataFrame:
    """column reason, the first ground for removal (task without quota, low score, in the boundary, constrained already), null for eligible rows."""
    marks = boundary.select(key).distinct().withColumn("_in", F.lit(True))
    reason = first_reason((~F.coalesce(F.col("bucket").isin(*quotas), F.lit(False)), "task"), (F.coalesce(F.col("score") < least, F.lit(True)), "score"), (F.coalesce("_in", F.lit(False)), "boundary"), (F.coalesce(F.col("question"), F.lit("")).rlike(EXPLICIT_CONSTRAINT), "constrained"))
    return rows.join(marks, key, "left").withColumn("reason", reason).drop("_in")


def guardrail_reason(rows: DataFrame, quotas: list[str], used: DataFrame, excluded: dict[str, str], least: float = LEAST_SCORE) -> DataFrame:
    """As source_reason, for a guardrail set: also ids in use, ids excluded by hand, length, and broken characters."""
    marks = used.select("id").distinct().withColumn("_in", F.lit(True))
    q = strip(F.coalesce("question", F.lit("")))
    by_hand = F.col("id").isin(*excluded) if excluded else F.lit(False)
    reason = first_reason(
        (~F.coalesce(F.col("bucket").isin(*quotas), F.lit(False)), "task"), (F.coalesce("_in", F.lit(False)), "in use"), (by_hand, "excluded"), (~F.length(q).between(LEAST_CHARS, MOST_CHARS), "length"),
        (F.coalesce("k", F.lit("")) == "", "no key"), (q.contains("�"), "broken characters"), (F.coalesce(F.col("score") < least, F.lit(True)), "score"),
    )
    return rows.join(marks, "id", "left").withColumn("reason", reason).drop("_in")


def reason_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("reason", F.lit("eligible")).alias("reason")).agg(F.count("*").alias("n"))


def prompt_set(turns: list[Column], normal: bool = False) -> Column:
    """K6: distinct keys of a row's turns that are there; the query fails on a cell that is no JSON."""
    keys = []
    for c in turns:
        full = F.nullif(F.nullif(c, F.lit("")), F.lit("None"))
        sure = F.assert_true(full.isNull() | F.try_parse_json(full).isNotNull(), "a turn is not JSON")
        keys.append(F.when(sure.isNull(), cased_prompt_key(parse_message(c), normal)))
    return F.array_distinct(F.array_compact(F.array(*keys)))


def benchmark_problems(rows: DataFrame, columns: list[str], key: str, expected: int) -> list[str]:
    """what is wrong with a benchmark table."""
    if gone := [c for c in columns if c not in rows.columns]:
        return [f"columns missing: {gone}"]
    r = rows.agg(F.count("*").alias("n"), F.count_distinct(key).alias("d"), F.count_if(F.coalesce(F.col(key).cast("string"), F.lit("")) == "").alias("e")).first()
    return [x for bad, x in ((r["n"] != expected, f"{r['n']} rows instead of {expected}"), (r["e"] > 0, f"{r['e']} empty keys"), (r["d"] != r["n"] - r["e"], "keys occur again")) if bad]


def too_long(rows: DataFrame, ids: str, most: int) -> DataFrame:
    """F32: rows whose ids are more than most. Counts the ids themselves."""
    return rows.filter(F.size(ids) > most)


def prompt_lengths(rows: DataFrame, ids: str) -> DataFrame:
    """A24."""
    return rows.agg(F.max(F.size(ids)).alias("max"), F.avg(F.size(ids)).alias("mean"))


def wants_second(first: Column) -> Column:
    """An answer that is empty, clipped or not closed is asked for again. first: struct of answer, clipped, unclosed."""
    return (strip(F.coalesce(first["answer"], F.lit(""))) == "") | first["clipped"] | first["unclosed"]


def chosen_answer(first: Column, second: Column) -> Column:
    """The second answer where it was wanted and is not empty, else the first: answer, fallback, tokens of both."""
    used = F.coalesce(wants_second(first) & (strip(F.coalesce(second["answer"], F.lit(""))) != ""), F.lit(False))
    return F.struct(F.when(used, second["answer"]).otherwise(first["answer"]).alias("answer"), used.alias("fallback"), (F.coalesce(first["tokens"], F.lit(0)) + F.when(wants_second(first), F.coalesce(second["tokens"], F.lit(0))).otherwise(0)).alias("tokens"))


def first_of_each(rows: DataFrame, by: str, order: str) -> DataFrame:
    """The first row of each class."""
    return rows.groupBy(by).agg(F.min_by(F.struct(*[c for c in rows.columns if c != by]), order).alias("r")).select(by, "r.*")


def compression_audit(rows: DataFrame) -> DataFrame:
    """Rows of before and after (tokens) and reason (null: accepted)."""
    ok = F.col("reason").isNull()
    before, after = F.sum(F.when(ok, F.col("before"))), F.sum(F.when(ok, F.col("after")))
    return rows.agg(F.count("*").alias("n"), F.count_if(ok).alias("n_accepted"), before.alias("before"), after.alias("after"), F.try_divide(after, before).alias("ratio"))


@dataclass(frozen=True)
class RunConfig:
    """numeric bounds; two runs may differ in the sampler only."""

    sampler: str = "uniform"
    batch: int = 8
    generations: int = 4
    learning_rate: float = 1e-6
    temperature: float = 1.0
    max_tokens: int = 1024
    buffer: int = 128

    def problems(self) -> list[str]:
        checks = ((self.batch > 0 and self.generations > 1, "batch and generations must be positive, generations over one"), (self.generations > 0 and self.batch % self.generations == 0, "the batch must be a multiple of the generations"), (0 < self.learning_rate < 1, "learning rate out of range"), (self.temperature > 0, "temperature must be positive"), (0 <= self.buffer < self.max_tokens, "the buffer must be under the token limit"))
        return [text for fine, text in checks if not fine]

    def differs_only_in_sampler(self, other: RunConfig) -> bool:
        return all(getattr(self, f.name) == getattr(other, f.name) for f in fields(self) if f.name != "sampler")
