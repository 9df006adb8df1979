"""The attempt loop: a generator answers prompts, checks judge, and what did not end is asked again, one durable step an attempt."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.text import parse_reasoning
from quillon.operators.gates import chosen_answer, wants_second
from quillon.sources.io import exists

MOST, FIRST_SEED, SEEDS_APART = 3, 42, 100
#: Columns that an attempt makes, and what it comes to: the first two verdicts end a row's attempts.
MADE = ("text", "tokens", "ended", "parsed", "reasoning", "answer", "results", "seed")
ACCEPTED, BROKEN, UNPARSED, CUT, FAILED = "accepted", "checker_error", "missing_or_empty_thinking_delimiter", "max_new_tokens_reached", "constraint_check_failed"


class Sampler(Protocol):
    """Answers prompts, each with its seed. Gives text, tokens and whether it came to an end by itself. Made once a task by a factory."""

    def __call__(self, prompts: list[str | None], seeds: list[int]) -> list[tuple[str | None, int, bool]]: ...


def sampled(rows: DataFrame, factory: Callable[[], Sampler], prompt: str = "prompt", seed: str = "seed") -> DataFrame:
    """rows with text, tokens and ended, from one answer to each. Columns of these names are replaced; ValueError where the sampler gives another number of answers."""
    more = [T.StructField("text", T.StringType()), T.StructField("tokens", T.LongType()), T.StructField("ended", T.BooleanType())]
    rows = rows.drop(*(f.name for f in more))
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = None
        for batch in batches:
            if not batch.num_rows:
                continue
            sampler = sampler or factory()
            got = list(sampler(batch.column(prompt).to_pylist(), batch.column(seed).to_pylist()))
            if len(got) != batch.num_rows:
                raise ValueError(f"{len(got)} answers for {batch.num_rows} prompts")
            own = [pa.array([x[k] for x in got], t) for k, t in enumerate((pa.string(), pa.int64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], [*names, *(f.name for f in more)])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *more]))


def _done(spark: SparkSession, step: str) -> bool:
    """A step counts once all its tasks' files are committed: an interrupted one is made anew."""
    return exists(spark, f"{step}/_SUCCESS")


def attempts(
    prompts: DataFrame, factory: Callable[[], Sampler], results: Callable[[Column], Column], path: str, key: str = "id", prompt: str = "prompt", place: str | None = None, most: int = MOST, max_tokens: int = 1024, finished: DataFrame | None = None
) -> DataFrame:
    """A record for each attempt: key, attempt (from 0), text, tokens, reasoning, answer, results, verdict.

    Attempt k is a table at path/attempt-k of the rows that no attempt before has ended; those that it does not end are in it with all their columns (but those named like a record's), so attempt
    k + 1 reads them from there, without a join. Called again
    with the same path after any interruption, steps that are whole are read, no prompt of theirs is asked again, and the rest goes on. results gives, for a column of
    answers, an array of booleans over the prompts' columns, null where the checks cannot be made: that ends a row, as does an array that is all true. finished: keys
    of earlier runs, which are left out. The seed of an attempt is 42 + 100 * place + attempt; without a place (a number of each row's own) the key's hash is one, so a rerun asks the same.
    Keys must be unique and not null: a row without one fails the query.
    """
    spark = prompts.sparkSession
    sure = F.when(F.assert_true(F.col(key).isNotNull(), "a prompt has no key").isNull(), F.col(key))
    left = prompts.withColumn(key, sure)
    if finished is not None:
        left = left.join(finished.select(key).distinct(), key, "left_anti")
    number = F.col(place).cast("long") if place else F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 40))
    steps: list[str] = []
    for k in range(most):
        step = f"{path}/attempt-{k}"
        if not _done(spark, step):
            asked = spark.read.parquet(steps[-1]).filter("row is not null").select("row.*") if steps else left
            asked = asked.withColumn("seed", FIRST_SEED + SEEDS_APART * number + k)
            got = sampled(asked, factory, prompt).withColumn("parsed", parse_reasoning(F.col("text")))
            got = got.withColumns({"reasoning": F.col("parsed")["reasoning"], "answer": F.col("parsed")["answer"]})
            got = got.withColumn("results", results(F.col("answer")))
            cut = (F.col("tokens") >= max_tokens) & ~F.col("ended")
            verdict = F.when(F.col("parsed").isNull(), UNPARSED).when(F.col("results").isNull(), BROKEN).when(cut, CUT).when(F.forall("results", lambda x: x), ACCEPTED).otherwise(FAILED)
            row = F.struct(*(F.col(f"`{c}`") for c in left.columns if c not in MADE))  # what the next attempt needs, of the rows that it asks
            record = got.select(key, F.lit(k).alias("attempt"), "text", "tokens", cut.alias("cut"), "reasoning", "answer", "results", verdict.alias("verdict"), row.alias("row"))
            record.withColumn("row", F.when(~F.col("verdict").isin(ACCEPTED, BROKEN), F.col("row"))).write.mode("overwrite").parquet(step)
        steps.append(step)
        if not spark.read.parquet(step).filter(~F.col("verdict").isin(ACCEPTED, BROKEN)).take(1):
            break
    return reduce(DataFrame.unionByName, (spark.read.parquet(s).drop("row") for s in steps))


def outcomes(records: DataFrame, key: str = "id") -> DataFrame:
    """One row for each key: accepted, attempts, first_pass, reason (null: accepted), and the candidate: the last attempt that could be parsed, null where none could."""
    parsed = F.col("answer").isNotNull()
    last = F.max(F.struct("attempt", "verdict"))
    candidate = F.max_by(F.struct("text", "tokens", "reasoning", "answer", "results"), F.when(parsed, F.col("attempt")))
    r = records.groupBy(key).agg(last.alias("last"), candidate.alias("candidate"))
    accepted = F.col("last")["verdict"] == ACCEPTED
    return r.select(key, accepted.alias("accepted"), (F.col("last")["attempt"] + 1).alias("attempts"), (accepted & (F.col("last")["attempt"] == 0)).alias("first_pass"), F.when(~accepted, F.col("last")["verdict"]).alias("reason"), "candidate.*")


def attempt_audit(records: DataFrame, key: str = "id") -> DataFrame:
    """A17 over records: attempts, rows, accepted and rejected ones, the share of attempts that were retries, answers cut off, checks that could not be made."""
    ended = F.max_by("verdict", "attempt")
    rows = records.groupBy(key).agg(F.count("*").alias("n"), F.count_if("cut").alias("n_cut"), ended.alias("v"))
    r = rows.agg(F.sum("n").alias("attempts"), F.count("*").alias("rows"), F.count_if(F.col("v") == ACCEPTED).alias("accepted"), F.count_if(F.col("v") == BROKEN).alias("checker_errors"), F.sum("n_cut").alias("cut"))
    return r.withColumn("rejected", F.col("rows") - F.col("accepted")).withColumn("retry_rate", F.try_divide(F.col("attempts") - F.col("rows"), F.col("attempts")))


def asked_again(rows: DataFrame, factory: Callable[[], Sampler], second: Callable[[], Sampler], path: str, key: str = "id", prompt: str = "prompt", seed: str = "seed", max_tokens: int = 1024) -> DataFrame:
    """Key, answer, fallback and tokens of both. Every prompt is asked once (path/first); those whose answer is empty, cut off or not closed are asked a second
    time of another sampler (path/second), whose answer counts unless it is empty. Steps that are whole are not made again."""
    spark = rows.sparkSession
    one = F.struct(F.col("text").alias("answer"), ((F.col("tokens") >= max_tokens) & ~F.col("ended")).alias("clipped"), (F.contains(F.col("text"), F.lit("<think>")) & ~F.contains(F.col("text"), F.lit("</think>"))).alias("unclosed"), "tokens")
    shape = F.struct(F.coalesce(one["answer"], F.lit("")).alias("answer"), F.coalesce(one["clipped"], F.lit(False)).alias("clipped"), F.coalesce(one["unclosed"], F.lit(False)).alias("unclosed"), one["tokens"].alias("tokens"))
    if not _done(spark, f"{path}/first"):
        sampled(rows.select(key, prompt, seed), factory, prompt, seed).select(key, shape.alias("first")).write.mode("overwrite").parquet(f"{path}/first")
    first = spark.read.parquet(f"{path}/first")
    if not _done(spark, f"{path}/second"):
        again = rows.select(key, prompt, seed).join(first.filter(wants_second(F.col("first"))).select(key), key, "left_semi")
        sampled(again, second, prompt, seed).select(key, F.struct(F.col("text").alias("answer"), "tokens").alias("second")).write.mode("overwrite").parquet(f"{path}/second")
    both = first.join(spark.read.parquet(f"{path}/second"), key, "left")
    return both.select(key, chosen_answer(F.col("first"), F.col("second")).alias("x")).select(key, "x.*")
