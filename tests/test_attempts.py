"""The attempt loop: who is asked when, what an interruption costs, and odd rows."""

import os

import pytest
from pyspark.sql import functions as F

from quillon.operators import attempts

KIND = "id string, prompt string, want int"


def logged(log, breaks=()):
    """A factory: passes a prompt at the attempt that its text names; writes down what it is asked, and breaks down at the attempts in `breaks`."""

    def answer(prompts, seeds):
        out = []
        for p, s in zip(prompts, seeds):
            k = (s - 42) % 100
            if k in breaks:
                raise RuntimeError("the machine is gone")
            with open(f"{log}/{os.getpid()}", "a") as f:
                f.write(f"{p} {k}\n")
            text = "<think>no end" if p == "never" else "<think>r</think>" + ("good" if k >= int(p) else "bad")
            out.append((text, 5, True))
        return out

    return lambda: answer


def asked(log):
    return sorted(tuple(x.split()) for f in os.listdir(log) for x in open(f"{log}/{f}").read().splitlines())


def results(answer):
    return F.when(F.col("want") != 9, F.array(answer == "good", F.lit(True)))


@pytest.fixture
def prompts(spark):
    return spark.createDataFrame([("a", "0", 1), ("b", "1", 1), ("c", "2", 1), ("d", "7", 1), ("e", "never", 1), ("f", "1", 9)], KIND)


WANT = {"a": (True, 1, None, "good"), "b": (True, 2, None, "good"), "c": (True, 3, None, "good"), "d": (False, 3, "constraint_check_failed", "bad"), "e": (False, 3, "missing_or_empty_thinking_delimiter", None), "f": (False, 1, "checker_error", "bad")}


def said(records):
    return {r.id: (r.accepted, r.attempts, r.reason, r.answer) for r in attempts.outcomes(records).collect()}


def test_only_what_is_open_is_asked(spark, prompts, tmp_path):
    os.mkdir(log := f"{tmp_path}/log")
    records = attempts.attempts(prompts, logged(log), results, f"{tmp_path}/run")
    assert said(records) == WANT
    assert asked(log) == sorted([("0", "0"), ("1", "0"), ("1", "0"), ("1", "1"), ("2", "0"), ("2", "1"), ("2", "2"), ("7", "0"), ("7", "1"), ("7", "2"), ("never", "0"), ("never", "1"), ("never", "2")])
    r = attempts.attempt_audit(records).first()
    assert (r.attempts, r.rows, r.accepted, r.rejected, r.checker_errors, r.cut) == (13, 6, 3, 3, 1, 0) and r.retry_rate == pytest.approx(7 / 13)
    again = attempts.attempts(prompts, logged(log, breaks=(0, 1, 2)), results, f"{tmp_path}/run")
    assert said(again) == WANT and len(asked(log)) == 13  # nothing is asked a second time


@pytest.mark.parametrize("at", [0, 1, 2])
def test_interrupted_between_attempts(spark, prompts, tmp_path, at):
    os.mkdir(log := f"{tmp_path}/log")
    with pytest.raises(Exception, match="the machine is gone"):
        attempts.attempts(prompts, logged(log, breaks=(at,)), results, f"{tmp_path}/run")
    before = asked(log)
    assert {int(k) for _, k in before} == set(range(at)) and not os.path.exists(f"{tmp_path}/run/attempt-{at}/_SUCCESS")
    assert said(attempts.attempts(prompts, logged(log), results, f"{tmp_path}/run")) == WANT
    after = asked(log)
    assert [x for x in after if int(x[1]) < at] == before and len(after) == 13


def test_rows_of_earlier_runs_and_odd_rows(spark, prompts, tmp_path):
    os.mkdir(log := f"{tmp_path}/log")
    got = said(attempts.attempts(prompts, logged(log), results, f"{tmp_path}/a", finished=spark.createDataFrame([("a",), ("d",), ("d",)], "id string")))
    assert got == {k: v for k, v in WANT.items() if k not in "ad"}
    assert attempts.attempts(prompts.limit(0), logged(log), results, f"{tmp_path}/b").count() == 0
    with pytest.raises(Exception, match="no key"):
        attempts.attempts(prompts.withColumn("id", F.nullif("id", F.lit("b"))), logged(log), results, f"{tmp_path}/c")
    with pytest.raises(Exception, match="1 answers for"):
        attempts.attempts(prompts.repartition(1), lambda: lambda p, s: [("x", 1, True)], results, f"{tmp_path}/d")
    odd = prompts.filter("id = 'a'").select("*", F.lit("x").alias("text"), F.lit(1).alias("tokens"))
    assert said(attempts.attempts(odd, logged(log), results, f"{tmp_path}/e")) == {"a": WANT["a"]}


def test_a_second_sampler(spark, tmp_path):
    texts = {"1": ("fine", 3, True), "2": (" ", 3, True), "3": ("<think>open", 3, True), "4": ("long", 64, False), "5": (None, 0, True)}
    rows = spark.createDataFrame([(k, k, 0) for k in texts], "id string, prompt string, seed int")
    again = lambda: lambda p, s: [("" if x == "4" else f"again {x}", 2, True) for x in p]
    got = {r.id: (r.answer, r.fallback, r.tokens) for r in attempts.asked_again(rows, lambda: lambda p, s: [texts[x] for x in p], again, f"{tmp_path}/x", max_tokens=64).collect()}
    assert got == {"1": ("fine", False, 3), "2": ("again 2", True, 5), "3": ("again 3", True, 5), "4": ("long", False, 66), "5": ("again 5", True, 2)}
