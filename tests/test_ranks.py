"""Scans over ranges of a series, and medians from counts, against plain loops."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from quillon.operators import metrics, ranks, rewards

KIND = "category string, step long, rate double"


@pytest.fixture
def small_ranges(spark):
    """More ranges than series: each series is cut."""
    for k, v in (("spark.sql.shuffle.partitions", "9"), ("spark.sql.adaptive.coalescePartitions.enabled", "false")):
        spark.conf.set(k, v)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def folded(rows, slow=0.9, fast=0.5, tolerance=0.02):
    out, state = {}, {}
    for c, step, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        if c not in state:
            state[c] = (x, x, 0, x)
        else:
            s, f, k, was = state[c]
            state[c] = (slow * s + (1 - slow) * x, fast * f + (1 - fast) * x, k + 1 if abs(x - was) <= tolerance else 0, x)
        out[c, step] = state[c][:3]
    return out


def test_averages_of_cut_series(spark, small_ranges):
    rng = random.Random(2)
    rows = [("long", i, rng.random() if i % 50 else 0.5) for i in range(700)] + [("flat", i * 3, 0.25) for i in range(60)] + [(None, i, i / 40) for i in range(40)] + [("one", 7, 0.1)]
    got = rewards.emas(spark.createDataFrame(rows, KIND).repartition(5)).collect()
    want = folded(rows)
    assert len(got) == len(rows) == len(want)
    for r in got:
        s, f, k = want[r.category, r.step]
        assert r.slow == pytest.approx(s, abs=1e-12) and r.fast == pytest.approx(f, abs=1e-12) and r.stagnant == k
    assert rewards.emas(spark.createDataFrame([], KIND)).count() == 0


def test_no_task_has_a_whole_series(spark, small_ranges):
    series = ranks.Series(spark.range(900).select((F.col("id") * 7 % 900).alias("step")), [], ["step"])
    assert series.rows.groupBy("_pid").count().agg(F.max("count")).first()[0] < 300


def test_runs_of_cut_series(spark, small_ranges):
    rng = random.Random(5)
    flags = [(k, i, rng.random() < 0.9 if i % 10 else None) for k in ("a", "b") for i in range(300)]
    df = spark.createDataFrame(flags, "k string, i int, f boolean")
    want, run = {}, 0
    for k, i, f in flags:
        run = run + 1 if f else 0
        want[k, i] = run = run if i or not f else 1
    assert {(r.k, r.i): r.run for r in rewards.runs(df, F.col("f"), "i", ["k"]).collect()} == want
    one = df.filter("k = 'a'")
    assert {r.i: r.run for r in rewards.runs(one, F.col("f"), "i").collect()} == {i: n for (k, i), n in want.items() if k == "a"}


def test_value_before(spark, small_ranges):
    rows = [("a", i, float(i * i)) for i in range(100)] + [("b", i, None if i % 3 else 1.0) for i in range(30)]
    got = {(r.category, r.step): r.was for r in ranks.Series(spark.createDataFrame(rows, KIND), ["category"], ["step"]).before("was", "rate").frame().collect()}
    by = {(c, s): x for c, s, x in rows}
    assert got == {(c, s): by.get((c, s - 1)) for c, s in by}


def test_medians(spark, small_ranges):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, rng.randint(-9, 9) / 4])) for _ in range(400)] + [("one", 3.0), ("none", None), ("two", 1.0), ("two", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double").withColumn("w", F.col("v") * 2)
    got = {r.g: r for r in metrics.score_summary(df, "v", "w", by=["g"]).collect()}
    assert set(got) == {"a", "b", None, "one", "none", "two"}
    for g, r in got.items():
        own = [v for k, v in rows if k == g and v is not None]
        assert r.n == sum(k == g for k, _ in rows) and r.v_median == (statistics.median(own) if own else None) and r.w_median == (2 * r.v_median if own else None)
        assert r.v_mean == (pytest.approx(sum(own) / len(own)) if own else None)
    whole = metrics.score_summary(df, "v").first()
    assert whole.v_median == statistics.median(v for _, v in rows if v is not None)
    assert metrics.score_summary(df.limit(0), "v", by=["g"]).count() == 0
