"""Processors over the state store: restarts, hand-over of state, bounds."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import rewards
from quillon.operators.sampling import hash_limit
from quillon.streaming import stateful

KIND = "category string, step long, rate double"


def last(rows):
    r = rewards.emas(rows).groupBy("category").agg(F.max_by(F.struct("slow", "fast", "stagnant"), "step").alias("s")).collect()
    return {x.category: (round(x.s.slow, 9), round(x.s.fast, 9), x.s.stagnant) for x in r}


def test_state_is_handed_over(spark, tmp_path):
    rng = random.Random(4)
    rows = spark.createDataFrame([(c, i, round(rng.random(), 2) if c == "a" else 0.5) for c in "ab" for i in range(30)] + [("early", 1, 0.25)], KIND)
    parts = [rows.filter(F.col("step").between(a, b)) for a, b in ((0, 6), (7, 19), (20, 29))]
    got = stateful.handed_over(parts, f"{tmp_path}/x").collect()
    assert {r.category: (round(r.slow, 9), round(r.fast, 9), r.stagnant) for r in got} == last(rows)
    first = stateful.state_of(spark, f"{tmp_path}/x/run-0/checkpoint", "averages").select("key.category", "value.*").collect()
    assert {r.category: (round(r.slow, 9), round(r.fast, 9), r.stagnant) for r in first} == last(parts[0])
    again = stateful.handed_over(parts, f"{tmp_path}/x")  # whole runs leave their state as it is
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got))


def test_a_snapshot_is_checked(spark):
    made = lambda *rows: stateful.checked(spark.createDataFrame(rows, "category string, slow double, fast double, last double, stagnant int"))
    assert tuple(made(("a", 0.5, None, None, None)).first()) == ("a", 0.5, 0.5, 0.5, 0)
    for bad in ([("a", 1.5, 0.1, 0.1, 0)], [("a", float("nan"), 0.1, 0.1, 0)], [("a", 0.5, 0.1, 0.1, 0)] * 2):
        with pytest.raises(Exception, match="out of bounds"):
            made(*bad).collect()


def steps(spark, flags):
    return spark.createDataFrame([(k, i, f) for k, fs in flags.items() for i, f in fs], "run_id string, step long, signal boolean")


def test_a_run_stops_across_restarts(spark, tmp_path):
    flags = {"quiet": [(i, False) for i in range(9)], "loud": [(i, i % 3 == 0) for i in range(9)], "late": [(i, i < 5) for i in range(9)]}
    parts = [steps(spark, {k: [x for x in v if x[0] // 2 == b] for k, v in flags.items()}) for b in range(5)]
    got = {r.run_id: (r.stopped_at, r.run) for r in stateful.drained_health(parts, 4, f"{tmp_path}/h").collect()}
    assert got == {"quiet": (3, 4), "late": (8, 4)}


def test_the_watch_raises_and_counts_on(spark, tmp_path):
    def run(a, b):
        steps(spark, {"r": [(i, False) for i in range(a, b)]}).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stateful.watch(spark.readStream.schema("run_id string, step long, signal boolean").parquet(f"{tmp_path}/in"), f"{tmp_path}/c", most=5)

    run(0, 2)
    run(2, 4)
    with pytest.raises(Exception, match="5 steps in a row"):
        run(4, 5)


def test_reservoir_has_bounded_state(spark, tmp_path):
    rows = spark.range(900).select(F.col("id").cast("string").alias("id")).repartition(6)
    want = {r.id for r in hash_limit(rows, 40).collect()}
    got = stateful.reservoir(rows, 40, "id", parts=3, path=f"{tmp_path}/r")
    assert {r.key for r in got.collect()} == want and len(want) == 40
    kept = spark.read.format("statestore").option("stateVarName", "kept").option("flattenCollectionTypes", True).load(f"{tmp_path}/r/checkpoint")
    assert kept.count() == 3 * 40
    batches = spark.read.parquet(f"{tmp_path}/r/out")
    assert batches.agg(F.max("n")).first()[0] <= 40
