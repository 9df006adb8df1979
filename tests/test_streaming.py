"""State, snapshots and the health monitor."""

import pytest
from pyspark.sql import functions as F

from quillon.operators import rewards
from quillon.streaming import state


def test_stream_equals_batch(spark):
    rows = spark.createDataFrame([("k", i, (i * 37 % 11) / 11) for i in range(12)] + [("s", i, 0.5) for i in range(5)], "category string, step long, rate double")
    stream = {r.category: (round(r.slow, 9), round(r.fast, 9), r.stagnant) for r in state.drained_emas(rows).collect()}
    last = rewards.emas(rows).groupBy("category").agg(F.max_by(F.struct("slow", "fast", "stagnant"), "step").alias("s")).collect()
    assert stream == {r.category: (round(r.s.slow, 9), round(r.s.fast, 9), r.s.stagnant) for r in last}


def test_appended_once(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v int")
    assert sorted(map(tuple, state.appended_once(rows, ["k"]).collect())) == [("a", 1), ("b", 2)]


def test_monitor(spark):
    m = state.HealthMonitor(most=2)
    quiet, loud = (spark.createDataFrame([(x,)], "signal boolean") for x in (False, True))
    m(quiet)
    m(loud)
    m(quiet)
    with pytest.raises(RuntimeError, match="2 batches"):
        m(quiet)


def test_snapshot(spark, tmp_path):
    s = spark.createDataFrame([("k", 0.5, None, 0.5, 0)], "category string, slow double, fast double, last double, stagnant int")
    state.snapshot(s, f"{tmp_path}/s", beta=0.9)
    assert state.restored(spark, f"{tmp_path}/s", beta=0.9).first().fast == 0.5
    with pytest.raises(ValueError, match="parameters"):
        state.restored(spark, f"{tmp_path}/s", beta=0.8)
    state.snapshot(s.withColumn("slow", F.lit(1.5)), f"{tmp_path}/s", beta=0.9)
    with pytest.raises(ValueError, match="bounds"):
        state.restored(spark, f"{tmp_path}/s", beta=0.9)


def test_monitor_counts_on_after_a_restart(spark, tmp_path):
    flat = spark.createDataFrame([(False,)], "signal boolean")
    for number in range(2):
        state.HealthMonitor(3, str(tmp_path / "runs"))(flat, number)
    state.HealthMonitor(3, str(tmp_path / "runs"))(flat, 1)  # the batch runs again
    with pytest.raises(RuntimeError):
        state.HealthMonitor(3, str(tmp_path / "runs"))(flat, 2)


def test_reservoir_is_the_sample_of_the_whole(spark):
    from quillon.operators.sampling import hash_limit

    rows = spark.range(500).select(F.col("id").cast("string").alias("id")).repartition(4)
    want = {r.id for r in hash_limit(rows, 40).collect()}
    assert {r.id for r in state.reservoir(rows, 40, "id").collect()} == want and len(want) == 40


def test_filters_spare_parts(spark, tmp_path):
    """New keys read (next to) no part, repeats their own only, and nothing is dropped or doubled; filters that outgrow their room are made anew."""
    def put(a, b):
        rows = spark.range(a, b).select(F.concat(F.lit("k"), "id").alias("k"), (F.col("id") % 7).alias("v"))
        return state.append_new(rows, f"{tmp_path}/t", ["k"])

    def held():
        r = spark.read.parquet(f"{tmp_path}/t").agg(F.count("*").alias("n"), F.count_distinct("k").alias("d")).first()
        return (r.n, r.d)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(state, "PARTS", 16)
        m.setattr(state, "FILTER_ROOM", 32)
        assert put(0, 400) == [] and held() == (400, 400)
        assert len(put(400, 900)) <= 3 and held() == (900, 900)  # new keys only: a few by chance
        assert put(900, 1500) is not None and held() == (1500, 1500)  # by now some filters were made anew
        assert len(put(10, 12)) in (1, 2) and held() == (1500, 1500)
        assert len(put(1400, 1600)) == 16 and held() == (1600, 1600)
        full = spark.read.parquet(f"{tmp_path}/t-filters")
        assert full.filter("n > room or bits is null").count() == 0 and full.agg(F.sum("n")).first()[0] == 1600
        (tmp_path / "t-filters").rename(tmp_path / "lost")  # without filters every part is read, and nothing is doubled
        assert len(put(0, 200)) == 16 and held() == (1600, 1600)
    odd = spark.createDataFrame([(None, 1), (None, 1), ("a", None)], "k string, v int")
    for _ in range(2):
        state.append_new(odd, f"{tmp_path}/odd", ["k", "v"])
    assert spark.read.parquet(f"{tmp_path}/odd").count() == 2


def test_weights_of_a_batch_stay(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.0)], "k string, x double")
    use = lambda batch, w: batch.join(w, "k")
    update = lambda batch, w: w.join(batch, "k").select("k", (F.col("w") + F.col("x")).alias("w"))
    run = state.weighted_batches(rows, spark.createDataFrame([("a", 0.0)], "k string, w double"), use, update, f"{tmp_path}/p", every=2)
    for n in (0, 1, 2, 1, 2, 3, 4):  # some run again
        run(rows, n)
    got = {r.batch: r.w for r in spark.read.parquet(f"{tmp_path}/p/out").collect()}
    assert got == {0: 0.0, 1: 0.0, 2: 2.0, 3: 2.0, 4: 4.0}
