"""Moving averages of pass rates, stagnation, learnability and weights over the events; streams of the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import scores
from quillon.operators import rewards
from quillon.plans.registry import query, table
from quillon.sources.spread import written

# an event is a check: its type the category, its value over 50 a pass; 100 events make a step
_SERIES = "series AS (SELECT event_type AS category, event_id // 500 AS step, avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) AS rate FROM events GROUP BY ALL), placed AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY step) AS i FROM series)"
_STATE = f"""RECURSIVE {_SERIES}, fold(category, i, step, rate, slow, fast, stagnant) AS (
  SELECT category, i, step, CAST(rate AS DOUBLE), CAST(rate AS DOUBLE), CAST(rate AS DOUBLE), 0 FROM placed WHERE i = 1
  UNION ALL SELECT p.category, p.i, p.step, CAST(p.rate AS DOUBLE), CAST(0.9 * f.slow + 0.1 * p.rate AS DOUBLE), CAST(0.5 * f.fast + 0.5 * p.rate AS DOUBLE), CASE WHEN abs(p.rate - f.rate) <= 0.02 THEN f.stagnant + 1 ELSE 0 END
  FROM fold f JOIN placed p ON p.category = f.category AND p.i = f.i + 1)"""


def _series(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("category"), F.floor(F.col("event_id") / 500).alias("step"), (F.col("value") > 50).cast("double").alias("ok"))
    return rows.groupBy("category", "step").agg(F.avg("ok").alias("rate"))


@query(f"WITH {_STATE} SELECT category, step, round(rate, 6) AS rate, round(slow, 6) AS slow, round(fast, 6) AS fast FROM fold")
def ema_fast_slow(spark, sf_dir):
    return rewards.emas(_series(spark, sf_dir)).select("category", "step", *(F.round(c, 6).alias(c) for c in ("rate", "slow", "fast")))


@query(f"WITH {_STATE} SELECT category, step, stagnant FROM fold")
def stagnation_runs(spark, sf_dir):
    return rewards.emas(_series(spark, sf_dir)).select("category", "step", "stagnant")


_LAST = f"{_STATE}, last AS (SELECT f.* FROM fold f JOIN (SELECT category, max(i) AS i FROM placed GROUP BY category) m ON m.category = f.category AND m.i = f.i), sig AS (SELECT category, 4 * slow * (1 - slow) AS learn, 4 * fast * (1 - fast) * greatest(0, fast - slow) * CASE WHEN stagnant >= 3 THEN 0.25 ELSE 1 END AS progress FROM last)"


def _signals(spark, sf_dir):
    state = rewards.emas(_series(spark, sf_dir))
    last = state.groupBy("category").agg(F.max_by(F.struct("slow", "fast", "stagnant"), "step").alias("s")).select("category", "s.*")
    return written(rewards.category_signals(last), "signals")  # a row a category, read more than once


@query(f"WITH {_LAST} SELECT category, round(learn, 6) AS learnability, round(progress, 6) AS progress, round(CASE WHEN max(learn) OVER () - min(learn) OVER () < 1e-12 THEN 0.5 ELSE (learn - min(learn) OVER ()) / (max(learn) OVER () - min(learn) OVER ()) END, 6) AS scaled FROM sig")
def learnability(spark, sf_dir):
    rows = _signals(spark, sf_dir)
    return rows.select("category", F.round("learnability", 6).alias("learnability"), F.round("progress", 6).alias("progress"), F.round(scores.min_max(F.col("learnability")), 6).alias("scaled"))


@query(f"WITH {_LAST}, flat AS (SELECT DISTINCT user_id AS id, event_type AS category FROM events), v AS (SELECT id, avg(learn) AS v FROM flat LEFT JOIN sig USING (category) GROUP BY id), b AS (SELECT min(v) AS lo, max(v) AS hi FROM v) SELECT id, round(CASE WHEN hi <= 1e-12 OR v IS NULL THEN 1 ELSE greatest(0.5, least(2.0, 0.5 + 0.5 * CASE WHEN hi - lo < 1e-12 THEN 0.5 ELSE (v - lo) / (hi - lo) END)) END, 6) AS weight FROM v, b")
def sample_weights(spark, sf_dir):
    prompts = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.collect_set("event_type").alias("categories"))
    return rewards.prompt_weights(prompts, _signals(spark, sf_dir)).select("id", F.round("weight", 6).alias("weight"))


@query(f"WITH {_STATE} SELECT s.step, s.category, round(f.slow, 6) AS slow FROM placed s JOIN fold f ON f.category = s.category AND f.step = (s.step // 5) * 5 WHERE s.step >= 5")
def weights_at_refresh_step(spark, sf_dir):
    """The state that weights at a step are of: that of the last refresh, here every 5 steps."""
    state = written(rewards.emas(_series(spark, sf_dir)), "state")  # joined with itself
    asked = state.select("category", "step", rewards.refresh_step(F.col("step"), 5).alias("at")).filter("at is not null")
    return asked.join(state.select("category", F.col("step").alias("at"), "slow"), ["category", "at"]).select("step", "category", F.round("slow", 6).alias("slow"))


@query(f"WITH {_STATE}, last AS (SELECT f.* FROM fold f JOIN (SELECT category, max(i) AS i FROM placed GROUP BY category) m ON m.category = f.category AND m.i = f.i) SELECT category, round(slow, 6) AS slow, round(fast, 6) AS fast, stagnant FROM last")
def stream_ema_state(spark, sf_dir):
    """The series as a stream of files into the state store, drained once; the final state of each category."""
    from quillon.streaming import state

    return state.drained_emas(_series(spark, sf_dir)).select("category", F.round("slow", 6).alias("slow"), F.round("fast", 6).alias("fast"), "stagnant")


@query("SELECT count(*) AS n, count(DISTINCT user_id) AS n_users FROM (SELECT DISTINCT user_id, event_type FROM events)")
def stream_append_dedup(spark, sf_dir):
    """Appends keys that were not written before, exactly once, over a stream that repeats them."""
    return stream_appended_keys(spark, sf_dir).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_appended_keys(spark, sf_dir):
    """The table itself that the same stream appends to: every key once."""
    from quillon.streaming import state

    keys = table(spark, sf_dir, "events").select("user_id", "event_type")
    return state.appended_once(keys, ["user_id", "event_type"])


@query(f"WITH {_STATE}, last AS (SELECT f.* FROM fold f JOIN (SELECT category, max(i) AS i FROM placed GROUP BY category) m ON m.category = f.category AND m.i = f.i) SELECT category, round(slow, 6) AS slow, round(fast, 6) AS fast, stagnant FROM last")
def stream_state_handed_over(spark, sf_dir):
    """The series in three streams, each started from a snapshot of the state store that the one before left behind: equal to the unbroken run."""
    from quillon.streaming import stateful

    rows = written(_series(spark, sf_dir), "series")
    n = (rows.agg(F.max("step")).first()[0] or 0) + 1
    parts = [rows.filter(F.floor(F.col("step") * 3 / n) == k) for k in range(3)]
    return stateful.handed_over(parts).select("category", F.round("slow", 6).alias("slow"), F.round("fast", 6).alias("fast"), "stagnant")


@query("WITH s AS (SELECT event_type AS run_id, event_id // 20 AS step, bool_or(value > 95) AS signal FROM events GROUP BY ALL), g AS (SELECT *, count(*) FILTER (signal) OVER (PARTITION BY run_id ORDER BY step) AS grp FROM s), r AS (SELECT run_id, step, row_number() OVER (PARTITION BY run_id, grp ORDER BY step) - CASE WHEN grp > 0 THEN 1 ELSE 0 END AS run FROM g) SELECT run_id, min(step) AS stopped_at, 6 AS run FROM r WHERE run = 6 GROUP BY run_id")
def stream_health(spark, sf_dir):
    """Where a run (a type of event) has gone six steps without a signal: counted in the state store, over two queries of which the second goes on from the first one's checkpoint."""
    from quillon.streaming import stateful

    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("run_id"), F.floor(F.col("event_id") / 20).alias("step")).agg(F.bool_or(F.col("value") > 95).alias("signal"))
    rows = written(rows, "steps")
    half = (rows.agg(F.max("step")).first()[0] or 0) // 2
    return stateful.drained_health([rows.filter(F.col("step") <= half), rows.filter(F.col("step") > half)], 6)


@query(f"WITH {_STATE}, dealt AS (SELECT category, step, step * 4 // (SELECT max(step) + 1 FROM series) AS batch FROM series), seen AS (SELECT d.category, d.step, d.batch, max(f.step) AS at FROM dealt d LEFT JOIN dealt e ON e.category = d.category AND e.batch < d.batch LEFT JOIN fold f ON f.category = e.category AND f.step = e.step GROUP BY ALL) SELECT s.batch, s.category, s.step, round(coalesce(4 * f.slow * (1 - f.slow), 1), 6) AS weight FROM seen s LEFT JOIN fold f ON f.category = s.category AND f.step = s.at")
def stream_batch_weights(spark, sf_dir):
    """Weights asked for anew before each of four micro-batches: those of the state that the batches before have left, by version."""
    import uuid

    from quillon.sources.spread import folder
    from quillon.streaming import state

    rows = written(_series(spark, sf_dir), "series")
    n, root = (rows.agg(F.max("step")).first()[0] or 0) + 1, f"{folder(spark, 'quillon-stream-')}/weights-{uuid.uuid4().hex}"
    for k in range(4):  # a file a batch, in the order of their making
        rows.filter(F.floor(F.col("step") * 4 / n) == k).coalesce(1).write.mode("append").parquet(f"{root}/in")

    def use(batch, weights):
        v = F.col("slow")
        return batch.join(weights, "category", "left").select("category", "step", F.coalesce(4 * v * (1 - v), F.lit(1.0)).alias("weight"))

    def update(batch, weights):
        known = weights.select("category", F.lit(-1).cast("long").alias("step"), F.col("slow").alias("rate"))  # the average so far, as a first step
        return rewards.emas(known.unionByName(batch.select("category", "step", "rate"))).groupBy("category").agg(F.max_by("slow", "step").alias("slow"))

    run = state.weighted_batches(rows, spark.createDataFrame([], "category string, slow double"), use, update, root)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("category string, step long, weight double, batch long").parquet(f"{root}/out").select("batch", "category", "step", F.round("weight", 6).alias("weight"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark, sf_dir):
    """An extension: tumbling windows of event time, as a batch over the same expression that a stream would use."""
    rows = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n")
