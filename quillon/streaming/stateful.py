"""State that outlives a query: processors over the state store, its snapshot through the state data source, and streams that start from one."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillon.functions.text import order_hash
from quillon.sources.io import exists
from quillon.sources.spread import folder

SLOW, FAST, TOLERANCE = 0.9, 0.5, 0.02
AVERAGES = "slow double, fast double, last double, stagnant int"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def _state_store(spark: SparkSession):
    """Processors need the store that keeps columns of state apart."""
    was = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if was is None else spark.conf.set(_PROVIDER, was)


def _drain(out: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over what is there, into Parquet: a batch that runs again writes its files once."""
    out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def state_of(spark: SparkSession, checkpoint: str, name: str, batch: int | None = None) -> DataFrame:
    """T-5: the state variable `name` of a query's checkpoint, as of its last batch or of an earlier one: key and value, read through Spark's state data source."""
    reader = spark.read.format("statestore").option("stateVarName", name)
    return (reader.option("batchId", batch) if batch is not None else reader).load(checkpoint)


# moving averages


class Averages(StatefulProcessor):
    """T-3: slow, fast, last and stagnant of a category, in one value. Within a batch steps are taken in their order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("averages", AVERAGES)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        self.state.update((float(row["slow"]), float(row["fast"]), float(row["last"]), int(row["stagnant"])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        slow, fast, last, still = self.state.get() if self.state.exists() else (None, None, None, 0)
        seen = pd.concat(list(rows)).sort_values("step")
        for x in seen["rate"]:
            if slow is None:
                slow, fast, still = x, x, 0
            else:
                still = still + 1 if abs(x - last) <= TOLERANCE else 0
                slow, fast = SLOW * slow + (1 - SLOW) * x, FAST * fast + (1 - FAST) * x
            last = x
        self.state.update((float(slow), float(fast), float(last), int(still)))
        yield pd.DataFrame({"category": [key[0]], "step": [int(seen["step"].max())], "slow": [slow], "fast": [fast], "last": [last], "stagnant": [still]})

    def close(self) -> None:
        pass


def averages(rates: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """A stream of category, step, rate to each category's state after every batch. initial: category, slow, fast, last, stagnant, where the averages go on from."""
    start = initial.groupBy("category") if initial is not None else None
    return rates.groupBy("category").transformWithStateInPandas(Averages(), f"category string, step long, {AVERAGES}", "append", "none", initialState=start)


def checked(state: DataFrame) -> DataFrame:
    """T-5: a state table that a stream may start from; the query fails where a rate is out of bounds or a category is there twice. A missing fast average starts at the slow one."""
    fine = F.assert_true(F.coalesce(F.col("slow").between(0, 1) & ~F.isnan("slow"), F.lit(False)) & (F.col("n") == 1), "a rate in the snapshot is out of bounds, or a category is there twice")
    one = state.groupBy("category").agg(F.count("*").alias("n"), *(F.max(c).alias(c) for c in ("slow", "fast", "last", "stagnant")))
    return one.filter(fine.isNull()).select("category", "slow", F.coalesce("fast", "slow").alias("fast"), F.coalesce("last", "slow").alias("last"), F.coalesce("stagnant", F.lit(0)).alias("stagnant"))


def handed_over(parts: list[DataFrame], path: str | None = None) -> DataFrame:
    """T-5: the series in several runs: each is a stream of its own, started from the state store of the one before it. The last run's state: category and AVERAGES.

    A run is a folder; one whose state was snapshot is not run again, so an interrupted hand-over goes on where it was.
    """
    spark = parts[0].sparkSession
    path = path or f"{folder(spark, 'quillon-stream-')}/handed-{uuid.uuid4().hex}"
    state = None
    with _state_store(spark):
        for k, part in enumerate(parts):
            root = f"{path}/run-{k}"
            if exists(spark, f"{root}/snapshot/_SUCCESS"):
                state = spark.read.parquet(f"{root}/snapshot")
                continue
            if not exists(spark, f"{root}/in/_SUCCESS"):
                part.select("category", F.col("step").cast("long").alias("step"), "rate").write.mode("overwrite").parquet(f"{root}/in")
            stream = spark.readStream.schema("category string, step long, rate double").parquet(f"{root}/in")
            _drain(averages(stream, state), f"{root}/out", f"{root}/checkpoint")
            new = state_of(spark, f"{root}/checkpoint", "averages").select("key.category", "value.*")
            if state is not None:  # a category that the run did not meet keeps its state
                new = new.unionByName(state.join(new, "category", "left_anti"))
            checked(new).write.mode("overwrite").parquet(f"{root}/snapshot")
            state = spark.read.parquet(f"{root}/snapshot")
    return state


# health


class Health(StatefulProcessor):
    """T-6: counts steps in a row without a signal; says once where there were `most` of them, and then looks no further."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("run", "run int, stopped boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        run, stopped = self.state.get() if self.state.exists() else (0, False)
        if not stopped:
            for step, signal in sorted(pd.concat(list(rows))[["step", "signal"]].itertuples(index=False)):
                run = 0 if signal else run + 1
                if run >= self.most:
                    stopped = True
                    yield pd.DataFrame({"run_id": [key[0]], "stopped_at": [int(step)], "run": [run]})
                    break
            self.state.update((int(run), bool(stopped)))

    def close(self) -> None:
        pass


def health(steps: DataFrame, most: int = 8) -> DataFrame:
    """A stream of run_id, step, signal to run_id, stopped_at, run: one row for a run when it has gone `most` steps without a signal. Steps come in order from batch to batch."""
    return steps.groupBy("run_id").transformWithStateInPandas(Health(most), "run_id string, stopped_at long, run int", "append", "none")


def watch(steps: DataFrame, checkpoint: str, most: int = 8) -> None:
    """T-6: drains a stream of run_id, step, signal and raises where a run has to stop. Called again with its checkpoint it counts on from there."""

    def stop(batch: DataFrame, number: int) -> None:
        if found := batch.take(1):
            raise RuntimeError(f"{found[0]['run_id']}: {found[0]['run']} steps in a row without a learning signal, up to {found[0]['stopped_at']}")

    with _state_store(steps.sparkSession):
        health(steps, most).writeStream.foreachBatch(stop).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drained_health(parts: list[DataFrame], most: int, path: str | None = None) -> DataFrame:
    """Where runs stop, over parts that come one after the other, each in a query that starts anew from the checkpoint."""
    spark = parts[0].sparkSession
    root = path or f"{folder(spark, 'quillon-stream-')}/health-{uuid.uuid4().hex}"
    with _state_store(spark):
        for part in parts:
            part.select("run_id", F.col("step").cast("long").alias("step"), "signal").write.mode("append").parquet(f"{root}/in")
            stream = spark.readStream.schema("run_id string, step long, signal boolean").parquet(f"{root}/in")
            _drain(health(stream, most), f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out")


# a sample of bounded state


class Smallest(StatefulProcessor):
    """T-1: the k rows of a part with the smallest hashes, in a list that never has more."""

    def __init__(self, k: int, fields: T.StructType):
        self.k, self.fields = k, fields

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", self.fields)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = self.fields.names
        held = [tuple(r) for r in self.kept.get()] if self.kept.exists() else []
        held.sort()
        for batch in rows:
            if len(held) >= self.k:
                batch = batch[batch["h"] <= held[-1][0]]
            held = sorted({*held, *batch[names].itertuples(index=False, name=None)})[: self.k]
        self.kept.put(held)
        yield pd.DataFrame({"part": [key[0]], "n": [len(held)]})

    def close(self) -> None:
        pass


def reservoir(rows: DataFrame, k: int, key: str, seed: int = 42, parts: int = 8, files_at_once: int = 1, path: str | None = None) -> DataFrame:
    """T-1, S9, O3: the keys of k rows (key, h), uniform and equal on rerun, from one pass over rows as a stream of files.

    A row's place is a hash of its key; the k smallest are the sample. Each part of the stream keeps its own k smallest in the state store, so state has parts * k rows at most
    however long the stream is, and no batch rewrites a table; files_at_once is what a batch admits. The sample is read from the state. Equal keys are one row; a null key is one too.
    """
    spark, root = rows.sparkSession, path or f"{folder(rows.sparkSession, 'quillon-stream-')}/reservoir-{uuid.uuid4().hex}"
    own = rows.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"))
    own.withColumn("h", order_hash(seed, F.col("key"))).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")).write.mode("ignore").parquet(f"{root}/in")
    fields = T.StructType([T.StructField("h", T.StringType()), T.StructField("key", T.StringType())])
    stream = spark.readStream.schema("key string, h string, part int").option("maxFilesPerTrigger", files_at_once).parquet(f"{root}/in")
    with _state_store(spark):
        made = stream.groupBy("part").transformWithStateInPandas(Smallest(k, fields), "part int, n long", "append", "none")
        _drain(made, f"{root}/out", f"{root}/checkpoint")
    kept = spark.read.format("statestore").option("stateVarName", "kept").option("flattenCollectionTypes", True).load(f"{root}/checkpoint").select("list_element.*")
    return kept.orderBy("h", "key").limit(k).select("key", "h")
