"""Streams: moving averages in the state store, append-once sinks, and a health monitor."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.sources.io import exists
from quillon.sources.spread import folder, written
from quillon.streaming import stateful

SLOW, FAST, TOLERANCE = 0.9, 0.5, 0.02
STATE = "slow double, fast double, last double, stagnant int"


def _advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    slow, fast, last, stagnant = state.get if state.exists else (None, None, None, 0)
    rows = pd.concat(list(parts)).sort_values("step")
    for rate in rows["rate"]:
        if slow is None:
            slow, fast, stagnant = rate, rate, 0
        else:
            stagnant = stagnant + 1 if abs(rate - last) <= TOLERANCE else 0
            slow, fast = SLOW * slow + (1 - SLOW) * rate, FAST * fast + (1 - FAST) * rate
        last = rate
    state.update((float(slow), float(fast), float(last), int(stagnant)))
    yield pd.DataFrame({"category": [key[0]], "step": [int(rows["step"].max())], "slow": [slow], "fast": [fast], "last": [last], "stagnant": [stagnant]})


def ema_stream(rates: DataFrame) -> DataFrame:
    """T-3: a stream of (category, step, rate) to one row for each category and micro-batch: its state after it. Within a batch steps are taken in order."""
    return rates.groupBy("category").applyInPandasWithState(_advance, f"category string, step long, {STATE}", STATE, "append", GroupStateTimeout.NoTimeout)


def drained_emas(series: DataFrame) -> DataFrame:
    """The series as a stream, drained once; the last state of each category."""
    spark, root = series.sparkSession, f"{folder(series.sparkSession, "quillon-stream-")}/emas-{uuid.uuid4().hex}"
    series.select("category", F.col("step").cast("long").alias("step"), "rate").write.parquet(f"{root}/in")
    stream = ema_stream(spark.readStream.schema("category string, step long, rate double").parquet(f"{root}/in"))
    stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{root}/out")
    return out.groupBy("category").agg(F.max_by(F.struct("slow", "fast", "last", "stagnant"), "step").alias("s")).select("category", "s.*")


#: Parts of an append-once table, by a hash of the key: a batch reads the keys of its own parts only.
PARTS = 64


#: Of the filter beside each part: bits and hashes a key, keys that the first one has room for.
FILTER_BITS, FILTER_HASHES, FILTER_ROOM = 16, 6, 1024
FILTER = "_part int, room long, n long, bits binary"


def _slots(h: np.ndarray, room: int) -> np.ndarray:
    """The bits of each hash, from its two halves."""
    one, two = h.astype(np.uint64) & np.uint64(0xFFFFFFFF), h.astype(np.uint64) >> np.uint64(32) | np.uint64(1)
    return (one[:, None] + np.arange(FILTER_HASHES, dtype=np.uint64) * two[:, None]) % np.uint64(room * FILTER_BITS)


def _with(bits: bytes | None, room: int, h: np.ndarray) -> bytes:
    out = np.unpackbits(np.frombuffer(bits, np.uint8)) if bits else np.zeros(room * FILTER_BITS, np.uint8)
    out[_slots(h, room).ravel()] = 1
    return np.packbits(out).tobytes()


def _maybe_known(key: tuple, new: pa.Table, known: pa.Table) -> pa.Table:
    """The hashes that a part may hold: all of them where it has no filter."""
    h, f = new.column("_h").to_numpy(), known.to_pylist()
    hit = np.ones(len(h), bool)
    if f and f[0]["bits"] is not None:
        hit = np.unpackbits(np.frombuffer(f[0]["bits"], np.uint8))[_slots(h, f[0]["room"])].all(axis=1)
    return pa.table({"_part": pa.array([key[0].as_py()] * int(hit.sum()), pa.int32()), "_h": pa.array(h[hit])})


def _grown(key: tuple, new: pa.Table, known: pa.Table) -> pa.Table:
    """The part's filter with new hashes; without bits where it would be too full: it is then made anew from the part's keys."""
    h, f = new.column("_h").to_numpy(), known.to_pylist()
    old = f[0] if f else {"room": 0, "n": 0, "bits": None}
    n, room = old["n"] + len(h), old["room"]
    bits = None
    if not f:
        room = max(FILTER_ROOM, 2 * len(h))
        bits = _with(None, room, h)
    elif old["bits"] is not None and n <= room:
        bits = _with(old["bits"], room, h)
    return pa.table({"_part": pa.array([key[0].as_py()], pa.int32()), "room": pa.array([room]), "n": pa.array([n]), "bits": pa.array([bits], pa.binary())})


def _made(key: tuple, t: pa.Table) -> pa.Table:
    h = t.column("_h").to_numpy()
    room = max(FILTER_ROOM, 2 * len(h))
    return pa.table({"_part": pa.array([key[0].as_py()], pa.int32()), "room": pa.array([room]), "n": pa.array([len(h)]), "bits": pa.array([_with(None, room, h)], pa.binary())})


def _read(spark: SparkSession, path: str, kind: str | T.StructType) -> DataFrame:
    return spark.read.schema(kind).parquet(path) if exists(spark, path) else spark.createDataFrame([], kind)


def append_new(batch: DataFrame, path: str, keys: list[str]) -> list[int]:
    """T-2, T-7, for foreachBatch: appends the rows whose keys the target does not have; a batch run again appends nothing. Returns the parts whose keys were read.

    The target is the seen-set, dealt into parts by a hash of the keys, and a restart needs nothing else. Beside each part stands a Bloom filter of its keys
    (two bytes a key): what it does not hold is new without a look at the part, so only parts with a repeat, or one key in some thousands, are read. Filters are written
    before rows, so they never lack a key; one that is missing or too full says "maybe" to all, and is made anew from its part. Nulls are keys like others.
    """
    spark, filters = batch.sparkSession, f"{path}-filters"
    new = batch.dropDuplicates(keys).withColumn("_h", F.xxhash64(*keys)).withColumn("_part", F.pmod("_h", F.lit(PARTS)).cast("int")).persist()
    put = lambda rows: rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_part").parquet(filters)
    try:
        touched = [r[0] for r in new.select("_part").distinct().collect()]
        held = _read(spark, filters, FILTER).filter(F.col("_part").isin(touched))
        read: list[int] = []
        fresh = new
        if exists(spark, path):
            maybe = new.select("_part", "_h").groupBy("_part").cogroup(held.groupBy("_part")).applyInArrow(_maybe_known, "_part int, _h long")
            stored = [x.name for x in spark.read.parquet(path).schema]
            read = sorted(r[0] for r in maybe.select("_part").distinct().collect())
            known = spark.read.parquet(path).filter(F.col("_part").isin(read)).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_part").alias("_p"))
            same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)), F.col("_part") == F.col("_p"))
            fresh = new.join(known, same, "left_anti").select(*[c for c in [*batch.columns, "_h", "_part"] if c in [*stored, "_h", "_part"]])
        fresh = fresh.persist()
        try:
            if fresh.take(1):
                grown = written(fresh.select("_part", "_h").groupBy("_part").cogroup(held.groupBy("_part")).applyInArrow(_grown, FILTER).filter("n > room or bits is not null"), "filters")
                put(grown)
                fresh.drop("_h").write.mode("append").partitionBy("_part").parquet(path)
                if full := [r[0] for r in grown.filter("bits is null").select("_part").collect()]:
                    rows = spark.read.parquet(path).filter(F.col("_part").isin(full)).select("_part", F.xxhash64(*keys).alias("_h"))
                    put(written(rows.groupBy("_part").applyInArrow(_made, FILTER), "filters"))
        finally:
            fresh.unpersist()
        return read
    finally:
        new.unpersist()


def appended_once(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows as a stream, appended to a table by key, drained twice: what the table holds then."""
    spark, root = rows.sparkSession, f"{folder(rows.sparkSession, "quillon-stream-")}/append-{uuid.uuid4().hex}"
    rows.write.parquet(f"{root}/in")
    for run in range(2):  # a second consumer that begins anew sees all input again
        stream = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
        stream.writeStream.foreachBatch(lambda b, _: append_new(b, f"{root}/out", keys)).option("checkpointLocation", f"{root}/checkpoint-{run}").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").drop("_part")


def reservoir(rows: DataFrame, k: int, key: str, seed: int = 42, files_at_once: int = 1) -> DataFrame:
    """T-1, S9: the k rows whose keys stateful.reservoir() keeps in its bounded state, uniform and equal on rerun. Keys must be unique and not null."""
    kept = stateful.reservoir(rows, k, key, seed, files_at_once=files_at_once).select(F.col("key").alias("_kept"))
    return rows.join(kept, F.col(key).cast("string") == F.col("_kept"), "left_semi")


def weighted_batches(rows: DataFrame, first: DataFrame, use: Callable[[DataFrame, DataFrame], DataFrame], update: Callable[[DataFrame, DataFrame], DataFrame], path: str, every: int = 1) -> Callable[[DataFrame, int], None]:
    """D4, T-4, for foreachBatch of a stream like rows: every micro-batch meets the weights as they then are.

    Weights are a table of versions: version 0 is `first`, version n + 1 is update(batch n, version n), written once. Batch n is given to use() with the version of the
    last refresh (every so many batches), which its number alone fixes: a batch that runs again meets the same weights, writes the same rows to path/out/batch=n and
    leaves later versions as they are.
    """
    spark = rows.sparkSession
    version = lambda n: f"{path}/versions/{n}"
    if not exists(spark, f"{version(0)}/_SUCCESS"):
        first.write.mode("overwrite").parquet(version(0))

    def run(batch: DataFrame, number: int) -> None:
        use(batch, spark.read.parquet(version(number - number % every))).write.mode("overwrite").parquet(f"{path}/out/batch={number}")
        if not exists(spark, f"{version(number + 1)}/_SUCCESS"):
            update(batch, spark.read.parquet(version(number))).write.mode("overwrite").parquet(version(number + 1))

    return run


class HealthMonitor:
    """T-6: counts batches without a signal; raises after `most` in a row, which stops the query whose foreachBatch calls it.

    With a path the count after each batch is kept there under the batch's number, so a restarted query goes on counting where the last one was, and a
    batch that runs again counts once.
    """

    def __init__(self, most: int = 8, path: str | None = None):
        self.most, self.path, self.run = most, path, 0

    def __call__(self, batch: DataFrame, number: int = 0) -> None:
        spark = batch.sparkSession
        if self.path and number > 0:
            self.run = spark.read.schema("run int").parquet(f"{self.path}/{number - 1}").first()["run"]
        self.run = 0 if batch.filter(F.col("signal")).take(1) else self.run + 1
        if self.path:
            spark.createDataFrame([(self.run,)], "run int").write.mode("overwrite").parquet(f"{self.path}/{number}")
        if self.run >= self.most:
            raise RuntimeError(f"{self.run} batches in a row without a learning signal")


def snapshot(state: DataFrame, path: str, **parameters: float) -> None:
    """T-5: the state table with the parameters it was made under."""
    state.withColumn("parameters", F.lit(repr(sorted(parameters.items())))).write.mode("overwrite").parquet(path)


def restored(spark: SparkSession, path: str, **parameters: float) -> DataFrame:
    """T-5: the snapshot; ValueError where parameters differ or a rate is out of bounds. A missing fast average starts at the slow one."""
    state = spark.read.parquet(path)
    if state.filter(F.col("parameters") != repr(sorted(parameters.items()))).take(1):
        raise ValueError("the snapshot was made under other parameters")
    if state.filter(~F.col("slow").between(0, 1) | F.isnan("slow")).take(1):
        raise ValueError("a rate in the snapshot is out of bounds")
    return state.drop("parameters").withColumn("fast", F.coalesce("fast", "slow"))
