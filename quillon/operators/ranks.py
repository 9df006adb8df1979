"""Running sums, ranks and scans without a task that sees all rows of a group: rows are dealt by range, each range adds what lies before it."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.sources.spread import written


def running(rows: DataFrame, by: list[str], order: list[Column | str], value: Column | None = None, name: str = "rn") -> DataFrame:
    """rows with `name`: the sum of value (1: the row's number) over the rows of its group (by; none: all rows) up to it in this order.

    Groups may be of any size: a range has rows of one group or of several, and only the ranges' sums meet, one for each range and group.
    Pass the columns that are needed only: rows are written once under the shared folder. The order must be total. A null in `by` is a group of its own.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = written(rows.withColumn("_run_v", value if value is not None else F.lit(1).cast("long")).repartitionByRange(*by, *order).withColumn("_run_pid", F.spark_partition_id()), "ranges")
    upto = W.partitionBy("_run_pid", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*by).orderBy("_run_pid").rowsBetween(W.unboundedPreceding, -1)
    sums = dealt.groupBy("_run_pid", *by).agg(F.sum("_run_v").alias("_run_t")).withColumn("_run_base", F.coalesce(F.sum("_run_t").over(before), F.lit(0)))
    sums = sums.select(*(F.col(c).alias(f"_{c}_") for c in ["_run_pid", *by]), "_run_base")
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in ["_run_pid", *by]))
    out = dealt.withColumn("_run_own", F.sum("_run_v").over(upto)).join(sums, same)
    return out.withColumn(name, F.col("_run_own") + F.col("_run_base")).select(*rows.columns, name)


def hash_cut(rows: DataFrame, k: int, h: Column, key: str, few: int = 10_000) -> tuple[str, object] | None:
    """(hash, key) of the k-th row by hash (hexadecimal) and key; None if k is 0 or there are fewer. The rows are counted by ever longer prefixes, of which
    at most 4,096 come to the driver, until so few share one that they can be sorted."""
    own, prefix = rows.select(h.alias("h"), F.col(key).alias("key")), ""
    n = own.count()
    if not 0 < k <= n:
        return None
    while n > few and len(prefix) < 60:
        counts = own.groupBy(F.substring("h", len(prefix) + 1, 3).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()
        for r in counts:
            if k <= r["n"]:
                break
            k -= r["n"]
        prefix, n = prefix + r["p"], r["n"]
        own = own.filter(F.col("h").startswith(prefix))
    last = own.orderBy("h", "key").limit(k).orderBy(F.desc("h"), F.desc("key")).first()
    return last["h"], last["key"]


def up_to(cut: tuple[str, object] | None, h: Column, key: str) -> Column:
    """Rows up to a cut of hash_cut()."""
    if cut is None:
        return F.lit(False)
    return (h < cut[0]) | ((h == cut[0]) & (F.col(key) <= F.lit(cut[1])))


class Series:
    """Rows dealt out by range in the order of by and order, for scans along each series (group of by): no task holds a whole one.

    Rows are written once under the shared folder, so several scans go over the same ranges. The order must be total within a series; a null in `by` is a series of its own.
    """

    def __init__(self, rows: DataFrame, by: list[str], order: list[str]):
        self.columns, self.by = rows.columns, by
        dealt = rows.repartitionByRange(*by, *order).withColumn("_pid", F.spark_partition_id())
        within = W.partitionBy("_pid").orderBy(*by, *order)
        segment = F.dense_rank().over(W.partitionBy("_pid").orderBy(*by)) if by else F.lit(1)
        self.rows = written(dealt.withColumns({"_at": F.row_number().over(within), "_seg": segment}), "series")

    def affine(self, **terms: tuple[Column, Column, Column]) -> Series:
        """One more column for each term (a, b, first): y = a * y of the row before + b, and first in a series' first row. Moving averages are such, and so are
        counters with resets (a = b = 1 while they count, else 0). A term's columns may use the columns of earlier calls.

        Maps y -> a * y + b chain to such maps: a range comes to one for each of its series, those are chained range after range (a row a range), and each range
        then starts from what came before it.
        """
        names, series = list(terms), self.by
        parts = [F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"_{n}_{k}") for n, cs in terms.items() for k, c in zip("abf", cs)]
        rows = self.rows.select("*", *parts)
        got = lambda t, n: [t.column(f"_{n}_{k}").to_numpy() for k in "abf"]
        by = T.StructType([rows.schema[c] for c in self.by])

        def totals(t: pa.Table) -> pa.Table:
            t = t.sort_by("_at")
            seg = t.column("_seg").to_numpy()
            first = np.flatnonzero(np.diff(seg, prepend=seg[0] - 1))
            out = {c: t.column(c).take(first) for c in ("_pid", "_seg", *series)}
            for n in names:
                a, b, f = got(t, n)
                chained = [_chain(a[i:j], b[i:j], f[i]) for i, j in zip(first, [*first[1:], len(seg)])]
                for k, name in enumerate("abv"):
                    out[f"{n}_{name}"] = pa.array([x[k] for x in chained], pa.float64())
            return pa.table(out)

        numbers = lambda ks: [T.StructField(f"{n}_{k}", T.DoubleType()) for n in names for k in ks]
        places = [T.StructField("_pid", T.IntegerType()), T.StructField("_seg", T.IntegerType())]
        maps = rows.groupBy("_pid").applyInArrow(totals, T.StructType([*places, *by, *numbers("abv")]))

        def starts(t: pa.Table) -> pa.Table:
            t = t.sort_by("_pid")
            out = {c: t.column(c) for c in ("_pid", "_seg")}
            for n in names:
                a, b, v = (t.column(f"{n}_{k}").to_pylist() for k in "abv")
                y = list(accumulate(range(1, len(a)), lambda y, i: a[i] * y + b[i], initial=v[0]))
                out[f"{n}_y"] = pa.array([None, *y[:-1]], pa.float64())
            return pa.table(out)

        begun = maps.withColumn("_all", F.lit(0)).groupBy("_all", *self.by).applyInArrow(starts, T.StructType([*places, *numbers("y")]))
        keep = [c for c in rows.columns if not any(c == f"_{n}_{k}" for n in names for k in "abf")]
        added = T.StructType([*(rows.schema[c] for c in keep), *(T.StructField(n, T.DoubleType()) for n in names)])

        def walk(t: pa.Table, before: pa.Table) -> pa.Table:
            t = t.sort_by("_at")
            seg = t.column("_seg").to_numpy()
            first = np.flatnonzero(np.diff(seg, prepend=seg[0] - 1))
            known = {x["_seg"]: x for x in before.to_pylist()}
            out = {c: t.column(c) for c in keep}
            for n in names:
                a, b, f = got(t, n)
                made: list[float] = []
                for i, j in zip(first.tolist(), [*first[1:].tolist(), len(seg)]):
                    y = known[seg[i]][f"{n}_y"]
                    own = zip(a[i:j].tolist(), b[i:j].tolist())
                    if y is None:
                        next(own)
                        made += accumulate(own, lambda y, m: m[0] * y + m[1], initial=float(f[i]))
                    else:
                        made += list(accumulate(own, lambda y, m: m[0] * y + m[1], initial=y))[1:]
                out[n] = pa.array(made, pa.float64())
            return pa.table(out)

        self.rows = rows.groupBy("_pid").cogroup(begun.groupBy("_pid")).applyInArrow(walk, added)
        self.columns = [*self.columns, *names]
        return self

    def before(self, name: str, value: str) -> Series:
        """One more column: value in the row before of the same series, null in the first. Only the last row of each range and series meets the next range."""
        within = W.partitionBy("_pid", "_seg").orderBy("_at")
        last = self.rows.groupBy("_pid", "_seg", *self.by).agg(F.max_by(value, "_at").alias("_last"))
        last = last.withColumn("_last", F.lag("_last").over(W.partitionBy(*self.by).orderBy("_pid"))).select("_pid", "_seg", "_last")
        rows = self.rows.withColumn(name, F.lag(value).over(within)).withColumn("_new", F.row_number().over(within) == 1)
        rows = rows.join(last, ["_pid", "_seg"]).withColumn(name, F.when(F.col("_new"), F.col("_last")).otherwise(F.col(name)))
        self.rows = rows.drop("_new", "_last")
        self.columns = [*self.columns, name]
        return self

    def frame(self) -> DataFrame:
        return self.rows.select(*self.columns)


def _chain(a: np.ndarray, b: np.ndarray, first: float) -> tuple[float, float, float]:
    """Of the maps y -> a * y + b, one after the other: the whole map's a and b, and what comes out where the first map gives `first`."""
    whole, off, y = 1.0, 0.0, float(first)
    for i, (x, c) in enumerate(zip(a.tolist(), b.tolist())):
        whole, off = x * whole, x * off + c
        if i:
            y = x * y + c
    return whole, off, y
