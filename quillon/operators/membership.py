"""Joins on keys and set checks. Spark picks the physical join from measured sizes; nothing here forces a broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import digest


def _by_digest(rows: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    """Keys may be whole texts: what is dealt out beside a row is a digest of 128 bits. A null key is in nothing, as in any join."""
    known = keys.filter(F.col(key).isNotNull()).select(*digest(key)).distinct()
    asked = rows.select("*", *(F.when(F.col(key).isNotNull(), c).alias(n) for c, n in zip(digest(key), ("_d1", "_d2"))))
    return asked.join(known, ["_d1", "_d2"], how).select(*rows.columns)


def without(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among keys."""
    return _by_digest(rows, keys, key, "left_anti")


def among(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """J4."""
    return _by_digest(rows, keys, key, "left_semi")


def overlap_fingerprint(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row, how many different keys (hexadecimal hashes of 60 digits at least) are in both, and a fingerprint of the set: sums of four parts of
    them, so that no list is gathered and partial sums are all that meets."""
    both = a.select(key).intersect(b.select(key))
    sums = [F.sum(F.conv(F.substring(key, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    return both.agg(F.count("*").alias("n_overlap"), F.sha2(F.concat_ws(":", *(x.cast("string") for x in sums)), 256).alias("fingerprint"))


def zipped(rows: DataFrame, *others: DataFrame, place: str = "place") -> DataFrame:
    """Tables side by side by place."""
    for x in others:
        rows = rows.join(x, place)
    return rows


def ordered_lookup(rows: DataFrame, wanted: DataFrame, key: str, place: str = "place") -> DataFrame:
    """The wanted rows with their place in the request; ValueError names those that are missing."""
    if gone := [r[0] for r in wanted.join(rows, key, "left_anti").select(key).limit(10).collect()]:
        raise ValueError(f"missing: {gone}")
    return rows.join(wanted.select(key, place), key)


def is_subset(a: DataFrame, b: DataFrame, key: str) -> bool:
    """U4."""
    return a.join(b.select(key), key, "left_anti").isEmpty()


def is_disjoint(a: DataFrame, b: DataFrame, key: str) -> bool:
    """U5."""
    return a.join(b.select(key), key, "left_semi").isEmpty()


def is_partition(whole: DataFrame, parts: list[DataFrame], key: str) -> bool:
    """The parts share no key and have all of the whole's."""
    ids = parts[0].select(key)
    for p in parts[1:]:
        ids = ids.unionByName(p.select(key))
    return ids.groupBy(key).count().filter("count > 1").isEmpty() and ids.exceptAll(whole.select(key)).isEmpty() and whole.select(key).exceptAll(ids).isEmpty()


def same_counts(a: DataFrame, b: DataFrame, by: list[str]) -> bool:
    """U7."""
    one, two = (x.groupBy(*by).count() for x in (a, b))
    return one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()
