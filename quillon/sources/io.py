"""Readers and writers. Paths go to Spark, so any file system that it reads will do."""

from __future__ import annotations

import json
import re
from dataclasses import fields
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CORRUPT = "_corrupt"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Strict; a broken line fails the query. Blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """(rows, broken lines), for logs whose last line may be cut off."""
    s = spark.createDataFrame([], schema).schema.add(_CORRUPT, T.StringType())
    lines = spark.read.text(path).filter(F.trim("value") != "")
    rows = lines.select(F.from_json("value", s, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}).alias("r"))
    return rows.filter(F.col("r")[_CORRUPT].isNull()).select("r.*").drop(_CORRUPT), rows.select(F.col("r")[_CORRUPT].alias(_CORRUPT)).filter(F.col(_CORRUPT).isNotNull())


def read_jsonl_last(spark: SparkSession, path: str, schema: T.StructType | str, key: str, order: str) -> DataFrame:
    """S3: strict, the row with the largest order of each key."""
    rows = read_jsonl(spark, path, schema)
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def write_jsonl(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """S4, S5 (mode append), S13 (the default refuses to overwrite). Nulls are written."""
    rows.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Quoted cells of several lines, doubled quotes, a byte order mark before the header."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    rows = (reader.schema(schema) if schema else reader).csv(path)
    return rows.toDF(*(c.lstrip("﻿") for c in rows.columns))


def write_csv(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """S7."""
    rows.write.mode(mode).option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_ids(rows: DataFrame, key: str, path: str, mode: str = "errorifexists") -> None:
    """One key a line."""
    rows.select(F.col(key).cast("string")).write.mode(mode).text(path)


def first_source(spark: SparkSession, *paths: str) -> DataFrame:
    """The first Parquet path that is there."""
    for p in paths:
        if exists(spark, p):
            return spark.read.parquet(p)
    raise FileNotFoundError(f"none of {paths}")


def write_splits(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet by split."""
    rows.write.mode(mode).partitionBy("split").parquet(path)


def read_splits(spark: SparkSession, path: str, *required: str) -> DataFrame:
    """ValueError unless all required splits are there; their names come from the folders, no row is read."""
    rows = spark.read.parquet(path)
    fs, p = _fs(spark, path)
    have = {PurePosixPath(s.getPath().toString()).name.removeprefix("split=") for s in fs.listStatus(p) if s.isDirectory()}
    if gone := set(required) - have:
        raise ValueError(f"splits missing: {sorted(gone)}")
    return rows


def read_config(spark: SparkSession, path: str) -> dict:
    """Nested parameters from a JSON file, which is YAML too, read through Spark's file systems."""
    return json.loads(read_text(spark, path))


def typed(kind, parameters: dict):
    """A dataclass from parameters; TypeError names those that it does not have, values are turned into their fields' types."""
    known = {f.name: type(f.default) for f in fields(kind)}
    if odd := sorted(set(parameters) - set(known)):
        raise TypeError(f"unknown parameters: {odd}")
    return kind(**{k: known[k](v) for k, v in parameters.items()})


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each file's bytes: path, length, sha256. For files that fit a task."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def row_set_fingerprint(rows: DataFrame) -> DataFrame:
    """One hash of a set of rows in any order: sums of row hashes, so nothing is collected; n and both sums tell sets apart."""
    h = F.xxhash64(*rows.columns).cast("decimal(38,0)")
    g = F.xxhash64(F.lit("again"), *rows.columns).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("n"), F.sum(h).alias("a"), F.sum(g).alias("b")).select("n", F.sha2(F.concat_ws(":", "n", "a", "b"), 256).alias("fingerprint"))


def split_metadata(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Per split the rows, distinct keys, repeats and a fingerprint."""
    h = F.sum(F.xxhash64(key).cast("decimal(38,0)"))
    return rows.groupBy(split).agg(F.count("*").alias("n"), F.count_distinct(key).alias("n_distinct"), (F.count(key) - F.count_distinct(key)).alias("n_again"), F.sha2(F.coalesce(h.cast("string"), F.lit("")), 256).alias("fingerprint"))


def write_text(spark: SparkSession, path: str, text: str, force: bool = False) -> None:
    """A small report or manifest, written by the driver through Hadoop's file system; refuses to overwrite unless forced."""
    fs, p = _fs(spark, path)
    out = fs.create(p, force)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect())


def write_manifest(spark: SparkSession, path: str, parts: dict[str, DataFrame | object], force: bool = False) -> dict:
    """Nested counts, hashes and checks as JSON. DataFrames must be small aggregates."""
    made = {k: [json.loads(x) for x in v.toJSON().collect()] if isinstance(v, DataFrame) else v for k, v in parts.items()}
    write_text(spark, path, json.dumps(made, ensure_ascii=False, indent=2, sort_keys=True), force)
    return made


def markdown_table(rows: DataFrame) -> str:
    """Of a small aggregate."""
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows.collect()])


def with_section(text: str, name: str, body: str) -> str:
    """Text with the part between the section's markers replaced, or added at the end; doing it twice changes nothing more."""
    begin, end = f"<!-- {name}:begin -->", f"<!-- {name}:end -->"
    block = f"{begin}\n{body}\n{end}"
    if begin in text and end in text:
        return re.sub(re.escape(begin) + r".*?" + re.escape(end), lambda _: block, text, count=1, flags=re.S)
    return f"{text.rstrip()}\n\n{block}\n" if text.strip() else block + "\n"


def decided(samples: DataFrame, decisions: DataFrame, key: str, order: str = "at") -> DataFrame:
    """Sampled rows with their latest decision, null where none was made."""
    last = W.partitionBy(key).orderBy(F.desc(order))
    latest = decisions.withColumn("_n", F.row_number().over(last)).filter("_n = 1").select(key, "decision")
    return samples.join(latest, key, "left")


def write_ordered(rows: DataFrame, order: list[str], path: str, mode: str = "errorifexists") -> None:
    """Rows in a total order, as parts by range: path/rows has a folder `_range=k` for each range, sorted within, and path/manifest says of each its rows and how many come before.

    No task sees all rows: Spark samples the order for the ranges. Read in the order of the manifest the parts are the whole order; read_ordered() gives each row its place.
    """
    dealt = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).sortWithinPartitions(*order)
    dealt.write.mode(mode).partitionBy("_range").parquet(f"{path}/rows")
    spark = rows.sparkSession
    counts = spark.read.parquet(f"{path}/rows").groupBy("_range").agg(F.count("*").alias("n"))  # a row a range
    before = F.coalesce(F.sum("n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts.withColumn("before", before).write.mode(mode).parquet(f"{path}/manifest")


def read_ordered(spark: SparkSession, path: str, order: list[str], name: str = "place") -> DataFrame:
    """The rows of write_ordered() with their places (from 0) in the whole order, each range numbered for itself. The order must be total for places to be the same each time."""
    rows, manifest = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/manifest")
    own = rows.withColumn(name, F.row_number().over(W.partitionBy("_range").orderBy(*order)))
    return own.join(manifest.select("_range", "before"), "_range").withColumn(name, F.col(name) - 1 + F.col("before")).drop("_range", "before")
