"""Rows of a source that comes in fewer pieces than there are cores, and the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def spread(rows: DataFrame) -> DataFrame:
    """Dealt out evenly if the scan has fewer partitions than the cluster has cores, as a small table in one file has; else as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows._jdf.queryExecution().toRdd().getNumPartitions() < cores else rows


def folder(spark: SparkSession, prefix: str) -> str:
    """The folder in spark.checkpoint.dir. In local mode, where driver and executors are one, it may be unset: a temporary one is made then
    and kept for the session. Elsewhere a local folder would be each machine's own, so an unset one is a ValueError."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if context._jsc.sc().getCheckpointDir().isEmpty():
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix=prefix))
        found = context._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet under the shared folder and read back: its lineage ends there."""
    path = f"{folder(df.sparkSession, 'quillon-checkpoint-')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
