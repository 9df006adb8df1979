"""All queries over the driver's tables by name, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.sources.spread import spread

#: Tables whose rows are long texts: work on one is worth a shuffle where a single file would leave cores idle.
LONG = ("documents",)
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its own name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in LONG else rows


from quillon.plans import q_adaptive, q_attempts, q_chat, q_checks, q_contracts, q_curation, q_gates, q_hooks, q_metrics, q_sampling, q_shapes, q_sources, q_terms  # noqa: E402, F401
