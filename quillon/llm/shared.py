"""What the operators share: the shared folder, small reads of tables, batching of long texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from quillon.sources.spread import spread, written  # noqa: F401  the operators write by it

#: Characters that one pass of a vectorised kernel takes at once; a longer text goes alone.
CHUNK_CHARS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


def mapped(docs: DataFrame, run, schema) -> DataFrame:
    """docs.mapInArrow(run, schema), whatever the columns' names: Spark itself takes a dot in one for a field of a struct."""
    names = docs.columns
    if not any(x in c for c in names for x in ".`"):
        return docs.mapInArrow(run, schema)
    return docs.toDF(*(f"_{i}" for i in range(len(names)))).mapInArrow(lambda batches: run(b.rename_columns(names) for b in batches), schema)


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most limit bytes of text, or one row: what a task holds as Python objects stays small however long texts are."""
    for batch in batches:
        at = size = 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
            if i > at and size + n > limit:
                yield batch.slice(at, i - at)
                at, size = i, 0
            size += n
        if at < batch.num_rows:
            yield batch.slice(at)


def slices(texts: list[str | None], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts that together have at most limit characters, or hold one text."""
    at = size = 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if i > at and size + n > limit:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)
