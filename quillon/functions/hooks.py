"""Places where a caller's own Python goes: token counters, rewards, generators, decoders. They see Arrow batches, never single rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def token_counter(count: Callable[[str], int] | None = None) -> Callable[[Column], Column]:
    """A function from a text column to its number of tokens. Without one of the caller's: words and single signs, by a pattern on the JVM. Null has none."""
    if count is None:
        return lambda c: F.coalesce(F.regexp_count(c, F.lit(r"(?U)\w+|[^\w\s]")), F.lit(0)).cast("long")

    @F.pandas_udf(T.LongType())
    def counted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda x: count(x) if x is not None else 0).astype("int64")

    return counted


def _added(rows: DataFrame, inputs: list[str], out: T.StructField, make: Callable[[dict[str, list]], list]) -> DataFrame:
    """rows with one more column (one of its name is replaced), made from lists of the inputs, batch by batch."""
    rows = rows.drop(out.name)
    names, kind = rows.columns, T.StructType([out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        field = to_arrow_schema(kind).field(0)
        for batch in batches:
            got = list(make({c: batch.column(c).to_pylist() for c in inputs}))
            if len(got) != batch.num_rows:
                raise ValueError(f"{len(got)} values for {batch.num_rows} rows")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, field.type)], [*names, out.name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, out]))


def rewarded(rows: DataFrame, callback: Callable[[dict[str, list]], list[float]], inputs: list[str], out: str = "reward") -> DataFrame:
    """D3: a reward for each row from a callback that gets columns as lists and gives as many numbers; ValueError if it does not."""
    return _added(rows, inputs, T.StructField(out, T.DoubleType()), callback)


class Generator(Protocol):
    """Whatever answers prompts. Made once for each batch of rows by a factory, on the executor, so that no model is sent."""

    def __call__(self, prompts: list[str]) -> list[str]: ...


def generated(rows: DataFrame, factory: Callable[[], Generator], prompt: str = "prompt", out: str = "answer") -> DataFrame:
    """Rows with an answer to each prompt. Another factory is another model: nothing else has to be replaced."""
    made: list[Generator] = []

    def answers(columns: dict[str, list]) -> list[str]:
        if not made:
            made.append(factory())
        return made[0](columns[prompt])

    return _added(rows, [prompt], T.StructField(out, T.StringType()), answers)


def decoded(rows: DataFrame, decode: Callable[[list[int]], str], ids: str = "ids", text: str = "text", out: str = "completion") -> DataFrame:
    """Completions from their raw ids where there are some, else the text as it came."""
    return _added(rows, [ids, text], T.StructField(out, T.StringType()), lambda c: [decode(i) if i is not None else t for i, t in zip(c[ids], c[text])])


def single_ids(strings: list[str], encode: Callable[[str], list[int]]) -> dict[str, int]:
    """the one id of each of a few structure strings; ValueError where a string has more or fewer, or two share one."""
    found = {s: encode(s) for s in strings}
    if odd := [s for s, ids in found.items() if len(ids) != 1]:
        raise ValueError(f"no single token: {odd}")
    if len({ids[0] for ids in found.values()}) < len(found):
        raise ValueError("structure strings share a token")
    return {s: ids[0] for s, ids in found.items()}


def single_pieces(marks: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """F35 against a vocabulary as a table (piece, id): mark, id of each structure string in marks; the query fails where one has no id or several, or two share one."""
    ids = marks.select("mark").distinct().join(vocabulary.select(F.col("piece").alias("mark"), "id").distinct(), "mark", "left")
    n = ids.groupBy("mark").agg(F.count("id").alias("n"), F.min("id").alias("id"))
    shared = n.groupBy(F.col("id").alias("own")).agg(F.count("*").alias("n_marks"))
    fine = F.assert_true((F.col("n") == 1) & (F.col("n_marks") == 1), "structure strings must have one id each, of their own")
    return n.join(shared, F.col("id").eqNullSafe(F.col("own"))).filter(fine.isNull()).select("mark", F.col("id").cast("int").alias("id"))


def with_weights(weights: Callable[[int], DataFrame], use: Callable[[DataFrame, DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """D4, for foreachBatch: the weights are asked for again before every micro-batch, by its number."""
    return lambda batch, number: use(batch, weights(number), number)


def largest_values(tensors: DataFrame, name: str = "name", values: str = "values", k: int = 10) -> DataFrame:
    """The k tensors with the largest absolute value. A tensor may come in many rows of arrays."""
    most = F.greatest(F.array_max(values), -F.array_min(values))
    return tensors.groupBy(name).agg(F.max(most).alias("max_abs")).orderBy(F.desc("max_abs"), name).limit(k)
