"""Bounded samples of labelled rows, the only thing that fitting a classifier sees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Rows whose labels nothing may be learned from; a null id is none of them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def balanced(rows: DataFrame, label: str, each: dict | int, key: str = "doc_id") -> DataFrame:
    """About `each` rows of every label (all, where there are fewer), picked by a hash of the key, so reruns agree. rows: label and key, which must be unique:
    rows of one key stay or go together."""
    counts = {r[0]: r[1] for r in rows.groupBy(label).agg(F.count("*")).collect()}
    share = F.lit(0.0)
    for value, n in sorted(counts.items(), key=str):
        most = each if isinstance(each, int) else each.get(value, 0)
        share = F.when(F.col(label) == value, min(1.0, most / n)).otherwise(share)
    return rows.filter(F.pmod(F.xxhash64(F.lit(4242), key), F.lit(1 << 30)) < share * (1 << 30))


def bounded(rows: DataFrame, label: str, each: dict | int, chars: int, longest: int) -> list[tuple[str | None, object]]:
    """(text, label) of about `each` rows and `chars` characters of every label at most, in the order of a hash of the text, by which they are
    picked too: null and repeated ids make no difference, and equal texts of one label count once, before shares are computed. Texts of more than
    `longest` characters are left out, so that no one text fills the sample. Null labels are none."""
    length = F.coalesce(F.length("text"), F.lit(0))
    fit = rows.select("text", label, F.xxhash64(F.lit(777), "text").alias("_h")).filter(F.col(label).isNotNull() & (length <= longest))
    sizes = fit.select(label, "_h", length.alias("chars")).dropDuplicates([label, "_h"]).groupBy(label).agg(F.count("*").alias("n"), F.sum("chars").alias("chars")).collect()
    share = F.lit(0.0)
    for r in sorted(sizes, key=str):
        most = each if isinstance(each, int) else each.get(r[0], 0)
        share = F.when(F.col(label) == r[0], min(1.0, most / r["n"], chars / max(1, r["chars"]))).otherwise(share)
    picked = fit.filter(F.pmod(F.xxhash64(F.lit(4242), "_h"), F.lit(1 << 30)) < share * (1 << 30)).dropDuplicates([label, "_h"])
    return [(r["text"], r[label]) for r in picked.sort("_h", label).collect()]
