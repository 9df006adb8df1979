"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Every document of a source has the same expected number of copies, target / source size. Its whole part is given to
all; the fraction is rounded pivotally: two sides meet and one takes mass (words) from the other at random until one
side is at 0 or 1. The words taken stay the same at each meeting, and every document's expectation too. The sides are a block's largest
undecided document and the pool of its smaller ones: between two single documents a large one would stay undecided to the end
and miss the target by its size. Blocks of a source do this side by side as folds; each leaves at most one document
undecided, and the leftovers are dealt into blocks again until each source has one: a tree of reductions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.shared import written
from quillon.operators.ranks import running

WEIGHTS, CAP, BLOCK = (5.0, 2.0, 1.0), 3.0, 128
_EDGE = 1e-9


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """sizes: source, source_size, one row for each source. Adds target: all sizes together, shared by weight, none above cap times its
    source's size (the limit of sharing the excess again and again). Sources are ordered by code point, null last."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, weights)), turn + 1)
    rows = sizes.withColumn("weight", weight).withColumn("most", F.lit(cap) * F.col("source_size"))
    # filled in the order of most / weight: those before the water line get their most, the others the same share by weight
    fill = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = fill.rowsBetween(W.unboundedPreceding, -1), fill.rowsBetween(W.currentRow, W.unboundedFollowing)
    whole = W.partitionBy()
    share = (F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    rows = rows.withColumn("share", share)
    # the first source whose most is not below its share sets the line for itself and all after it
    line = F.min(F.when(F.col("most") >= F.col("share") * F.col("weight"), F.struct(F.col("most") / F.col("weight"), F.col("source").isNull(), "source", "share"))).over(whole)
    return rows.withColumn("line", line["share"]).select("source", "source_size", F.least(F.col("most"), F.coalesce(F.col("line") * F.col("weight"), F.col("most"))).alias("target"))


def _ident() -> Column:
    """What a row is known by: its doc_id, or its text's hash where that is null, so that rows without one are no single group."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))


def _unit(seed: int, *by) -> Column:
    """A number in (0, 1) from a hash: reruns agree."""
    return (F.pmod(F.xxhash64(F.lit(seed), *by), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _snap(v: Column) -> Column:
    return F.when(v < _EDGE, 0.0).when(v > 1 - _EDGE, 1.0).otherwise(v)


def _meet(state: Column, x: Column) -> Column:
    """The next document meets the pool of those after it in its block.

    state: size and mass of the pool that still holds x, and the map p -> a * p + b that earlier meetings have made of the
    pool's fractions; done: documents with their new p. Mass goes from x to the pool or back, at odds that keep
    all expectations, until x or the whole pool is at 0 or 1.
    """
    p = _snap(state["a"] * x["p"] + state["b"])
    size, mass = state["size"] - x["size"], state["mass"] - x["size"] * p
    left, room = F.greatest(F.lit(0.0), mass), F.greatest(F.lit(0.0), size - mass)
    up, down = F.least(1 - p, left / x["size"]), F.least(p, room / x["size"])
    rise = x["u"] * (up + down) < down
    keep = _snap(F.when(rise, 1 - F.coalesce(F.try_divide(up * x["size"], left), F.lit(0.0))).otherwise(1 - F.coalesce(F.try_divide(down * x["size"], room), F.lit(0.0))))
    a, b = state["a"] * keep, F.when(rise, state["b"] * keep).otherwise(state["b"] * keep + 1 - keep)
    moved = F.when(rise, -up).otherwise(down) * x["size"]
    out = x.withField("p", _snap(F.when(rise, p + up).otherwise(p - down)))
    return F.struct(size.alias("size"), (mass + moved).alias("mass"), a.alias("a"), b.alias("b"), F.concat(state["done"], F.array(out)).alias("done"))


def _round(rows: DataFrame, seed: int, level: int) -> DataFrame:
    """Folds each block, its largest document first: rows of source, block become documents at 0 or 1, and one at most between."""
    rows = rows.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("k"), "id", "again", "size", "p", _unit(seed + level, "id", "again", "size").alias("u")))).alias("docs"))
    kind = "array<struct<k:double,id:bigint,again:bigint,size:double,p:double,u:double>>"
    total = lambda f: F.aggregate("docs", F.lit(0.0), lambda s, x: s + f(x))
    start = F.struct(total(lambda x: x["size"]).alias("size"), total(lambda x: x["size"] * x["p"]).alias("mass"), F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.array().cast(kind).alias("done"))
    return rows.select("source", F.explode(F.aggregate("docs", start, _meet, lambda s: s["done"])).alias("d")).select("source", "d.id", "d.again", "d.size", "d.p")


def _numbered(rows: DataFrame) -> DataFrame:
    """rows: rid, doc_id, source, text, whole. rid, doc_id, ident, source, size of each row, and again: its number among the rows alike in ident, source and size,
    which go by the hashes of their texts, then by whole. Rows alike in all of these are one as good as the other; rid deals them out over the ranges, so no task numbers all of them."""
    sized = rows.select("rid", F.col("doc_id").cast("long").alias("doc_id"), _ident().alias("ident"), "source", words_of(F.col("text")).alias("size"), F.xxhash64("text").alias("h"), "whole")
    sized = written(sized, "words")  # dealing out by range reads its rows twice: not the texts
    return written(running(sized, ["ident", "source", "size"], ["h", "whole", "rid"], name="again").drop("h", "whole"), "sized")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: int = 17, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, ident (doc_id, or the text's hash), source, again (its number among rows alike in ident, source and size),
    size, source_size, target, copies.

    size is the number of words (null: 0). A document of no words gets the whole part of its expectation, as copies of it weigh nothing. A null doc_id is a
    document too; repeated rows are rounded separately. If no source has words all targets are 0. Only doc_id, source and text are read.
    """
    rows = docs.select("doc_id", "source", "text", F.lit(0).alias("whole"), F.monotonically_increasing_id().alias("rid"))
    return _copies(_numbered(rows), weights, cap, seed, block).drop("rid")


def _copies(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: int = 17, block: int = BLOCK) -> DataFrame:
    """sized (of _numbered()) with source_size, target and copies."""
    totals = written(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n")), "totals")
    goals = targets(totals, weights, cap).select(F.col("source").alias("of"), "target").join(totals, F.col("of").eqNullSafe(F.col("source"))).drop("of")
    goals = written(goals.withColumn("each", F.least(F.lit(cap), F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))), "goals")
    own = sized.alias("d").join(goals.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source"))).select("d.rid", "d.doc_id", "d.ident", "d.source", "d.again", "d.size", "g.source_size", "g.target", "g.each", "g.n")
    part = F.col("each") - F.floor("each")
    name = F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))
    open_ = own.filter((F.col("size") > 0) & (part > _EDGE) & (part < 1 - _EDGE))
    left = open_.select(name.alias("source"), F.col("ident").alias("id"), "again", F.col("size").cast("double").alias("size"), part.alias("p"), "n")
    done, level = [], 0
    while True:
        blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / block))
        left = left.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1000 + level), "id", "again", "size"), blocks))
        now = written(_round(left, seed, level), "rounded")
        done.append(now.filter("p = 0 or p = 1"))
        left = now.filter("p > 0 and p < 1")
        sizes = left.groupBy("source").agg(F.count("*").alias("n"))
        if not sizes.filter("n > 1").take(1):
            break
        left, level = left.join(sizes, "source"), level + 1
    done.append(left.withColumn("p", F.when(_unit(seed - 1, "id", "again", "size") < F.col("p"), 1.0).otherwise(0.0)))
    taken = done[0]
    for x in done[1:]:
        taken = taken.union(x)
    keys = taken.filter("p = 1").select(F.col("source").alias("name"), F.col("id"), F.col("again").alias("row"), F.col("size").cast("long").alias("words"), F.lit(1).alias("one"))
    named = own.select("*", name.alias("own_name"))
    more = named.join(keys, (F.col("own_name") == F.col("name")) & (F.col("ident") == F.col("id")) & (F.col("again") == F.col("row")) & (F.col("size") == F.col("words")), "left")
    whole = F.floor(F.col("each") + _EDGE)
    return more.select("rid", "doc_id", "ident", "source", "again", "size", "source_size", "target", (whole + F.coalesce("one", F.lit(0))).cast("long").alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as it is taken; columns unchanged, whatever their names. Of rows alike in doc_id, source and text the hash of all
    other columns says which are taken (maps and variants cannot be hashed and do not count), so reruns agree."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    whole = F.xxhash64(F.lit(0), *(c for c, (_, kind) in zip(columns, docs.dtypes) if "map<" not in kind and "variant" not in kind))
    own = written(docs.select(F.struct(*columns).alias("row"), whole.alias("whole"), F.monotonically_increasing_id().alias("rid")), "rows")
    times = _copies(_numbered(own.select("rid", "whole", "row.doc_id", "row.source", "row.text")), **options)
    both = own.join(times.filter("copies > 0").select("rid", F.col("copies").cast("int").alias("copies")), "rid")
    return both.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def report(docs: DataFrame) -> DataFrame:
    """The digest of op10."""
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
