"""Document fingerprints by I-Match over randomised lexicons, in DataFrame functions only.

The lexicon is the terms whose share of documents lies in a band: those in fewer are noise, those in more say
little. A document's distinct lexicon terms are sorted and, for each of 40 random subsets of the lexicon, those in the
subset are hashed together. The subsets come in five densities, so that short and long documents both have some
that hold a few of their terms. Two fingerprints are as alike as the share of equal hashes among the subsets that either uses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.shared import written

#: The band, as shares of documents. At most (mean distinct terms of a document) / LEAST terms are in it, whatever the corpus.
LEAST, MOST = 1 / 2000, 1 / 10
SLOT_BITS, GROUP, DENSITIES = 22, 8, 5
LAST = (1 << 63) - 1


def _bits(h: Column, at: int, n: int) -> Column:
    return F.shiftrightunsigned(h, at).bitwiseAND((1 << n) - 1)


def terms(text: Column) -> Column:
    """Hashes of the distinct terms: runs of letters and digits, in lower case."""
    return F.array_distinct(F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != ""), lambda x: F.xxhash64(x)))


def lexicon(texts: DataFrame, least: float = LEAST, most: float = MOST, slot_bits: int = SLOT_BITS) -> list[int]:
    """The band as a bitmap over slots of term hashes, 64 slots a number: its size is fixed, so it may go to every task.

    In a corpus too small for the band (under 1 / most documents) a term may still be in two. Terms that share
    a slot with one of the lexicon count as of it, the same in every document.
    """
    n = texts.count()
    counts = texts.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    band = counts.filter((F.col("df") >= least * n) & (F.col("df") <= max(2.0, most * n)))
    slots = band.select(_bits(F.col("term"), 0, slot_bits).alias("slot"))
    words = slots.groupBy(F.shiftrightunsigned("slot", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    out = [0] * (1 << slot_bits - 6)
    for r in words.collect():
        out[r["word"]] = r["bits"]
    return out


def _kept(found: Column, bitmap: list[int], slot_bits: int) -> Column:
    known = F.split(F.lit(",".join(map(str, bitmap))), ",").cast("array<bigint>")
    return F.sort_array(F.filter(found, lambda h: F.call_function("shiftrightunsigned", F.get(known, _bits(h, 6, slot_bits - 6).cast("int")), h.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1))


def fingerprinted(df: DataFrame, bitmap: list[int], text: str, to: str, slot_bits: int = SLOT_BITS) -> DataFrame:
    """Adds `to`: an array of 41 numbers, null for a subset without terms; the last is set only where all others
    are null, and stands for all the text's terms, or for the text itself if it has none."""
    all_, kept, thin = f"{to}_all", f"{to}_kept", f"{to}_thin"
    df = df.withColumn(all_, terms(F.col(text))).withColumn(kept, _kept(F.col(all_), bitmap, slot_bits))
    # each density keeps a quarter of the terms of the one before, the first a half of all
    levels = [F.filter(kept, lambda h: _bits(h, slot_bits, 1) == 0)]
    df = df.withColumn(thin, F.array(levels[0]))
    for k in range(1, DENSITIES):
        df = df.withColumn(thin, F.concat(thin, F.array(F.filter(F.element_at(thin, -1), _thinned(slot_bits + 1 + 2 * k)))))
    subsets = F.flatten(F.transform(thin, lambda level, k: F.transform(F.sequence(F.lit(0), F.lit(GROUP - 1)), lambda s: F.filter(level, lambda h: _group(h, k) == s))))
    df = df.withColumn(to, F.transform(subsets, lambda x: F.when(F.size(x) > 0, F.xxhash64(x))))
    rest = F.when(~F.exists(to, lambda x: x.isNotNull()), F.when(F.size(all_) > 0, F.xxhash64(F.sort_array(all_))).otherwise(F.xxhash64(F.lit("text"), F.col(text))))
    return df.withColumn(to, F.concat(to, F.array(rest))).drop(all_, kept, thin)


def _thinned(at: int):
    return lambda h: _bits(h, at, 2) == 0


def _group(h: Column, k: Column) -> Column:
    return F.pmod(F.xxhash64(h, k), F.lit(GROUP)).cast("int")


def shown(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda x: F.coalesce(F.hex(F.shiftrightunsigned(x, 32)), F.lit("-"))), ".")


def likeness(a: Column, b: Column) -> Column:
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    used = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.isNotNull() | y.isNotNull()), lambda x: x))
    return same / used


def followers(ids: DataFrame) -> DataFrame:
    """ids: rid, tie, n. Adds next_rid and next_tie of the row after it by rid and tie; after the last comes the first.

    Rows are dealt by range; only the first row of each range meets the others, one for each partition.
    """
    dealt = written(ids.repartitionByRange("rid", "tie").withColumn("pid", F.spark_partition_id()), "ranges")
    order = W.partitionBy("pid").orderBy("rid", "tie")
    after = dealt.withColumn("next", F.lead(F.struct("rid", "tie")).over(order))
    firsts = dealt.groupBy("pid").agg(F.min(F.struct("rid", "tie")).alias("first"))
    by = W.orderBy("pid")
    firsts = firsts.select("pid", F.coalesce(F.lead("first").over(by), F.first("first").over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("then"))
    out = after.join(firsts, "pid").withColumn("next", F.coalesce("next", "then"))
    return out.select("rid", "tie", "n", F.col("next")["rid"].alias("next_rid"), F.col("next")["tie"].alias("next_tie"))


def report(docs: DataFrame) -> DataFrame:
    """The digest of op2, one row per row of docs. A null text is empty, a null doc_id comes after all others; rows alike in doc_id and text are
    fingerprinted alike, and their next document is the next different one (itself, if there is no other)."""
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("rid"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    bitmap = lexicon(own.select("text"))
    after = written(followers(own.select("rid", "tie", F.length("text").alias("n")).distinct()), "followers")
    # what each document gives to the one before it
    give = after.select(F.col("next_rid").alias("rid"), F.col("next_tie").alias("tie"), F.col("rid").alias("to_rid"), F.col("tie").alias("to_tie"), F.floor(F.col("n") / 4).cast("int").alias("m"))
    given = own.join(give, ["rid", "tie"]).select(F.col("to_rid").alias("rid"), F.col("to_tie").alias("tie"), F.substr("text", F.lit(1), F.col("m")).alias("tail")).dropDuplicates(["rid", "tie"])
    both = own.join(given, ["rid", "tie"]).join(after, ["rid", "tie"])
    both = both.withColumn("edited", F.concat(F.substr("text", F.lit(1), (F.col("n") - F.floor(F.col("n") / 4)).cast("int")), "tail"))
    both = fingerprinted(fingerprinted(both, bitmap, "text", "own"), bitmap, "edited", "new")
    both = written(both.select("rid", "tie", "next_rid", "next_tie", F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "own", "new"), "fingerprints")
    next_ = both.select(F.col("rid").alias("next_rid"), F.col("tie").alias("next_tie"), F.col("own").alias("theirs")).dropDuplicates(["next_rid", "next_tie"])
    out = both.join(next_, ["next_rid", "next_tie"])
    return out.select(F.when(F.col("rid") != LAST, F.col("rid")).alias("doc_id"), "n_chars", "edited_sha256", shown(F.col("own")).alias("fingerprint"), shown(F.col("new")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("new")).alias("near_edited"), likeness(F.col("own"), F.col("theirs")).alias("near_next"))
