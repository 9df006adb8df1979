"""How five filters act together: what each removes in every order, and what it removes that others would have.

Texts are scanned in the Arrow buffers they come in: tables say of each byte whether it belongs to a word, is a capital,
a symbol or the start of a code point, and prefix sums count them per document. A word is known by a 64-bit hash;
a document's sorted hashes give its distinct words, and equal hashes are verified by their bytes. A document becomes five bits,
one for each filter that it fails. Documents of equal bits behave alike in every order, so counts of bits by
part are all that the 120 orders need.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import CHUNK_CHARS, pieces, written
from quillon.llm.words import SPACED, span_hash

FILTERS = "ABCDE"
#: A: fewer words than this. B: fewer distinct words of 100 words. C: more capitals of 100 code points. D: any of these bytes.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SYMBOLS = 200, 50, 2, b"#$%&*|"
_CAPITAL, _SYMBOL, _POINT = (np.array([f(b) for b in range(256)]) for f in (lambda b: 65 <= b <= 90, lambda b: b in SYMBOLS, lambda b: b & 0xC0 != 0x80))


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings and where each row's begin, and the last's end; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def _per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many flags are set between each place and the next, by prefix sums."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]


def _words(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word; a row's end ends a word."""
    keep = SPACED[0][buf]
    first = np.zeros(len(buf) + 1, bool)
    first[at] = True
    before = np.concatenate(([False], keep[:-1]))
    start = np.flatnonzero(keep & (~before | first[:-1]))
    after = np.concatenate((keep[1:], [False]))
    return start, np.flatnonzero(keep & (~after | first[1:])) + 1


def _hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, limit: int) -> np.ndarray:
    """span_hash() of words side by side, about `limit` bytes of them at a time."""
    out, a = np.empty(len(start), np.uint64), 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(end, start[a] + limit, "right")))
        lo = start[a]
        out[a:b] = span_hash(buf[lo : end[b - 1]], start[a:b] - lo, end[a:b] - lo)
        a = b
    return out


def _same(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the `size` bytes at a and at b are equal, pair by pair, eight bytes at a time."""
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(buf) + 1, "<u8", padded.data, strides=(1,))
    same, live, done = np.ones(len(a), bool), np.arange(len(a)), 0
    while len(live := live[size[live] > done]):
        rest = np.minimum(size[live] - done, 8).astype(np.uint64)
        mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - rest * np.uint64(8))
        same[live] &= ((eight[a[live] + done] ^ eight[b[live] + done]) & mask) == 0
        done += 8
    return same


def _distinct(buf: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray, doc: np.ndarray, rows: int) -> np.ndarray:
    """Distinct words of each row: sorted hashes, neighbours of equal hash compared byte by byte. Where two different words share a hash, the row's words are counted as they are."""
    order = np.lexsort((h, doc))
    doc, h, start, end = doc[order], h[order], start[order], end[order]
    twin = np.flatnonzero((h[1:] == h[:-1]) & (doc[1:] == doc[:-1]))
    size = end - start
    alike = size[twin] == size[twin + 1]
    alike[alike] = _same(buf, start[twin[alike]], start[twin[alike] + 1], size[twin[alike]])
    count = np.bincount(doc, minlength=rows) - np.bincount(doc[twin], minlength=rows)
    for r in set(doc[twin[~alike]].tolist()):
        own = doc == r
        count[r] = len({buf[a:b].tobytes() for a, b in zip(start[own], end[own])})
    return count


def scan(column: pa.Array, limit: int = CHUNK_CHARS) -> dict[str, np.ndarray]:
    """words, distinct, capitals, points (code points) and symbols of each row of a column of strings; a null is an empty text."""
    buf, at = _buffer(column)
    start, end = _words(buf, at)
    doc = np.searchsorted(at[1:], start, "right")
    found = {"words": np.bincount(doc, minlength=len(column)), "distinct": _distinct(buf, start, end, _hashes(buf, start, end, limit), doc, len(column))}
    return found | {k: _per_row(t[buf], at) for k, t in (("capitals", _CAPITAL), ("points", _POINT), ("symbols", _SYMBOL))}


def bits(docs: DataFrame) -> DataFrame:
    """doc_id, source, digest (of the text's bytes) and fails (bits 1, 2, 4 and 8 for A, B, C and D), a row for each row of docs."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")

    def run(batches):
        for batch in pieces(batches):
            text = batch.column("text")
            x = scan(text)
            fails = (x["words"] < MIN_WORDS) + 2 * (100 * x["distinct"] < MIN_DISTINCT * x["words"]) + 4 * (100 * x["capitals"] > MAX_CAPITALS * x["points"]) + 8 * (x["symbols"] > 0)
            buf, at = _buffer(text)
            digest = [hashlib.sha256(buf[a:b]).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(digest, pa.binary()), pa.array(fails, pa.int32())], ["doc_id", "source", "digest", "fails"])

    return own.mapInArrow(run, "doc_id long, source string, digest binary, fails int")


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bits 1 to 16: the filters A to E that fail), n, good, toxic: documents by part and mask, and how many of them are labelled quality = 1 and toxic = 1.

    E fails if a smaller doc_id has the same text anywhere in docs; a null doc_id is larger than all others, rows of one doc_id are not each other's copies. A null
    text is an empty one, a null source the part ''. Repeated rows count each. A document with several labels is good (toxic) if one of them says so; a null label says nothing.
    """
    rows = written(bits(docs), "bits")
    rows = rows.groupBy("doc_id", F.coalesce("source", F.lit("")).alias("part"), "digest", "fails").agg(F.count("*").alias("n"))
    said = labels.groupBy(F.col("doc_id").cast("long").alias("said_id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    rows = rows.join(said, F.col("doc_id") == F.col("said_id"), "left").drop("said_id").na.fill(False, ["good", "toxic"])
    rows = written(rows, "labelled")
    count = [F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic")]
    # all rows by bits, as copies; the rows of a text's smallest doc_id are none: they go back from there. They meet it by text and id, which no large group of copies shares.
    least = rows.groupBy(F.col("digest").alias("of")).agg(F.min("doc_id").alias("least"))
    first = rows.join(least, (F.col("digest") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("least")), "left_semi").groupBy("part", "fails").agg(*count)
    minus = first.select("part", (F.col("fails") + 16).alias("mask"), (-F.col("n")).alias("n"), (-F.col("good")).alias("good"), (-F.col("toxic")).alias("toxic"))
    every = rows.groupBy("part", "fails").agg(*count).select("part", (F.col("fails") + 16).alias("mask"), "n", "good", "toxic")
    both = every.union(minus).union(first.select("part", F.col("fails").alias("mask"), "n", "good", "toxic"))
    return both.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def _set(letters: Column) -> Column:
    """The bits of the filters whose letters stand in a string."""
    total = F.lit(0)
    for k, c in enumerate(FILTERS):
        total = total + F.when(F.contains(letters, F.lit(c)), 1 << k).otherwise(0)
    return total


def interactions(counts: DataFrame) -> DataFrame:
    """masks() by part, all orders of the filters and steps: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    What is left after some filters depends on their set alone: 32 sums for each part say it all. A part is one row here, however many rows it has.
    """
    sets = range(1 << len(FILTERS))
    left = lambda c: F.array(*(F.sum(F.when(F.col("mask").bitwiseAND(s) == 0, F.col(c)).otherwise(0)) for s in sets))
    only = F.array(*(F.sum(F.when(F.col("mask") == 1 << k, F.col("n")).otherwise(0)) for k in range(len(FILTERS))))
    by_part = counts.groupBy("part").agg(*(left(c).alias(c) for c in ("n", "good", "toxic")), only.alias("only"))
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    steps = by_part.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    letter = F.expr("substring(filter_order, step, 1)")
    steps = steps.select("*", _set(F.expr("substring(filter_order, 1, step - 1)")).alias("before"), _set(letter).alias("own"), (F.instr(F.lit(FILTERS), letter)).alias("k"))
    at = lambda c, s: F.element_at(c, s + 1)
    before, after, own = F.col("before"), F.col("before") + F.col("own"), F.col("own")
    lost = lambda c: at(c, before) - at(c, after)
    # a filter comes at each step of the orders: |S|! (4 - |S|)! of them have the set S before it
    ways = {s: int(np.prod(range(1, s + 1))) * int(np.prod(range(1, len(FILTERS) - s))) for s in range(len(FILTERS))}
    shares = F.array(*(sum((F.lit(ways[s.bit_count()]) * (F.element_at("n", s + 1) - F.element_at("n", s + (1 << k) + 1)) for s in sets if not s >> k & 1), F.lit(0)) for k in range(len(FILTERS))))
    steps = steps.withColumn("shares", shares)
    return steps.select(
        "part",
        "filter_order",
        "step",
        at("n", after).alias("kept"),
        lost("n").alias("removed"),
        (at("n", F.lit(0)) - at("n", own) - lost("n")).alias("redundant"),
        F.element_at("only", F.col("k")).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.element_at("shares", F.col("k")).cast("long").alias("shapley"),
    )


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of op11; no documents give no parts and no rows."""
    return interactions(masks(docs, labels))


def brute(docs: list[tuple], labels: list[tuple]) -> list[tuple]:
    """By the definition, for tests: docs (doc_id, text, source), labels (doc_id, quality, toxic); rows as report() has them, by walking each order document by document."""
    import re

    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    fails = []
    for i, text, source in docs:
        text = text or ""
        w = re.findall("[^\x20\x09-\x0d]+", text)
        smaller = any((t or "") == text and j is not None and (i is None or j < i) for j, t, _ in docs)
        found = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": smaller}
        fails.append((source or "", i, {k for k, v in found.items() if v}))
    out = []
    for part in {p for p, *_ in fails}:
        rows, removed = [], dict.fromkeys(FILTERS, 0)
        for order in map("".join, permutations(FILTERS)):
            left = [(i, f) for p, i, f in fails if p == part]
            gone: list = []
            for step, c in enumerate(order, 1):
                now = [(i, f) for i, f in left if c in f]
                again = sum(c in f for _, f in gone)
                left, gone = [(i, f) for i, f in left if c not in f], gone + now
                removed[c] += len(now)
                rows.append([part, order, step, len(left), len(now), again, sum(f == {c} for p, _, f in fails if p == part), sum(i in good for i, _ in now), sum(i in toxic for i, _ in now)])
        out += [(*r, removed[r[1][r[2] - 1]]) for r in rows]
    return out
