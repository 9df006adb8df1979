"""Benchmark decontamination by Wu-Manber search for many strings.

The alphabet is words. A window of a test item is 10 consecutive words (an item of fewer words is
one window). For each window length there are: a shift table over blocks of two words, which says how far the
search may jump when a block ends at a position; buckets of windows by a hash of their last and first
blocks; and the windows' words, compared directly with the text's before an occurrence counts.
All texts of a batch are searched side by side, each cut into lanes that advance by their own shifts.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.shared import mapped, pieces, slices, written
from quillon.llm.words import ALNUM, Words, mix, words

WINDOW = 10
#: End positions that one lane goes through.
LANE = 256
#: Characters and windows of test items that one search holds; a larger benchmark is searched in as many passes. A window takes about half a
#: kilobyte in the driver and in each Python worker, whatever the length of its words.
PASS_CHARS, PASS_WINDOWS = 32_000_000, 500_000
_BLOCK = np.uint64(0xA0761D6478BD642F)

SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", SPAN), T.StructField("item_ids", T.ArrayType(T.StringType()))]


class Searcher:
    """The tables for windows of one length."""

    def __init__(self, length: int, rows: np.ndarray, texts: list[bytes], owners: list[tuple[str, ...]]):
        self.length, self.rows, self.texts, self.owners = length, rows, texts, owners
        b = self.block = min(2, length)
        bits = max(10, int(np.ceil(np.log2(max(2, len(rows) * (length - b + 1)) * 4))))
        self.down = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, length - b + 1, np.int64)
        for i in range(b - 1, length):
            np.minimum.at(self.shift, self._slot(self._at(rows.T, i)), length - 1 - i)
        key = self.key(rows.T, length - 1)
        order = np.argsort(key, kind="stable")
        self.keys, self.which = key[order], order

    def _at(self, columns, i):
        return mix(columns[i - 1] * _BLOCK + columns[i]) if self.block == 2 else columns[i]

    def _slot(self, h):
        return (h >> self.down).astype(np.int64)

    def key(self, columns, i):
        """Of the window that ends at i: its last block and its first words."""
        head = i - self.length + 1
        return mix(self._at(columns, i) ^ (columns[head] * _BLOCK + columns[head + self.block - 1]))

    def find(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """The first words of all occurrences, and the windows' numbers."""
        h, m = w.hash, self.length
        first, lanes_at, lanes_to = w.first, [], []
        full = np.flatnonzero(w.count >= m)
        if not len(full):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        lo, hi = first[full] + m - 1, first[full + 1] - 1
        n = (hi - lo) // LANE + 1
        part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        lanes_at = np.repeat(lo, n) + part * LANE
        lanes_to = np.minimum(lanes_at + LANE - 1, np.repeat(hi, n))
        at, to, ends = lanes_at, lanes_to, []
        while len(at):
            block = mix(h[at - 1] * _BLOCK + h[at]) if self.block == 2 else h[at]
            step = self.shift[self._slot(block)]
            ends.append(at[step == 0])
            at = at + np.maximum(step, 1)
            live = at <= to
            at, to = at[live], to[live]
        end = np.concatenate(ends)
        head = end - m + 1
        last = mix(h[end - 1] * _BLOCK + h[end]) if self.block == 2 else h[end]
        key = mix(last ^ (h[head] * _BLOCK + h[head + self.block - 1]))
        a, b = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        times = b - a
        head = np.repeat(head, times)
        which = self.which[np.repeat(a, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
        same = np.ones(len(head), bool)
        for k in range(m):
            same &= h[head + k] == self.rows[which, k]
        head, which = head[same], which[same]
        spans = zip(head.tolist(), which.tolist())
        sure = [_said(w, i, m) == self.texts[p] for i, p in spans]
        return head[sure], which[sure]


def _said(w: Words, i: int, m: int) -> bytes:
    return b" ".join(w.buf[w.start[k] : w.end[k]].tobytes() for k in range(i, i + m))


def searchers(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> list[Searcher]:
    """items: (id, text). Equal windows are held once, with the ids of all items that have them."""
    found: dict[int, dict[bytes, tuple[np.ndarray, set]]] = defaultdict(dict)
    for a, b in slices([t for _, t in items]):
        w = words([t for _, t in items[a:b]], ALNUM)
        first = w.first
        for d in range(b - a):
            n = int(w.count[d])
            m = min(n, window)
            for i in range(first[d], first[d] + n - m + 1) if n else ():
                _, ids = found[m].setdefault(_said(w, i, m), (w.hash[i : i + m], set()))
                if items[a + d][0] is not None:
                    ids.add(str(items[a + d][0]))
    return [Searcher(m, np.array([h for h, _ in x.values()]), list(x), [tuple(ids) for _, ids in x.values()]) for m, x in sorted(found.items())]


def search(texts: list[str | None], tables: list[Searcher]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """For each text: its words, the runs of hit words (from, to), the ids of items that occur."""
    out = []
    for a, b in slices(texts):
        w = words(texts[a:b], ALNUM)
        first, change, ids = w.first, np.zeros(len(w.hash) + 1, np.int32), defaultdict(set)
        for s in tables:
            head, which = s.find(w)
            np.add.at(change, head, 1)
            np.add.at(change, head + s.length, -1)
            for d, p in set(zip(w.doc[head].tolist(), which.tolist())):
                ids[d].update(s.owners[p])
        hit = np.cumsum(change[:-1]) > 0
        for d in range(b - a):
            edge = np.flatnonzero(np.diff(hit[first[d] : first[d + 1]].view(np.int8), prepend=0, append=0)).tolist()
            out.append((int(w.count[d]), list(zip(edge[::2], edge[1::2])), sorted(ids[d]) if d in ids else []))
    return out


def _merged(a: list, b: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x, y in sorted([*a, *b]):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], y))
        else:
            out.append((x, y))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, pass_chars: int = PASS_CHARS, pass_windows: int = PASS_WINDOWS) -> DataFrame:
    """docs with n_words, hit_spans (word ranges covered by occurrences of benchmark windows) and item_ids (sorted strings).

    A null or wordless text has no words and no hits; a null or wordless item has no windows; an item without an
    id hits words but is not listed. Columns of docs named like the three are replaced. Repeated rows are judged alike. The benchmark's size is
    checked: beyond pass_chars or pass_windows its items are dealt by hash into as many passes, each over all documents.
    """
    docs = docs.drop(*(f.name for f in FIELDS))
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text"))
    # no item has more windows than words, nor more words than these
    size = items.agg(F.sum(F.length("text")).alias("chars"), F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))).alias("words")).first()
    passes = max(-(-(size["chars"] or 0) // pass_chars), -(-(size["words"] or 0) // pass_windows), 1)
    schema, names = T.StructType([*docs.schema.fields, *FIELDS]), docs.columns
    out = docs
    for k in range(passes):
        own = items if passes == 1 else items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(passes)) == k)
        tables = searchers([(r["id"], r["text"]) for r in own.collect()], window)

        def run(batches, tables=tables, again=k > 0):
            arrow = [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())]
            for batch in pieces(batches):
                found = search(batch.column(text).to_pylist(), tables)
                if again:
                    old = zip(batch.column("hit_spans").to_pylist(), batch.column("item_ids").to_pylist())
                    found = [(n, _merged(s, [(x["start"], x["end"]) for x in s0]), sorted({*i, *i0})) for (n, s, i), (s0, i0) in zip(found, old)]
                more = [[n for n, _, _ in found], [[{"start": x, "end": y} for x, y in s] for _, s, _ in found], [i for *_, i in found]]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(v, t) for v, t in zip(more, arrow)], [*names, *(f.name for f in FIELDS)])

        out = mapped(out, run, schema)
        if k < passes - 1:
            out = written(out, "decontaminate")
    return out


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of op7, one row per document; columns as its contract names them."""
    hits = decontaminate(docs.select("doc_id", "text"), benchmark)
    return hits.select(
        "doc_id",
        "n_words",
        F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]).alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


def brute(texts: list[str | None], items: list[tuple[str | None, str | None]], window: int = WINDOW) -> list[tuple[int, int, list[str], str]]:
    """By the definition, for tests: n_words, n_hit, ids, their digest."""
    import re

    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    split = lambda t: pattern.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    wanted = defaultdict(set)
    for i, t in items:
        own = split(t)
        m = min(window, len(own))
        for k in range(len(own) - m + 1) if own else ():
            wanted[tuple(own[k : k + m])].add(i)
    out = []
    for t in texts:
        own, hit, ids = split(t), set(), set()
        for m in {len(x) for x in wanted}:
            for k in range(len(own) - m + 1):
                if who := wanted.get(tuple(own[k : k + m])):
                    hit.update(range(k, k + m))
                    ids |= who
        ids = sorted({str(i) for i in ids if i is not None})
        out.append((len(own), len(hit), ids, hashlib.sha256(",".join(ids).encode()).hexdigest()))
    return out
