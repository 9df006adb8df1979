"""Removal of byte strings that an earlier document has, by a suffix array in range-partitioned buckets.

A string is 50 consecutive bytes of one document. Of all suffixes (one begins at every byte) most need not be sorted,
and a first exchange proves which:

* Every string has a key: the smallest hash of the 32-byte runs within it. Neighbouring strings that share their key
  make a stretch (ten bytes of them on average). Equal strings have equal keys, whatever stands around them.
* Units (some MB of documents) ask about their stretches by key and by a hash of the bytes of the whole stretch (packed.py: some ten bytes
  a stretch cross the network, once for each unit). A stretch that an earlier document has as a whole is done with: its
  strings repeat. A key that comes with one stretch only, however often, has no other strings. What is left are first stretches
  whose key another stretch has too: the edges of repeats, some hundredths of the text.

The suffixes of what is left, cut to 50 bytes, are the suffix array's. Splitters are sampled from all suffixes and deal them out by
range: every unit sorts its own by multikey quicksort, eight bytes a level, cuts them at the splitters and sends each bucket its stretch of
them (sorted neighbours compress well); a bucket sorts what all units sent and compares neighbours. Suffixes on the two sides of
a splitter differ within their 50 bytes, as splitters are whole suffixes, so nothing is left to compare across a boundary. A unit sends
a suffix once however many of its documents have it, so no common string makes a hot bucket.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import packed
from quillon.llm.shared import written
from quillon.llm.words import _UNIT, _power, mix

SPAN, RUN = 50, 32
#: Bytes of a unit, at least and at most; it grows with the corpus, so that what units send to parts does not shrink to a few hashes.
UNIT_BYTES = (4_000_000, 8_000_000)
#: Stretches that a part compares, about; bytes of text for one bucket, and suffixes sampled for one splitter.
PART_STRETCHES, BUCKET_BYTES, SAMPLED = 1_000_000, 12_500_000, 64
#: Splitters at most, which all tasks get: beyond, buckets grow.
SPLITTERS = 1 << 16
#: A key with more different stretches than this in one unit is not asked about stretch by stretch: all its strings go to the suffix array.
MANY = 16
#: Bytes hashed at once.
CHUNK = 1 << 18
LAST = (1 << 63) - 1
_BODY = 32  # bits of a stretch's hash that are sent beside its key


# units


def _pack_units(docs: DataFrame, unit_bytes: int) -> DataFrame:
    """docs' rows in units as the tasks meet them: unit, ids, null_ids, sizes (bytes of each text) and the texts' bytes, compressed. Written, so that units stay as they are."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))

    def run(batches):
        task, made, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def unit():
            known = [LAST if i is None else i for i in ids]
            blob = zstandard.ZstdCompressor(level=6).compress(b"".join(texts))
            row = {"unit": [(task << 32) + made], "ids": [np.array(known, np.int64).tobytes()], "null_ids": [np.packbits([i is None for i in ids]).tobytes()], "sizes": [np.array([len(t) for t in texts], np.int64).tobytes()], "texts": [blob]}
            return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64() if k == "unit" else pa.binary()) for k, v in row.items()})

        for batch in batches:
            column = batch.column("text")
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                text = column[i].as_py() or b""
                if size and size + len(text) > unit_bytes:
                    yield unit()
                    made, ids, texts, size = made + 1, [], [], 0
                ids.append(doc)
                texts.append(text)
                size += len(text) + 16
        if ids:
            yield unit()

    return written(own.mapInArrow(run, "unit long, ids binary, null_ids binary, sizes binary, texts binary"), "units")


class Unit:
    def __init__(self, row: dict):
        self.ids, self.sizes = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["sizes"], np.int64)
        self.null = np.unpackbits(np.frombuffer(row["null_ids"], np.uint8), count=len(self.ids)).astype(bool)
        total = int(self.sizes.sum())
        self.buf = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["texts"], max_output_size=total) if total else b"", np.uint8)
        self.at = np.concatenate(([0], np.cumsum(self.sizes)))

    def chunks(self, limit: int = CHUNK):
        """Ranges of about limit bytes whose strings together are all strings: neighbours overlap by what a string is longer than one byte."""
        for a in range(0, len(self.buf), limit):
            yield a, min(len(self.buf), a + limit + SPAN - 1)


class _Hashes:
    """Hashes of any spans of some bytes, from one prefix sum; a span's hash depends on its bytes only."""

    def __init__(self, buf: np.ndarray):
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_UNIT[buf] * _power("up", len(buf)), out=self.sums[1:])
        self.down = _power("down", len(buf) + 1)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def runs(self, n: int) -> np.ndarray:
        return mix((self.sums[n:] - self.sums[:-n]) * self.down[: len(self.sums) - n])


def stretches(unit: Unit) -> dict[str, np.ndarray]:
    """first and last string of each stretch (places in the unit's bytes), its key, the hash of its bytes, its document's number."""
    out: dict[str, list] = {k: [] for k in ("first", "last", "key", "body")}
    for lo, hi in unit.chunks():
        n = hi - lo - SPAN + 1
        if n <= 0:
            continue
        hashes = _Hashes(unit.buf[lo:hi])
        h = hashes.runs(RUN)
        low, size, wide = h, 1, SPAN - RUN + 1
        while 2 * size <= wide:
            low, size = np.minimum(low[:-size], low[size:]), 2 * size
        if size < wide:
            low = np.minimum(low[: len(low) - (wide - size)], low[wide - size :])
        docs = np.arange(np.searchsorted(unit.at, lo, "right") - 1, np.searchsorted(unit.at, hi, "left"))
        a, b = np.maximum(unit.at[docs] - lo, 0), np.minimum(unit.at[docs + 1] - SPAN + 1 - lo, n)
        change = np.zeros(n + 1, np.int32)
        np.add.at(change, a[b > a], 1)
        np.add.at(change, b[b > a], -1)
        inside = np.cumsum(change[:-1]) > 0  # strings that end in the document they start in
        ends = h[:n] == low
        ends[:-1] |= (low[1:] != low[:-1]) | ~inside[1:]
        ends[-1] = True
        starts = np.concatenate(([True], ends[:-1] | ~inside[:-1])) & inside
        first, last = np.flatnonzero(starts), np.flatnonzero(ends & inside)
        out["first"].append(first + lo)
        out["last"].append(last + lo)
        out["key"].append(mix(low[first]))  # smallest hashes are small: mixed, they deal out evenly
        out["body"].append(hashes.spans(first, last + SPAN))
    found = {k: np.concatenate(v) if v else np.empty(0, np.uint64 if k in ("key", "body") else np.int64) for k, v in out.items()}
    found["doc"] = np.searchsorted(unit.at, found["first"], "right") - 1  # empty texts begin where the next one does: the last is meant
    return found


def _groups(sorted_by: np.ndarray) -> np.ndarray:
    """Where each run of equal neighbours begins."""
    return np.flatnonzero(np.concatenate(([True], sorted_by[1:] != sorted_by[:-1]))) if len(sorted_by) else np.empty(0, np.int64)


class Asked:
    """A unit's different stretches in the order of key (cut to `bits`) and body, and what it asks about them."""

    def __init__(self, unit: Unit, bits: int):
        s = self.s = stretches(unit)
        key, body = s["key"] >> np.uint64(64 - bits), s["body"] >> np.uint64(64 - _BODY)
        doc = unit.ids[s["doc"]] if len(unit.ids) else np.empty(0, np.int64)
        self.doc = doc
        order = np.lexsort((doc, body, key))
        key, body = key[order], body[order]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (body[1:] != body[:-1]))) if len(key) else np.empty(0, bool)
        at = np.flatnonzero(new)
        self.of = np.empty(len(order), np.int64)  # of each stretch, the number of its kind
        self.of[order] = np.cumsum(new) - 1
        self.key, self.body, self.least = key[at], body[at], doc[order][at]
        begin = _groups(self.key)
        many = np.diff(begin, append=len(self.key)) > MANY
        self.many = np.repeat(many, np.diff(begin, append=len(self.key)))
        ask = ~self.many
        ask[begin] = True  # one of a key with many says so
        self.ask = np.flatnonzero(ask)

    def cut(self, parts: int, bits: int):
        return packed.cuts(self.key[self.ask] << np.uint64(64 - bits), parts)


def _asking(bits: int, parts: int):
    def fn(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                x = Asked(Unit(row), bits)
                out = {"part": [], "unit": [], "key": [], "body": [], "doc": []}
                for part, a, b in x.cut(parts, bits):
                    own = x.ask[a:b]
                    out["part"].append(part)
                    out["unit"].append(row["unit"])
                    out["key"].append(packed.pack(x.key[own]))
                    out["body"].append(packed.plain((x.body[own] << np.uint64(1)) | x.many[own]))
                    out["doc"].append(packed.plain(x.least[own]))
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64() if k in ("part", "unit") else pa.binary()) for k, v in out.items()})

    return fn


def _answer(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """For each unit and stretch two bits: an earlier document has it whole; its key comes with another stretch too."""
    keys = [packed.unpack(x) for x in t.column("key").to_pylist()]
    k, sizes = np.concatenate(keys), [len(x) for x in keys]
    body = np.concatenate([packed.unplain(x, np.uint64) for x in t.column("body").to_pylist()])
    doc = np.concatenate([packed.unplain(x) for x in t.column("doc").to_pylist()])
    many, body = (body & np.uint64(1)).astype(bool), body >> np.uint64(1)
    order = np.lexsort((body, k))
    ks, bs = k[order], body[order]
    at = _groups(ks)
    size = np.diff(at, append=len(ks))
    several = (np.minimum.reduceat(bs, at) != np.maximum.reduceat(bs, at)) | np.logical_or.reduceat(many[order], at)
    kind = np.flatnonzero(np.concatenate(([True], (ks[1:] != ks[:-1]) | (bs[1:] != bs[:-1]))))
    first = np.repeat(np.minimum.reduceat(doc[order], kind), np.diff(kind, append=len(ks)))
    whole, other = np.empty(len(k), bool), np.empty(len(k), bool)
    whole[order], other[order] = first < doc[order], np.repeat(several, size)
    ends = np.cumsum(sizes)
    bits = [np.concatenate((np.packbits(whole[e - n : e]), np.packbits(other[e - n : e]))) for e, n in zip(ends, sizes)]
    some = [i for i, x in enumerate(bits) if x.any()]
    units = t.column("unit").to_pylist()
    return pa.table({"unit": pa.array([units[i] for i in some], pa.int64()), "part": pa.array([key[0].as_py()] * len(some), pa.int64()), "blob": pa.array([bits[i].tobytes() for i in some], pa.binary())})


# what is left: the suffix array


def multikey_order(n: int, column) -> tuple[np.ndarray, np.ndarray]:
    """The order of n rows of 8-byte keys, and for each place in it whether the row equals the one before. column(k, rows): the k-th keys of some rows.

    Multikey quicksort by levels: rows are sorted by one key, and only those that tie go on to the next one, within their ties.
    """
    order, tied = np.arange(n), np.zeros(n, bool)
    group, live = np.zeros(n, np.int64), np.arange(n)  # live: places whose rows still tie with a neighbour
    for k in range(-(-SPAN // 8)):
        if not len(live):
            break
        own = order[live]
        key = column(k, own)
        turn = np.lexsort((key, group[live]))
        order[live], v = own[turn], key[turn]
        g = group[live]  # places of a group lie together and stay its own
        same = np.concatenate(([False], (v[1:] == v[:-1]) & (g[1:] == g[:-1])))
        tied[live] = same
        group[live] = live[np.maximum.accumulate(np.where(same, 0, np.arange(len(live))))]
        live = live[same | np.concatenate((same[1:], [False]))]
    return order, tied


def _keys(buf: np.ndarray, place: np.ndarray):
    """column() of multikey_order() for the SPAN bytes from each place."""
    padded = np.concatenate((buf, np.zeros(SPAN + 8, np.uint8)))
    eight = np.ndarray(len(buf) + SPAN, ">u8", padded.data, strides=(1,))
    rest = np.uint64((1 << 64) - (1 << 8 * (-SPAN % 8)))  # what of the last key is within the SPAN bytes
    return lambda k, rows: eight[place[rows] + 8 * k].astype(np.uint64) & (rest if 8 * k + 8 > SPAN else ~np.uint64(0))


class Left:
    """What the answers leave of a unit: the runs of places whose strings repeat, the other strings' places, and the different ones among these in their order."""

    def __init__(self, row: dict, said: dict[int, bytes], bits: int, parts: int):
        unit = self.unit = Unit(row)
        x = Asked(unit, bits)
        begin = _groups(x.key)
        size = np.diff(begin, append=len(x.key))
        whole, other = np.zeros(len(x.key), bool), np.repeat(size > 1, size)
        for part, a, b in x.cut(parts, bits):
            if part in said:
                two, own = np.frombuffer(said[part], np.uint8).reshape(2, -1), x.ask[a:b]
                whole[own] = np.unpackbits(two[0], count=b - a).astype(bool)
                other[own] |= np.unpackbits(two[1], count=b - a).astype(bool)
        done = (whole & ~x.many)[x.of] | (x.doc > x.least[x.of])
        self.first, self.last = x.s["first"][done], x.s["last"][done]
        todo = np.flatnonzero(~done & other[x.of])
        first, last, doc = x.s["first"][todo], x.s["last"][todo], x.doc[todo]
        turn = np.argsort(first)
        n = (last - first + 1)[turn]
        self.place = np.repeat(first[turn] - np.cumsum(n) + n, n) + np.arange(n.sum())
        self.doc = np.repeat(doc[turn], n)
        h = np.empty(len(self.place), np.uint64)
        for lo, hi in unit.chunks():
            a, b = np.searchsorted(self.place, (lo, hi - SPAN + 1))
            if b > a:
                h[a:b] = _Hashes(unit.buf[lo:hi]).spans(self.place[a:b] - lo, self.place[a:b] - lo + SPAN)
        order = np.lexsort((self.doc, h))
        new = _groups(h[order])
        kinds = self.place[order][new]
        turn, _ = multikey_order(len(kinds), _keys(unit.buf, kinds))
        self.kinds, self.least = kinds[turn], self.doc[order][new][turn]
        number = np.empty(len(kinds), np.int64)
        number[turn] = np.arange(len(kinds))
        self.which = np.empty(len(self.place), np.int64)
        self.which[order] = np.repeat(number, np.diff(new, append=len(h)))

    def suffix(self, i: int) -> bytes:
        return self.unit.buf[self.kinds[i] : self.kinds[i] + SPAN].tobytes()

    def cut(self, splitters: list[bytes]) -> list[tuple[int, int, int]]:
        """(bucket, from, to) of the buckets that get some of the different strings: bucket k has those from the k-th splitter on."""
        ends = [bisect_left(range(len(self.kinds)), x, key=self.suffix) for x in splitters]
        return [(k, a, b) for k, (a, b) in enumerate(zip([0, *ends], [*ends, len(self.kinds)])) if b > a]


def splitters(units: DataFrame, n_units: int, buckets: int) -> list[bytes]:
    """buckets - 1 suffixes at even distances in the order of a sample of all: some of each unit's, at places drawn by the unit's number."""
    each = -(-SAMPLED * buckets // max(1, n_units))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                buf = Unit(row).buf
                at = np.random.default_rng(row["unit"]).integers(0, len(buf) - SPAN, each) if len(buf) > SPAN else ()
                yield pa.RecordBatch.from_pydict({"suffix": pa.array([buf[p : p + SPAN].tobytes() for p in at], pa.binary())})

    if buckets < 2:
        return []
    found = sorted(bytes(r[0]) for r in units.mapInArrow(run, "suffix binary").collect())
    return sorted({found[k * len(found) // buckets] for k in range(1, buckets)}) if found else []


def _left(bits: int, parts: int, sent):
    def fn(key: tuple[pa.Scalar, ...], units: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in ("bucket", "unit", "start", "suffixes", "doc")}
        for row in units.to_pylist():
            x = Left(row, dict(zip(answers.column("part").to_pylist(), answers.column("blob").to_pylist())), bits, parts)
            for bucket, a, b in x.cut(sent.value):
                text = x.unit.buf[x.kinds[a:b, None] + np.arange(SPAN)]
                for k, v in zip(out, (bucket, row["unit"], a, zstandard.ZstdCompressor(level=3).compress(text.tobytes()), packed.plain(x.least[a:b]))):
                    out[k].append(v)
        return pa.table({k: pa.array(v, pa.binary() if k in ("suffixes", "doc") else pa.int64()) for k, v in out.items()})

    return fn


def _bucket(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """One bucket of suffixes: sorted, neighbours compared; the numbers of those that an earlier document has go back to their units."""
    docs = [packed.unplain(x) for x in t.column("doc").to_pylist()]
    text = [np.frombuffer(zstandard.ZstdDecompressor().decompress(x, max_output_size=SPAN * len(d)), np.uint8) for x, d in zip(t.column("suffixes").to_pylist(), docs)]
    doc, buf = np.concatenate(docs), np.concatenate(text)
    order, tied = multikey_order(len(doc), _keys(buf, np.arange(len(doc)) * SPAN))
    at = np.flatnonzero(~tied)
    late = np.empty(len(doc), bool)
    late[order] = np.repeat(np.minimum.reduceat(doc[order], at), np.diff(at, append=len(doc))) < doc[order]
    ends = np.cumsum([len(d) for d in docs])
    found = [(u, packed.pack((np.flatnonzero(late[e - len(d) : e]) + a).astype(np.uint64))) for u, a, d, e in zip(t.column("unit").to_pylist(), t.column("start").to_pylist(), docs, ends)]
    found = [x for x in found if x[1]]
    return pa.table({"unit": pa.array([u for u, _ in found], pa.int64()), "part": pa.array([-1] * len(found), pa.int64()), "blob": pa.array([x for _, x in found], pa.binary())})


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _kept(bits: int, parts: int, with_bytes: bool):
    def fn(key: tuple[pa.Scalar, ...], units: pa.Table, said: pa.Table) -> pa.Table:
        both = list(zip(said.column("part").to_pylist(), said.column("blob").to_pylist()))
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for row in units.to_pylist():
            x = Left(row, {p: v for p, v in both if p >= 0}, bits, parts)
            unit, late = x.unit, np.zeros(len(x.kinds), bool)
            for p, v in both:
                if p < 0:
                    late[packed.unpack(v).astype(np.int64)] = True
            place = x.place[late[x.which] | (x.doc > x.least[x.which])]
            change = np.zeros(len(unit.buf) + 1, np.int32)
            for first, last in ((x.first, x.last), (place, place)):
                np.add.at(change, first, 1)
                np.add.at(change, last + SPAN, -1)
            gone = np.cumsum(change[:-1]) > 0
            for i, null, a, b in zip(unit.ids.tolist(), unit.null.tolist(), unit.at[:-1].tolist(), unit.at[1:].tolist()):
                own = gone[a:b]
                left = unit.buf[a:b][~own].tobytes() if own.any() else unit.buf[a:b].tobytes()
                out["doc_id"].append(None if null else i)
                out["n_bytes"].append(b - a)
                out["n_removed"].append(b - a - len(left))
                out["n_spans"].append(int(np.count_nonzero(own[1:] & ~own[:-1]) + own[0]) if b > a else 0)
                out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
                out["kept"].append(left if with_bytes else None)
        kinds = {"kept_sha256": pa.string(), "kept": pa.binary()}
        return pa.table({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})

    return fn


def drop_repeats(docs: DataFrame, with_bytes: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and (with_bytes) kept, the bytes left.

    A byte goes if a 50-byte string that covers it also starts in a document of smaller doc_id, judged on the input; matches do not cross documents.
    A null text is empty; a text of under 50 bytes loses none; rows of equal doc_id do not remove each other's bytes, so repeated rows fare alike; a null doc_id
    comes after all others. No rows give none. What is left may be cut within a character, so it is binary. Of docs' columns only doc_id and text are used.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    units = _pack_units(docs, max(UNIT_BYTES[0], min(UNIT_BYTES[1], total // 4000)))
    likely = total // 10 + 1  # stretches
    bits, parts = min(62, max(24, math.ceil(math.log2(likely + 2)) + 10)), -(-likely // PART_STRETCHES)
    asked = units.mapInArrow(_asking(bits, parts), "part long, unit long, key binary, body binary, doc binary")
    answers = written(asked.groupBy("part").applyInArrow(_answer, "unit long, part long, blob binary"), "answers")
    sent = spark.sparkContext.broadcast(splitters(units, units.count(), min(SPLITTERS, total // BUCKET_BYTES + 1)))
    by_unit = units.groupBy("unit")  # its exchange serves both rounds
    left = by_unit.cogroup(answers.groupBy("unit")).applyInArrow(_left(bits, parts, sent), "bucket long, unit long, start long, suffixes binary, doc binary")
    late = left.groupBy("bucket").applyInArrow(_bucket, "unit long, part long, blob binary")
    out = by_unit.cogroup(answers.union(late).groupBy("unit")).applyInArrow(_kept(bits, parts, with_bytes), KEPT)
    return out if with_bytes else out.drop("kept")


def brute(rows: list[tuple[int | None, str | None]]) -> list[tuple[int, int, int, str]]:
    """By the definition, for tests: n_bytes, n_removed, n_spans, kept_sha256."""
    texts = [(LAST if i is None else i, (t or "").encode()) for i, t in rows]
    least: dict[bytes, int] = {}
    for i, t in texts:
        for k in range(len(t) - SPAN + 1):
            g = t[k : k + SPAN]
            least[g] = min(i, least.get(g, i))
    out = []
    for i, t in texts:
        gone = {j for k in range(len(t) - SPAN + 1) if least[t[k : k + SPAN]] < i for j in range(k, k + SPAN)}
        left = bytes(c for j, c in enumerate(t) if j not in gone)
        out.append((len(t), len(gone), sum(j - 1 not in gone for j in gone), hashlib.sha256(left).hexdigest()))
    return out
