"""Removal of word sequences that an earlier document has, by fixed-block anchors.

A window is 13 consecutive words. Every document's words are cut into blocks of 7 that do not overlap:
any window holds one block whole. The blocks are indexed and probed with every rolling run of 7 words. A run that
is some document's block and occurs elsewhere too is a hit; the windows around hits are the only ones that
can repeat, and are compared by their own 64-bit hashes: those of an earlier document mark the words.
Neighbouring marked windows join, so a repeat is removed to its full length.

Both comparisons are packed exchanges (packed.py) between units of a few MB of text: what is shuffled is the
text once and a few bytes a word, no pair of documents is ever formed, and a passage that a million
documents share crosses once for each unit.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import packed
from quillon.llm.shared import slices
from quillon.llm.words import SPACED, words

WINDOW, BLOCK = 13, 7  # 2 * BLOCK - 1 <= WINDOW: each window holds a whole block
#: Characters of a unit and runs of a part, at least and at most. They grow with the corpus, so that what a unit sends to a part does
#: not shrink to a few hashes: parts and units multiply.
UNIT_CHARS, PART_RUNS = (4_000_000, 64_000_000), (2_000_000, 16_000_000)
LAST = (1 << 63) - 1


def _ids(t: pa.Table) -> np.ndarray:
    return t.column("doc_id").fill_null(LAST).to_numpy()


def _grams(t: pa.Table, n: int):
    """For slices of the texts: number of the first text, its words, the runs of n words."""
    texts = t.column("text").to_pylist()
    for a, b in slices(texts):
        w = words(texts[a:b], SPACED)
        yield a, w, *w.grams(n)


def _runs(t: pa.Table, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The unit's distinct runs of a block's length, cut to bits, and whether each is a block of the index or occurs twice."""
    got = [(g, w.position[at] % BLOCK == 0) for _, w, at, g in _grams(t, BLOCK)]
    h = np.concatenate([g for g, _ in got]) >> np.uint64(64 - bits) << np.uint64(64 - bits)
    order = np.argsort(h)
    h, anchor = h[order], np.concatenate([x for _, x in got])[order]
    at = np.flatnonzero(np.diff(h, prepend=h[:1] ^ np.uint64(1 << 63))) if len(h) else np.empty(0, np.int64)
    n = np.diff(at, append=len(h))
    return h[at], (np.logical_or.reduceat(anchor, at) if len(at) else anchor).astype(np.uint64) * np.uint64(2) + (n > 1).astype(np.uint64)


def _table(**columns) -> pa.Table:
    return pa.table({k: pa.array(v, pa.binary() if k == "blob" or k == "extra" else pa.int64()) for k, v in columns.items()})


def _ask(bits: int, parts: int):
    def fn(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        h, flags = _runs(t, bits)
        low = np.uint64(64 - bits)
        cut = packed.cuts(h, parts)
        return _table(part=[p for p, *_ in cut], unit=[key[0].as_py()] * len(cut), blob=[packed.pack(((h[a:b] >> low) << np.uint64(2)) | flags[a:b]) for _, a, b in cut])

    return fn


def _answer(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    units, lists = t.column("unit").to_pylist(), [packed.unpack(x) for x in t.column("blob").to_pylist()]
    v = np.concatenate(lists)
    order = np.argsort(v >> np.uint64(2), kind="stable")
    s = v[order]
    at = np.flatnonzero(np.diff(s >> np.uint64(2), prepend=~(s[0] >> np.uint64(2))))
    any_of = np.bitwise_or.reduceat(s, at)
    n = np.diff(at, append=len(s))
    hit = np.empty(len(v), bool)
    hit[order] = np.repeat(((any_of & np.uint64(2)) > 0) & ((n > 1) | ((any_of & np.uint64(1)) > 0)), n)
    ends = np.cumsum([len(x) for x in lists])
    bits = [hit[e - len(x) : e] for e, x in zip(ends, lists)]
    some = [i for i, x in enumerate(bits) if x.any()]
    return _table(unit=[units[i] for i in some], part=[key[0].as_py()] * len(some), blob=[np.packbits(bits[i]).tobytes() for i in some])


def _first(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, ascending, and the smallest document of each."""
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    at = np.flatnonzero(np.diff(h, prepend=~h[:1])) if len(h) else np.empty(0, np.int64)
    return h[at], doc[at]


def _windows(bits: int, parts: int):
    def fn(key: tuple[pa.Scalar, ...], docs: pa.Table, answers: pa.Table) -> pa.Table:
        h, _ = _runs(docs, bits)
        hit, said = np.zeros(len(h), bool), dict(zip(answers.column("part").to_pylist(), answers.column("blob").to_pylist()))
        for p, a, b in packed.cuts(h, parts):
            if p in said:
                hit[a:b] = np.unpackbits(np.frombuffer(said[p], np.uint8), count=b - a)
        h, ids, got, own = h[hit], _ids(docs), [], []
        for first, w, at, g in _grams(docs, BLOCK) if len(h) else ():
            g = g >> np.uint64(64 - bits) << np.uint64(64 - bits)
            mark = np.zeros(len(w.hash) + WINDOW, np.int64)
            mark[at[h[np.minimum(np.searchsorted(h, g), len(h) - 1)] == g]] = 1
            sums = np.concatenate(([0], np.cumsum(mark)))
            at, g = w.grams(WINDOW)
            near = sums[at + WINDOW - BLOCK + 1] > sums[at]
            got.append(g[near])
            own.append(ids[first + w.doc[at[near]]])
        if not got:
            return _table(part=[], unit=[], blob=[], extra=[])
        h, doc = _first(np.concatenate(got), np.concatenate(own))
        cut = packed.cuts(h, parts)
        return _table(part=[p for p, *_ in cut], unit=[key[0].as_py()] * len(cut), blob=[packed.pack(h[a:b]) for _, a, b in cut], extra=[packed.plain(doc[a:b]) for _, a, b in cut])

    return fn


def _earlier(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """For each unit the windows that another unit has in an earlier document."""
    units, lists = t.column("unit").to_pylist(), [packed.unpack(x) for x in t.column("blob").to_pylist()]
    doc, h = np.concatenate([packed.unplain(x) for x in t.column("extra").to_pylist()]), np.concatenate(lists)
    known, first = _first(h, doc)
    late = first[np.searchsorted(known, h)] < doc
    ends = np.cumsum([len(x) for x in lists])
    out = [(u, x[late[e - len(x) : e]]) for u, x, e in zip(units, lists, ends)]
    out = [(u, x) for u, x in out if len(x)]
    return _table(unit=[u for u, _ in out], blob=[packed.pack(x) for _, x in out])


KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _kept(with_text: bool):
    def fn(key: tuple[pa.Scalar, ...], docs: pa.Table, late: pa.Table) -> pa.Table:
        theirs = np.sort(np.concatenate([np.empty(0, np.uint64), *(packed.unpack(x) for x in late.column("blob").to_pylist())]))
        ids, got = _ids(docs), [(first + w.doc[at], g) for first, w, at, g in _grams(docs, WINDOW)]
        mine, least = _first(np.concatenate([g for _, g in got]), ids[np.concatenate([d for d, _ in got])])
        out = {k: [] for k in ("n_words", "n_removed", "kept_sha256", "kept")}
        for first, w, at, g in _grams(docs, WINDOW):
            gone = least[np.searchsorted(mine, g)] < ids[first + w.doc[at]] if len(g) else np.empty(0, bool)
            if len(theirs) and len(g):
                gone |= theirs[np.minimum(np.searchsorted(theirs, g), len(theirs) - 1)] == g
            change = np.zeros(len(w.hash) + WINDOW + 1, np.int32)
            change[at[gone]] += 1
            np.add.at(change, at[gone] + WINDOW, -1)
            keep = np.cumsum(change[: len(w.hash)]) == 0
            edge = np.zeros(len(w.buf) + 1, np.int8)
            edge[w.start[keep]] += 1
            np.add.at(edge, w.end[keep] + 1, -1)  # with one byte after each word, made a space
            buf = w.buf.copy()
            buf[w.end] = 32
            left = buf[np.cumsum(edge[:-1], dtype=np.int8) > 0].tobytes()
            size = np.bincount(w.doc[keep], weights=(w.end - w.start + 1)[keep], minlength=len(w.count)).astype(np.int64)
            ends = np.cumsum(size).tolist()
            for n, k, e, s in zip(w.count.tolist(), np.bincount(w.doc[keep], minlength=len(w.count)).tolist(), ends, size.tolist()):
                text = left[e - s : e - 1] if s else b""
                out["n_words"].append(n)
                out["n_removed"].append(n - k)
                out["kept_sha256"].append(hashlib.sha256(text).hexdigest())
                out["kept"].append(text.decode("utf-8", "surrogatepass") if with_text else None)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.table({"doc_id": docs.column("doc_id")} | {k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds)})

    return fn


def _within(n: int, bounds: tuple[int, int]) -> int:
    return max(bounds[0], min(bounds[1], n))


def drop_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 and (with_text) kept, the words left, joined by one space.

    Words are runs of anything but white space (space, 9 to 13). A window counts as repeated if it starts in a document of smaller
    doc_id, judged on the input. A null text has no words; a text of under 13 words loses none; rows of equal
    doc_id do not remove each other's words; a null doc_id comes after all others. Of docs' columns only doc_id and text are used.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chars = own.agg(F.sum(F.length("text"))).first()[0] or 0
    units = -(-chars // _within(chars // 4000, UNIT_CHARS)) or 1
    parts = -(-chars // (6 * _within(chars // 25_000, PART_RUNS))) or 1
    bits = min(62, max(24, math.ceil(math.log2(chars + 2))) + 8)
    units_of = own.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(units)).alias("unit"), "doc_id", "text")
    by_unit = units_of.groupBy("unit")
    asked = by_unit.applyInArrow(_ask(bits, parts), "part long, unit long, blob binary")
    answers = asked.groupBy("part").applyInArrow(_answer, "unit long, part long, blob binary")
    near = by_unit.cogroup(answers.groupBy("unit")).applyInArrow(_windows(bits, parts), "part long, unit long, blob binary, extra binary")
    late = near.groupBy("part").applyInArrow(_earlier, "unit long, blob binary")
    out = by_unit.cogroup(late.groupBy("unit")).applyInArrow(_kept(with_text), KEPT)
    return out if with_text else out.drop("kept")


def brute(rows: list[tuple[int | None, str | None]]) -> list[tuple[int, int, str]]:
    """By the definition, for tests: n_words, n_removed, kept_sha256."""
    import re

    split = [(LAST if i is None else i, re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in rows]
    least: dict[tuple, int] = {}
    for i, own in split:
        for k in range(len(own) - WINDOW + 1):
            g = tuple(own[k : k + WINDOW])
            least[g] = min(i, least.get(g, i))
    out = []
    for i, own in split:
        gone = {j for k in range(len(own) - WINDOW + 1) if least[tuple(own[k : k + WINDOW])] < i for j in range(k, k + WINDOW)}
        left = " ".join(x for j, x in enumerate(own) if j not in gone)
        out.append((len(own), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return out
