"""Byte repeats against the definition, with units, parts and buckets of all sizes."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import suffix_dedup
from quillon.llm.suffix_dedup import SPAN

KIND = "doc_id long, text string"


def made(seed, n=60):
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "be", "gamma", "é", "日本", "x" * 9, "delta", "ε", "zeta", "eta"]) + str(rng.randint(0, 99))
    prose = lambda k: " ".join(word() for _ in range(k))
    texts = [prose(rng.randint(0, 60)) for _ in range(n)]
    base, passage = prose(80).split(), prose(14)
    for _ in range(15):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += [prose(5) + passage + prose(9) for _ in range(10)] + [passage, passage[:49], passage[3:53], prose(3) + passage[5:60] + prose(2)]
    texts += ["a" * k for k in (49, 50, 51, 300)] + ["ab" * 80, "ba" * 40, "x" * 200 + "y" * 200, "x" * 60 + "z" + "y" * 60]
    texts += [texts[3], texts[3], "", None, None, "\x00" * 70, "\x00" * 55, "q" + "\x00" * 50, prose(900)]
    rng.shuffle(texts)
    rows = [(i * 2, t) for i, t in enumerate(texts)]
    return rows + rows[:4] + [(8, texts[9]), (None, texts[5]), (None, texts[20])]


def check(spark, rows, parts=3):
    got = suffix_dedup.drop_repeats(spark.createDataFrame(rows, KIND).repartition(parts)).collect()
    want = [(i, *w) for (i, _), w in zip(rows, suffix_dedup.brute(rows))]
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=repr) == sorted(want, key=repr)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed for r in got)


@pytest.mark.parametrize("unit, part, bucket, many, chunk", [(4_000_000, 1_000_000, 12_500_000, 16, 1_000_000), (300, 40, 500, 1, 64), (2_000, 500, 3_000, 2, 333)])
def test_by_definition(spark, monkeypatch, unit, part, bucket, many, chunk):
    monkeypatch.setattr(suffix_dedup, "UNIT_BYTES", (unit, unit))
    monkeypatch.setattr(suffix_dedup, "PART_STRETCHES", part)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", bucket)
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    cut = suffix_dedup.Unit.chunks
    monkeypatch.setattr(suffix_dedup.Unit, "chunks", lambda self, limit=chunk: cut(self, limit))
    check(spark, made(unit))


def test_no_rows_and_few(spark):
    assert suffix_dedup.drop_repeats(spark.createDataFrame([], KIND)).count() == 0
    check(spark, [(1, None), (2, ""), (None, None)])
    clash = spark.createDataFrame([(1, "k" * 60), (2, "k" * 60)], KIND).select("*", *(F.lit(3).alias(c) for c in ("unit", "ids", "at", "doc", "suffix", "n_bytes", "a.b")))
    assert [(r.doc_id, r.n_removed, r.n_spans) for r in sorted(suffix_dedup.drop_repeats(clash, with_bytes=False).collect())] == [(1, 0, 0), (2, 60, 1)]


def test_multikey_order():
    rng = np.random.default_rng(1)
    for n, top in ((0, 2), (1, 2), (500, 2), (500, 3), (300, 1 << 40)):
        rows = rng.integers(0, top, (n, 7)).astype(np.uint64)
        order, tied = suffix_dedup.multikey_order(n, lambda k, own: rows[own, k])
        want = sorted(map(tuple, rows.tolist()))
        assert [tuple(r) for r in rows[order].tolist()] == want
        assert tied.tolist() == [i > 0 and want[i] == want[i - 1] for i in range(n)]
    text = bytes(rng.integers(0, 3, 400, dtype=np.uint8))
    place = np.arange(400 - SPAN + 1)
    order, _ = suffix_dedup.multikey_order(len(place), suffix_dedup._keys(np.frombuffer(text, np.uint8), place))
    cut = [text[p : p + SPAN] for p in order]
    assert cut == sorted(cut) and sorted(order) == list(place)


def test_equal_strings_have_equal_keys():
    """Whatever stands around a string, its stretch's key is the same."""
    rng = random.Random(6)
    core = "".join(rng.choice("abcdefgh ") for _ in range(SPAN))
    keys = set()
    for _ in range(40):
        pad = lambda: "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 80)))
        left, right = pad(), pad()
        text = f"{left}{core}{right}".encode()
        unit = suffix_dedup.Unit({"ids": np.zeros(1, np.int64).tobytes(), "null_ids": b"\0", "sizes": np.array([len(text)]).tobytes(), "texts": suffix_dedup.zstandard.ZstdCompressor().compress(text)})
        s = suffix_dedup.stretches(unit)
        at = np.flatnonzero((s["first"] <= len(left)) & (len(left) <= s["last"]))
        assert len(at) == 1 and int((s["last"] - s["first"] + 1).sum()) == len(text) - SPAN + 1
        keys.add(int(s["key"][at[0]]))
    assert len(keys) == 1
