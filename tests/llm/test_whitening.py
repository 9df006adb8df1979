"""Whitening against exact fractions, and on rows that are null, not finite, of odd lengths, repeated or none."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import whitening

KIND = "vec_id long, embedding array<double>"


def by_definition(df, got, k):
    rows = {}
    for r in got:
        rows.setdefault(r.vec_id, {})[r.component] = r
    own = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    n, deviation, matrix = whitening.brute([v for _, v in own])
    d = len(matrix)
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1], vectors[:, ::-1]
    x = np.array([[math.floor(64 * c) for c in v] for _, v in own], float)
    centred = x - np.array(sorted({tuple(v) for v in x.tolist()})).mean(axis=0)
    want = centred @ vectors[:, :k] / np.sqrt(values[:k])
    signs = np.sign([[rows[i][c + 1].whitened * w[c] for c in range(k)] for (i, _), w in zip(own, want)])
    assert len(rows) == len(own) and all(sorted(r) == list(range(1, min(k, d) + 1)) for r in rows.values())
    for (i, _), m, w, s in zip(own, deviation, want, signs):
        for c in range(k):
            r = rows[i][c + 1]
            assert (r.n, r.deviation) == (n, m) and abs(r.whitened) == pytest.approx(abs(w[c]), abs=1e-7) and r.identity_error < 1e-9
            assert r.explained == pytest.approx(values[c] / np.trace(matrix), rel=1e-9)
    for c in range(k):
        assert len({s for s in signs[:, c] if s}) == 1  # one sign for all rows


def test_against_fractions(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.3 * (j + 1)) for j in range(6)]) for i in range(80)]
    rows += [(100 + i, rows[5][1]) for i in range(200)]
    df = spark.createDataFrame(rows, KIND).repartition(5)
    by_definition(df, whitening.whiten(df, components=4).collect(), 4)
    with_more = df.select("*", F.lit(7).alias("x"), F.lit(7).alias("n"), F.lit(7).alias("k0"), F.lit(7).alias("component"), F.lit(7).alias("a.b"))
    assert whitening.whiten(with_more, components=2).count() == 560


def test_odd_vectors(spark):
    good = [[0.5, 1.0, -2.0], [0.25, 3.0, 1.0], [9.0, 1.0, 1.0], [1.0, 1.0, 5.5]]
    odd = [None, [], [None, 1.0, 1.0], [float("nan"), 1.0, 1.0], [float("inf"), 0.0, 0.0], [1.0], [1.0] * 7]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(good + odd)] + [(None, good[0]), (0, good[0])], KIND)
    got = whitening.whiten(df).collect()
    assert sorted({(r.vec_id is None, r.vec_id or 0) for r in got}) == [(False, 0), (False, 1), (False, 2), (False, 3), (True, 0)]
    assert len(got) == 6 * 3 and {r.n for r in got} == {4} and {r.component for r in got} == {1, 2, 3}
    assert max(r.identity_error for r in got) < 1e-9
    n, deviation, _ = whitening.brute(good)
    assert {r.vec_id: r.deviation for r in got if r.vec_id is not None} == dict(enumerate(deviation)) and n == 4


def test_no_variance_and_no_rows(spark):
    same = whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], KIND)).collect()
    assert len(same) == 10 and all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, None, None, 0.0) for r in same)
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), float(2 * i)]) for i in range(5)], KIND)).collect()
    assert all(r.whitened is None and r.explained == 0 for r in line if r.component == 2) and all(r.explained == pytest.approx(1) and r.identity_error < 1e-9 for r in line if r.component == 1)
    for none in (spark.createDataFrame([], KIND), spark.createDataFrame([(1, None), (2, []), (3, [float("nan")])], KIND)):
        got = whitening.whiten(none)
        assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.count() == 0


def test_large_entries(spark):
    """Sums stay exact where doubles are not, and a deviation that fits no long is null."""
    df = spark.createDataFrame([(1, [1e14, 0.5]), (2, [-1e14, 0.25]), (3, [1e300, 0.0]), (4, [0.0, 1.0])], KIND)
    got = {r.vec_id: r for r in whitening.whiten(df).filter("component = 1").collect()}
    assert len(got) == 4 and all(r.deviation is None for i, r in got.items() if i < 4)
    small = spark.createDataFrame([(1, [2e5, 0.5]), (2, [-2e5, 0.25]), (4, [0.0, 1.0])], KIND)
    _, deviation, _ = whitening.brute([[2e5, 0.5], [-2e5, 0.25], [0.0, 1.0]])
    assert [r.deviation for r in sorted(whitening.whiten(small).filter("component = 1").collect())] == deviation
