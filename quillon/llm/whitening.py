"""Whitening of embeddings by a covariance taken in two passes.

Entries become integers, so the sums are exact whatever the order of adding, and with them the mean. The second pass
centres every vector on it, multiplies the centred rows of a chunk with themselves (one GEMM) and adds
the products up in a tree of tasks. The matrix, d x d for vectors of d entries, is all that comes to the driver;
its eigenvectors go to all tasks and project every row.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import written

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Entries beyond are taken for this one, so that all x are exact as doubles.
MOST = 1 << 52
#: Entries that are multiplied at once.
CHUNK = 1 << 21
#: An eigenvalue below this share of the trace is no variance but rounding.
FLAT = 1e-12
_X = np.dtype("<i8")


def _vectors(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows whose vectors are whole, and their entries as doubles. Whole: d entries, all of them finite."""
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(sizes == d)
    if not d or not len(at):
        return at[:0], np.empty((0, d))
    flat = column.take(pa.array(at)).flatten()
    c = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, d)  # nulls become nan
    good = np.isfinite(c).all(axis=1)
    return at[good], c[good]


def _integers(c: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * c), -MOST, MOST).astype(_X) + SHIFT


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), _X).reshape(-1, d)


def _chunks(batches, d: int, column: str = "x"):
    for batch in batches:
        for a in range(0, batch.num_rows, step := max(1, CHUNK // d)):
            yield batch.slice(a, step), _matrix(batch.column(column).slice(a, step), d)


def integers(rows: DataFrame, d: int, keep: list[str], vector: str) -> DataFrame:
    """keep's columns and x (the integers, 8 bytes each) of the rows whose vectors are whole; the other rows are left out."""
    own = rows.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)), F.col(vector).cast("array<double>").alias("v"))
    schema = ", ".join([*(f"k{i} {own.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))), "x binary"])

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, step := max(1, CHUNK // max(1, d))):
                part = batch.slice(a, step)
                at, c = _vectors(part.column("v"), d)
                x = pa.array([r.tobytes() for r in _integers(c)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(pa.array(at)) for i in range(len(keep))), x], [*(f"k{i}" for i in range(len(keep))), "x"])

    return own.mapInArrow(run, schema).toDF(*keep, "x")


def dimension(rows: DataFrame, vector: str) -> int:
    """The commonest number of entries, the largest of several such; 0 without any."""
    found = rows.filter(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return found["d"] if found else 0


def _plus(a: tuple, b: tuple) -> tuple:
    return tuple(x + y for x, y in zip(a, b))


def _tree(rows: DataFrame, run, plus=_plus):
    """What run makes of each task's batches (None: nothing), added up in a tree of tasks; None if there is nothing at all."""

    def packed(batches):
        yield pa.RecordBatch.from_pydict({"v": pa.array([pickle.dumps(run(batches))], pa.binary())})

    def either(a, b):
        return b if a is None else a if b is None else plus(a, b)

    return rows.mapInArrow(packed, "v binary").rdd.map(lambda r: pickle.loads(bytes(r[0]))).treeAggregate(None, either, either)


def sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """How many vectors, and the exact sum of each entry (of any size)."""

    def run(batches):
        n, high, low = 0, np.zeros(d, object), np.zeros(d, object)
        for _, x in _chunks(batches, d):
            n += len(x)
            high += (x >> 26).sum(axis=0).astype(object)  # halves, so that no sum of a chunk leaves 64 bits
            low += (x & ((1 << 26) - 1)).sum(axis=0).astype(object)
        return n, high * (1 << 26) + low

    n, s = _tree(fit, run) or (0, np.zeros(d, object))
    return n, [int(v) for v in s]


class Centre:
    """The mean S / n as the integer nearest to it and what is left over, so that x - S / n loses nothing though x and S are large."""

    def __init__(self, n: int, s: list[int]):
        self.n = n
        whole = [(2 * v + n) // (2 * n) for v in s]
        self.near, self.rest = np.array(whole, _X), [v - n * w for v, w in zip(s, whole)]
        self.part = np.array([r / n for r in self.rest])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.near).astype(np.float64) - self.part

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n * x - S) ** 2 over the entries, exact; None if it is over the largest long."""
        y = x - self.near
        if len(y) and float(np.abs(y).max() + 1) * self.n < (1 << 31) / max(1, x.shape[1]) ** 0.5 * 1.4:  # n * y - rest, squared and summed, fits 63 bits
            m = y * self.n - np.array(self.rest, _X)
            return (m * m).sum(axis=1).tolist()
        found = [sum((self.n * v - r) ** 2 for v, r in zip(row, self.rest)) for row in y.tolist()]
        return [v if v < 1 << 63 else None for v in found]


def covariance(fit: DataFrame, d: int, centre: Centre) -> np.ndarray:
    """Of the fit list, divisor n: the second pass."""

    def run(batches):
        total = np.zeros((d, d))
        for _, x in _chunks(batches, d):
            c = centre(x)
            total += c.T @ c
        return (total,)

    return (_tree(fit, run) or (np.zeros((d, d)),))[0] / centre.n


class Whitener:
    """Eigenvalues, falling, and unit eigenvectors (columns, the largest entry of each positive) of a covariance; how to project on them."""

    def __init__(self, centre: Centre, matrix: np.ndarray):
        values, vectors = np.linalg.eigh(matrix)
        self.centre, self.values, vectors = centre, values[::-1], vectors[:, ::-1]
        self.vectors = vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None], 0) < 0, -1.0, 1.0)
        self.trace = float(np.trace(matrix))
        self.live = int((self.values > FLAT * self.trace).sum()) if self.trace > 0 else 0

    def __call__(self, x: np.ndarray, k: int) -> np.ndarray:
        k = min(k, self.live)
        return self.centre(x) @ self.vectors[:, :k] / np.sqrt(self.values[:k])


def identity_error(fit: DataFrame, d: int, whitener: Whitener, k: int) -> float:
    """The largest absolute entry of (covariance of the whitened fit list - identity), in one pass: each chunk is centred on its own mean, and chunks are merged with the
    products of their means' distances."""
    k = min(k, whitener.live)
    sent = fit.sparkSession.sparkContext.broadcast(whitener)

    def merged(a, b):
        n = a[0] + b[0]
        gap = b[1] - a[1]
        return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)

    def run(batches):
        found = None
        for _, x in _chunks(batches, d):
            w = sent.value(x, k)
            mean = w.mean(axis=0)
            one = (len(w), mean, (w - mean).T @ (w - mean))
            found = one if found is None else merged(found, one)
        return found

    found = _tree(fit, run, merged)
    return float(np.abs(found[2] / found[0] - np.eye(k)).max()) if found and k else 0.0


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each row of rows with a whole vector and each component up to `components` (d at most): key, component (from 1), n, deviation,
    whitened, explained, identity_error.

    x = floor(64 * entry) + 1,000,000. n, the mean S / n and the covariance are of the distinct x vectors, so repeated rows count once; every row with a whole vector is
    projected, repeated rows and rows without a key too. A vector is whole if it has as many entries as most vectors have (of equally common lengths the largest)
    and holds no null, infinity or nan; rows with other vectors are left out, so a table without whole vectors gives no rows. Entries of over 2^46 in size count as that.
    A component without variance (fewer distinct vectors than entries) has whitened null and explained 0 (null if there is no variance at all); identity_error is over the
    others, 0 if there are none. deviation is null where it leaves 63 bits. Other columns, whatever their names, are not read. The driver holds one d x d matrix.
    """
    d = dimension(rows, vector)
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not d:
        return rows.sparkSession.createDataFrame([], schema)
    own = written(integers(rows, d, [key], vector), "integers")
    fit = written(own.select("x").distinct(), "fit-list")
    n, s = sums(fit, d)
    if not n:
        return rows.sparkSession.createDataFrame([], schema)
    centre = Centre(n, s)
    whitener = Whitener(centre, covariance(fit, d, centre))
    error, k = identity_error(fit, d, whitener, components), min(components, d)
    explained = [max(0.0, float(v)) / whitener.trace if whitener.trace > 0 else None for v in whitener.values[:k]]
    explained = [v if i < whitener.live or v is None else 0.0 for i, v in enumerate(explained)]
    sent = rows.sparkSession.sparkContext.broadcast(whitener)

    def run(batches):
        for batch, x in _chunks(batches, d):
            w, m = sent.value(x, k), len(x)
            full = np.full((m, k), np.nan)
            full[:, : w.shape[1]] = w
            times = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(times)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, np.int64)),
                    pa.array(sent.value.centre.deviation(x), pa.int64()).take(pa.array(times)),
                    pa.array(full.ravel(), mask=np.isnan(full.ravel())),
                    pa.array(explained * m, pa.float64()),
                    pa.array(np.full(m * k, error)),
                ],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return own.mapInArrow(run, schema)


def brute(vectors: list) -> tuple[int, list[int], np.ndarray]:
    """By the definition, for tests: n, the deviations of the rows that are left, the covariance (from exact fractions)."""
    from fractions import Fraction
    from math import floor, isfinite

    left = [v for v in vectors if v is not None and all(c is not None and isfinite(c) for c in v)]
    x = [tuple(floor(SCALE * float(c)) + SHIFT for c in v) for v in left]
    fit = sorted(set(x))
    n, s = len(fit), [sum(col) for col in zip(*fit)]
    d = len(s)
    centred = [[n * v - t for v, t in zip(row, s)] for row in fit]
    matrix = np.array([[float(Fraction(sum(r[i] * r[j] for r in centred), n**3)) for j in range(d)] for i in range(d)])
    return n, [sum((n * v - t) ** 2 for v, t in zip(row, s)) for row in x], matrix
