"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's subwords are all runs of 2, 3 and 4 bytes of its lower-cased letters, with other characters as spaces. Each is
hashed to a row of an embedding table; the average goes through a linear layer and a softmax. Both are trained by
stochastic gradient descent in numpy on a bounded sample. Part of the sample sets the temperature of the
scores and the confidence below which a prediction is marked as rejected.
Scoring needs only (table times layer), a few numbers for each hash.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.samples import bounded, held_out
from quillon.llm.shared import mapped, pieces, slices

BUCKETS_BITS, SIZES, WIDTH = 16, (2, 3, 4), 16
#: What is fitted on, at most about: rows and characters of each language, characters of a text.
SAMPLE, SAMPLE_CHARS, SAMPLE_LONGEST = 500, 4_000_000, 400_000
EPOCHS, BATCH, RATE, SEED = 6, 16, 20.0, 11
REJECT = 0.01
_MAYBE = re.compile(r"[^\W\d_]")
_CLEAN = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint32)
_MUL = np.uint32(2654435761)


def has_letter(text: str | None) -> bool:
    """Letters are of Unicode's category L; numbers that are no digits, like ½ or Ⅷ, are none."""
    return bool(text) and any(m[0].isalpha() for m in _MAYBE.finditer(text))


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all subwords, and how many each text has (one at least)."""
    raw = [b"  " + t.lower().encode("utf-8", "surrogatepass") + b"  " for t in texts]
    size = np.array([len(x) for x in raw])
    b = _CLEAN[np.frombuffer(b"".join(raw), np.uint8)]
    last = max(SIZES)
    out, run = np.zeros((len(SIZES), len(b)), np.uint32), np.zeros(len(b), np.uint32)
    for n in range(last):
        run = run * np.uint32(257) + np.concatenate((b[n:], np.zeros(n, np.uint32)))
        if n + 1 in SIZES:
            out[SIZES.index(n + 1)] = ((run ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * _MUL) >> np.uint32(32 - BUCKETS_BITS)
    # runs that would reach into the next text start in the last bytes of one; those are its padding
    keep = np.ones(len(b), bool)
    for k in range(1, last):
        keep[np.cumsum(size) - k] = False
    kept = np.add.reduceat(keep, np.cumsum(size) - size)
    order = np.repeat(np.arange(len(texts)), size)[keep]
    ids = out[:, keep]
    return ids[:, np.argsort(order, kind="stable")].T.ravel(), kept * len(SIZES)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # a row for each hash, a column for each language
    bias: np.ndarray
    heat: float = 1.0
    least: float = 0.0

    def logits(self, texts: list[str]) -> np.ndarray:
        ids, n = subwords(texts)
        sums = np.add.reduceat(self.table[ids], np.cumsum(n) - n, axis=0)
        return sums / n[:, None] + self.bias

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, calibrated score, rejected); und with score 0 for a text without letters."""
        out = []
        for a, b in slices(texts):
            own = texts[a:b]
            real = [i for i, t in enumerate(own) if has_letter(t)]
            found = [("und", 0.0, True)] * len(own)
            if real and self.langs:
                p = _softmax(self.logits([own[i] for i in real]) / self.heat)
                for i, k, s in zip(real, p.argmax(1).tolist(), p.max(1).tolist()):
                    found[i] = (self.langs[k], float(s), s < self.least)
            out += found
        return out


def train(texts: list[str], langs: list[str]) -> Model:
    """Fits on four fifths and calibrates on the rest."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((1 << BUCKETS_BITS, 1), np.float32), np.zeros(1))
    rng = np.random.default_rng(SEED)
    y = np.array([names.index(x) for x in langs])
    order = rng.permutation(len(y))
    docs = []
    for t in texts:
        ids, times = np.unique(subwords([t])[0], return_counts=True)
        docs.append((ids, (times / times.sum()).astype(np.float32)))
    fit, tune = (order[len(y) // 5 :], order[: len(y) // 5]) if len(y) >= 20 else (order, order)
    table = rng.normal(0, 0.1, (1 << BUCKETS_BITS, WIDTH)).astype(np.float32)
    layer, bias = rng.normal(0, 0.3, (WIDTH, len(names))).astype(np.float32), np.zeros(len(names), np.float32)
    steps, done = EPOCHS * -(-len(fit) // BATCH), 0
    for _ in range(EPOCHS):
        mixed = rng.permutation(fit)
        for at in range(0, len(mixed), BATCH):
            rate, own = RATE * (1 - done / steps), mixed[at : at + BATCH]
            done += 1
            ids, w = np.concatenate([docs[i][0] for i in own]), np.concatenate([docs[i][1] for i in own])
            n = np.array([len(docs[i][0]) for i in own])
            mean = np.add.reduceat(table[ids] * w[:, None], np.cumsum(n) - n, axis=0)
            error = _softmax(mean @ layer + bias)
            error[np.arange(len(own)), y[own]] -= 1
            error /= len(own)
            back = error @ layer.T
            layer -= rate * 0.05 * (mean.T @ error)
            bias -= rate * 0.05 * error.sum(0)
            np.add.at(table, ids, -rate * np.repeat(back, n, axis=0) * w[:, None])
    model = Model(names, (table @ layer).astype(np.float32), bias)
    z = model.logits([texts[i] for i in tune])
    heats = np.geomspace(0.02, 20, 60)
    model.heat = float(min(heats, key=lambda h: -np.log(_softmax(z / h)[np.arange(len(tune)), y[tune]] + 1e-12).mean()))
    p = _softmax(z / model.heat)
    right = p.max(1)[p.argmax(1) == y[tune]]
    model.least = float(np.quantile(right, REJECT)) if len(right) else 0.0
    return model


def fit(docs: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS, longest: int = SAMPLE_LONGEST) -> Model:
    """docs: doc_id, text, lang. Learns from rows that are not held out; rows without a lang, a text or a letter teach nothing, equal texts of one
    lang teach once. What comes to the driver is bounded in rows and characters for each language."""
    rows = [(t, lang) for t, lang in bounded(docs.filter(~held_out(F.col("doc_id"))), "lang", sample, chars, longest) if has_letter(t)]
    return train([t for t, _ in rows], [x for _, x in rows])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score and rejected; columns of docs of those names are replaced. Each row is judged by its text alone."""
    docs = docs.drop("lang_pred", "score", "rejected")
    names = docs.columns

    def run(batches):
        for batch in pieces(batches):
            found = model.predict(batch.column("text").to_pylist())
            more = [pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + more, [*names, "lang_pred", "score", "rejected"])

    return mapped(docs, run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]))


def report(docs: DataFrame) -> DataFrame:
    """The digest of op4, one row per row of docs. A null doc_id is not held out."""
    found = identify(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), fit(docs))
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")
