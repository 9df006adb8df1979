"""Toxicity by compression distance.

Two zstandard dictionaries are made: one trained on ordinary text, and one of the telling words of toxic text, those that toxic documents
have far more often (by a likelihood ratio of word pieces). The latter is trained on toxic texts of which only these words are left, or it is the words
themselves, best last: trainers leave out words that a calibration part of the sample shows to be needed, and that part chooses.
Windows of a text are compressed with the ordinary dictionary and with both; what the toxic one saves
shows toxic words. The share and number of windows that save at least some bytes are turned
into a score by a logistic fit on the calibration part, which also chooses the number of telling words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.samples import balanced, bounded, held_out
from quillon.llm.shared import mapped, pieces, written

#: Rows that are fitted on, at most about (half for the dictionaries, half for calibration), and characters, of each label and of a text.
TOXIC_SAMPLE, ORDINARY_SAMPLE, SAMPLE_CHARS, SAMPLE_LONGEST = 2400, 4800, 16_000_000, 400_000
WINDOW, STEP, LEVEL, BASE_BYTES = 96, 72, 9, 16384
SAVINGS, WORD_LIMITS, PIECES = (2, 3, 4, 5, 6), (30, 60, 120), (5, 6, 7, 8)
#: The toxic dictionary's trainer: bytes a word, lengths of the segments that it keeps and of the strings that it counts, so short that single words stay.
WORD_BYTES, SEGMENT, COUNTED = 34, 24, 6
#: Stretches of 40 words, at most, that the ordinary dictionary is trained on: every k-th of the sample's.
PARTS = 20_000
#: Every so many texts of the calibration part choose among the candidates for the toxic dictionary.
STRIDE = 4
#: A piece is telling if its likelihood ratio statistic and its ratio of frequencies are at least these.
TELLING, TIMES = 15.0, 25.0
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")


def _words(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").lower().encode("utf-8", "surrogatepass"))


def _pieces(words, sizes: tuple[int, ...] = PIECES) -> set[bytes]:
    out = set()
    for w in words:
        w = b" " + w + b" "
        if len(w) < min(PIECES) in sizes:
            out.add(w)
        for n in sizes:
            out.update(w[i : i + n] for i in range(len(w) - n + 1))
    return out


def _likelihood(x: int, y: int, nx: int, ny: int) -> float:
    """Of a piece in x of nx toxic and y of ny ordinary documents, against equal shares."""
    n, all_ = x + y, nx + ny
    cell = lambda k, e: k * math.log(k / e) if k and e else 0.0
    return 2 * (cell(x, n * nx / all_) + cell(y, n * ny / all_) + cell(nx - x, nx * (1 - n / all_)) + cell(ny - y, ny * (1 - n / all_)))


def _telling(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """Words with the most telling pieces, best first, at most two for a piece."""
    nx, ny = len(toxic), len(ordinary)
    own = [set(_words(t)) for t in toxic]
    ct: dict[bytes, int] = {}
    for size in PIECES:  # one size after the other: most pieces are rare and go at once
        ct |= {p: n for p, n in Counter(p for w in own for p in _pieces(w, (size,))).items() if n >= 3}
    co = Counter(p for t in ordinary for p in _pieces(set(_words(t))) if p in ct)
    good = {p: g for p, n in ct.items() if n / nx >= TIMES * (co[p] + 0.5) / max(ny, 1) and (g := _likelihood(n, co[p], nx, ny)) >= TELLING}
    found, seen, out = {}, Counter(), []
    for w, n in Counter(x for w in own for x in w).items():
        if best := max((p for p in _pieces([w]) if p in good), key=lambda p: (good[p], p), default=None):
            found[w] = (-good[best], -n, w, best)
    for w in sorted(found, key=found.get):
        if seen[found[w][3]] < 2:
            seen[found[w][3]] += 1
            out.append(w)
    return out


def _ordinary(texts: list[str]) -> bytes:
    cut = lambda: (b" ".join(w[i : i + 40]) + b" " for t in texts for w in [_words(t)] for i in range(0, len(w), 40))
    # evenly over all of them, so that texts late in the sample count as the first do
    parts = list(islice(cut(), 0, None, max(1, -(-sum(1 for _ in cut()) // PARTS))))
    try:
        return zstandard.train_dictionary(BASE_BYTES, parts).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: it is its own dictionary
        return b"".join(parts)[-BASE_BYTES:] or b" " * 8


def _toxic(texts: list[str], telling: list[bytes]) -> list[bytes]:
    """The telling words themselves, and (where there is enough to train on) a dictionary trained on what these words leave of the texts."""
    known, out = set(telling), [b" " + b" ".join(reversed(telling)) + b" " if telling else b""]
    left = [[w for w in _words(t) if w in known] for t in texts]
    try:
        out.append(zstandard.train_dictionary(max(256, WORD_BYTES * len(telling)), [b" " + b" ".join(w) + b" " for w in left if w] * 2, k=SEGMENT, d=COUNTED).as_bytes())
    except zstandard.ZstdError:
        pass
    return out


def _windows(text: str | None) -> list[bytes]:
    b = b" " + b" ".join(_words(text)) + b" "
    return [b[i : i + WINDOW] for i in range(0, max(1, len(b) - (WINDOW - STEP)), STEP)]


def _savings(d: np.ndarray) -> list[float]:
    """What a text is scored by, from the bytes that each of its windows saves."""
    over = [(d >= k).sum() for k in SAVINGS]
    return [d.max(), np.sort(d)[-3:].mean(), d.mean(), *(20 * x / len(d) for x in over), *(math.log1p(x) for x in over[1:]), math.log1p(len(d))]


@dataclass
class Model:
    base: bytes = b" " * 8
    toxic: bytes = b""
    weights: list[float] = field(default_factory=list)
    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    floor: float = 0.0

    def compressors(self):
        def of(content):
            # what trainers add for entropy coding is of no use in windows as short as these; the last bytes of a content are not searched, so they are none of it
            made = zstandard.ZstdCompressionDict(content + bytes(16), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False).compress

        return of(self.base), of(self.base + self.toxic)

    def features(self, texts: list[str | None], made=None) -> np.ndarray:
        plain, toxic = made or self.compressors()
        return np.array([_savings(np.array([len(plain(x)) - len(toxic(x)) for x in _windows(t)], float)) for t in texts]).reshape(len(texts), -1)

    def score(self, texts: list[str | None], made=None) -> np.ndarray:
        if not self.weights:
            return np.full(len(texts), self.floor)
        x = (self.features(texts, made) - self.mean) / self.scale
        # summed row by row: a matrix product would round a text's score by the texts beside it
        return 1 / (1 + np.exp(-np.clip((x * self.weights[:-1]).sum(1) + self.weights[-1], -30, 30)))


def _calibrated(model: Model, x: np.ndarray, y: np.ndarray) -> float:
    """Sets the logistic fit to features x; returns its mean log loss."""
    model.mean, model.scale = x.mean(0).tolist(), (x.std(0) + 1e-9).tolist()
    a, w = np.c_[(x - model.mean) / model.scale, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w += np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.eye(len(w)), a.T @ (y - p) - w)
    model.weights = w.tolist()
    p = np.clip(1 / (1 + np.exp(-np.clip(a @ w, -30, 30))), 1e-9, 1 - 1e-9)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def train(rows: list[tuple[str | None, int]], natural: float | None = None) -> Model:
    """rows: (text, label). natural: the share of label 1 among all labelled rows, to which the scores are calibrated."""
    toxic, ordinary = [t or "" for t, y in rows if y == 1], [t or "" for t, y in rows if y != 1]
    if len(toxic) < 4 or len(ordinary) < 4:
        return Model(floor=1.0 if toxic and not ordinary else 0.0)
    telling = _telling(toxic[::2], ordinary[::2])
    base, best = _ordinary(ordinary[::2]), None
    test, y = toxic[1::2] + ordinary[1::2], np.array([1.0] * len(toxic[1::2]) + [0.0] * len(ordinary[1::2]))
    cut = [_windows(t) for t in test]
    plain = Model(base).compressors()[0]
    before = [np.array([len(plain(x)) for x in w], float) for w in cut]  # what the ordinary dictionary makes of them is the same for all candidates

    def features(model: Model, some) -> np.ndarray:
        toxic = model.compressors()[1]
        return np.array([_savings(before[i] - [len(toxic(x)) for x in cut[i]]) for i in some])

    few = range(0, len(test), STRIDE if len(test) >= 40 * STRIDE else 1)
    for limit in WORD_LIMITS:  # candidates are compared on a stride of the calibration part; the best one is fitted to all of it
        for content in _toxic(toxic[::2], telling[:limit]):
            model = Model(base, content)
            loss = _calibrated(model, features(model, few), y[few])
            if best is None or loss < best[0]:
                best = (loss, model)
        if len(telling) <= limit:
            break
    model = best[1]
    _calibrated(model, features(model, range(len(test))), y)
    if natural is not None and 0 < natural < 1:
        share = y.mean()
        model.weights[-1] += math.log(natural / (1 - natural)) - math.log(share / (1 - share))
    return model


def fit(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC_SAMPLE, ordinary: int = ORDINARY_SAMPLE, chars: int = SAMPLE_CHARS, longest: int = SAMPLE_LONGEST) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic. Labels of held-out documents, null labels and null ids teach nothing; of repeated labels the larger
    counts, and equal texts of one label teach once, so an id that many documents share does not fill the sample. What comes to the driver is bounded in rows and characters."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r[0]: r[1] for r in known.groupBy("toxic").agg(F.count("*")).collect()}
    # about as many ids as the sample is large, whatever the corpus; written, so that Spark knows its size when it picks the join
    chosen = written(balanced(known, "toxic", {1: toxic, 0: ordinary}), "sample-ids")
    rows = written(docs.select("doc_id", "text").join(chosen, "doc_id").select("text", "toxic"), "sample")
    return train(bounded(rows, "toxic", {1: toxic, 0: ordinary}, chars, longest), n.get(1, 0) / max(1, sum(n.values())))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with toxic_score (0 to 1; of null and empty texts too). A column of that name is replaced; each row is judged by its text alone."""
    docs = docs.drop("toxic_score")
    names = docs.columns

    def run(batches):
        made = model.compressors()
        for batch in pieces(batches):
            score = pa.array(model.score(batch.column("text").to_pylist(), made).tolist(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [score], [*names, "toxic_score"])

    return mapped(docs, run, T.StructType([*docs.schema.fields, T.StructField("toxic_score", T.DoubleType())]))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest of op5, one row per row of docs."""
    found = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))
