"""The filter audit against a walk through every order, and its scan against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import audit

DOCS, LABELS = "doc_id long, text string, source string", "doc_id long, quality int, toxic int"
COLUMNS = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def made(rng, n):
    texts = [" ".join(rng.choice(["a", "b", "Über", "Ångström", "word", "x" * rng.randint(1, 30), "AB", "50%"][: rng.randint(2, 8)]) for _ in range(rng.choice([0, 3, 199, 200, 201, 260]))) for _ in range(n)]
    texts += [" ".join(f"w{i}" for i in range(250)), " ".join(f"w{i % 100}" for i in range(200)), " ".join(f"w{i % 99}" for i in range(200)), None, "", "\t\n", "é" * 60_000 + " a" * 300]
    return texts + texts[: n // 2] + [texts[0]] * 9


def test_scan():
    texts = made(random.Random(4), 20)
    for column in (pa.array(texts), pa.array(texts, pa.large_string()), pa.array(["x", *texts, "y"]).slice(1, len(texts)), pa.array([], pa.string())):
        got = audit.scan(column, limit=64)
        for i, t in enumerate(column.to_pylist()):
            w = re.findall("[^\x20\x09-\x0d]+", t or "")
            assert [int(got[k][i]) for k in ("words", "distinct", "capitals", "points", "symbols")] == [len(w), len(set(w)), len(re.findall("[A-Z]", t or "")), len(t or ""), len(re.findall(r"[#$%&*|]", t or ""))]


def test_equal_hashes_are_verified(monkeypatch):
    monkeypatch.setattr(audit, "span_hash", lambda units, start, end: np.zeros(len(start), np.uint64))
    texts = ["one two one", "a a a", "b c d e longerword longerworm", "", "same same"]
    assert audit.scan(pa.array(texts))["distinct"].tolist() == [2, 1, 6, 0, 1]


@pytest.mark.parametrize("seed", [1, 2])
def test_by_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = made(rng, 40)
    docs = [(i if rng.random() < 0.95 else None, t, rng.choice(["s", "t", "", None])) for i, t in enumerate(texts)]
    docs += docs[:5] + [(3, "other text under one id", "s")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, len(docs), 2)] + [(2, 1, 0), (None, 1, 1), (9_999, 1, 1)]
    df = spark.createDataFrame(docs, DOCS).repartition(3).select("*", F.lit(1).alias("fails"), F.lit(1).alias("n"), F.lit(2).alias("digest"), F.lit("x").alias("part"))
    got = audit.report(df, spark.createDataFrame(labels, LABELS).withColumn("said_id", F.lit(5)))
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, audit.brute(docs, labels)))


def test_no_rows(spark):
    none = audit.report(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS))
    assert none.columns == COLUMNS and none.count() == 0
    alone = audit.report(spark.createDataFrame([(1, None, None)], DOCS), spark.createDataFrame([], LABELS)).collect()
    assert len(alone) == 600 and {r.part for r in alone} == {""} and sum(r.removed for r in alone) == 120
