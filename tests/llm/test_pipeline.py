"""The pipeline: its stages' decisions against brute force over what each of them was given, and the guard around the subpackage."""

import os
import shutil
import subprocess
import sys
import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from quillon.llm import decontam, mixing, ngram_join, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == names
        kept[name] = docs.collect()
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 0").collect()}
    assert len({r.doc_id for r in kept["toxicity"]} & toxic) >= 0.95 * len(toxic)
    want = {i for i, (c, _) in ngram_join.brute([(r.doc_id, r.text) for r in kept["toxicity"]]).items() if i == c}
    assert {r.doc_id for r in kept["near copies"]} == want and len(kept["near copies"]) == len(want)
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = decontam.brute([r.text for r in kept["near copies"]], items)
    assert sorted(r.doc_id for r in kept["benchmark passages"]) == sorted(r.doc_id for r, h in zip(kept["near copies"], hit) if not h[1])
    clean = spark.createDataFrame(kept["benchmark passages"], docs.schema)
    times = {r.doc_id: r.copies for r in mixing.mix(clean).collect()}
    assert sorted(r.doc_id for r in kept["mixing"]) == sorted(i for i, n in times.items() for _ in range(n))
    out = corpus_pipeline.STAGES[4][1](spark, docs, SF).orderBy("start").collect()
    tok, start = Tokenizer.from_file(queries.tokenizer_path()), 0
    for r, src in zip(out, sorted(kept["mixing"], key=lambda r: r.doc_id), strict=True):
        ids = [*tok.encode(src.text, add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (src.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.fixture(scope="module")
def odd(spark):
    """Rows of documents with null and repeated ids, null and empty texts, repeated rows, a very long text, and columns named like the operators' own."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    names = docs.columns
    more = [(None, "a text without an id, of a few words", "en", None, 36), (None, "another text without an id, of a few words", None, "src1", 42), (5, "a second text under one id", "en", "src1", 26), (5, None, None, None, None), (6, "", "en", "src2", 0), (7, "w " * 60_000, "en", "src1", 120_000)]
    rows = docs.union(spark.createDataFrame(more, docs.schema)).union(docs.limit(4))
    return rows.select(*names, *(F.lit(7).alias(c) for c in ("toxic_score", "n_words", "hit_spans", "item_ids", "row", "rid", "copies", "row.x"))).cache()


def test_stages_over_odd_rows(spark, odd):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF).cache()
        rows = docs.collect()
        assert docs.columns == odd.columns and all(r[c] == 7 for r in rows for c in ("toxic_score", "n_words", "hit_spans", "row.x"))
        said = {(r.doc_id, r.text) for r in rows}
        if name != "mixing":
            assert {(5, "a second text under one id"), (5, None), (6, "")} <= said and any(i is None for i, _ in said), name
        assert said <= {(r.doc_id, r.text) for r in odd.collect()}
    out = corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()
    assert len(out) == docs.count() and sum(r.n_tokens for r in out) == max(r.start + r.n_tokens for r in out)


def test_stages_over_nothing(spark, odd):
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, odd.limit(0), SF)
        assert made.count() == 0


def test_run(spark):
    assert entry.queries()["pipeline"](spark, SF).count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(queries.ORACLE_SQL[name])
    at = [rel.columns.index(c) for c in cols]
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in rel.fetchall())


def test_entry_without_the_subpackage(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(f"{root}/quillon", tmp_path / "quillon", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(entry.__file__, tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), len(e.oracle_sql()))"
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert said.returncode == 0 and said.stdout.split()[1] == "False" and int(said.stdout.split()[0]) > 80, said.stderr
