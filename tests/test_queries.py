"""Every query with SQL against DuckDB at the smallest scale, and the rest for rows and reruns."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from quillon.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return round(float(v), 6) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_without_sql(spark, name):
    first = sorted(map(repr, registry.QUERIES[name](spark, SF).collect()))
    assert first and first == sorted(map(repr, registry.QUERIES[name](spark, SF).collect()))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_partition_count_does_not_matter(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    rows = sorted(map(repr, registry.QUERIES["stratified_topk"](spark, SF).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    assert sorted(map(repr, registry.QUERIES["stratified_topk"](spark, SF).collect())) == rows
    spark.conf.set("spark.sql.shuffle.partitions", was)


@pytest.mark.parametrize("lines", [["Éréré.", "ñaña ûû"], ["a" * 25, "incomprehensibly unquestionable"], [None, ""]], ids=["accents", "long words", "nothing"])
def test_constraint_sampling_knows_terms_as_its_sql_does(spark, tmp_path, lines):
    con = duckdb.connect()
    con.execute("create table documents as select cast(unnest(range(60)) as bigint) as doc_id, 's' as source, cast(null as varchar) as text")
    for i, line in enumerate(lines):
        con.execute("update documents set text = $1 where doc_id % $2 = $3", [line and f"{line}\nan answer", len(lines), i])
    con.execute("create table labels as select doc_id, 1 as quality, 0 as toxic from documents")
    for t in ("documents", "labels"):
        con.execute(f"copy {t} to '{tmp_path}/{t}.parquet'")
    want = con.execute(registry.ORACLE_SQL["constraint_sampling"]).fetchall()
    assert len(want) == 60
    assert sorted(map(tuple, registry.QUERIES["constraint_sampling"](spark, str(tmp_path)).collect())) == sorted(want)
