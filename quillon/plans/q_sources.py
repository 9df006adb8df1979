"""Round trips through readers and writers: what comes back is what the table has."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quillon.operators import gates, metrics, sampling
from quillon.plans.registry import query, table
from quillon.sources import io, tail
from quillon.sources.spread import folder
from quillon.streaming import state

_TURN = "conv_id long, turn long, role string, text string"


def _path(spark, name):
    return f"{folder(spark, 'quillon-files-')}/{name}-{uuid.uuid4().hex}"


@query("SELECT conv_id, turn, role, sha256(text) AS text FROM conversations")
def jsonl_round_trip(spark, sf_dir):
    path = _path(spark, "jsonl")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    io.write_jsonl(rows.filter("turn < 2"), path)
    io.write_jsonl(rows.filter("turn >= 2"), path, "append")
    return io.read_jsonl(spark, path, _TURN).select("conv_id", "turn", "role", F.sha2("text", 256).alias("text"))


@query("SELECT conv_id, turn, false AS broken FROM conversations WHERE conv_id % 7 <> 0 UNION ALL SELECT NULL, count(*), true FROM conversations WHERE conv_id % 7 = 0")
def jsonl_tolerant(spark, sf_dir):
    """A log whose lines are cut off for every seventh conversation: whole lines are read, broken ones counted."""
    path = _path(spark, "log")
    line = F.to_json(F.struct("conv_id", "turn", "role", "text"))
    table(spark, sf_dir, "conversations").select(F.when(F.col("conv_id") % 7 == 0, F.substring(line, 1, 25)).otherwise(line)).write.text(path)
    rows, broken = io.read_jsonl_tolerant(spark, path, _TURN)
    return rows.select("conv_id", "turn", F.lit(False).alias("broken")).union(broken.agg(F.lit(None).cast("long"), F.count("*"), F.lit(True)))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def jsonl_last_wins(spark, sf_dir):
    path = _path(spark, "jsonl")
    io.write_jsonl(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), path)
    return io.read_jsonl_last(spark, path, "event_id long, user_id long, event_type string", "user_id", "event_id")


@query("SELECT doc_id, lang, sha256(text) AS text FROM documents WHERE text <> ''")
def csv_round_trip(spark, sf_dir):
    """Whole texts with line breaks, quotes and commas as cells. CSV tells no empty text from a null one, so those are left out."""
    path = _path(spark, "csv")
    io.write_csv(table(spark, sf_dir, "documents").select("doc_id", "lang", "text").filter("text <> ''"), path)
    return io.read_csv(spark, path, "doc_id long, lang string, text string").select("doc_id", "lang", F.sha2("text", 256).alias("text"))


@query("SELECT o_orderkey FROM orders")
def ids_round_trip(spark, sf_dir):
    path = _path(spark, "ids")
    io.write_ids(table(spark, sf_dir, "orders"), "o_orderkey", path)
    return spark.read.text(path).select(F.col("value").cast("long").alias("o_orderkey"))


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn, count(*) OVER () AS n FROM documents) SELECT CASE WHEN rn <= greatest(1, round_even(n * 0.05, 0)) THEN 'validation' ELSE 'train' END AS split, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM r GROUP BY 1")
def cached_splits(spark, sf_dir):
    path = _path(spark, "splits")
    io.write_splits(sampling.hash_split(table(spark, sf_dir, "documents").select("doc_id"), 0.05, key="doc_id"), path)
    return io.read_splits(spark, path, "train", "validation").groupBy("split").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("SELECT r_regionkey, r_name FROM region")
def source_fallback(spark, sf_dir):
    return io.first_source(spark, f"{sf_dir}/no-such-cache.parquet", f"{sf_dir}/region.parquet").select("r_regionkey", "r_name")


@query("SELECT count(*) AS length_of_list, sha256(string_agg(r_name, chr(10) ORDER BY r_regionkey)) AS sha256 FROM region")
def file_fingerprint(spark, sf_dir):
    """The hash of a file's bytes is the hash of what was written."""
    path = _path(spark, "names")
    names = [r[0] for r in table(spark, sf_dir, "region").orderBy("r_regionkey").select("r_name").collect()]
    io.write_text(spark, path, "\n".join(names))
    return io.file_hashes(spark, path).select(F.lit(len(names)).cast("long").alias("length_of_list"), "sha256")


@query("SELECT 'lang' AS field, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'rows', NULL, count(*) FROM documents")
def manifest_round_trip(spark, sf_dir):
    path = _path(spark, "manifest")
    docs = table(spark, sf_dir, "documents")
    io.write_manifest(spark, path, {"lang": metrics.distribution(docs, "lang"), "rows": docs.count()})
    made = json.loads(io.read_text(spark, path))
    return spark.createDataFrame([("lang", r.get("lang"), r["n"]) for r in made["lang"]] + [("rows", None, made["rows"])], "field string, value string, n long")


@query("WITH l AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang) SELECT line FROM (SELECT '# report' AS line UNION ALL SELECT '' UNION ALL SELECT '<!-- counts:begin -->' UNION ALL SELECT '| lang | n |' UNION ALL SELECT '|---|---|' UNION ALL SELECT '| ' || lang || ' | ' || n || ' |' FROM l UNION ALL SELECT '<!-- counts:end -->')")
def markdown_report(spark, sf_dir):
    """A section of a report, written twice: the second time changes nothing."""
    body = io.markdown_table(metrics.distribution(table(spark, sf_dir, "documents"), "lang").orderBy("lang"))
    text = io.with_section(io.with_section("# report", "counts", "old"), "counts", body)
    path = _path(spark, "report")
    io.write_text(spark, path, io.with_section(text, "counts", body))
    return spark.createDataFrame([(x,) for x in io.read_text(spark, path).rstrip("\n").split("\n")], "line string")


@query("SELECT count(*) AS n, true AS refused FROM nation")
def overwrite_guard(spark, sf_dir):
    """A second write is refused, a forced one replaces."""
    path, rows = _path(spark, "guard"), table(spark, sf_dir, "nation")
    io.write_jsonl(rows, path)
    try:
        io.write_jsonl(rows, path)
        refused = False
    except AnalysisException:
        refused = True
    io.write_jsonl(rows, path, "overwrite")
    return spark.read.json(path).agg(F.count("*").alias("n"), F.lit(refused).alias("refused"))


@query("WITH s AS (SELECT CASE WHEN doc_id % 4 = 0 THEN 'test' ELSE 'dev' END AS split, text FROM documents) SELECT split, count(*) AS n, count(DISTINCT text) AS n_distinct, count(text) - count(DISTINCT text) AS n_again, true AS fingerprinted FROM s GROUP BY split")
def split_facts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 4 == 0, "test").otherwise("dev").alias("split"), "text")
    return io.split_metadata(rows, "text").withColumn("fingerprinted", F.length("fingerprint") == 64).drop("fingerprint")


@query("SELECT c_custkey AS user_id, d.decision FROM customer LEFT JOIN (SELECT user_id, arg_max(event_type, event_id) AS decision FROM events GROUP BY user_id) d ON d.user_id = c_custkey")
def decided_samples(spark, sf_dir):
    decisions = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("decision"), F.col("event_id").alias("at"))
    return io.decided(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")), decisions, "user_id").select("user_id", "decision")


@query(
    """WITH c AS (SELECT c_nationkey AS g, count(*) AS n, CAST(floor(avg(c_acctbal)) AS BIGINT) AS mean FROM customer GROUP BY 1)
SELECT g AS nation, 4 + g % 3 * 2 AS generations, CAST(n AS INTEGER) AS batch, concat_ws(';', CASE WHEN n % (4 + g % 3 * 2) <> 0 THEN 'the batch must be a multiple of the generations' END, CASE WHEN mean >= 5000 THEN 'the buffer must be under the token limit' END) AS problems,
  (SELECT count(*) FROM customer WHERE c_nationkey = g AND c_acctbal BETWEEN mean AND 5000) AS n_within FROM c"""
)
def config_round_trip(spark, sf_dir):
    """A configuration for each nation, made from its customers, written as a file of its own, read again and typed; its problems, and the customers within its bounds."""
    customers = table(spark, sf_dir, "customer")
    facts = customers.groupBy("c_nationkey").agg(F.count("*").cast("int").alias("n"), F.floor(F.avg("c_acctbal")).alias("mean")).collect()  # a row a nation
    path, out = _path(spark, "configs"), []
    for r in facts:
        run = {"sampler": "uniform", "batch": r["n"], "generations": 4 + r["c_nationkey"] % 3 * 2, "buffer": r["mean"], "max_tokens": 5000}
        io.write_text(spark, f"{path}/{r['c_nationkey']}.json", json.dumps({"run": run}))
    for r in facts:
        made = io.typed(gates.RunConfig, io.read_config(spark, f"{path}/{r['c_nationkey']}.json")["run"])
        out.append((r["c_nationkey"], made.generations, made.batch, ";".join(made.problems()), made.buffer, made.max_tokens))
    bounds = spark.createDataFrame(out, "nation int, generations int, batch int, problems string, low long, high long")
    within = customers.join(bounds, customers["c_nationkey"] == bounds["nation"]).groupBy("nation", "generations", "batch", "problems")
    return within.agg(F.count_if(F.col("c_acctbal").between(F.col("low"), F.col("high"))).alias("n_within"))


@query("SELECT doc_id, lang FROM documents ORDER BY sha256('42:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 50")
def stream_reservoir(spark, sf_dir):
    """One pass over a stream of files; the state never has more than 50 rows."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").repartition(3)
    return state.reservoir(rows, 50, "doc_id")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS place FROM orders")
def ordered_sink(spark, sf_dir):
    """Orders written in the order of their price, in parts by range, and read back with their places."""
    path, order = _path(spark, "ordered"), ["falling", "o_orderkey"]
    io.write_ordered(table(spark, sf_dir, "orders").select("o_orderkey", (-F.col("o_totalprice")).alias("falling")), order, path)
    return io.read_ordered(spark, path, order).select("o_orderkey", "place")


@query("SELECT event_id, event_type, round(value, 6) AS value FROM events")
def stream_tail(spark, sf_dir):
    """The events as a log of JSON lines that grows between two runs of a stream over it: what the stream has written in the end."""
    path, rows = _path(spark, "tail"), table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    for k in range(2):
        io.write_jsonl(rows.filter(F.col("event_id") % 2 == k), f"{path}/log", "append")
        lines, _ = tail.tail_jsonl(spark, f"{path}/log", rows.schema)
        lines.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").withColumn("value", F.round("value", 6))
