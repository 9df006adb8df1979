"""Contracts of rows and tables, gates, and set checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import checkers, text
from quillon.operators import gates, membership, metrics, quality, restructure, rewards, sampling, validate
from quillon.plans.fixtures import ANNOTATED_SQL, annotated
from quillon.plans.registry import query, table

_NONE = "array<struct<role:string,content:string>>"
_CODES = "list_filter([{}], lambda x: x IS NOT NULL)"

# preference records: a conversation's first message as prompt, its second as chosen, a broken third as rejected
_DPO = "dpo AS (SELECT conv_id, list(role ORDER BY turn) AS roles, list(text ORDER BY turn) AS texts FROM conversations GROUP BY conv_id)"


@query(f"WITH {_DPO} SELECT conv_id, array_to_string({_CODES.format("CASE WHEN conv_id % 6 = 0 THEN 'prompt: messages_missing' END, CASE WHEN len(roles) < 2 THEN 'chosen: messages_missing' END, CASE WHEN len(roles) < 3 THEN 'rejected: messages_missing' WHEN conv_id % 4 = 0 THEN 'rejected: invalid_role' END, CASE WHEN len(roles) >= 3 AND conv_id % 5 = 0 THEN 'rejected: content_missing' END")}, ',') AS codes FROM dpo")
def preference_contract(spark, sf_dir):
    rows, c, m = restructure.messages(table(spark, sf_dir, "conversations")), F.col("conv_id"), F.col("messages")
    none = F.array().cast(_NONE)
    part = lambda i: F.slice(m, i, 1)
    broken = F.transform(part(3), lambda x: F.struct(F.when(c % 4 == 0, "robot").otherwise(x["role"]).alias("role"), F.when(c % 5 != 0, x["content"]).alias("content")))
    codes = validate.dpo_codes(F.when(c % 6 == 0, none).otherwise(part(1)), part(2), broken)
    return rows.select("conv_id", F.array_join(codes, ",").alias("codes"))


@query("WITH c AS (SELECT conv_id, arg_max(role, turn) AS last, count(*) FILTER (role = 'user') AS n_user FROM conversations GROUP BY conv_id) SELECT problem FROM (SELECT count(*) FILTER (last <> 'user' OR n_user <> 2) || ' rows break the contract' AS problem, count(*) FILTER (last <> 'user' OR n_user <> 2) AS n FROM c UNION ALL SELECT '3 rows more or fewer than expected', 3) WHERE n > 0")
def pool_contract(spark, sf_dir):
    rows = restructure.messages(table(spark, sf_dir, "conversations"))
    one = F.array(F.lit("a:b"))
    codes = validate.training_codes(F.col("conv_id").cast("string"), F.col("messages"), one, F.array(F.lit("{}")), F.array(F.lit("a")), F.lit(1), F.lit(2))
    found = validate.pool_problems(rows.withColumn("codes", codes), "codes", "conv_id", rows.count() + 3)
    return spark.createDataFrame([(x,) for x in found], "problem string")


_SETS = f"""{ANNOTATED_SQL}, s AS (SELECT *, greatest(1, n_stratum // 3) AS kk FROM ranked WHERE n_stratum >= 2), f AS (
  SELECT 'full' AS file, * FROM s WHERE rn <= n_stratum - kk UNION ALL SELECT 'clean', * FROM s WHERE rn <= kk AND rn <= n_stratum - kk UNION ALL SELECT 'raw', * FROM s WHERE rn > n_stratum - kk)"""


@query(f"WITH {_SETS} SELECT file, count(*) AS n, CAST(0 AS BIGINT) AS n_invalid, count(*) FILTER (reward IS NULL) AS n_no_metadata, count(k) - count(DISTINCT k) AS n_again, round(avg(score), 6) AS score_mean, median(score) AS score_median, round(avg(reward), 6) AS reward_mean, median(reward) AS reward_median, true AS files_fit FROM f GROUP BY file")
def raw_contract(spark, sf_dir):
    """The three files of a data set against their contract, and against each other."""
    strata = ["bucket", "length_bucket"]
    rows = annotated(spark, sf_dir).filter(F.size("hard") == 0).select("ord", "k", *strata, "score", "reward", "question", "answer")
    rows = sampling.ranked(quality.first_wins(rows, "k", "ord"), strata).filter("n_stratum >= 2")
    said = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    rows = rows.withColumn("messages", F.array(said("user", "question"), said("assistant", "answer"))).withColumn("kk", F.greatest(F.lit(1), F.floor(F.col("n_stratum") / 3)))
    files = {"full": rows.filter("rn <= n_stratum - kk"), "clean": rows.filter("rn <= kk and rn <= n_stratum - kk"), "raw": rows.filter("rn > n_stratum - kk")}
    out = validate.raw_report(files, "k", "messages", "score", "reward", strata)
    return out.withColumn("score_mean", F.round("score_mean", 6)).withColumn("reward_mean", F.round("reward_mean", 6))


@query("SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'truncated' WHEN doc_id % 7 = 0 THEN 'no strict results' WHEN contains(text, ',') THEN 'strict check failed' WHEN doc_id % 5 = 0 THEN 'reasoning not closed' WHEN doc_id % 3 = 0 THEN 'severe repetition' END AS reason FROM documents")
def teacher_contract(spark, sf_dir):
    d = F.col("doc_id")
    strict = F.when(d % 7 == 0, F.array().cast("array<boolean>")).otherwise(F.array(~F.col("text").contains(",")))
    raw = F.concat(F.when(d % 3 == 0, F.repeat(F.lit("the same line again\n"), 3)).otherwise("a line that occurs once\n"), F.when(d % 5 == 0, "").otherwise("</think>"), F.lit("yes"))
    return table(spark, sf_dir, "documents").select("doc_id", validate.teacher_reason(d % 11 == 0, strict, raw).alias("reason"))


@query("WITH c AS (SELECT coalesce(CASE WHEN doc_id % 11 = 0 THEN 'too long' WHEN text = '' THEN 'empty' END, 'kept') AS reason FROM documents) SELECT reason, count(*) AS n FROM c GROUP BY reason")
def reject_routing(spark, sf_dir):
    """Good rows and rejects are two filters of one column."""
    rows = table(spark, sf_dir, "documents").withColumn("reason", validate.first_reason((F.col("doc_id") % 11 == 0, "too long"), (F.col("text") == "", "empty")))
    good, bad = rows.filter("reason is null").withColumn("reason", F.lit("kept")), rows.filter("reason is not null")
    return good.unionByName(bad).groupBy("reason").agg(F.count("*").alias("n"))


_BARE = "regexp_replace({}, '\\s+', '', 'g')"


@query(f"SELECT doc_id, length({_BARE.format('text')}) >= 32 AND doc_id % 3 = 0 AS copied, CASE WHEN doc_id % 5 = 0 THEN 'reasoning missing' WHEN doc_id % 7 = 0 THEN 'answer missing' WHEN doc_id % 4 = 0 THEN 'last message not assistant' WHEN doc_id % 9 = 0 THEN 'answer differs from message' END AS reason FROM documents")
def reasoning_integrity(spark, sf_dir):
    d = F.col("doc_id")
    reasoning = F.when(d % 3 == 0, F.concat(F.lit("so: "), F.replace("text", F.lit(" "), F.lit("\n")))).otherwise("so it is")
    integrity = validate.answer_integrity(F.when(d % 5 == 0, " ").otherwise("why"), F.when(d % 7 == 0, "").otherwise("yes"), F.when(d % 4 == 0, "user").otherwise("assistant"), F.when(d % 9 == 0, "no").otherwise("yes"))
    return table(spark, sf_dir, "documents").select("doc_id", text.copies_answer(reasoning, F.col("text")).alias("copied"), integrity.alias("reason"))


_TAGGED = "CASE doc_id % 6 WHEN 0 THEN '<think>a</think>' || lang WHEN 1 THEN '</think>' || lang || '<think>' WHEN 2 THEN '<think>' || lang WHEN 3 THEN 'a</think>b' WHEN 4 THEN '<think></think><think>x</think>' ELSE lang END"


@query("SELECT doc_id, doc_id % 6 IN (0, 3, 4) AS thinking, doc_id % 6 IN (0, 1, 4, 5) AS plain FROM documents")
def thinking_structure(spark, sf_dir):
    said = F.expr(_TAGGED)
    return table(spark, sf_dir, "documents").select("doc_id", text.thinking_structure_ok(said, True).alias("thinking"), text.thinking_structure_ok(said, False).alias("plain"))


@query("WITH r AS (SELECT count(*) AS n, count(DISTINCT item_id) AS d FROM benchmark) SELECT 'whole' AS which, CAST(NULL AS VARCHAR) AS problem UNION ALL SELECT 'short', n || ' rows instead of ' || (n + 1) FROM r UNION ALL SELECT 'again', 'keys occur again' UNION ALL SELECT 'columns', 'columns missing: [''answer'']'")
def benchmark_contract(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark")
    n = rows.count()
    asked = {"whole": (rows, ["item_id", "text"], n), "short": (rows, ["item_id"], n + 1), "again": (rows.union(rows), ["item_id"], 2 * n), "columns": (rows, ["item_id", "answer"], n)}
    found = [(k, x) for k, (r, cols, want) in asked.items() for x in gates.benchmark_problems(r, cols, "item_id", want) or [None]]
    return spark.createDataFrame(found, "which string, problem string")


@query("SELECT id AS instruction_id, count(*) AS n, count(*) FILTER (b) AS n_broken, known FROM (SELECT 'keywords:existence' AS id, doc_id % 4 = 0 AS b, true AS known FROM documents UNION ALL SELECT 'punctuation:no_comma', false, true FROM documents UNION ALL SELECT 'no:such_check', true, false FROM documents WHERE doc_id % 3 = 0) GROUP BY id, known")
def checker_arguments(spark, sf_dir):
    """How often each check occurs, whether there is one of that name, and how often it lacks an argument."""
    d = F.col("doc_id")
    none = F.create_map().cast("map<string,string>")
    more = F.when(d % 3 == 0, 3).otherwise(2)
    ids = F.slice(F.array(F.lit("keywords:existence"), F.lit("punctuation:no_comma"), F.lit("no:such_check")), 1, more)
    args = F.slice(F.array(F.when(d % 4 == 0, none).otherwise(F.create_map(F.lit("keywords"), F.lit("x"))), none, none), 1, more)
    return validate.argument_gaps(table(spark, sf_dir, "documents").select(ids.alias("ids"), args.alias("args")), "ids", "args")


@query("SELECT doc_id, len(string_split(text, ' ')) AS n, max(len(string_split(text, ' '))) OVER () AS longest, round(avg(len(string_split(text, ' '))) OVER (), 6) AS mean FROM documents QUALIFY len(string_split(text, ' ')) > 1000")
def prompt_length_gate(spark, sf_dir):
    """Prompts over the limit, beside the longest and the mean of all."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ", -1).alias("ids"))
    r = gates.prompt_lengths(rows, "ids").first()
    return gates.too_long(rows, "ids", 1000).select("doc_id", F.size("ids").cast("long").alias("n"), F.lit(r["max"]).cast("long").alias("longest"), F.round(F.lit(r["mean"]), 6).alias("mean"))


@query(
    """WITH ids AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) AS p FROM orders), a AS (SELECT * FROM ids WHERE k % 4 = 0), b AS (SELECT * FROM ids WHERE k % 4 <> 0), other AS (SELECT k, lead(k, 1, 0) OVER (ORDER BY k) AS p FROM ids)
SELECT 'subset' AS what, NOT EXISTS (SELECT k FROM a EXCEPT SELECT k FROM ids) AS holds
UNION ALL SELECT 'no subset', NOT EXISTS (SELECT k FROM ids EXCEPT SELECT k FROM a)
UNION ALL SELECT 'disjoint', NOT EXISTS (SELECT k FROM a INTERSECT SELECT k FROM b)
UNION ALL SELECT 'not disjoint', NOT EXISTS (SELECT k FROM a INTERSECT SELECT k FROM ids)
UNION ALL SELECT 'partition', NOT EXISTS (SELECT k FROM a INTERSECT SELECT k FROM b) AND (SELECT count(*) FROM a) + (SELECT count(*) FROM b) = (SELECT count(*) FROM ids)
UNION ALL SELECT 'no partition', NOT EXISTS (SELECT k FROM a INTERSECT SELECT k FROM ids) AND (SELECT count(*) FROM a) + (SELECT count(*) FROM ids) = (SELECT count(*) FROM ids)
UNION ALL SELECT 'same order', (SELECT list(k ORDER BY p) FROM ids) = (SELECT list(k ORDER BY k) FROM ids)
UNION ALL SELECT 'other order', (SELECT list(k ORDER BY p) FROM ids) = (SELECT list(k ORDER BY p) FROM other)"""
)
def set_contracts(spark, sf_dir):
    """Subset, disjointness, partition and order of ids, each where it holds and where it does not."""
    ids = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("place"))
    a, b = ids.filter("o_orderkey % 4 = 0"), ids.filter("o_orderkey % 4 <> 0")
    key = "o_orderkey"
    found = [
        ("subset", membership.is_subset(a, ids, key)), ("no subset", membership.is_subset(ids, a, key)), ("disjoint", membership.is_disjoint(a, b, key)), ("not disjoint", membership.is_disjoint(a, ids, key)),
        ("partition", membership.is_partition(ids, [a, b], key)), ("no partition", membership.is_partition(ids, [a, ids], key)),
        ("same order", validate.same_order(ids, ids.repartition(3), key, "place")), ("other order", validate.same_order(ids, ids.withColumn("place", F.col("place") + 1), key, "place")),
    ]
    return spark.createDataFrame(found, "what string, holds boolean")


@query("WITH b AS (SELECT event_id // 100 AS step, avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) AS p, max(value) - min(value) > 1 AS signal, avg(CASE WHEN value > 95 THEN 1.0 ELSE 0.0 END) AS lim FROM events GROUP BY 1) SELECT round(max(p), 6) AS best_parse, bool_or(signal) AS any_signal, round(avg(lim), 6) AS limit_share, CASE WHEN max(p) <= 0 THEN 'nothing parsed' WHEN NOT bool_or(signal) THEN 'no learning signal' WHEN avg(lim) >= 1 THEN 'all at the limit' ELSE 'healthy' END AS verdict FROM b")
def smoke_health(spark, sf_dir):
    v = F.col("value")
    rows = table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 100).alias("step")).agg(F.avg((v > 50).cast("double")).alias("parse_ok"), (F.max(v) - F.min(v) > 1).alias("signal"), F.avg((v > 95).cast("double")).alias("at_limit"))
    return rewards.smoke_health(rows).withColumn("best_parse", F.round("best_parse", 6)).withColumn("limit_share", F.round("limit_share", 6))


@query("SELECT o_orderpriority, count(*) AS n, round(CAST(3 * count(*) - count(*) FILTER (o_orderstatus = 'F') - count(*) FILTER (o_orderstatus = 'O') AS DOUBLE) / (3 * count(*)), 6) AS retry_rate, round(avg(CASE WHEN o_totalprice > 100000 THEN o_totalprice END), 4) AS mean_price FROM orders GROUP BY o_orderpriority")
def teacher_audit(spark, sf_dir):
    """The share of attempts that were retries, three attempts to a row here; a mean that skips nulls."""
    s = F.col("o_orderstatus")
    rows = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(s == "F").alias("ok"), F.count_if(s == "O").alias("bad"), F.avg(F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice"))).alias("price"))
    return rows.select("o_orderpriority", "n", F.round(metrics.retry_audit(3 * F.col("n"), F.col("ok"), F.col("bad")), 6).alias("retry_rate"), F.round("price", 4).alias("mean_price"))


@query("SELECT l_orderkey, bool_or(abs(l_discount - 0.05) > 1e-8) AS signal FROM lineitem GROUP BY l_orderkey")
def learning_signal(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_discount") - 0.05).alias("a"))
    return rows.select("l_orderkey", rewards.has_signal(F.array("a")).alias("signal"))


@query("SELECT l_orderkey, round((avg(l_tax) * count(*) + avg(l_discount) * 4 * count(*) FILTER (l_returnflag = 'R')) / (count(*) + 4 * count(*) FILTER (l_returnflag = 'R')), 9) AS loss FROM lineitem GROUP BY l_orderkey")
def structure_loss(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.avg("l_tax").alias("l"), F.avg("l_discount").alias("s"), F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("k"))
    return rows.select("l_orderkey", F.round(rewards.structure_weighted_mean(F.col("l"), F.col("s"), F.col("n"), F.col("k"), 5.0), 9).alias("loss"))


@query("WITH r AS (SELECT p_partkey, list_position([7, 3], p_partkey) AS p, (p_partkey - 50 + 10 * (SELECT count(*) FROM part)) % (SELECT count(*) FROM part) AS turn FROM part) SELECT p_partkey FROM r ORDER BY p IS NULL, p, turn, p_partkey LIMIT 20")
def required_rows_first(spark, sf_dir):
    """Two required rows, then from the fiftieth on, around."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_partkey").alias("ord"))
    return sampling.required_first(rows, ["7", "3"], 50, 20).select(F.col("id").cast("long").alias("p_partkey"))


@query()
def stable_numbers(spark, sf_dir):
    """BLAKE2b, which SQL lacks; tests hold it against the library's."""
    return table(spark, sf_dir, "documents").select("doc_id", text.stable_number(F.col("text")).alias("number"))


@query("SELECT doc_id, policy, CASE WHEN policy = 'teacher' AND doc_id % 3 = 0 THEN 'false,false' ELSE CASE WHEN contains(text, ',') OR text = '' THEN 'false' ELSE 'true' END || ',' || CASE WHEN doc_id % 3 = 0 OR NOT contains(lower(text), 'the') THEN 'false' ELSE 'true' END END AS results FROM documents, (SELECT unnest(['reward', 'teacher']) AS policy)")
def check_policies(spark, sf_dir):
    """A check that cannot be made (every third keyword list is missing): one result is false, or all are."""
    d, none = F.col("doc_id"), F.create_map().cast("map<string,string>")
    kinds = F.array(F.lit("punctuation:no_comma"), F.lit("keywords:existence"))
    args = F.array(none, F.when(d % 3 == 0, none).otherwise(F.create_map(F.lit("keywords"), F.lit("the"))))
    both = [F.struct(F.lit(p).alias("policy"), F.array_join(checkers.strict_results(F.col("text"), kinds, args, p).cast("array<string>"), ",").alias("results")) for p in ("reward", "teacher")]
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(*both)).alias("x")).select("doc_id", "x.*")
