"""Callers' functions over the tables: with functions that SQL can say as well."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions import hooks
from quillon.plans.registry import query, table


@query(r"SELECT conv_id, turn, len(regexp_extract_all(text, '[\pL\pM\p{Nd}\p{Pc}]+|[^\pL\pM\p{Nd}\p{Pc}\s]')) AS n_tokens, length(text) AS n_chars FROM conversations")
def token_counts(spark, sf_dir):
    """The counter that needs no tokenizer, and one of the caller's."""
    own, theirs = hooks.token_counter(), hooks.token_counter(len)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", own(F.col("text")).alias("n_tokens"), theirs(F.col("text")).alias("n_chars"))


@query("SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN length(text) / 100.0 ELSE 0.0 END AS reward FROM conversations")
def batch_rewards(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return hooks.rewarded(rows, lambda c: [len(t) / 100.0 if r == "assistant" else 0.0 for r, t in zip(c["role"], c["text"])], ["role", "text"]).select("conv_id", "turn", "reward")


@query("SELECT conv_id, turn, 'you said: ' || string_split(text, ' ')[1] AS answer FROM conversations WHERE role = 'user'")
def generated_answers(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    return hooks.generated(rows, lambda: lambda prompts: [f"you said: {p.split(' ')[0]}" for p in prompts]).drop("prompt")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'id:' || (doc_id % 100) || ',' || n_chars ELSE source END AS completion FROM documents")
def decoded_completions(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.array(F.col("doc_id") % 100, "n_chars")).alias("ids"), F.col("source").alias("text"))
    return hooks.decoded(rows, lambda ids: "id:" + ",".join(map(str, ids))).select("doc_id", "completion")


@query("SELECT l_orderkey AS name, max(greatest(l_extendedprice, -l_extendedprice, abs(l_discount - l_quantity))) AS max_abs FROM lineitem GROUP BY l_orderkey ORDER BY max_abs DESC, name LIMIT 10")
def largest_tensors(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("name"), F.array("l_extendedprice", F.col("l_discount") - F.col("l_quantity")).alias("values"))
    return hooks.largest_values(rows)


@query("SELECT source AS mark, CAST(rank() OVER (ORDER BY source) + 1000 AS INTEGER) AS id FROM (SELECT DISTINCT source FROM documents)")
def structure_tokens(spark, sf_dir):
    """Every source's mark must be one id of a vocabulary over all words of the documents' languages and sources; the query fails where one has two ids, none or a shared one."""
    docs = table(spark, sf_dir, "documents")
    marks = docs.select(F.col("source").alias("mark")).distinct()
    vocabulary = marks.select(F.col("mark").alias("piece"), (F.rank().over(W.orderBy("mark")) + 1000).alias("id")).union(docs.select("lang", F.lit(7)).distinct())
    return hooks.single_pieces(marks, vocabulary)
