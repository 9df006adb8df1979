"""Messages, turns, histories, masks and token arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import membership, restructure, validate
from quillon.plans.registry import query, table

_CONV = "conv AS (SELECT conv_id, list(role ORDER BY turn) AS roles, list(text ORDER BY turn) AS texts, count(*) AS n FROM conversations GROUP BY conv_id)"


def _messages(spark, sf_dir):
    return restructure.messages(table(spark, sf_dir, "conversations"))


@query(f"WITH {_CONV} SELECT conv_id, n, CASE WHEN roles[-1] = 'assistant' THEN '' ELSE 'last_not_assistant' END AS codes FROM conv")
def conv_role_contract(spark, sf_dir):
    return _messages(spark, sf_dir).select("conv_id", F.size("messages").cast("long").alias("n"), F.array_join(validate.sft_codes(F.col("messages")), ",").alias("codes"))


@query(f"WITH {_CONV} SELECT conv_id, sha256(array_to_string(list_transform(range(1, n + 1), lambda i: '[' || roles[i] || ']' || chr(10) || texts[i]), chr(10) || chr(10))) AS rendered FROM conv")
def conv_to_messages(spark, sf_dir):
    m = F.transform("messages", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"), F.lit("").alias("reasoning_content")))
    return _messages(spark, sf_dir).select("conv_id", F.sha2(restructure.render_task(m), 256).alias("rendered"))


@query("SELECT conv_id, turn, CAST(count(*) OVER w AS BIGINT) AS n_before, sha256(string_agg(text, chr(10)) OVER w) AS history FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)")
def history_accumulate(spark, sf_dir):
    rows = restructure.histories(table(spark, sf_dir, "conversations"))
    return rows.select("conv_id", "turn", F.size("history").cast("long").alias("n_before"), F.sha2(F.array_join(F.transform("history", lambda x: x["content"]), "\n"), 256).alias("history"))


@query("SELECT conv_id, count(*) FILTER (role = 'user') AS n_user, count(*) FILTER (role = 'assistant') AS n_assistant, bool_or(role = 'system') AS has_system FROM conversations GROUP BY conv_id")
def context_turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("n_user"), F.count_if(F.col("role") == "assistant").alias("n_assistant"), F.bool_or(F.col("role") == "system").alias("has_system"))


@query(f"WITH {_CONV}, v AS (SELECT list_filter([CASE WHEN roles[-1] <> 'user' THEN 'last_not_user' END, 'no_instructions', CASE WHEN len(list_filter(roles, lambda r: r = 'user')) <> 2 THEN 'context_turns_differ' END], lambda x: x IS NOT NULL) AS codes FROM conv) SELECT code, count(*) AS n FROM (SELECT unnest(codes) AS code FROM v) GROUP BY code")
def violations_report(spark, sf_dir):
    none = F.array().cast("array<string>")
    v = validate.training_codes(F.col("conv_id").cast("string"), F.col("messages"), none, none, none, F.lit(0), F.lit(2))
    return _messages(spark, sf_dir).select(F.explode(v).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query("SELECT conv_id, CAST(turn // 2 + 1 AS INTEGER) AS turn, sha256(max(text)) AS prompt FROM conversations WHERE turn % 2 = 0 GROUP BY conv_id, turn")
def turn_unpivot(spark, sf_dir):
    """Every second turn as a column, as many as the longest conversation has, and back to rows."""
    rows = table(spark, sf_dir, "conversations")
    n = (rows.agg(F.max("turn")).first()[0] or 0) // 2 + 1
    wide = rows.groupBy("conv_id").agg(*(F.max(F.when(F.col("turn") == 2 * i, F.col("text"))).alias(f"t{i}") for i in range(n)))
    return restructure.turns_to_rows(wide, [f"t{i}" for i in range(n)], ["conv_id"]).select("conv_id", "turn", F.sha2("prompt", 256).alias("prompt"))


@query(f"WITH {_CONV} SELECT conv_id, CAST(i - 1 AS INTEGER) AS place, roles[i] AS role, length(texts[i]) AS n FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM conv)")
def parallel_zip_explode(spark, sf_dir):
    rows = _messages(spark, sf_dir).select("conv_id", F.posexplode(F.arrays_zip(F.transform("messages", lambda x: x["role"]).alias("role"), F.transform("messages", lambda x: F.length(x["content"])).alias("n"))).alias("place", "x"))
    return rows.select("conv_id", "place", "x.role", F.col("x.n").cast("long").alias("n"))


@query("WITH w AS (SELECT item_id AS doc_id, row_number() OVER (ORDER BY item_id DESC) - 1 AS place FROM benchmark) SELECT place, d.doc_id, d.n_chars FROM w JOIN documents d USING (doc_id)")
def ordered_lookup(spark, sf_dir):
    from pyspark.sql import Window as W

    wanted = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), (F.row_number().over(W.orderBy(F.desc("item_id"))) - 1).cast("long").alias("place"))
    return membership.ordered_lookup(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), wanted, "doc_id").select("place", "doc_id", "n_chars")


# token ids that both engines can make: a word's length and first character
_IDS = "list_transform(string_split({}, ' '), lambda w: length(w) * 1000 + CASE WHEN w = '' THEN 0 ELSE ord(w) END)"
_TOK = f"last AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS t FROM conversations), tok AS (SELECT conv_id, {_IDS.format('q')} AS p, {_IDS.format("q || ' ' || a")} AS ids FROM (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) FILTER (turn < t) AS q, max(text) FILTER (turn = t) AS a FROM last GROUP BY conv_id) WHERE q IS NOT NULL)"


def _ids(c):
    return F.transform(F.split(c, " ", -1), lambda w: F.length(w) * 1000 + F.when(w == "", 0).otherwise(F.ascii(w)))


def _tokens(spark, sf_dir):
    """All turns but the last as the prompt, the whole conversation as ids."""
    said = restructure.messages(table(spark, sf_dir, "conversations")).select("conv_id", F.transform("messages", lambda x: x["content"]).alias("t")).filter(F.size("t") > 1)
    before = F.array_join(F.slice("t", 1, F.size("t") - 1), " ")
    return said.select("conv_id", _ids(before).alias("p"), _ids(F.array_join("t", " ")).alias("ids"))


@query(f"WITH {_TOK} SELECT conv_id, len(ids) AS n, sha256(array_to_string(list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN i <= len(p) THEN -100 ELSE ids[i] END), ',')) AS labels FROM tok")
def label_mask(spark, sf_dir):
    rows = _tokens(spark, sf_dir)
    return rows.select("conv_id", F.size("ids").cast("long").alias("n"), F.sha2(F.array_join(restructure.label_mask(F.col("p"), F.col("ids")).cast("array<string>"), ","), 256).alias("labels"))


@query(f"WITH {_TOK} SELECT conv_id, len(ids) AS n, CASE WHEN len(ids) > 512 THEN 'length_out_of_range' ELSE '' END AS codes FROM tok")
def token_length_filter(spark, sf_dir):
    rows = _tokens(spark, sf_dir)
    code = validate.tokenized_codes(F.col("ids"), F.transform("ids", lambda x: F.lit(1)), restructure.label_mask(F.col("p"), F.col("ids")), 512)
    return rows.select("conv_id", F.size("ids").cast("long").alias("n"), F.array_join(code, ",").alias("codes"))


@query(f"WITH {_TOK} SELECT a.conv_id, len(a.ids) AS n, len(b.ids) AS m FROM tok a JOIN tok b ON b.conv_id = a.conv_id + 1 WHERE len(a.ids) <= 512 AND len(b.ids) <= 512")
def paired_filter(spark, sf_dir):
    rows = _tokens(spark, sf_dir).select("conv_id", F.size("ids").cast("long").alias("n"))
    other = rows.select((F.col("conv_id") - 1).alias("conv_id"), F.col("n").alias("m"))
    return membership.zipped(rows, other, place="conv_id").filter("n <= 512 and m <= 512")


@query("WITH t AS (SELECT doc_id, [CASE WHEN doc_id % 5 = 0 THEN 9 ELSE 1 END, CAST(doc_id % 7 AS INTEGER) + 10, CASE WHEN doc_id % 3 = 0 THEN 9 ELSE 2 END, 20, CASE WHEN doc_id % 4 = 0 THEN 9 ELSE 3 END] AS ids FROM documents) SELECT doc_id, array_to_string(list_filter([CASE WHEN NOT list_contains(ids, 1) THEN 'opening_count' END, CASE WHEN NOT list_contains(ids, 2) THEN 'closing_count' END, CASE WHEN NOT list_contains(ids, 3) THEN 'no_end' END, CASE WHEN ids[1] <> 1 THEN 'not_opened_first' END], lambda x: x IS NOT NULL), ',') AS codes FROM t")
def structure_ids_check(spark, sf_dir):
    d = F.col("doc_id")
    ids = F.array(F.when(d % 5 == 0, 9).otherwise(1), (d % 7).cast("int") + 10, F.when(d % 3 == 0, 9).otherwise(2), F.lit(20), F.when(d % 4 == 0, 9).otherwise(3))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(validate.structure_codes(ids, 1, 2, 3), ",").alias("codes"))


@query("WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), h AS (SELECT doc_id, unnest(range(1, len(w))) AS i, w FROM w) SELECT w.doc_id, coalesce(max(i) FILTER (h.w[i] = 'the' AND h.w[i + 1] = 'the'), 0) - 1 AS place FROM w LEFT JOIN h USING (doc_id) GROUP BY w.doc_id")
def last_subsequence(spark, sf_dir):
    """Over the words as an array: the last place of 'the', 'the'."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ", -1).alias("words"))
    return rows.select("doc_id", validate.last_subsequence(F.col("words"), F.array(F.lit("the"), F.lit("the"))).cast("long").alias("place"))


_UNITS = "list_filter(list_transform(string_split(regexp_replace(text, '([。！？!?])', '\\1' || chr(10), 'g'), chr(10)), lambda u: lower(regexp_replace(u, '\\s+', '', 'g'))), lambda u: u <> '')"


@query(f"WITH u AS (SELECT doc_id, {_UNITS} AS u FROM documents) SELECT doc_id, len(list_filter(range(1, len(u) - 1), lambda i: u[i] = u[i + 1] AND u[i] = u[i + 2] AND length(u[i]) >= 12)) > 0 AS repeats FROM u")
def repetition_loop(spark, sf_dir):
    from quillon.functions.text import repetition_loop as loop

    return table(spark, sf_dir, "documents").select("doc_id", loop(F.col("text")).alias("repeats"))
