"""Changes of shape: source rows, cells, templates, previews."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import text
from quillon.operators import restructure
from quillon.plans.registry import query, table

# a document as a hub row: its first line and the rest, with what a hub has besides
_HUB = "hub AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'en' ELSE 'zh-cn' END AS langdetect, split_part(text, chr(10), 1) AS q, CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS a, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 9 END AS reward, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE source END AS source FROM documents)"


def _hub(spark, sf_dir):
    d, at = F.col("doc_id"), F.instr("text", "\n")
    said = lambda who, c: F.struct(F.lit(who).alias("from"), c.alias("value"))
    turns = F.array(said("human", F.substring_index("text", "\n", 1)), said("gpt", F.when(at > 0, F.substr("text", at + 1)).otherwise("")))
    label = F.struct(F.array(F.lit("x")).alias("ability_zh"), F.lit(None).cast("array<string>").alias("cate_ability_zh"))
    return table(spark, sf_dir, "documents").select(d.cast("string").alias("id"), F.when(d % 3 == 0, "en").otherwise("zh-cn").alias("langdetect"), turns.alias("conversations"), F.when(d % 5 != 0, d % 9).alias("reward"), F.when(d % 4 != 0, F.col("source")).alias("source"), label.alias("label"))


_S = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


@query(f"WITH {_HUB} SELECT CAST(doc_id AS VARCHAR) AS id, sha256({_S.format('q')}) AS question, sha256({_S.format('a')}) AS answer, CAST(reward AS DOUBLE) AS reward, coalesce(source, 'unknown') AS source, 1 AS n_ability, 0 AS n_category FROM hub WHERE langdetect = 'zh-cn' AND {_S.format('q')} <> '' AND {_S.format('a')} <> '' AND reward IS NOT NULL")
def source_rows(spark, sf_dir):
    made, m = restructure.from_source(_hub(spark, sf_dir)), F.col("metadata")
    return made.select(m["id"].alias("id"), F.sha2(F.col("messages")[0]["content"], 256).alias("question"), F.sha2(F.col("messages")[1]["content"], 256).alias("answer"), m["reward"].alias("reward"), m["source"].alias("source"), F.size(m["ability"]).alias("n_ability"), F.size(m["category"]).alias("n_category"))


@query("SELECT CAST(doc_id AS VARCHAR) AS row_id, sha256(text) AS prompt, 'lang=' || lang || CASE WHEN doc_id % 2 = 0 THEN ';source=' || source ELSE '' END AS constraint_kwargs FROM documents")
def trainer_rows(spark, sf_dir):
    """Renamed for a trainer, arguments without nulls, raw texts dropped."""
    args = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.when(F.col("doc_id") % 2 == 0, F.col("source")))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.sha2("text", 256).alias("messages"), restructure.without_nulls(args).alias("kwargs"), F.col("text").alias("raw_text"))
    shown = F.array_join(F.transform(F.map_entries("constraint_kwargs"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return restructure.without_raw(restructure.trainer_rows(rows)).withColumn("constraint_kwargs", shown)


@query("SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 0 THEN '<think>' || lang || '</think>' || chr(10) || text WHEN doc_id % 3 = 1 THEN text END) AS completion FROM documents")
def completion_texts(spark, sf_dir):
    d = F.col("doc_id") % 3
    made = restructure.completion_text(F.when(d == 0, F.col("lang")).when(d == 1, "").otherwise(None), F.when(d < 2, F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(made, 256).alias("completion"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN sha256(text) END AS content, CAST(CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END AS INTEGER) AS n_constraints, CASE WHEN doc_id % 2 = 0 THEN source END AS source FROM documents")
def parsed_cells(spark, sf_dir):
    """Cells of JSON: a message, or nothing; ids with arguments that are encoded twice."""
    d = F.col("doc_id")
    cell = F.when(d % 4 < 2, F.to_json(F.struct(F.col("text").alias("content")))).when(d % 4 == 2, "None").otherwise("")
    ids = F.when(d % 2 == 0, F.lit('["a:b", "c:d"]')).otherwise("[]")
    args = F.when(d % 2 == 0, F.to_json(F.array(F.lit("{}"), F.to_json(F.struct("source"))))).otherwise("[]")
    rows = table(spark, sf_dir, "documents").select("doc_id", restructure.parse_message(cell).alias("m"), restructure.parse_constraints(ids, args).alias("c"))
    return rows.select("doc_id", F.sha2("m", 256).alias("content"), F.size("c").alias("n_constraints"), F.try_element_at("c", F.lit(2))["args"]["source"].alias("source"))


@query("SELECT conv_id, count(*) AS n, sha256(string_agg(CASE WHEN i = n THEN role || ':' || text || '!' ELSE role || ':' || text END, chr(10) ORDER BY i)) AS messages FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) GROUP BY conv_id")
def last_message_changed(spark, sf_dir):
    rows = restructure.messages(table(spark, sf_dir, "conversations"))
    new = restructure.with_last(F.col("messages"), lambda x: x.withField("content", F.concat(x["content"], F.lit("!"))))
    shown = F.array_join(F.transform(new, lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "\n")
    return rows.select("conv_id", F.size("messages").cast("long").alias("n"), F.sha2(shown, 256).alias("messages"))


@query("SELECT doc_id, sha256('Within ' || (doc_id % 900 + 100) || ' tokens: ' || text || ' / ' || source || ' / {\"lang\":\"' || lang || '\"}') AS prompt FROM documents")
def editor_prompts(spark, sf_dir):
    made = restructure.editor_prompt("Within {budget} tokens: {task} / {reasoning} / {constraints}", F.col("doc_id") % 900 + 100, F.col("text"), F.col("source"), F.struct("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(made, 256).alias("prompt"))


@query("SELECT doc_id, doc_id % 3 + 1 > 1 AS retried, greatest(0, n_chars - 800) AS \"over\", n_chars >= 960 AS near_cap FROM documents")
def trajectory_risks(spark, sf_dir):
    risk = restructure.trajectory_risk(F.col("doc_id") % 3 + 1, F.col("n_chars"), F.lit(800))
    return table(spark, sf_dir, "documents").select("doc_id", risk.alias("r")).select("doc_id", "r.*")


@query("SELECT item_id, printf('row-%04d', row_number() OVER (ORDER BY sha256('42:' || CAST(item_id AS VARCHAR)), item_id)) AS new_id FROM benchmark")
def numbered_rows(spark, sf_dir):
    return restructure.numbered(table(spark, sf_dir, "benchmark").select("item_id"), "row-%04d", text.order_hash(42, F.col("item_id")), "item_id")


@query(f"SELECT doc_id, substr({_S.format("regexp_replace(text, '\\s+', ' ', 'g')")}, 1, 120) AS preview FROM documents")
def previews(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.preview(F.col("text")).alias("preview"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'yes and' || chr(10) || 'no' WHEN 1 THEN 'short ' || lang WHEN 2 THEN lang WHEN 3 THEN 'so' ELSE source END AS edited FROM documents")
def editor_outputs(spark, sf_dir):
    d, lang = F.col("doc_id") % 5, F.col("lang")
    said = F.when(d == 0, "<think>yes and\nno</think> left over<|im_end|>").when(d == 1, F.concat(F.lit("```text\n推理：short "), lang, F.lit("\n```"))).when(d == 2, F.concat(F.lit("<<a title>>\n"), lang, F.lit(" <|endoftext|>")))
    said = said.when(d == 3, "压缩后的推理：so</think>rest").otherwise(F.concat(F.lit("  "), "source", F.lit("\n")))
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_editor_output(said).alias("edited"))
