"""Changes of shape: source rows to messages, wide turns to long, histories, masks, templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.text import strip
from quillon.operators.ranks import running


def from_source(rows: DataFrame, language: str = "zh-cn") -> DataFrame:
    """Hub rows of one human and one other turn, both with text, in the language and with a reward, to messages and metadata."""
    c = F.col("conversations")
    one, two = F.try_element_at(c, F.lit(1)), F.try_element_at(c, F.lit(2))
    keep = (F.col("langdetect") == language) & (F.size(c) == 2) & (one["from"] == "human") & (two["from"] == "gpt") & (strip(one["value"]) != "") & (strip(two["value"]) != "") & F.col("reward").isNotNull()
    said = lambda role, x: F.struct(F.lit(role).alias("role"), strip(x["value"]).alias("content"))
    none = F.array().cast("array<string>")
    meta = F.struct("id", F.coalesce("label.ability_zh", none).alias("ability"), F.coalesce("label.cate_ability_zh", none).alias("category"), F.col("reward").cast("double").alias("reward"), F.coalesce("source", F.lit("unknown")).alias("source"))
    return rows.filter(keep).select(F.array(said("user", one), said("assistant", two)).alias("messages"), meta.alias("metadata"))


def constrained_messages(turns: Column, question: Column, answer: Column, texts: Column, header: str, bridge: tuple[str, str], revision: str) -> Column:
    """1 turn: the question with numbered constraints; 2: the pair, then the request to revise; 3: a bridge pair between."""
    listed = F.array_join(F.transform(texts, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    asked = lambda c: F.concat(c, F.lit("\n\n"), F.lit(header), F.lit("\n"), listed)
    say = lambda role, c: F.struct(F.lit(role).alias("role"), (c if isinstance(c, Column) else F.lit(c)).alias("content"))
    pair = F.array(say("user", question), say("assistant", answer))
    last = F.array(say("user", asked(F.lit(revision))))
    return F.when(turns == 1, F.array(say("user", asked(question)))).when(turns == 2, F.concat(pair, last)).otherwise(F.concat(pair, F.array(say("user", bridge[0]), say("assistant", bridge[1])), last))


def without_nulls(args: Column) -> Column:
    """P4."""
    return F.map_filter(args, lambda k, v: v.isNotNull())


def trainer_rows(rows: DataFrame) -> DataFrame:
    """The names that a trainer expects."""
    names = {"id": "row_id", "messages": "prompt", "kwargs": "constraint_kwargs"}
    return rows.withColumnsRenamed(names)


def without_raw(rows: DataFrame, *heavy: str) -> DataFrame:
    """What a report keeps: all but the raw texts."""
    return rows.drop(*(heavy or ("raw_text",)))


def completion_text(reasoning: Column, content: Column) -> Column:
    """P5: a completion as one text, reasoning in its tags."""
    return F.when(F.coalesce(reasoning, F.lit("")) != "", F.concat(F.lit("<think>"), reasoning, F.lit("</think>\n"), F.coalesce(content, F.lit("")))).otherwise(content)


def parse_message(cell: Column) -> Column:
    """The content of a JSON message; null for a null, empty or 'None' cell."""
    return F.get_json_object(F.nullif(F.nullif(cell, F.lit("")), F.lit("None")), "$.content")


def parse_constraints(ids: Column, args: Column) -> Column:
    """Ids and doubly encoded arguments, one struct each; the query fails if they differ in number."""
    i, a = F.from_json(ids, "array<string>"), F.from_json(args, "array<string>")
    same = F.assert_true(F.size(i).eqNullSafe(F.size(a)), "ids and arguments differ in number")
    return F.when(same.isNull(), F.zip_with(i, a, lambda x, y: F.struct(x.alias("id"), F.from_json(y, "map<string,string>").alias("args"))))


def turns_to_rows(rows: DataFrame, columns: list[str], keep: list[str], value: str = "prompt", turn: str = "turn") -> DataFrame:
    """One row for each turn column that is not null."""
    pairs = F.explode(F.array(*(F.struct(F.lit(i + 1).alias(turn), F.col(c).alias(value)) for i, c in enumerate(columns))))
    return rows.select(*keep, pairs.alias("x")).select(*keep, f"x.{turn}", f"x.{value}").filter(F.col(value).isNotNull())


def messages(rows: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """One row for each conversation: its messages in order."""
    said = F.sort_array(F.collect_list(F.struct(order, "role", F.col("text").alias("content"))))
    return rows.groupBy(key).agg(F.transform(said, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def histories(rows: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """With each row the messages up to it."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("history", F.collect_list(F.struct("role", F.col("text").alias("content"))).over(w))


def label_mask(prompt: Column, ids: Column) -> Column:
    """Ids with the prompt's masked by -100, null where the prompt is not their prefix."""
    n = F.size(prompt)
    return F.when(F.slice(ids, 1, n) == prompt, F.concat(F.array_repeat(F.lit(-100), n), F.slice(ids, n + 1, F.greatest(F.lit(0), F.size(ids) - n))))


def with_last(items: Column, change) -> Column:
    """The array with its last element changed."""
    return F.transform(items, lambda x, i: F.when(i == F.size(items) - 1, change(x)).otherwise(x))


def render_task(m: Column) -> Column:
    """[role] and content, without assistant messages that show reasoning."""
    shown = F.filter(m, lambda x: ~((x["role"] == "assistant") & (F.coalesce(x["reasoning_content"], F.lit("")) != "")))
    return F.array_join(F.transform(shown, lambda x: F.concat(F.lit("["), x["role"], F.lit("]\n"), x["content"])), "\n\n")


def editor_prompt(template: str, budget: Column, task: Column, reasoning: Column, args: Column) -> Column:
    """Named places of a template, the arguments as JSON."""
    out = F.lit(template)
    for name, c in (("budget", budget.cast("string")), ("task", task), ("reasoning", reasoning), ("constraints", F.to_json(args))):
        out = F.replace(out, F.lit("{" + name + "}"), c)
    return out


def trajectory_risk(attempts: Column, tokens: Column, budget: Column, near: int = 960) -> Column:
    """P14."""
    return F.struct((attempts > 1).alias("retried"), F.greatest(F.lit(0), tokens - budget).alias("over"), (tokens >= near).alias("near_cap"))


def numbered(rows: DataFrame, pattern: str, *order: Column | str) -> DataFrame:
    """Ids in an order, such as 'row-%04d'."""
    return running(rows, [], list(order), name="_rn").withColumn("new_id", F.format_string(pattern, "_rn")).drop("_rn")
