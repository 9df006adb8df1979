"""Contracts of rows and tables: each validator gives the codes of what is wrong, in a fixed order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.checkers import CHECKERS, raises
from quillon.functions.text import repetition_loop, strip
from quillon.operators.membership import is_disjoint, is_subset, same_counts
from quillon.operators.quality import codes

ROLES = ["system", "user", "assistant", "tool"]


def message_codes(m: Column, has_tools: bool = False, prefix: str = "") -> Column:
    """of an array of role, content (and tool_calls). Null and absent content are one here; validate_json() tells them apart."""
    bad_role = F.exists(m, lambda x: F.coalesce(~x["role"].isin(*ROLES), F.lit(True)))
    empty = F.exists(m, lambda x: x["content"].isNull() & (x["tool_calls"].isNull() if has_tools else F.lit(True)))
    return F.when(m.isNull() | (F.size(m) == 0), F.array(F.lit(prefix + "messages_missing"))).otherwise(codes((F.exists(m, lambda x: x.isNull()), prefix + "message_not_object"), (bad_role, prefix + "invalid_role"), (empty, prefix + "content_missing")))


def sft_codes(m: Column, **options) -> Column:
    """F7."""
    own = message_codes(m, **options)
    return F.when(F.coalesce(F.try_element_at(m, F.lit(-1))["role"] == "assistant", F.lit(False)), own).otherwise(F.concat(own, F.array(F.lit("last_not_assistant"))))


def dpo_codes(prompt: Column, chosen: Column, rejected: Column) -> Column:
    """F8."""
    return F.concat(*(message_codes(m, prefix=f"{n}: ") for n, m in (("prompt", prompt), ("chosen", chosen), ("rejected", rejected))))


def validate_json(record: Column) -> Column:
    """F6 and F7 over raw JSON, where an absent content differs from a null one."""
    v = F.try_parse_json(record)
    m = F.try_variant_get(v, "$.messages", "array<variant>")
    field = lambda x, p, t="string": F.try_variant_get(x, p, t)
    objects = F.forall(m, lambda x: F.schema_of_variant(x).startswith("OBJECT"))
    role = F.forall(m, lambda x: F.coalesce(field(x, "$.role").isin(*ROLES), F.lit(False)))
    shown = F.forall(m, lambda x: F.schema_of_variant(x).contains("content:") | F.schema_of_variant(x).contains("tool_calls:"))
    kind = F.forall(m, lambda x: F.coalesce(F.schema_of_variant(F.try_variant_get(x, "$.content", "variant")).isin("STRING", "VOID"), F.lit(True)))
    last = F.coalesce(field(F.try_element_at(m, F.lit(-1)), "$.role") == "assistant", F.lit(False))
    return F.when(v.isNull(), F.array(F.lit("invalid_json"))).when(m.isNull(), F.array(F.lit("messages_missing"))).otherwise(codes((~objects, "message_not_object"), (~role, "invalid_role"), (~shown, "content_missing"), (~kind, "content_not_text"), (~last, "last_not_assistant")))


def categories(ids: Column) -> Column:
    """Sorted distinct prefixes before the colon."""
    return F.array_sort(F.array_distinct(F.transform(ids, lambda x: F.split_part(x, F.lit(":"), F.lit(1)))))


def training_codes(id_: Column, m: Column, ids: Column, args: Column, cats: Column, count: Column, turns: Column) -> Column:
    """F9."""
    n_user = F.size(F.filter(m, lambda x: x["role"] == "user"))
    return F.concat(
        codes((id_.isNull() | (id_ == ""), "id_missing"), (F.coalesce(F.size(m), F.lit(0)) == 0, "messages_missing")),
        codes(
            (F.coalesce(F.try_element_at(m, F.lit(-1))["role"] != "user", F.lit(True)), "last_not_user"),
            (F.exists(m, lambda x: F.coalesce(~x["role"].isin(*ROLES), F.lit(True)) | x["content"].isNull()), "invalid_message"),
            (F.coalesce(F.size(ids), F.lit(0)) == 0, "no_instructions"),
            (~F.coalesce(F.size(ids) == F.size(args), F.lit(False)), "kwargs_not_aligned"),
            (~F.coalesce(categories(ids) == cats, F.lit(False)), "categories_differ"),
            (~F.coalesce(F.size(ids) == count, F.lit(False)), "constraint_count_differs"),
            (~F.coalesce(n_user == turns, F.lit(False)), "context_turns_differ"),
        ),
    )


def pool_problems(rows: DataFrame, violations: str, key: str, expected: int | None = None) -> list[str]:
    """what is wrong with a training pool, from one aggregate; empty if nothing is."""
    r = rows.agg(F.count("*").alias("n"), F.count_if(F.size(violations) > 0).alias("bad"), (F.count(key) - F.count_distinct(key)).alias("again")).first()
    found = [("rows break the contract", r["bad"]), ("ids occur again", r["again"]), ("rows more or fewer than expected", abs(r["n"] - expected) if expected is not None else 0)]
    return [f"{n} {what}" for what, n in found if n]


def raw_report(files: dict[str, DataFrame], key: str, messages: str, score: str, reward: str, strata: list[str]) -> DataFrame:
    """F11, one row for each file of a data set: rows, rows that break the contract, rows without metadata, repeated keys, mean and median of both values, and
    whether the files fit each other: clean lies in full, raw shares nothing with full, clean and raw have the same strata."""
    parts = []
    for name, rows in files.items():
        gone = F.col(score).isNull() | F.col(reward).isNull() | F.col(key).isNull()
        facts = [F.count("*").alias("n"), F.count_if(F.size(sft_codes(F.col(messages))) > 0).alias("n_invalid"), F.count_if(gone).alias("n_no_metadata"), (F.count(key) - F.count_distinct(key)).alias("n_again")]
        values = [f(c).alias(f"{c}_{n}") for c in (score, reward) for n, f in (("mean", F.avg), ("median", F.median))]
        parts.append(rows.agg(*facts, *values).select(F.lit(name).alias("file"), "*"))
    fine = is_subset(files["clean"], files["full"], key) and is_disjoint(files["raw"], files["full"], key) and same_counts(files["clean"], files["raw"], strata)
    return reduce(DataFrame.unionByName, parts).withColumn("files_fit", F.lit(fine))


def tokenized_codes(ids: Column, mask: Column, labels: Column, most: int) -> Column:
    """F12."""
    return codes(
        (~((F.size(ids) == F.size(mask)) & (F.size(ids) == F.size(labels))), "lengths_differ"),
        ((F.size(ids) == 0) | (F.size(ids) > most), "length_out_of_range"),
        (~F.exists(labels, lambda x: x != -100), "nothing_supervised"),
        (F.exists(F.zip_with(ids, labels, lambda a, b: (b != -100) & ~a.eqNullSafe(b)), lambda x: x), "label_not_its_token"),
    )


def first_reason(*pairs: tuple[Column, str]) -> Column:
    """the first that holds, or null: good rows and rejects are two filters of it."""
    return F.coalesce(*(F.when(p, r) for p, r in pairs))


def teacher_reason(truncated: Column, strict: Column, raw: Column) -> Column:
    """F13."""
    return first_reason((F.coalesce(truncated, F.lit(False)), "truncated"), (F.coalesce(F.size(strict), F.lit(0)) == 0, "no strict results"), (F.exists(strict, lambda x: ~x), "strict check failed"), (~raw.contains("</think>"), "reasoning not closed"), (repetition_loop(raw), "severe repetition"))


def answer_integrity(reasoning: Column, answer: Column, last_role: Column, last_content: Column) -> Column:
    """F25."""
    return first_reason((F.coalesce(strip(reasoning), F.lit("")) == "", "reasoning missing"), (F.coalesce(strip(answer), F.lit("")) == "", "answer missing"), (last_role != "assistant", "last message not assistant"), (~last_content.eqNullSafe(answer), "answer differs from message"))


def structure_codes(ids: Column, opening: int, closing: int, eos: int) -> Column:
    """one opening id at the start, one closing id after it, an end after that."""
    count = lambda t: F.size(F.filter(ids, lambda x: x == t))
    at = lambda t: F.array_position(ids, F.lit(t))
    return codes((count(opening) != 1, "opening_count"), (count(closing) != 1, "closing_count"), (count(eos) < 1, "no_end"), (~((at(opening) < at(closing)) & (at(closing) < F.size(ids) - at_last(ids, eos) + 1)) & (count(opening) == 1) & (count(closing) == 1) & (count(eos) > 0), "order"), (~F.coalesce(F.try_element_at(ids, F.lit(1)) == opening, F.lit(False)), "not_opened_first"))


def at_last(ids: Column, t: int) -> Column:
    """How far from the end (0: at it) the last occurrence of a value is."""
    return F.array_position(F.reverse(ids), F.lit(t)) - 1


def last_subsequence(ids: Column, part: Column) -> Column:
    """place (from 0) of the last occurrence of part in ids, -1 without one or for an empty part. Pass columns, not expressions: each is read for every place."""
    room, first = F.size(ids) - F.size(part), F.try_element_at(part, F.lit(1))
    starts = F.filter(F.transform(ids, lambda x, i: F.when(x == first, i)), lambda i: i.isNotNull() & (i <= room))
    hits = F.filter(starts, lambda i: F.slice(ids, i + 1, F.size(part)) == part)
    return F.when((room < 0) | (F.size(part) == 0), -1).otherwise(F.coalesce(F.array_max(hits), F.lit(-1)))


def last_supervised_end(ids: Column, labels: Column, eos: int) -> Column:
    """the last place where id and label are the end id, or -1."""
    return F.coalesce(F.array_max(F.filter(F.transform(F.arrays_zip(ids.alias("i"), labels.alias("l")), lambda x, k: F.when((x["i"] == eos) & (x["l"] == eos), k)), lambda k: k.isNotNull())), F.lit(-1))


def argument_gaps(rows: DataFrame, ids: str, args: str) -> DataFrame:
    """for each constraint id how often it occurs, whether it is known, and how often it lacks an argument."""
    flat = rows.select(F.explode(F.arrays_zip(F.col(ids).alias("i"), F.col(args).alias("a"))).alias("x")).select(F.col("x.i").alias("instruction_id"), F.col("x.a").alias("a"))
    return flat.groupBy("instruction_id").agg(F.count("*").alias("n"), F.count_if(raises(F.col("instruction_id"), F.col("a"))).alias("n_broken")).withColumn("known", F.col("instruction_id").isin(*CHECKERS))


def same_order(a: DataFrame, b: DataFrame, key: str, order: str) -> bool:
    """both have the same keys at the same places, without a null or a repeated one."""
    one, two = (x.select(F.col(order).alias("o"), F.col(key).alias("k")) for x in (a, b))
    r = one.agg(F.count("*").alias("n"), F.count_distinct("k").alias("d")).first()
    return r["n"] > 0 and r["n"] == r["d"] and one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()
