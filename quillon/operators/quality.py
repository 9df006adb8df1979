"""Hard rules, soft flags and the score of question-answer rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import PLACEHOLDER, SELF_ID_MARKERS, alnum_key, digest, strip

# What each soft flag takes from the score.
PENALTIES = {"negative_reward": 12, "low_reward": 4, "very_short_answer": 8, "very_long_sample": 3, "assistant_self_identification": 8, "answer_copied_from_prompt": 10}


def codes(*pairs: tuple[Column, str]) -> Column:
    """The codes whose predicate holds, in order."""
    return F.array_compact(F.array(*(F.when(p, c) for p, c in pairs)))


def inspected(rows: DataFrame, normal: bool = False) -> DataFrame:
    """Rows of question, answer, reward get hard (codes), flags (soft) and score.

    The first stage (empty texts, invalid reward) ends the inspection with score 0; the second still gives a score. Where rows come as
    messages, see dialogue_codes() for what stands before. A null text is empty.
    """
    q, a, r = strip(F.coalesce("question", F.lit(""))), strip(F.coalesce("answer", F.lit(""))), F.col("reward")
    kq, ka = alnum_key(F.coalesce("question", F.lit("")), normal), alnum_key(F.coalesce("answer", F.lit("")), normal)
    first = codes((q == "", "empty_question"), (a == "", "empty_answer"), (r.isNull() | F.isnan(r), "invalid_reward"))
    second = codes((kq == ka, "question_equals_answer"), (F.concat(q, a).contains("�"), "invalid_unicode_replacement"), (a.rlike(PLACEHOLDER), "unresolved_placeholder"))
    self_id = F.lit(False)
    for m in SELF_ID_MARKERS:
        self_id = self_id | F.lower(a).contains(m)
    soft = codes(
        (r < 0, "negative_reward"),
        ((r >= 0) & (r < 1), "low_reward"),
        ((F.length(a) < 8) & (F.length(q) > 24), "very_short_answer"),
        (F.length(q) + F.length(a) > 4000, "very_long_sample"),
        (self_id, "assistant_self_identification"),
        ((ka != "") & kq.contains(ka), "answer_copied_from_prompt"),
    )
    penalty = F.create_map(*(F.lit(x) for kv in PENALTIES.items() for x in kv))
    rows = rows.withColumn("_first", first).withColumn("_second", second).withColumn("_soft", soft)
    ended = F.size("_first") > 0
    lost = F.aggregate("_soft", F.lit(0), lambda s, x: s + F.try_element_at(penalty, x))
    rows = rows.withColumn("hard", F.when(ended, F.col("_first")).otherwise(F.col("_second"))).withColumn("flags", F.when(ended, F.array().cast("array<string>")).otherwise(F.col("_soft")))
    score = F.bround(50 + 2 * F.greatest(F.lit(-5.0), F.least(F.lit(5.0), r)) - lost, 3)
    return rows.withColumn("score", F.when(ended, 0.0).otherwise(score)).drop("_first", "_second", "_soft")


def dialogue_codes(messages: Column, metadata: Column) -> Column:
    """at most one code for a row that is no dialogue of one turn each."""
    roles = F.transform(messages, lambda m: m["role"])
    return F.when(F.coalesce(F.size(messages), F.lit(0)) != 2, F.array(F.lit("not_one_turn_dialogue"))).when(roles != F.array(F.lit("user"), F.lit("assistant")), F.array(F.lit("invalid_roles"))).when(metadata.isNull(), F.array(F.lit("missing_metadata"))).otherwise(F.array().cast("array<string>"))


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by order; rows with an empty or null key are dropped too. Filter before, never after.

    Keys meet as 128-bit digests, and repeats within a task go before the shuffle, so neither long keys nor a hot one weigh. Pass the columns that are needed only.
    """
    own = rows.filter((F.col(key) != "") & F.col(key).isNotNull())
    return own.groupBy(*digest(key)).agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, at the place of the first (column first_place). Partial aggregation goes before the shuffle."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("r"), F.min(order).alias("first_place")).select("r.*", "first_place")


def failure_counts(annotated: DataFrame, key: str = "k") -> DataFrame:
    """A3: rows for each hard code, and duplicate_question for the usable rows that first_wins drops."""
    hard = annotated.select(F.explode("hard").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    usable = annotated.filter(F.size("hard") == 0).groupBy(*digest(key), (F.coalesce(F.col(key), F.lit("")) == "").alias("empty")).agg(F.count("*").alias("m"))
    again = usable.agg(F.sum(F.when(F.col("empty"), F.col("m")).otherwise(F.col("m") - 1)).alias("n")).filter("n > 0")
    return hard.union(again.select(F.lit("duplicate_question").alias("reason"), "n"))
