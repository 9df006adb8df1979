"""Chat formatting in budgeted windows, in DataFrame functions only.

Prefix sums of the turns' tokens cut a conversation into spans at turns. A span's window has the system turn, a limited history
of the turns before the span, and the span's own turns. Repeated turns are masked: the loss mask of a window covers the
texts of its own assistant turns, so over all windows each counts once.

A turn is [INST]role[/INST]text</s> and a window starts with <s>. In roles and texts every "<", "[" and "\\" is
followed by a backslash of ours, so no control string can occur in them, and taking those out restores them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUDGET, HISTORY_TURNS, HISTORY_TOKENS, TURN_TOKENS = 1024, 2, 256, 8
START, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escaped(role), F.lit(CLOSE), escaped(text), F.lit(END))


def tokens_of(text: Column) -> Column:
    """An estimate that needs no tokenizer: words, and signs that are neither words nor white space, and what the turn's marks cost."""
    return F.regexp_count(text, F.lit(r"(?U)\w+|[^\w\s]")) + TURN_TOKENS


def windows(conversations: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """conversations: conv_id, turn, role, text; other columns are not read. One row for each window: conv_id, window (from 0), formatted,
    n_repeated (turns at its head that are repeats), n_turns (its own), loss_spans (start and length in code points), n_tokens.

    Turns are ordered by turn (null first), then role and text; a null role or text is empty. All windows but those of a single long turn keep to
    the budget: a turn is never cut, and neither is the system turn. One that leaves less room than two turns need is repeated all the same, so each
    window then has a turn and is over the budget by what the system turn is. A conversation is put in order by one task. Rows without conv_id are one conversation. Repeated rows are turns like others.
    The first system turn so far is kept at the head of the windows after its own.
    """
    if history_tokens < 0 or budget <= 2 * history_tokens:
        raise ValueError("the budget must be over twice the history's")
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumn("said", rendered(F.col("role"), F.col("text"))).withColumn("tokens", tokens_of(F.col("text")).cast("long"))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    system = F.first(F.when(F.col("role") == "system", F.struct("said", "tokens")), ignorenulls=True)
    turns = turns.withColumn("place", F.row_number().over(order)).withColumn("sum", F.sum("tokens").over(so_far)).withColumn("system", system.over(so_far))
    # a turn belongs to the stretch of half the room in which its last token lies; longer turns stand alone
    room = F.greatest(F.lit(1), (F.lit(budget - history_tokens) - F.coalesce(F.col("system")["tokens"], F.lit(0))) / 2).cast("long")
    turns = turns.withColumn("room", room)
    stretch, long_ = F.floor((F.col("sum") - 1) / F.col("room")), F.col("tokens") > F.col("room")
    before = lambda c: F.lag(c).over(order)
    new = (F.col("place") == 1) | before(stretch).isNull() | (stretch != before(stretch)) | long_ | before(long_) | (F.col("room") != before("room"))
    turns = turns.withColumn("new", F.when(new, 1).otherwise(0))
    past = [F.when(new, F.lag(F.struct("said", "tokens", F.col("role").alias("role")), k).over(order)) for k in range(1, history_turns + 1)]
    turns = turns.withColumn("past", F.when(F.col("new") == 1, F.array(*past)) if past else F.array()).withColumn("known", F.when(F.col("new") == 1, F.lag("system").over(order)))
    turns = turns.withColumn("window", F.sum("new").over(so_far) - 1)
    # the past is told from the latest turn on, as far as its tokens go, and without the system turn
    kind = "array<struct<said:string,tokens:bigint>>"
    taken = F.aggregate(
        "past",
        F.struct(F.lit(0).cast("long").alias("n"), F.array().cast(kind).alias("turns")),
        lambda s, x: F.when(x.isNull() | (x["role"] == "system") | (s["n"] + F.coalesce(x["tokens"], F.lit(0)) > history_tokens), F.struct(F.lit(1 << 40).alias("n"), s["turns"].alias("turns"))).otherwise(F.struct((s["n"] + x["tokens"]).alias("n"), F.concat(F.array(F.struct(x["said"].alias("said"), x["tokens"].alias("tokens"))), s["turns"]).alias("turns"))),
        lambda s: s["turns"],
    )
    turns = turns.withColumn("head", F.when(F.col("new") == 1, F.concat(F.when(F.col("known").isNull(), F.array().cast(kind)).otherwise(F.array("known")), taken)))
    own = turns.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(F.struct("place", "role", "said", "text"))).alias("turns"), F.first("head", ignorenulls=True).alias("head"), F.sum("tokens").alias("tokens"))
    head = F.concat(F.lit(START), F.array_join(F.transform("head", lambda x: x["said"]), ""))
    own = own.withColumn("front", head)
    spans = F.aggregate(
        "turns",
        F.struct(F.length("front").cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda s, x: F.struct(
            (s["at"] + F.length(x["said"])).alias("at"),
            F.when(x["role"] != "assistant", s["spans"]).otherwise(F.concat(s["spans"], F.array(F.struct((s["at"] + len(OPEN + CLOSE) + F.length(escaped(x["role"]))).alias("start"), F.length(escaped(x["text"])).cast("long").alias("length"))))).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    return own.select(
        "conv_id",
        F.col("window").cast("int").alias("window"),
        F.concat("front", F.array_join(F.transform("turns", lambda x: x["said"]), "")).alias("formatted"),
        F.size("head").alias("n_repeated"),
        F.size("turns").alias("n_turns"),
        spans.alias("loss_spans"),
        (F.col("tokens") + F.aggregate("head", F.lit(0).cast("long"), lambda s, x: s + x["tokens"])).alias("n_tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """From windows: conv_id, window, turns (role and text of its own turns), loss (the text under its mask), chars."""
    said = F.split("formatted", END, -1)
    said = F.slice(said, F.col("n_repeated") + 1, F.greatest(F.lit(0), F.size(said) - 1 - F.col("n_repeated")))
    clean = F.transform(said, lambda x: F.when(x.startswith(START), F.substr(x, F.lit(len(START) + 1))).otherwise(x))
    pair = lambda x: F.struct(unescaped(F.substr(F.substring_index(x, CLOSE, 1), F.lit(len(OPEN) + 1))).alias("role"), unescaped(F.substring_index(x, CLOSE, -1)).alias("text"))
    masked = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substr("formatted", s["start"].cast("int") + 1, s["length"].cast("int")))), "")
    return formatted.select("conv_id", "window", F.transform(clean, pair).alias("turns"), masked.alias("loss"), F.length("formatted").cast("long").alias("chars"))


def report(conversations: DataFrame) -> DataFrame:
    """The digest of op1, read back from the windows. A digest is of one string, so here, not in the operator, a conversation comes together."""
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    parts = read_back(windows(conversations)).select("conv_id", "window", said.alias("said"), "loss", F.size("turns").alias("n"), "chars")
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "said", "loss"))).alias("w"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    text = lambda c: F.array_join(F.transform("w", lambda x: x[c]), "")
    return whole.select("conv_id", "n_turns", F.sha2(text("said"), 256).alias("turns_sha256"), F.length(text("loss")).cast("long").alias("loss_chars"), F.sha2(text("loss"), 256).alias("loss_sha256"), "formatted_chars")
