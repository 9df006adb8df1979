"""Normalised keys, ordering hashes, and parsing of texts, as Column expressions."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The rules of task buckets, in order, and the markers of quality checks.
TASK_RULES = [
    ("code", ["代码", "编程", "python", "java", "c++", "sql", "算法"]),
    ("math_reasoning", ["数学", "计算", "推理", "逻辑", "证明"]),
    ("translation", ["翻译", "译成", "translate"]),
    ("rewrite_summary", ["改写", "润色", "摘要", "总结", "概括", "压缩"]),
    ("extraction_classification", ["抽取", "分类", "情感分析", "实体识别"]),
    ("creative_writing", ["写一篇", "故事", "诗歌", "创作", "文案"]),
    ("dialogue_roleplay", ["对话", "角色扮演", "回复"]),
    ("knowledge_qa", ["知识", "常识", "科普", "法律", "医学", "历史"]),
]
DEFAULT_BUCKET = "general_instruction"
LENGTH_LIMITS = [256, 512, 1024, 2048]
PLACEHOLDER = r"__[A-Z][A-Z0-9_]*__|\[(?:姓名|日期|公司|部门|职位|待填写)\]"
SELF_ID_MARKERS = ["作为一个人工智能", "作为一名人工智能", "作为chatgpt"]
END_MARKERS = ["<|im_end|>", "<|endoftext|>"]
#: The characters of Unicode's White_Space property, which (?U)\s matches.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
EXPLICIT_CONSTRAINT = r"(?:(?:最多|不超过|不得超过|少于|至少|不少于|多于|恰好|正好|限制在).{0,10}(?:个)?(?:字|词|句话|句|段落|段)|[\d一二三四五六七八九十]+(?:到|至|-)[\d一二三四五六七八九十]+(?:句话|句|段落|段)|(?:单行|一句话)(?:简介|回答|描述|总结|摘要))"


@F.pandas_udf(T.StringType())
def nfkc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility normalisation, the one text primitive that Spark lacks; Arrow batches."""
    for s in parts:
        yield s.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.DecimalType(20, 0))
def stable_number(s: pd.Series) -> pd.Series:
    """The first 8 bytes of BLAKE2b as an unsigned number, for ties that must equal another system's."""
    from decimal import Decimal

    return s.map(lambda x: x if x is None else Decimal(int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big")))


def strip(c: Column) -> Column:
    """Without white space at either end, by Unicode's notion of it. Trimmed from the ends: a pattern would be tried at every character."""
    return F.btrim(c, F.lit(WHITE))


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def alnum_key(c: Column, normal: bool = False) -> Column:
    """K1: lower case, letters and numbers only. normal: the text is known to be NFKC already."""
    return F.regexp_replace(F.lower(c if normal else nfkc(c)), r"[^\p{L}\p{N}]++", "")


def prompt_key(c: Column, normal: bool = False) -> Column:
    """K3 and K4: lower case, white space collapsed."""
    return collapse(F.lower(c if normal else nfkc(c)))


def cased_prompt_key(c: Column, normal: bool = False) -> Column:
    """K5: white space collapsed, case kept."""
    return collapse(c if normal else nfkc(c))


def digest(key: str) -> list[Column]:
    """128 bits of a key, as two columns to group or join by: of 10^12 different keys two are alike by chance with odds of about 10^-15."""
    return [F.xxhash64(F.col(key)).alias("_d1"), F.xxhash64(F.lit("again"), F.col(key)).alias("_d2")]


def order_hash(*parts: Column | str | int) -> Column:
    """SHA-256 of the parts joined by colons."""
    return F.sha2(F.concat_ws(":", *(p if isinstance(p, Column) else F.lit(str(p)) for p in parts)), 256)


def task_bucket(text: Column, rules: list[tuple[str, list[str]]] = TASK_RULES, default: str = DEFAULT_BUCKET) -> Column:
    """The first rule one of whose markers is in the lower-cased text."""
    low, out = F.lower(text), F.lit(default)
    for name, markers in reversed(rules):
        hit = F.lit(False)
        for m in markers:
            hit = hit | low.contains(m)
        out = F.when(hit, name).otherwise(out)
    return out


def length_bucket(n: Column) -> Column:
    """X2."""
    out = F.lit(f"gt_{LENGTH_LIMITS[-1]}")
    for limit in reversed(LENGTH_LIMITS):
        out = F.when(n <= limit, f"le_{limit}").otherwise(out)
    return out


def without_end_markers(c: Column) -> Column:
    marks = "|".join(m.replace("|", r"\|") for m in END_MARKERS)
    return F.regexp_replace(strip(c), rf"(?:\s*(?:{marks}))+\s*$", "")


def parse_reasoning(c: Column) -> Column:
    """Struct of reasoning and answer around the first </think>, null unless both have text."""
    s = without_end_markers(c)
    at = F.instr(s, "</think>")
    left = strip(F.regexp_replace(strip(F.substr(s, F.lit(1), at - 1)), "^<think>", ""))
    right = strip(F.substr(s, at + 8))
    return F.when((at > 0) & (left != "") & (right != ""), F.struct(left.alias("reasoning"), right.alias("answer")))


def _count(c: Column, what: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))) / len(what)).cast("int")


def _last(c: Column, what: str) -> Column:
    return F.when(c.contains(what), F.length(c) - F.length(F.substring_index(c, what, -1)) - len(what) + 1).otherwise(0)


def thinking_structure_ok(c: Column, enabled: Column | bool) -> Column:
    """with thinking, a close after the last open; without, as many opens as closes."""
    opens, closes = _count(c, "<think>"), _count(c, "</think>")
    on = enabled if isinstance(enabled, Column) else F.lit(enabled)
    return F.when(on, (closes > 0) & (_last(c, "</think>") > _last(c, "<think>"))).otherwise(opens == closes)


def extract_final(c: Column, enabled: Column | bool) -> Column:
    """What follows the last </think>; empty where the structure is broken or never closed."""
    on = enabled if isinstance(enabled, Column) else F.lit(enabled)
    s = F.replace(c, F.lit("<|im_end|>"), F.lit(""))
    after = F.when(s.contains("</think>"), F.substring_index(s, "</think>", -1)).when(s.contains("<think>"), "").otherwise(s)
    return F.when(on & ~thinking_structure_ok(s, True), "").otherwise(strip(F.replace(after, F.lit("<think>"), F.lit(""))))


def clean_editor_output(c: Column) -> Column:
    """An editor's output without markers, wrapper, fence, label and a leading title."""
    s = without_end_markers(c)
    s = strip(F.when(s.startswith("<think>"), F.substring_index(strip(F.regexp_replace(s, "^<think>", "")), "</think>", 1)).otherwise(F.substring_index(s, "</think>", 1)))
    fenced = s.startswith("```") & s.endswith("```") & (F.length(s) >= 6)
    s = F.when(fenced, strip(F.regexp_replace(strip(F.substr(s, F.lit(4), F.length(s) - 6)), r"^(?:text|markdown)\n", ""))).otherwise(s)
    s = strip(F.regexp_replace(s, "^(?:压缩后的推理：|压缩推理：|推理：)", ""))
    return strip(F.regexp_replace(s, r"^<<[^<>\r\n]+>>\s*(?:\r?\n)?", ""))


def copies_answer(reasoning: Column, answer: Column, least: int = 32) -> Column:
    """the answer, if long enough, stands in the reasoning, white space aside."""
    bare = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    return (F.length(bare(answer)) >= least) & bare(reasoning).contains(bare(answer))


def response_variants(c: Column) -> Column:
    """The response, without its first line, its last, both; then the four without asterisks."""
    lines = F.split(c, "\n", -1)
    n = F.size(lines)
    cut = lambda a, k: strip(F.array_join(F.slice(lines, a, F.greatest(F.lit(0), n - k)), "\n"))
    four = F.array(c, cut(2, 1), cut(1, 1), cut(2, 2))
    return F.concat(four, F.transform(four, lambda x: F.replace(x, F.lit("*"), F.lit(""))))


def repetition_loop(c: Column, least: int = 12, times: int = 3) -> Column:
    """F16: the same unit (line or sentence of `least` characters or more, white space aside) `times` times running."""
    units = F.transform(F.split(c, r"\n+|(?<=[。！？!?])"), lambda u: F.lower(F.regexp_replace(u, r"(?U)\s+", "")))
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(False).alias("bad"))
    step = lambda s, u: F.when(F.length(u) < least, F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), s["bad"].alias("bad"))).otherwise(
        F.struct(u.alias("last"), F.when(u == s["last"], s["run"] + 1).otherwise(1).alias("run"), (s["bad"] | ((u == s["last"]) & (s["run"] + 1 >= times))).alias("bad"))
    )
    return F.aggregate(F.filter(units, lambda u: u != ""), start, step, lambda s: s["bad"])


def answer_end_phrase(answer: Column, first_term: Column) -> Column:
    """The last sentence fit to end an answer with, or a fixed phrase around the first term."""
    plain = F.regexp_replace(answer, r"(?s)```.*?```", " ")
    parts = F.transform(F.split(plain, r"[。！？!?\n]"), lambda p: strip(F.regexp_replace(p, r"(?U)^[#>*\-\d.\s]+|[。！？!?\s]+$", "")))
    fit = F.filter(parts, lambda p: F.length(p).between(8, 36) & ~p.endswith("：") & ~p.endswith(":") & ~p.startswith("以下"))
    return F.coalesce(F.try_element_at(fit, F.lit(-1)), F.concat(F.lit("关于"), first_term, F.lit("的说明到此结束")), F.lit("以上说明到此结束"))


def preview(c: Column, n: int = 120) -> Column:
    """P18."""
    return F.substring(collapse(c), 1, n)
