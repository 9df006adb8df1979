"""Verifiable constraints for prompts: what a task allows, which go together, their parameters and texts.

Draws are hashes of seed and row, so any executor gives the same ones; choosing is a fold over at most three unrolled draws.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.text import answer_end_phrase
from quillon.operators.sampling import uniform, weighted_choice

# Kinds with weights, ranges and texts; groups and pairs that exclude each other; what tasks allow.
WEIGHTS = {
    "keywords:existence": 1.0,
    "keywords:frequency": 0.8,
    "keywords:forbidden_words": 1.0,
    "length_constraints:number_sentences": 0.8,
    "length_constraints:number_words": 0.7,
    "length_constraints:number_paragraphs": 0.8,
    "length_constraints:nth_paragraph_first_word": 0.4,
    "detectable_content:number_placeholders": 0.4,
    "detectable_content:postscript": 0.2,
    "detectable_format:number_bullet_lists": 0.8,
    "detectable_format:number_highlighted_sections": 0.6,
    "detectable_format:multiple_sections": 0.5,
    "detectable_format:json_format": 0.5,
    "detectable_format:title": 1.0,
    "combination:two_responses": 0.3,
    "combination:repeat_prompt": 0.2,
    "startend:end_checker": 0.8,
    "startend:quotation": 0.6,
    "punctuation:no_comma": 0.5,
}
TEMPLATES = {
    "keywords:existence": "你的回答必须包含以下关键词：{keywords}。",
    "keywords:frequency": "你的回答中“{keyword}”必须至少出现 {frequency} 次。",
    "keywords:forbidden_words": "你的回答不能包含以下词语：{forbidden_words}。",
    "length_constraints:number_sentences": "你的回答必须{relation} {num_sentences} 句话。",
    "length_constraints:number_words": "你的回答必须{relation} {num_words} 个字。",
    "length_constraints:number_paragraphs": "你的回答必须包含 {num_paragraphs} 个段落，段落之间用三个星号（***）分隔。",
    "length_constraints:nth_paragraph_first_word": "你的回答必须有 {num_paragraphs} 个段落，第 {nth_paragraph} 段必须以“{first_word}”开头，段落之间用两个换行符分隔。",
    "detectable_content:number_placeholders": "你的回答必须包含至少 {num_placeholders} 个用方括号标记的占位符，例如[姓名]。",
    "detectable_content:postscript": "你的回答末尾必须包含以“{postscript_marker}”开头的附言。",
    "detectable_format:number_bullet_lists": "你的回答必须包含恰好 {num_bullets} 个 Markdown 星号项目符号。",
    "detectable_format:number_highlighted_sections": "你的回答必须用双星号标出恰好 {num_highlights} 个重点，例如**重点**。",
    "detectable_format:multiple_sections": "你的回答必须包含至少 {num_sections} 个部分，并使用“部分1”“部分2”这样的标题。",
    "detectable_format:json_format": "整个回答必须是可以被解析的 JSON；可以放在 Markdown JSON 代码块中。",
    "detectable_format:title": "你的回答必须包含一个用双角括号括起来的标题，例如<<标题>>。",
    "combination:two_responses": "请给出两个不同版本的回答，并用六个星号（******）分隔。",
    "combination:repeat_prompt": "首先逐字重复原始请求，然后再给出答案；重复前不要添加任何内容。",
    "startend:end_checker": "你的回答必须以“{end_phrase}”结尾，之后不能再有其他文字。",
    "startend:quotation": "整个回答必须放在一对英文双引号中。",
    "punctuation:no_comma": "你的回答不能包含英文逗号（,）。",
}
RELATIONS = {"less than": "少于", "at least": "至少包含"}
RANGES = {"length_constraints:number_sentences": {"less than": (5, 10), "at least": (3, 6)}, "length_constraints:number_words": {"less than": (120, 300), "at least": (80, 180)}}
COUNTS = {"num_paragraphs": (2, 4), "num_placeholders": (1, 3), "num_bullets": (3, 6), "num_highlights": (2, 4), "num_sections": (2, 4)}
FIRST_WORDS, POSTSCRIPTS, SECTION = ["首先", "其次", "最后", "总之"], ["附言", "备注"], "部分"
REPEAT_LIMIT = 120
EXCLUSIVE = [
    ["detectable_format:json_format", "length_constraints:number_paragraphs", "length_constraints:nth_paragraph_first_word", "detectable_format:number_bullet_lists", "detectable_format:multiple_sections", "combination:two_responses", "combination:repeat_prompt"],
    ["length_constraints:number_paragraphs", "length_constraints:nth_paragraph_first_word", "detectable_format:number_bullet_lists", "detectable_format:multiple_sections", "combination:two_responses"],
]
FORBIDDEN_PAIRS = [
    ("detectable_format:json_format", "detectable_format:title"),
    ("detectable_format:json_format", "punctuation:no_comma"),
    ("detectable_format:json_format", "detectable_content:number_placeholders"),
    ("detectable_content:postscript", "startend:end_checker"),
    ("startend:end_checker", "startend:quotation"),
    ("startend:end_checker", "detectable_format:json_format"),
    ("startend:end_checker", "keywords:forbidden_words"),
    ("combination:repeat_prompt", "startend:quotation"),
    ("combination:repeat_prompt", "detectable_format:json_format"),
    ("combination:repeat_prompt", "keywords:forbidden_words"),
    ("combination:repeat_prompt", "keywords:existence"),
    ("combination:repeat_prompt", "keywords:frequency"),
    ("keywords:existence", "keywords:forbidden_words"),
    ("keywords:frequency", "keywords:forbidden_words"),
    ("keywords:existence", "keywords:frequency"),
    ("length_constraints:number_sentences", "detectable_format:number_bullet_lists"),
]
_EXTRACTION = ["detectable_format:json_format", "detectable_format:number_bullet_lists", "detectable_format:title", "keywords:existence", "keywords:forbidden_words", "startend:end_checker"]
_TRANSLATION = ["length_constraints:number_sentences", "length_constraints:number_words", "detectable_format:title", "startend:end_checker", "startend:quotation", "punctuation:no_comma"]
BARRED = {
    "general_instruction": [],
    "knowledge_qa": ["detectable_content:number_placeholders", "detectable_format:json_format"],
    "creative_writing": ["detectable_format:json_format"],
    "dialogue_roleplay": ["detectable_format:json_format", "combination:repeat_prompt"],
    "extraction_classification": [x for x in WEIGHTS if x not in _EXTRACTION],
    "rewrite_summary": ["detectable_content:number_placeholders"],
    "translation": [x for x in WEIGHTS if x not in _TRANSLATION],
}
KEYWORD_KINDS = ["keywords:existence", "keywords:frequency", "keywords:forbidden_words"]
KINDS = list(WEIGHTS)


def clashes(kind: str) -> list[str]:
    """the kinds that cannot go with this one, itself among them."""
    out = {kind}
    for g in EXCLUSIVE:
        out |= set(g) if kind in g else set()
    for a, b in FORBIDDEN_PAIRS:
        out |= {a, b} if kind in (a, b) else set()
    return [k for k in KINDS if k in out]


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def allowed(bucket: Column, n_terms: Column, request: Column) -> Column:
    """kinds that the task allows, without those that lack terms or would repeat a long request. An unknown task fails the query."""
    out = F.when(F.assert_true(bucket.isin(*BARRED), "unknown task").isNull(), _strings([]))
    for name, barred in BARRED.items():
        out = F.when(bucket == name, _strings([k for k in KINDS if k not in barred])).otherwise(out)
    out = F.when(n_terms > 0, out).otherwise(F.array_except(out, _strings(KEYWORD_KINDS)))
    # a null request cannot be repeated either
    return F.when(F.length(request) <= REPEAT_LIMIT, out).otherwise(F.array_except(out, _strings(["combination:repeat_prompt"])))


def _lookup(kinds: Column, values: dict, none: Column) -> Column:
    return reduce(lambda out, kv: F.when(kinds == kv[0], kv[1]).otherwise(out), values.items(), none)


def choose(allowed_: Column, n: Column, seed: Column, attempts: int = 4) -> Column:
    """Up to 3 kinds that go together, each drawn by weight from those left; the fullest of some attempts, the first of equals.

    seed: what identifies the row. Fewer than n come back only where no attempt finds n.
    """
    weight = F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv))
    clash = F.create_map(*(x for k in KINDS for x in (F.lit(k), _strings(clashes(k)))))

    def draw(t: Column) -> Column:
        def step(state: Column, k: Column) -> Column:
            at = weighted_choice(F.transform(state["left"], lambda x: F.try_element_at(weight, x)), uniform(seed, t, k))
            one = F.try_element_at(state["left"], at + 1)
            after = F.struct(F.array_except(state["left"], F.try_element_at(clash, one)).alias("left"), F.array_append(state["got"], one).alias("got"))
            return F.when((F.size(state["got"]) < n) & (F.size(state["left"]) > 0), after).otherwise(state)

        start = F.struct(allowed_.alias("left"), F.array().cast("array<string>").alias("got"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(2)), start, step, lambda s: s["got"])

    drawn = F.transform(F.sequence(F.lit(0), F.lit(attempts - 1)), draw)
    tries = F.transform(drawn, lambda got, t: F.struct(F.size(got).alias("n"), (-t).alias("t"), got.alias("got")))
    return F.array_max(tries)["got"]


def _between(seed: Column, name: str, low: int, high: int) -> Column:
    return (F.lit(low) + F.floor(uniform(seed, name) * (high - low + 1))).cast("int")


def _pick(seed: Column, name: str, values: Column) -> Column:
    return F.element_at(values, (F.floor(uniform(seed, name) * F.size(values)) + 1).cast("int"))


def _some(seed: Column, name: str, terms: Column, n: Column) -> Column:
    """n of the terms, in hash order."""
    keyed = F.array_sort(F.transform(terms, lambda x: F.struct(F.sha2(F.concat_ws(":", seed, F.lit(name), x), 256).alias("h"), x.alias("x"))))
    return F.transform(F.slice(keyed, 1, n), lambda s: s["x"])


def arguments(kind: Column, seed: Column, terms: Column, request: Column, answer: Column) -> Column:
    """A map of the kind's parameters; lists are joined by U+001F."""
    m = lambda **kw: F.create_map(*(c for k, v in kw.items() for c in (F.lit(k), (v if isinstance(v, Column) else F.lit(v)).cast("string"))))
    s = F.concat_ws(":", seed, kind)
    word = _pick(s, "keyword", F.when(F.size(terms) > 0, terms).otherwise(_strings([""])))
    relation = F.when(uniform(s, "relation") < 0.5, "less than").otherwise("at least")
    ranged = lambda k, name: m(**{"relation": relation, name: F.when(relation == "less than", _between(s, name, *RANGES[k]["less than"])).otherwise(_between(s, name, *RANGES[k]["at least"]))})
    n = lambda name: _between(s, name, *COUNTS[name])
    listed = lambda name: F.array_join(_some(s, name, terms, _between(s, name, 1, 3)), "\x1f")
    made = {
        "keywords:existence": m(keywords=listed("keywords")),
        "keywords:frequency": m(keyword=word, frequency=F.when(F.length(word) > 8, 1).otherwise(_between(s, "frequency", 1, 3)), relation="at least"),
        "keywords:forbidden_words": m(forbidden_words=listed("forbidden_words")),
        "length_constraints:number_sentences": ranged("length_constraints:number_sentences", "num_sentences"),
        "length_constraints:number_words": ranged("length_constraints:number_words", "num_words"),
        "length_constraints:number_paragraphs": m(num_paragraphs=n("num_paragraphs")),
        "length_constraints:nth_paragraph_first_word": m(num_paragraphs=n("num_paragraphs"), nth_paragraph=(F.floor(uniform(s, "nth") * n("num_paragraphs")) + 1).cast("int"), first_word=_pick(s, "first", _strings(FIRST_WORDS))),
        "detectable_content:number_placeholders": m(num_placeholders=n("num_placeholders")),
        "detectable_content:postscript": m(postscript_marker=_pick(s, "postscript", _strings(POSTSCRIPTS))),
        "detectable_format:number_bullet_lists": m(num_bullets=n("num_bullets")),
        "detectable_format:number_highlighted_sections": m(num_highlights=n("num_highlights")),
        "detectable_format:multiple_sections": m(section_spliter=SECTION, num_sections=n("num_sections")),
        "combination:repeat_prompt": m(prompt_to_repeat=request),
        "startend:end_checker": m(end_phrase=answer_end_phrase(answer, F.try_element_at(terms, F.lit(1)))),
    }
    return _lookup(kind, made, F.create_map().cast("map<string,string>"))


def constraint_text(kind: Column, args: Column) -> Column:
    """The kind's text with its parameters in place; lists joined by an enumeration comma."""
    out = _lookup(kind, {k: F.lit(t) for k, t in TEMPLATES.items()}, F.lit(""))
    shown = F.transform(F.map_entries(args), lambda e: F.struct(e["key"].alias("k"), F.replace(F.when(e["key"] == "relation", _lookup(e["value"], {k: F.lit(v) for k, v in RELATIONS.items()}, e["value"])).otherwise(e["value"]), F.lit("\x1f"), F.lit("、")).alias("v")))
    return F.aggregate(shown, out, lambda t, e: F.replace(t, F.concat(F.lit("{"), e["k"], F.lit("}")), e["v"]))
