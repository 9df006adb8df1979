"""Checks of responses against constraints: 19 constraint kinds, 9 answer checks, strict and loose, as Column expressions.

The constraint kinds follow the published descriptions of instruction-following evaluation; where those leave a choice it is
stated at the kind. Arguments come as a map of strings; lists are joined by U+001F.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.text import response_variants, strip

SEP = "\x1f"


def _n(args: Column, name: str) -> Column:
    return F.expr("cast(null as int)") if args is None else F.try_element_at(args, F.lit(name)).try_cast("int")


def _s(args: Column, name: str) -> Column:
    return F.try_element_at(args, F.lit(name))


def _list(args: Column, name: str) -> Column:
    return F.split(_s(args, name), SEP)


def _related(count: Column, args: Column, name: str) -> Column:
    return F.when(_s(args, "relation") == "less than", count < _n(args, name)).otherwise(count >= _n(args, name))


def _pieces(v: Column, pattern: str) -> Column:
    return F.size(F.filter(F.split(v, pattern, -1), lambda p: strip(p) != ""))


def _occurrences(v: Column, k: Column) -> Column:
    v, k = F.lower(v), F.lower(k)
    return ((F.length(v) - F.length(F.replace(v, k, F.lit("")))) / F.length(k)).cast("int")


def _has(v: Column, word: Column) -> Column:
    """Latin words at their boundaries, others anywhere."""
    latin = word.rlike("^[A-Za-z]+$")
    inside = F.lower(v).contains(F.lower(word))
    return F.when(latin, F.regexp_like(F.lower(v), F.concat(F.lit(r"(?<![a-z])"), F.lower(word), F.lit(r"(?![a-z])")))).otherwise(inside)


def _nth_paragraph(v: Column, a: Column) -> Column:
    parts = F.filter(F.split(v, "\n\n", -1), lambda p: strip(p) != "")
    return (F.size(parts) == _n(a, "num_paragraphs")) & F.coalesce(F.lower(strip(F.try_element_at(parts, _n(a, "nth_paragraph")))).startswith(F.lower(_s(a, "first_word"))), F.lit(False))


def _paragraphs(v: Column, a: Column) -> Column:
    parts = F.split(v, r"\s?\*\*\*\s?", -1)
    inner = F.slice(parts, 2, F.greatest(F.lit(0), F.size(parts) - 2))
    return (F.size(F.filter(parts, lambda p: strip(p) != "")) == _n(a, "num_paragraphs")) & ~F.exists(inner, lambda p: strip(p) == "")


def _two(v: Column, a: Column) -> Column:
    parts = F.transform(F.split(v, r"\*{6}", -1), lambda p: strip(p))
    return (F.size(parts) == 2) & F.forall(parts, lambda p: p != "") & (F.element_at(parts, 1) != F.element_at(parts, -1))


def _json(v: Column) -> Column:
    bare = strip(F.regexp_replace(strip(v), r"^```(?:json|Json|JSON)?\s*|\s*```$", ""))
    return F.try_parse_json(bare).isNotNull()


#: id -> (arguments that must be there, predicate of response and arguments).
CHECKERS: dict[str, tuple[list[str], Callable[[Column, Column], Column]]] = {
    "keywords:existence": (["keywords"], lambda v, a: F.forall(_list(a, "keywords"), lambda k: F.lower(v).contains(F.lower(k)))),
    "keywords:frequency": (["keyword", "frequency", "relation"], lambda v, a: _related(_occurrences(v, _s(a, "keyword")), a, "frequency")),
    "keywords:forbidden_words": (["forbidden_words"], lambda v, a: ~F.exists(_list(a, "forbidden_words"), lambda k: _has(v, k))),
    "length_constraints:number_sentences": (["num_sentences", "relation"], lambda v, a: _related(_pieces(v, r"[。！？!?]+|\.(?:\s|$)"), a, "num_sentences")),
    # a CJK character is a word, and so is a run of other word characters
    "length_constraints:number_words": (["num_words", "relation"], lambda v, a: _related(F.regexp_count(v, F.lit(r"\p{IsHan}|[\p{L}\p{N}_&&[^\p{IsHan}]]+")), a, "num_words")),
    "length_constraints:number_paragraphs": (["num_paragraphs"], _paragraphs),
    "length_constraints:nth_paragraph_first_word": (["num_paragraphs", "nth_paragraph", "first_word"], _nth_paragraph),
    "detectable_content:number_placeholders": (["num_placeholders"], lambda v, a: F.regexp_count(v, F.lit(r"\[.*?\]")) >= _n(a, "num_placeholders")),
    "detectable_content:postscript": (["postscript_marker"], lambda v, a: F.exists(F.split(F.lower(v), "\n", -1), lambda x: F.regexp_replace(x, r"(?U)^\s+", "").startswith(F.lower(_s(a, "postscript_marker"))))),
    "detectable_format:number_bullet_lists": (["num_bullets"], lambda v, a: F.regexp_count(v, F.lit(r"(?m)^\s*\*[^*].*$")) + F.regexp_count(v, F.lit(r"(?m)^\s*-.*$")) == _n(a, "num_bullets")),
    # the template says exactly; the published definition says at least: argument cmp = "ge" asks for that
    "detectable_format:number_highlighted_sections": (["num_highlights"], lambda v, a: F.when(_s(a, "cmp") == "ge", F.regexp_count(v, F.lit(r"\*\*[^\n*]*[^\s*][^\n*]*\*\*")) >= _n(a, "num_highlights")).otherwise(F.regexp_count(v, F.lit(r"\*\*[^\n*]*[^\s*][^\n*]*\*\*")) == _n(a, "num_highlights"))),
    "detectable_format:multiple_sections": (["section_spliter", "num_sections"], lambda v, a: F.regexp_count(v, F.concat(F.lit(r"\Q"), _s(a, "section_spliter"), F.lit(r"\E\s?\d+"))) >= _n(a, "num_sections")),
    "detectable_format:json_format": ([], lambda v, a: _json(v)),
    "detectable_format:title": ([], lambda v, a: v.rlike(r"<<[^\n>]*[^\s>][^\n>]*>>")),
    "combination:two_responses": ([], _two),
    "combination:repeat_prompt": (["prompt_to_repeat"], lambda v, a: F.lower(strip(v)).startswith(F.lower(strip(_s(a, "prompt_to_repeat"))))),
    "startend:end_checker": (["end_phrase"], lambda v, a: F.lower(F.regexp_replace(strip(v), r'^"+|"+$', "")).endswith(F.lower(strip(_s(a, "end_phrase"))))),
    "startend:quotation": ([], lambda v, a: (F.length(strip(v)) > 1) & strip(v).startswith('"') & strip(v).endswith('"')),
    "punctuation:no_comma": ([], lambda v, a: ~v.contains(",")),
}


def raises(kind: Column, args: Column) -> Column:
    """The check cannot be made: an unknown kind, or an argument is missing."""
    out = F.lit(True)
    for name, (needed, _) in CHECKERS.items():
        gone = F.lit(False)
        for x in needed:
            gone = gone | _s(args, x).isNull()
        out = F.when(kind == name, gone).otherwise(out)
    return out


def passes(kind: Column, args: Column, response: Column) -> Column:
    """X11 strict, one constraint. False where it cannot be made; see raises()."""
    out = F.lit(False)
    for name, (_, check) in CHECKERS.items():
        out = F.when(kind == name, check(response, args)).otherwise(out)
    return F.coalesce(out, F.lit(False)) & (strip(response) != "")


def passes_loose(kind: Column, args: Column, response: Column) -> Column:
    """X11 loose: any variant that is not blank passes."""
    return F.exists(F.array_distinct(response_variants(response)), lambda v: (strip(v) != "") & passes(kind, args, v))


def strict_results(response: Column, kinds: Column, args: Column, policy: str = "reward") -> Column:
    """Arrays of kinds and arguments to an array of results, under one of three policies for checks that cannot be made.

    reward (X12): that one is false. teacher (X13): all are false. propagate: the query fails. A blank response fails all; arrays of
    unequal length fail the query.
    """
    sure = F.when(F.assert_true(F.size(kinds) == F.size(args), "kinds and arguments differ in number").isNull(), kinds)
    one = F.zip_with(sure, args, lambda k, a: ~raises(k, a) & passes(k, a, response))
    broken = F.exists(F.zip_with(kinds, args, lambda k, a: raises(k, a)), lambda x: x)
    if policy == "teacher":
        return F.when(broken, F.transform(one, lambda x: F.lit(False))).otherwise(one)
    if policy == "propagate":
        return F.when(F.assert_true(~broken, "a check cannot be made").isNull(), one)
    return one


def check_answer(text: Column, check: Column) -> Column:
    """Check is a struct of type, value, values, min, max. An unknown type fails the query."""
    t, lines = strip(text), F.split(strip(text), r"\R", -1)
    full = F.filter(lines, lambda x: strip(x) != "")
    value, values = check["value"], F.coalesce(check["values"], F.array().cast("array<string>"))
    n = check["value"].try_cast("int")
    numbered = F.forall(F.transform(full, lambda x, i: F.regexp_like(x, F.concat(F.lit("^"), (i + 1).cast("string"), F.lit(r"\.\s")))), lambda x: x)
    kinds = {
        "exact": t == value,
        "contains_all": F.forall(values, lambda x: t.contains(x)),
        "excludes_all": ~F.exists(values, lambda x: t.contains(x)),
        "line_count": F.size(full) == n,
        "numbered_list": (F.size(full) == n) & numbered,
        "bullet_list": (F.size(full) == n) & F.forall(full, lambda x: x.startswith("- ")),
        "json_value": F.coalesce(F.to_json(F.try_parse_json(t)) == F.to_json(F.try_parse_json(value)), F.lit(False)),
        "char_range": F.length(t).between(check["min"], check["max"]),
        "regex_forbidden": ~F.regexp_like(t, value),
    }
    out = F.when(F.assert_true(check["type"].isin(*kinds), "unknown check").isNull(), F.lit(False))
    for k, v in kinds.items():
        out = F.when(check["type"] == k, v).otherwise(out)
    return F.coalesce(out, F.lit(False))
