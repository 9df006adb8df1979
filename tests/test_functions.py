"""Golden values of scalar functions and checkers."""

import pytest
from pyspark.sql import functions as F

from quillon.functions import checkers, scores, terms, text
from quillon.operators import constraints


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


L = F.lit


def test_keys(spark):
    a, b, c = one(spark, text.alnum_key(L("Ｈｅｌｌｏ， ①Ⅳ ﬁ!")), text.prompt_key(L(" Ａ　 B c ")), text.cased_prompt_key(L(" Ａ　 B ")))
    assert (a, b, c) == ("hello1ivfi", "a b c", "A B")


def test_strip_takes_what_the_pattern_takes(spark):
    chars = spark.createDataFrame([(chr(i),) for i in range(0x3100)], "c string")
    x = F.concat("c", F.lit("a"), "c", F.lit("b"), "c", "c")
    assert chars.filter(text.strip(x) != F.regexp_replace(x, r"(?U)^\s+|\s+$", "")).count() == 0
    assert one(spark, text.strip(L(" \u3000\n")), text.strip(L("")), text.strip(L(None).cast("string"))) == ["", "", None]


def test_stable_number(spark):
    import hashlib

    assert int(one(spark, text.stable_number(L("x")))[0]) == int.from_bytes(hashlib.blake2b(b"x", digest_size=8).digest(), "big")


def test_buckets(spark):
    got = one(spark, text.task_bucket(L("请用PYTHON写一篇")), text.task_bucket(L("写一篇散文")), text.task_bucket(L("hello")), *(text.length_bucket(L(n)) for n in (256, 257, 2048, 2049)))
    assert got == ["code", "creative_writing", "general_instruction", "le_256", "le_512", "le_2048", "gt_2048"]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("<think>r</think>a", ("r", "a")),
        ("r</think>a<|im_end|>", ("r", "a")),
        (" <think> r </think> a <|im_end|><|endoftext|> ", ("r", "a")),
        ("a</think>b</think>c", ("a", "b</think>c")),
        ("no tags", None),
        ("<think></think>a", None),
        ("<think>r</think>  ", None),
        (None, None),
    ],
)
def test_parse_reasoning(spark, raw, want):
    got = one(spark, text.parse_reasoning(L(raw).cast("string")))[0]
    assert (tuple(got) if got else None) == want


def test_final_content(spark):
    f = lambda x, on: one(spark, text.extract_final(L(x), on))[0]
    assert f("a</think>b<|im_end|>", True) == "b"
    assert f("<think>a", True) == "" and f("<think>a", False) == ""
    assert f("plain", True) == "" and f("plain", False) == "plain"
    ok = lambda x, on: one(spark, text.thinking_structure_ok(L(x), on))[0]
    assert ok("a</think>b", True) and not ok("a</think>b", False)
    assert ok("plain", False) and not ok("a</think><think>", True)


def test_clean_editor_output(spark):
    f = lambda x: one(spark, text.clean_editor_output(L(x)))[0]
    assert f("<think>core</think>rest<|im_end|>") == "core"
    assert f("core</think>rest") == "core"
    assert f("```text\ncore\n```") == "core"
    assert f("压缩后的推理：core") == "core"
    assert f("<<Title>>\ncore <<x>>") == "core <<x>>"


def test_copies_answer(spark):
    a = "x" * 31
    assert one(spark, text.copies_answer(L("q " + a), L(a)), text.copies_answer(L("q " + "x " * 32), L("x" * 32))) == [False, True]


def test_variants(spark):
    got = one(spark, text.response_variants(L("*a*\nb\nc")))[0]
    assert got == ["*a*\nb\nc", "b\nc", "*a*\nb", "b", "a\nb\nc", "b\nc", "a\nb", "b"]


def test_repetition(spark):
    u = "the same long unit"
    f = lambda x: one(spark, text.repetition_loop(L(x)))[0]
    assert f("\n".join([u] * 3)) and not f("\n".join([u] * 2))
    assert not f("\n".join([u, u, "short", u])) and f(f"{u}！" * 3)


def test_scores(spark):
    c = lambda r, a: scores.clip_higher(L(r), L(a))
    assert one(spark, c(1.0, 1.0), c(1.25, 1.0), c(0.5, -1.0)) == [-1.0, -1.25, 0.8]
    assert one(spark, *(scores.soft_overlong(L(n), 512, 64) for n in (200, 480, 512, 600))) == [0.0, -0.5, -1.0, -1.0]
    assert one(spark, *(scores.learnability(L(p)) for p in (0.0, 0.5, 1.0))) == [0.0, 1.0, 0.0]
    assert one(spark, *(scores.interpolated_budget(L(p)) for p in (0.0, 0.25, 0.3, 0.5, 1.0))) == [128, 192, 224, 256, 512]
    assert one(spark, scores.progress_signal(L(0.5), L(0.5), L(0)), scores.progress_signal(L(0.5), L(0.7), L(0)) > 0) == [0.0, True]
    with pytest.raises(Exception, match="pass rate"):
        one(spark, scores.learnability(L(1.1)))
    with pytest.raises(ValueError):
        scores.interpolated_budget(L(0.5), 0)


GOOD = {
    "keywords:existence": ({"keywords": "a\x1fb"}, "A and B", "a only"),
    "keywords:frequency": ({"keyword": "a", "frequency": "2", "relation": "at least"}, "a a", "a"),
    "keywords:forbidden_words": ({"forbidden_words": "cat"}, "category", "a cat"),
    "length_constraints:number_sentences": ({"num_sentences": "2", "relation": "at least"}, "One. Two!", "One."),
    "length_constraints:number_words": ({"num_words": "3", "relation": "less than"}, "two words", "你好吗"),
    "length_constraints:number_paragraphs": ({"num_paragraphs": "2"}, "a\n***\nb", "a *** *** b"),
    "length_constraints:nth_paragraph_first_word": ({"num_paragraphs": "2", "nth_paragraph": "2", "first_word": "首先"}, "x\n\n首先 y", "首先 x\n\ny"),
    "detectable_content:number_placeholders": ({"num_placeholders": "2"}, "[a] [b]", "[a]"),
    "detectable_content:postscript": ({"postscript_marker": "备注"}, "x\n 备注：y", "x 备注"),
    "detectable_format:number_bullet_lists": ({"num_bullets": "2"}, "* a\n- b", "* a"),
    "detectable_format:number_highlighted_sections": ({"num_highlights": "1"}, "**a**", "**a** **b**"),
    "detectable_format:multiple_sections": ({"section_spliter": "部分", "num_sections": "2"}, "部分1 x 部分 2", "部分1"),
    "detectable_format:json_format": ({}, '```json\n{"a": 1}\n```', "{a"),
    "detectable_format:title": ({}, "<<t>> x", "<< >>"),
    "combination:two_responses": ({}, "a******b", "a******a"),
    "combination:repeat_prompt": ({"prompt_to_repeat": "Say it"}, "say it: now", "now say it"),
    "startend:end_checker": ({"end_phrase": "The end."}, '"x. the end."', "the end. x"),
    "startend:quotation": ({}, ' "x" ', '"x'),
    "punctuation:no_comma": ({}, "a b", "a, b"),
}


def test_all_checkers(spark):
    assert set(GOOD) == set(checkers.CHECKERS) == set(constraints.KINDS)
    rows = [(k, {a: b for a, b in args.items()}, yes, no) for k, (args, yes, no) in GOOD.items()]
    df = spark.createDataFrame(rows, "k string, a map<string,string>, yes string, no string")
    c = F.col
    for r in df.select("k", checkers.passes(c("k"), c("a"), c("yes")).alias("y"), checkers.passes(c("k"), c("a"), c("no")).alias("n"), checkers.passes(c("k"), c("a"), L(" ")).alias("b"), checkers.raises(c("k"), c("a")).alias("r")).collect():
        assert (r.y, r.n, r.b, r.r) == (True, False, False, False), r.k


def test_loose_and_policies(spark):
    none = F.create_map().cast("map<string,string>")
    assert one(spark, checkers.passes(L("punctuation:no_comma"), none, L("Well,\nyes")), checkers.passes_loose(L("punctuation:no_comma"), none, L("Well,\nyes"))) == [False, True]
    kinds, args = F.array(L("punctuation:no_comma"), L("nonsense")), F.array(none, none)
    assert one(spark, checkers.strict_results(L("a"), kinds, args), checkers.strict_results(L("a"), kinds, args, "teacher")) == [[True, False], [False, False]]
    with pytest.raises(Exception, match="cannot be made"):
        one(spark, checkers.strict_results(L("a"), kinds, args, "propagate"))
    with pytest.raises(Exception, match="differ in number"):
        one(spark, checkers.strict_results(L("a"), kinds, F.array(none)))


def test_check_answer(spark):
    def check(text_, t, value=None, values=None, low=None, high=None):
        c = F.struct(L(t).alias("type"), L(value).cast("string").alias("value"), (F.array(*map(L, values)) if values else L(None).cast("array<string>")).alias("values"), L(low).cast("int").alias("min"), L(high).cast("int").alias("max"))
        return one(spark, checkers.check_answer(L(text_), c))[0]

    assert check(" x ", "exact", "x") and not check("y", "exact", "x")
    assert check("a b", "contains_all", values=["a", "b"]) and not check("a", "contains_all", values=["a", "b"])
    assert check("a", "excludes_all", values=["c"]) and check("a\n\nb", "line_count", 2)
    assert check("1. a\n2. b", "numbered_list", 2) and not check("1. a\n3. b", "numbered_list", 2)
    assert check("- a\n- b", "bullet_list", 2) and not check("- a\nb", "bullet_list", 2)
    assert check('{"b":2, "a":1}', "json_value", '{"a":1,"b":2}') and not check("{", "json_value", "{}")
    assert check("abc", "char_range", low=3, high=3) and not check("abcd", "char_range", low=3, high=3)
    assert check("abc", "regex_forbidden", r"\d") and not check("a1", "regex_forbidden", r"\d")
    with pytest.raises(Exception, match="unknown check"):
        check("a", "nonsense")


def test_terms():
    assert terms.cleaned("请写一篇关于人工智能的文章") == "人工智能"
    found = terms.candidates("请比较“深度学习”和Python语言，列出关于气候变化的文章。")
    assert "深度学习" in found and "Python" in found and "气候变化" in found
    assert terms.candidates("A. ") == [] and terms.candidates("如何回答这个问题") == []


def test_constraints_go_together(spark):
    rows = spark.range(300).select(F.col("id").cast("string").alias("s"), (F.col("id") % 3 + 1).cast("int").alias("n"), F.element_at(F.array(*map(L, constraints.BARRED)), (F.col("id") % len(constraints.BARRED) + 1).cast("int")).alias("bucket"))
    picked = rows.withColumn("kinds", constraints.choose(constraints.allowed(F.col("bucket"), L(3), L("short")), F.col("n"), F.col("s"))).cache()
    for r in picked.collect():
        assert len(r.kinds) == len(set(r.kinds)) <= r.n and r.kinds
        assert not set(r.kinds) & set(constraints.BARRED[r.bucket])
        assert all(b not in constraints.clashes(a) for a in r.kinds for b in r.kinds if a != b)
    assert picked.filter(F.size("kinds") == F.col("n")).count() > 280
    made = picked.select("s", F.explode("kinds").alias("k")).withColumn("a", constraints.arguments(F.col("k"), F.col("s"), F.array(L("t1"), L("t2"), L("t3")), L("ask"), L("答案是这样的一个长句子。")))
    bad = made.withColumn("t", constraints.constraint_text(F.col("k"), F.col("a"))).filter(F.col("t").contains("{") | (F.col("t") == "") | checkers.raises(F.col("k"), F.col("a")))
    assert bad.count() == 0
    assert one(spark, F.size(F.array_intersect(constraints.allowed(L("general_instruction"), L(0), L("x" * 121)), F.array(*map(L, [*constraints.KEYWORD_KINDS, "combination:repeat_prompt"])))))[0] == 0


def test_prompt_terms_are_ranked_before_they_are_cut(spark, monkeypatch):
    """The end phrase names the best term, keywords are among the best 12, by frequency over all questions."""
    import collections
    import json
    import math
    import random

    from quillon.functions.terms import candidates
    from quillon.plans.registry import q_terms

    rng = random.Random(3)
    pool = [rng.choice("bcdfg") * rng.randint(2, 5) + rng.choice("aeiou") + str(i) for i in range(40)] + ["红楼梦", "水浒传", "长江黄河"]
    asked = [", ".join(rng.sample(pool, 18)) for _ in range(150)]
    asked += asked[:5] + [""]
    rows = spark.createDataFrame([(i, str(i), "s", q, "", 1.0) for i, q in enumerate(asked)] + [(900, "900", "s", None, "", 1.0)], "ord long, id string, source string, question string, answer string, reward double")
    monkeypatch.setattr(q_terms, "sft", lambda *_: rows)
    made = q_terms.constraint_prompt_build(spark, "").collect()
    df, n = collections.Counter(t for q in asked for t in candidates(q)), q_terms._constrained(spark, "").count()
    best = [sorted(candidates(q), key=lambda t: (math.log((n + 1) / (df[t] + 1)) + 0.15 * len(t), len(t), t), reverse=True)[:12] for q in asked]
    ends = words = 0
    for r in made:
        for a in json.loads(r.args) if r.ord < 150 else ():
            if "end_phrase" in a:
                ends += 1
                assert a["end_phrase"] == f"关于{best[r.ord][0]}的说明到此结束"
            for t in [a["keyword"]] if "keyword" in a else (a.get("keywords") or a.get("forbidden_words") or "").split("\x1f"):
                words += t != ""
                assert t == "" or t in best[r.ord]
    assert ends > 5 and words > 20
