"""Reasoning, response variants, constraint checks and rewards. Responses are whole documents in wrappings chosen by doc_id."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import checkers, text
from quillon.operators import rewards
from quillon.plans.registry import query, table

_THINK = "CASE doc_id % 6 WHEN 0 THEN '<think>why' || chr(10) || '</think>' || text WHEN 1 THEN 'so it is</think>' || text || '<|im_end|>' WHEN 2 THEN '<think>' || text WHEN 3 THEN '<think>a</think>b</think> ' || text || '<|im_end|><|endoftext|>' WHEN 4 THEN '<think></think>' || text ELSE text END"
_RAW = f"raw AS (SELECT doc_id, {_THINK} AS r FROM documents)"
_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


def _raw(spark, sf_dir):
    t, m = F.col("text"), F.col("doc_id") % 6
    r = F.when(m == 0, F.concat(F.lit("<think>why\n</think>"), t)).when(m == 1, F.concat(F.lit("so it is</think>"), t, F.lit("<|im_end|>"))).when(m == 2, F.concat(F.lit("<think>"), t))
    r = r.when(m == 3, F.concat(F.lit("<think>a</think>b</think> "), t, F.lit("<|im_end|><|endoftext|>"))).when(m == 4, F.concat(F.lit("<think></think>"), t)).otherwise(t)
    return table(spark, sf_dir, "documents").select("doc_id", r.alias("r"))


@query(f"""WITH {_RAW}, s AS (SELECT doc_id, regexp_replace({_STRIP.format('r')}, '(\\s*(<\\|im_end\\|>|<\\|endoftext\\|>))+\\s*$', '') AS s FROM raw),
p AS (SELECT doc_id, strpos(s, '</think>') AS pos, {_STRIP.format("regexp_replace(" + _STRIP.format("substr(s, 1, greatest(strpos(s, '</think>') - 1, 0))") + ", '^<think>', '')")} AS l, {_STRIP.format("substr(s, strpos(s, '</think>') + 8)")} AS a FROM s)
SELECT doc_id, CASE WHEN pos > 0 AND l <> '' AND a <> '' THEN l END AS reasoning, CASE WHEN pos > 0 AND l <> '' AND a <> '' THEN sha256(a) END AS answer FROM p""")
def parse_reasoning(spark, sf_dir):
    rows = _raw(spark, sf_dir).withColumn("p", text.parse_reasoning(F.col("r")))
    return rows.select("doc_id", F.col("p")["reasoning"].alias("reasoning"), F.sha2(F.col("p")["answer"], 256).alias("answer"))


@query(f"""WITH {_RAW}, s AS (SELECT doc_id, replace(r, '<|im_end|>', '') AS s FROM raw)
SELECT doc_id, sha256({_STRIP.format("replace(CASE WHEN contains(s, '</think>') THEN regexp_replace(s, '(?s)^.*</think>', '') WHEN contains(s, '<think>') THEN '' ELSE s END, '<think>', '')")}) AS free,
  sha256(CASE WHEN contains(s, '</think>') THEN {_STRIP.format("regexp_replace(s, '(?s)^.*</think>', '')")} ELSE '' END) AS thinking FROM s""")
def extract_final(spark, sf_dir):
    return _raw(spark, sf_dir).select("doc_id", F.sha2(text.extract_final(F.col("r"), False), 256).alias("free"), F.sha2(text.extract_final(F.col("r"), True), 256).alias("thinking"))


@query(f"""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS x FROM documents),
v AS (SELECT doc_id, [text, {_STRIP.format("array_to_string(x[2:], chr(10))")}, {_STRIP.format("array_to_string(x[:-2], chr(10))")}, {_STRIP.format("array_to_string(x[2:-2], chr(10))")}] AS v FROM l)
SELECT doc_id, i, sha256(CASE WHEN i <= 4 THEN v[i] ELSE replace(v[i - 4], '*', '') END) AS variant FROM (SELECT *, CAST(unnest(range(1, 9)) AS INTEGER) AS i FROM v)""")
def response_variants(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.response_variants(F.col("text"))).alias("i", "v"))
    return rows.select("doc_id", (F.col("i") + 1).alias("i"), F.sha2("v", 256).alias("variant"))


@query("""WITH t AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents), l AS (SELECT doc_id, t, list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '\\s', '', 'g') <> '') AS l FROM t)
SELECT doc_id, 'contains_all' AS type, contains(t, 'the') AND contains(t, 'on') AS passed FROM l UNION ALL SELECT doc_id, 'excludes_all', NOT (contains(t, 'moron') OR contains(t, '###')) FROM l
UNION ALL SELECT doc_id, 'line_count', len(l) = 3 FROM l UNION ALL SELECT doc_id, 'char_range', length(t) BETWEEN 100 AND 1000 FROM l UNION ALL SELECT doc_id, 'regex_forbidden', NOT regexp_matches(t, '[0-9]{4}') FROM l
UNION ALL SELECT doc_id, 'exact', t = 'x' FROM l UNION ALL SELECT doc_id, 'json_value', false FROM l UNION ALL SELECT doc_id, 'bullet_list', false FROM l UNION ALL SELECT doc_id, 'numbered_list', false FROM l""")
def check_answer_kinds(spark, sf_dir):
    none = F.lit(None)
    check = lambda t, value=none, values=None, low=none, high=none: F.struct(F.lit(t).alias("type"), value.cast("string").alias("value"), (F.array(*map(F.lit, values)) if values else none.cast("array<string>")).alias("values"), low.cast("int").alias("min"), high.cast("int").alias("max"))
    all_ = F.array(
        check("contains_all", values=["the", "on"]), check("excludes_all", values=["moron", "###"]), check("line_count", F.lit(3)), check("char_range", low=F.lit(100), high=F.lit(1000)), check("regex_forbidden", F.lit("[0-9]{4}")),
        check("exact", F.lit("x")), check("json_value", F.lit('{"a": 1}')), check("bullet_list", F.lit(2)), check("numbered_list", F.lit(2)),
    )
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.explode(all_).alias("c"))
    return rows.select("doc_id", F.col("c.type").alias("type"), checkers.check_answer(F.col("text"), F.col("c")).alias("passed"))


# six constraints whose checks both engines spell alike, over documents wrapped so that each passes for some
_WRAP = "CASE doc_id % 5 WHEN 0 THEN '\"' || text || '\"' WHEN 1 THEN '<<' || source || '>>' || chr(10) || text WHEN 2 THEN '* one' || chr(10) || '* two' || chr(10) || '- three' || chr(10) || text WHEN 3 THEN text || chr(10) || 'P.S. ' || source ELSE replace(text, ',', '') END"
_CHECKED = f"""resp AS (SELECT doc_id, {_WRAP} AS r FROM documents), s AS (SELECT doc_id, r, {_STRIP.format('r')} AS s, string_split(r, chr(10)) AS x FROM resp),
k AS (SELECT doc_id, [length(s) > 1 AND starts_with(s, '"') AND ends_with(s, '"'), regexp_matches(r, '<<[^\\n>]*[^\\s>][^\\n>]*>>'), NOT contains(r, ','),
  contains(lower(r), 'the') AND contains(lower(r), 'on'), len(list_filter(x, lambda l: starts_with(lower(ltrim(l)), 'p.s.'))) > 0,
  len(list_filter(x, lambda l: regexp_matches(l, '^\\s*\\*[^*]') OR regexp_matches(l, '^\\s*-'))) = 3] AS strict FROM s)"""
_KINDS = ["startend:quotation", "detectable_format:title", "punctuation:no_comma", "keywords:existence", "detectable_content:postscript", "detectable_format:number_bullet_lists"]


def _checked(spark, sf_dir):
    t, m = F.col("text"), F.col("doc_id") % 5
    r = F.when(m == 0, F.concat(F.lit('"'), t, F.lit('"'))).when(m == 1, F.concat(F.lit("<<"), "source", F.lit(">>\n"), t)).when(m == 2, F.concat(F.lit("* one\n* two\n- three\n"), t)).when(m == 3, F.concat(t, F.lit("\nP.S. "), "source")).otherwise(F.replace(t, F.lit(","), F.lit("")))
    none = F.create_map().cast("map<string,string>")
    args = F.array(none, none, none, F.create_map(F.lit("keywords"), F.lit("the\x1fon")), F.create_map(F.lit("postscript_marker"), F.lit("P.S.")), F.create_map(F.lit("num_bullets"), F.lit("3")))
    return table(spark, sf_dir, "documents").select("doc_id", r.alias("r"), F.array(*map(F.lit, _KINDS)).alias("kinds"), args.alias("args"))


_LABEL = "['" + "','".join(_KINDS) + "']"


@query(f"WITH {_CHECKED} SELECT doc_id, kind, strict[i] AS passed FROM (SELECT doc_id, strict, unnest(range(1, 7)) AS i FROM k), (SELECT unnest({_LABEL}) AS kind, unnest(range(1, 7)) AS j) WHERE i = j")
def constraint_strict(spark, sf_dir):
    rows = _checked(spark, sf_dir)
    strict = checkers.strict_results(F.col("r"), F.col("kinds"), F.col("args"))
    return rows.select("doc_id", F.explode(F.arrays_zip(F.col("kinds").alias("kind"), strict.alias("passed"))).alias("x")).select("doc_id", "x.kind", "x.passed")


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x, text FROM documents), v AS (SELECT doc_id, [text, array_to_string(x[2:], chr(10)), array_to_string(x[:-2], chr(10)), array_to_string(x[2:-2], chr(10))] AS v FROM l)
SELECT doc_id, len(list_filter(v, lambda t: regexp_replace(t, '[\\s*]', '', 'g') <> '' AND NOT contains(t, ','))) > 0 OR len(list_filter(v, lambda t: regexp_replace(t, '\\s', '', 'g') <> '' AND NOT contains(t, ','))) > 0 AS loose FROM v""")
def constraint_loose(spark, sf_dir):
    passed = checkers.passes_loose(F.lit("punctuation:no_comma"), F.create_map().cast("map<string,string>"), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", passed.alias("loose"))


_MET = "len(list_filter(strict, lambda x: x))"


@query(f"WITH {_CHECKED} SELECT doc_id, round({_MET} / 6.0, 6) AS instruction, CAST(CASE WHEN {_MET} = 6 THEN 1 ELSE 0 END AS DOUBLE) AS prompt, round(0.7 * {_MET} / 6.0 + 0.3 * CASE WHEN {_MET} = 6 THEN 1 ELSE 0 END, 6) AS core FROM k")
def reward_score(spark, sf_dir):
    rows = _checked(spark, sf_dir)
    rows = rows.withColumn("s", checkers.strict_results(F.col("r"), F.col("kinds"), F.col("args")))
    one, all_, core = rewards.reward_parts(F.col("s"))
    return rows.select("doc_id", F.round(one, 6).alias("instruction"), all_.alias("prompt"), F.round(core, 6).alias("core"))


@query(f"""WITH {_RAW}, s AS (SELECT doc_id, r, regexp_replace({_STRIP.format('r')}, '(\\s*(<\\|im_end\\|>|<\\|endoftext\\|>))+\\s*$', '') AS s FROM raw),
p AS (SELECT doc_id, r, strpos(s, '</think>') > 0 AND {_STRIP.format("regexp_replace(" + _STRIP.format("substr(s, 1, greatest(strpos(s, '</think>') - 1, 0))") + ", '^<think>', '')")} <> '' AND {_STRIP.format("substr(s, strpos(s, '</think>') + 8)")} <> '' AS parsed,
  {_STRIP.format("substr(s, strpos(s, '</think>') + 8)")} AS a FROM s),
c AS (SELECT doc_id, parsed, NOT parsed AND NOT contains(r, 'think>') AND {_STRIP.format('r')} <> '' AS bare, CASE WHEN parsed THEN a ELSE {_STRIP.format('r')} END AS a, length(r) AS n FROM p)
SELECT doc_id, NOT parsed AS reasoning_missing, bare AS answer_only_fallback, round(CASE WHEN (parsed OR bare) AND NOT contains(a, ',') THEN 1.0 ELSE 0.0 END + CASE WHEN n <= 3072 THEN 0.0 ELSE -least((n - 3072) / 1024.0, 1.0) END, 6) AS reward FROM c""")
def reward_batch_records(spark, sf_dir):
    rows = _raw(spark, sf_dir).withColumn("c", rewards.completion_parts(F.col("r")))
    results = F.array(F.coalesce(checkers.passes(F.lit("punctuation:no_comma"), F.create_map().cast("map<string,string>"), F.col("c.answer")), F.lit(False)))
    core = rewards.reward_parts(results)[2]
    return rows.select("doc_id", F.col("c.reasoning_missing").alias("reasoning_missing"), F.col("c.answer_only_fallback").alias("answer_only_fallback"), F.round(rewards.reward(core, F.length("r"), 4096, 1024, True), 6).alias("reward"))


@query(f"WITH {_CHECKED} SELECT split_part(kind, ':', 1) AS category, round(avg(CAST(strict[i] AS INTEGER)), 6) AS rate, count(*) AS n FROM (SELECT strict, unnest(range(1, 7)) AS i FROM k), (SELECT unnest({_LABEL}) AS kind, unnest(range(1, 7)) AS j) WHERE i = j GROUP BY 1")
def category_pass_rates(spark, sf_dir):
    rows = _checked(spark, sf_dir).withColumn("s", checkers.strict_results(F.col("r"), F.col("kinds"), F.col("args")))
    return rewards.category_rates(rows, "kinds", "s").withColumn("rate", F.round("rate", 6))


@query(f"WITH {_CHECKED} SELECT doc_id % 3 + 1 AS turn, count(*) AS n_prompts, CAST(sum(len(strict)) AS BIGINT) AS n_instructions, round(avg(CASE WHEN {_MET} = 6 THEN 1 ELSE 0 END), 6) AS strict_prompt, round(sum({_MET}) / sum(len(strict)), 6) AS strict_instruction FROM k GROUP BY 1")
def per_turn_metrics(spark, sf_dir):
    from quillon.operators.metrics import turn_metrics

    rows = _checked(spark, sf_dir).withColumn("strict", checkers.strict_results(F.col("r"), F.col("kinds"), F.col("args")))
    out = turn_metrics(rows.select((F.col("doc_id") % 3 + 1).alias("turn"), "strict", F.col("strict").alias("loose")))
    return out.select("turn", "n_prompts", "n_instructions", F.round("strict_prompt", 6).alias("strict_prompt"), F.round("strict_instruction", 6).alias("strict_instruction"))
