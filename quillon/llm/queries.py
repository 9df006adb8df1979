"""The thin queries over the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import audit, chat_windows, decontam, imatch, langid, mixing, ngram_join, substring_dedup, suffix_dedup, surrogates, toxicity, wavelet, whitening
from quillon.llm.shared import table


def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_windows.report(own.unionByName(probe))


def op2_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.report(table(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_copies(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is the session's; only where it is unset (as in tests and benchmarks of invented texts) a public one."""
    key = spark.conf.get("spark.quillon.surrogates.key", "of invented texts")
    return surrogates.report(table(spark, sf_dir, "documents"), key.encode())


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.drop_repeats(table(spark, sf_dir, "documents"), with_text=False)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.read_shards(wavelet.write_shards(table(spark, sf_dir, "documents"), tokenizer_path()))


def op10_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.drop_repeats(table(spark, sf_dir, "documents"), with_bytes=False)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_chat_windows, op2_imatch, op3_ngram_join, op4_language_id, op5_toxicity, op6_surrogates, op7_decontaminate, op8_substring_dedup, op9_wavelet_tokens, op10_pivotal_mix, op11_filter_audit, op12_suffix_dedup, op13_whitening)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_ESCAPED = r"regexp_replace({}, '([<\[\\])', '\1\\', 'g')"
_PROBE = "'</s>[INST] ok [/INST]'"

ORACLE_SQL = {
    "op1_chat_windows": rf"""
WITH turn AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', {_PROBE} UNION ALL SELECT -1, 1, 'assistant', {_PROBE}
), a AS (
  SELECT *, length('[INST]' || {_ESCAPED.format("role")} || '[/INST]' || {_ESCAPED.format("t")} || '</s>') AS chars,
    len(regexp_extract_all(t, '[\pL\pM\p{{Nd}}\p{{Pc}}]+|[^\pL\pM\p{{Nd}}\p{{Pc}}\s]')) + 8 AS tokens FROM turn
), b AS (
  SELECT *, row_number() OVER o AS place, sum(tokens) OVER (o ROWS UNBOUNDED PRECEDING) AS upto,
    first_value(CASE WHEN role = 'system' THEN chars END IGNORE NULLS) OVER (o ROWS UNBOUNDED PRECEDING) AS sys_chars,
    first_value(CASE WHEN role = 'system' THEN tokens END IGNORE NULLS) OVER (o ROWS UNBOUNDED PRECEDING) AS sys_tokens
  FROM a WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, t)
), c AS (
  SELECT *, greatest(1, (1024 - 256 - coalesce(sys_tokens, 0)) // 2) AS room FROM b
), d AS (
  SELECT *, (upto - 1) // room AS stretch, tokens > room AS long FROM c
), e AS (
  SELECT *, place = 1 OR stretch <> lag(stretch) OVER o OR long OR lag(long) OVER o OR room <> lag(room) OVER o AS new, lag(sys_chars) OVER o AS known,
    lag(role) OVER o AS r1, lag(chars) OVER o AS c1, lag(tokens) OVER o AS t1, lag(role, 2) OVER o AS r2, lag(chars, 2) OVER o AS c2, lag(tokens, 2) OVER o AS t2
  FROM d WINDOW o AS (PARTITION BY conv_id ORDER BY place)
), f AS (
  SELECT *, chars + CASE WHEN NOT new THEN 0 ELSE 3 + coalesce(known, 0) + CASE WHEN r1 IS NULL OR r1 = 'system' OR t1 > 256 THEN 0
    ELSE c1 + CASE WHEN r2 IS NULL OR r2 = 'system' OR t1 + t2 > 256 THEN 0 ELSE c2 END END END AS out_chars FROM e
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(length(coalesce(string_agg(t, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(out_chars) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
""",
    "op3_ngram_join": f"""
WITH RECURSIVE doc AS (
  SELECT doc_id, text, {_WORDS.format("lower(text)")} AS w FROM documents WHERE text <> ''
), gram AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM doc WHERE len(w) > 0)
  UNION ALL SELECT doc_id, chr(1) || text FROM doc WHERE len(w) = 0
), own AS (
  SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id
), link AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM gram x JOIN gram y ON x.g = y.g AND x.doc_id <> y.doc_id JOIN own p ON p.doc_id = x.doc_id JOIN own q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING count(*) / (p.n + q.n - count(*)) >= 0.8
), reach(a, b) AS (
  SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b
), class AS (
  SELECT a AS doc_id, min(b) AS least_of FROM reach GROUP BY a
), many AS (
  SELECT a AS doc_id, count(*) AS n FROM link GROUP BY a
), copy AS (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY CASE WHEN len(w) > 0 THEN array_to_string(w, ' ') ELSE chr(1) || text END) AS copy_id FROM doc
)
SELECT d.doc_id, least(d.doc_id, coalesce(class.least_of, d.doc_id)) AS class_id, coalesce(copy.copy_id, d.doc_id) AS copy_id, coalesce(many.n, 0) AS n_links
FROM documents d LEFT JOIN class ON class.doc_id = d.doc_id LEFT JOIN many ON many.doc_id = d.doc_id LEFT JOIN copy ON copy.doc_id = d.doc_id
""",
    "op7_decontaminate": f"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS id, {_WORDS.format(_LOWER.format("text"))} AS w FROM benchmark
), item_window AS (
  SELECT DISTINCT id, least(10, len(w)) AS m, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)
), doc AS (
  SELECT doc_id, {_WORDS.format(_LOWER.format("text"))} AS w FROM documents
), doc_window AS (
  SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM doc, (SELECT DISTINCT m FROM item_window) WHERE len(w) >= m)
), hit AS (
  SELECT DISTINCT d.doc_id, d.m, d.i, x.id FROM doc_window d JOIN item_window x ON d.m = x.m AND d.g = x.g
), word AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id
), who AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, id FROM hit WHERE id IS NOT NULL) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(word.n_hit, 0) AS n_hit, coalesce(who.n_items, 0) AS n_items,
  sha256(coalesce(who.ids, '')) AS items_sha256, coalesce(word.n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN word ON word.doc_id = d.doc_id LEFT JOIN who ON who.doc_id = d.doc_id
""",
    "op8_substring_dedup": r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), place AS (
  SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM doc WHERE len(w) >= 13)
), least_of AS (
  SELECT g, min(doc_id) AS first_id FROM place GROUP BY g
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM place JOIN least_of USING (g) WHERE first_id < doc_id
), word AS (
  SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM doc WHERE len(w) > 0
), kept AS (
  SELECT word.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS s FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY word.doc_id
)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256
FROM doc LEFT JOIN kept ON kept.doc_id = doc.doc_id
""",
    "op11_filter_audit": r"""
WITH doc AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least_id FROM documents
), said AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), fail AS (
  SELECT part, good, toxic, (len(w) < 200)::INT + 2 * (100 * list_unique(w) < 50 * len(w))::INT + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc.doc_id > least_id, least_id IS NOT NULL)::INT AS mask
  FROM doc LEFT JOIN said ON said.doc_id = doc.doc_id
), m AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM fail GROUP BY part, mask
), letter(c, bit) AS (
  VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), o AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS s FROM letter a, letter b, letter c, letter d, letter e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), step AS (
  SELECT s, k, own.c, own.bit AS own, coalesce((SELECT sum(bit)::INT FROM letter WHERE strpos(left(s, k - 1), letter.c) > 0), 0) AS before
  FROM (SELECT s, unnest(range(1, 6)) AS k FROM o) JOIN letter own ON own.c = s[k]
), r AS (
  SELECT part, s, k, c, sum(n) FILTER (mask & (before | own) = 0) AS kept, sum(n) FILTER (mask & before = 0 AND mask & own > 0) AS removed,
    sum(n) FILTER (mask & before > 0 AND mask & own > 0) AS redundant, sum(n) FILTER (mask = own) AS unique_fails,
    sum(good) FILTER (mask & before = 0 AND mask & own > 0) AS good_lost, sum(toxic) FILTER (mask & before = 0 AND mask & own > 0) AS toxic_lost
  FROM m, step GROUP BY part, s, k, c
)
SELECT part, s AS filter_order, CAST(k AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
  CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, c), 0) AS BIGINT) AS shapley
FROM r
""",
    "op12_suffix_dedup": """
WITH doc AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents
), place AS (
  SELECT doc_id, i, b[i : i + 49] AS g FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 48)) AS i FROM doc WHERE octet_length(b) >= 50)
), least_of AS (
  SELECT g, min(doc_id) AS first_id FROM place GROUP BY g HAVING min(doc_id) < max(doc_id)
), hit AS (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before_i FROM place JOIN least_of USING (g) WHERE first_id < doc_id
), run AS (
  SELECT doc_id, i, sum(CASE WHEN i <= before_i + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM hit
), span AS (
  SELECT doc_id, k, min(i) AS a, max(i) + 50 AS z FROM run GROUP BY doc_id, k
), gap AS (
  SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 1) AS free_from FROM span
), kept AS (
  SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS rest, string_agg(hex(b[free_from : a - 1]), '' ORDER BY a) AS s FROM gap JOIN doc USING (doc_id) GROUP BY doc_id
)
SELECT doc.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(CASE WHEN kept.doc_id IS NULL THEN b ELSE unhex(s || hex(b[rest : octet_length(b)])) END) AS kept_sha256
FROM doc LEFT JOIN kept ON kept.doc_id = doc.doc_id
""",
}
