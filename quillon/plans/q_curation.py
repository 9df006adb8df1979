"""Keys, quality, duplicates, buckets, decontamination and set checks over the documents as question-answer rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions.text import alnum_key, cased_prompt_key, order_hash, prompt_key
from quillon.operators import membership, metrics, quality
from quillon.plans.fixtures import ANNOTATED_SQL, SFT_SQL, annotated, sft
from quillon.plans.registry import query, table


@query(f"WITH {ANNOTATED_SQL} SELECT ord, sha256(k) AS key_sha256, n, len(hard) AS n_hard FROM usable")
def norm_key_dedup_first(spark, sf_dir):
    rows = annotated(spark, sf_dir).filter(F.size("hard") == 0).select("ord", "k", (F.length("question") + F.length("answer")).cast("long").alias("n"), F.size("hard").cast("long").alias("n_hard"))
    return quality.first_wins(rows, "k", "ord").select("ord", F.sha2("k", 256).alias("key_sha256"), "n", "n_hard")


@query(f"WITH {SFT_SQL}, keyed AS (SELECT *, regexp_replace(lower(question || answer), '[^\\pL\\pN]', '', 'g') AS k FROM sft) SELECT sha256(k) AS key_sha256, max(ord) AS ord, min(ord) AS first_place, arg_max(reward, ord) AS reward FROM keyed WHERE reward IS NOT NULL GROUP BY k")
def dedup_last_wins(spark, sf_dir):
    rows = sft(spark, sf_dir).filter("reward is not null").select("ord", "reward", F.sha2(alnum_key(F.concat("question", "answer"), True), 256).alias("key_sha256"))
    return quality.last_wins(rows, "key_sha256", "ord").select("key_sha256", "ord", "first_place", "reward")


@query("SELECT count(*) AS n, count(DISTINCT text) AS n_distinct, count(text) - count(DISTINCT text) AS n_again FROM documents")
def duplicate_report(spark, sf_dir):
    return metrics.uniqueness(table(spark, sf_dir, "documents"), "text")


@query(f"WITH {ANNOTATED_SQL} SELECT reason, count(*) AS n FROM (SELECT unnest(hard) AS reason FROM annotated UNION ALL SELECT 'duplicate_question' FROM (SELECT k, row_number() OVER (PARTITION BY k ORDER BY ord) AS nth FROM annotated WHERE len(hard) = 0) WHERE nth > 1 OR k = '') GROUP BY reason")
def hard_rule_failures(spark, sf_dir):
    return quality.failure_counts(annotated(spark, sf_dir))


@query(f"WITH {ANNOTATED_SQL} SELECT flag, count(*) AS n, round(avg(score), 6) AS mean_score FROM (SELECT unnest(flags) AS flag, score FROM annotated) GROUP BY flag")
def soft_flags(spark, sf_dir):
    rows = annotated(spark, sf_dir).select(F.explode("flags").alias("flag"), "score")
    return rows.groupBy("flag").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


@query(f"WITH {ANNOTATED_SQL} SELECT ord, score, array_to_string(hard, ',') AS hard, array_to_string(flags, ',') AS flags FROM annotated")
def quality_score(spark, sf_dir):
    return annotated(spark, sf_dir).select("ord", "score", F.array_join("hard", ",").alias("hard"), F.array_join("flags", ",").alias("flags"))


@query(f"WITH {ANNOTATED_SQL} SELECT bucket, count(*) AS n FROM annotated GROUP BY bucket")
def task_bucket_counts(spark, sf_dir):
    return metrics.distribution(annotated(spark, sf_dir), "bucket")


@query(f"WITH {ANNOTATED_SQL} SELECT length_bucket, count(*) AS n FROM annotated GROUP BY length_bucket")
def length_bucket_counts(spark, sf_dir):
    return metrics.distribution(annotated(spark, sf_dir), "length_bucket")


@query(f"WITH {ANNOTATED_SQL} SELECT bucket, count(*) AS n, round(avg(score), 6) AS score_mean, median(score) AS score_median, round(avg(reward), 6) AS reward_mean, median(reward) AS reward_median FROM usable GROUP BY bucket")
def score_summary_median(spark, sf_dir):
    rows = quality.first_wins(annotated(spark, sf_dir).filter(F.size("hard") == 0).select("ord", "k", "bucket", "score", "reward"), "k", "ord")
    out = metrics.score_summary(rows, "score", "reward", by=["bucket"])
    return out.withColumn("score_mean", F.round("score_mean", 6)).withColumn("reward_mean", F.round("reward_mean", 6))


@query(f"WITH {ANNOTATED_SQL} SELECT bucket, length_bucket, count(*) AS n FROM usable GROUP BY bucket, length_bucket")
def strata_counts(spark, sf_dir):
    rows = quality.first_wins(annotated(spark, sf_dir).filter(F.size("hard") == 0).select("ord", "k", "bucket", "length_bucket"), "k", "ord")
    return metrics.distribution(rows, "bucket", "length_bucket")


_FIELDS = "SELECT 'bucket' AS field, bucket AS value FROM annotated UNION ALL SELECT 'length_bucket', length_bucket FROM annotated UNION ALL SELECT 'source', source FROM annotated"


@query(f"WITH {ANNOTATED_SQL} SELECT field, value, count(*) AS n FROM ({_FIELDS}) GROUP BY field, value")
def manifest_counts(spark, sf_dir):
    return metrics.manifest_counts(annotated(spark, sf_dir), ["bucket", "length_bucket", "source"])


# the boundary: keys of benchmark texts and of every tenth document, so that the anti-join has something to remove
_KEY = "regexp_replace(regexp_replace(lower({}), '\\s+', ' ', 'g'), '^ | $', '', 'g')"
_BOUNDARY_SQL = f"boundary AS (SELECT DISTINCT {_KEY.format('text')} AS k FROM benchmark UNION SELECT DISTINCT {_KEY.format('text')} FROM documents WHERE doc_id % 10 = 0), keyed AS (SELECT doc_id, {_KEY.format('text')} AS k FROM documents)"


def _boundary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", prompt_key(F.col("text"), True).alias("k"))
    marks = table(spark, sf_dir, "benchmark").select(prompt_key(F.col("text"), True).alias("k")).union(docs.filter("doc_id % 10 = 0").select("k"))
    return docs, marks


@query(f"WITH {_BOUNDARY_SQL} SELECT doc_id, sha256(k) AS key_sha256 FROM keyed WHERE k NOT IN (SELECT k FROM boundary)")
def decontaminate_anti(spark, sf_dir):
    docs, marks = _boundary(spark, sf_dir)
    return membership.without(docs, marks, "k").select("doc_id", F.sha2("k", 256).alias("key_sha256"))


@query(f"WITH {_BOUNDARY_SQL} SELECT doc_id, sha256(k) AS key_sha256 FROM keyed WHERE k IN (SELECT k FROM boundary)")
def overlap_semi(spark, sf_dir):
    docs, marks = _boundary(spark, sf_dir)
    return membership.among(docs, marks, "k").select("doc_id", F.sha2("k", 256).alias("key_sha256"))


@query(f"WITH {_BOUNDARY_SQL}, h AS (SELECT DISTINCT sha256(k) AS h FROM keyed WHERE k IN (SELECT k FROM boundary)) SELECT count(*) AS n_overlap, sha256({" || ':' || ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS HUGEINT)) AS VARCHAR)" for i in range(4))}) AS fingerprint FROM h")
def overlap_fingerprint(spark, sf_dir):
    docs, marks = _boundary(spark, sf_dir)
    h = lambda x: x.select(F.sha2("k", 256).alias("h"))
    return membership.overlap_fingerprint(h(docs), h(marks), "h")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_id % 3 = 0 UNION SELECT event_id FROM events WHERE value < 10)")
def resume_anti(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    done = rows.filter("event_id % 3 = 0").unionByName(rows.filter("value < 10"))
    return membership.without(rows, done, "event_id").select("event_id", "user_id", "event_type")


_A, _B = "SELECT o_custkey AS id FROM orders WHERE o_totalprice > 200000", "SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0"


@query(f"SELECT 'union' AS op, count(*) AS n, CAST(sum(id) AS BIGINT) AS s FROM ({_A} UNION {_B}) UNION ALL SELECT 'intersect', count(*), CAST(sum(id) AS BIGINT) FROM ({_A} INTERSECT {_B}) UNION ALL SELECT 'except', count(*), CAST(sum(id) AS BIGINT) FROM ({_A} EXCEPT {_B})")
def id_union_intersect_except(spark, sf_dir):
    a = table(spark, sf_dir, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("id"))
    b = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b)}
    made = [x.agg(F.count("*").alias("n"), F.sum("id").alias("s")).select(F.lit(k).alias("op"), "n", "s") for k, x in parts.items()]
    return made[0].union(made[1]).union(made[2])


_CASED = "regexp_replace(regexp_replace({}, '\\s+', ' ', 'g'), '^ | $', '', 'g')"


@query(f"SELECT conv_id, turn, sha256({_CASED.format('text')}) AS cased, sha256({_KEY.format('text')}) AS uncased, sha256('42:' || CAST(conv_id AS VARCHAR) || ':' || text) AS stable FROM conversations")
def prompt_keys(spark, sf_dir):
    c = F.col("text")
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.sha2(cased_prompt_key(c, True), 256).alias("cased"), F.sha2(prompt_key(c, True), 256).alias("uncased"), order_hash(42, F.col("conv_id"), c).alias("stable"))
