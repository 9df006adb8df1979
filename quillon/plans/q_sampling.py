"""Ranks, quotas, splits and schedules."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quillon.functions.text import order_hash
from quillon.operators import quality, sampling
from quillon.operators.ranks import running
from quillon.plans.fixtures import ANNOTATED_SQL, annotated, sft
from quillon.plans.registry import query, table

STRATA = ["bucket", "length_bucket"]


def _usable(spark, sf_dir):
    rows = annotated(spark, sf_dir).filter(F.size("hard") == 0).select("ord", "k", *STRATA, "score")
    return quality.first_wins(rows, "k", "ord").select("ord", F.sha2("k", 256).alias("k"), *STRATA, "score")


def _ranked(spark, sf_dir):
    return sampling.ranked(_usable(spark, sf_dir), STRATA, tie=F.col("k"))  # the key's hash already


_K = "greatest(1, n_stratum // 3)"


@query(f"WITH {ANNOTATED_SQL} SELECT ord, bucket, length_bucket, score, rn, n_stratum FROM ranked WHERE rn <= {_K} AND n_stratum >= 2")
def stratified_topk(spark, sf_dir):
    """The flagship: annotate, drop broken rows and repeats, and take the best third of each stratum."""
    top = _ranked(spark, sf_dir).filter((F.col("n_stratum") >= 2) & (F.col("rn") <= F.greatest(F.lit(1), F.floor(F.col("n_stratum") / 3))))
    return top.select("ord", *STRATA, "score", F.col("rn").cast("long").alias("rn"), "n_stratum")


@query(f"WITH {ANNOTATED_SQL} SELECT ord, bucket, length_bucket, score, rn, n_stratum FROM ranked WHERE rn > n_stratum - {_K} AND n_stratum >= 2")
def stratified_bottomk(spark, sf_dir):
    low = _ranked(spark, sf_dir).filter((F.col("n_stratum") >= 2) & (F.col("rn") > F.col("n_stratum") - F.greatest(F.lit(1), F.floor(F.col("n_stratum") / 3))))
    return low.select("ord", *STRATA, "score", F.col("rn").cast("long").alias("rn"), "n_stratum")


@query(f"WITH {ANNOTATED_SQL}, s AS (SELECT *, {_K} AS kk FROM ranked WHERE n_stratum >= 2) SELECT bucket, length_bucket, count(*) FILTER (rn <= n_stratum - kk) AS n_full, count(*) FILTER (rn <= kk) AS n_clean, count(*) FILTER (rn > n_stratum - kk) AS n_raw, count(*) FILTER (rn <= kk AND rn > n_stratum - kk) AS n_both FROM s GROUP BY bucket, length_bucket")
def clean_raw_disjoint(spark, sf_dir):
    rows = _ranked(spark, sf_dir).filter("n_stratum >= 2").withColumn("kk", F.greatest(F.lit(1), F.floor(F.col("n_stratum") / 3)))
    clean, raw = F.col("rn") <= F.col("kk"), F.col("rn") > F.col("n_stratum") - F.col("kk")
    return rows.groupBy(*STRATA).agg(F.count_if(F.col("rn") <= F.col("n_stratum") - F.col("kk")).alias("n_full"), F.count_if(clean).alias("n_clean"), F.count_if(raw).alias("n_raw"), F.count_if(clean & raw).alias("n_both"))


@query(f"WITH {ANNOTATED_SQL}, s AS (SELECT *, {_K} AS kk FROM ranked WHERE n_stratum >= 2), c AS (SELECT bucket, length_bucket, count(*) AS n FROM s WHERE rn <= kk GROUP BY ALL), r AS (SELECT bucket, length_bucket, count(*) AS n FROM s WHERE rn > n_stratum - kk GROUP BY ALL) SELECT (SELECT count(*) FROM (SELECT * FROM c EXCEPT SELECT * FROM r)) + (SELECT count(*) FROM (SELECT * FROM r EXCEPT SELECT * FROM c)) AS n_unequal, (SELECT count(*) FROM c) AS n_strata")
def strata_multiset_equal(spark, sf_dir):
    rows = _ranked(spark, sf_dir).filter("n_stratum >= 2").withColumn("kk", F.greatest(F.lit(1), F.floor(F.col("n_stratum") / 3)))
    c = rows.filter("rn <= kk").groupBy(*STRATA).count()
    r = rows.filter("rn > n_stratum - kk").groupBy(*STRATA).count()
    both = c.exceptAll(r).union(r.exceptAll(c)).agg(F.count("*").alias("n_unequal"))
    return both.join(c.agg(F.count("*").alias("n_strata")), F.lit(True))


@query("WITH h AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM documents WHERE source IN ('src1', 'src2', 'src3')) SELECT doc_id, source, rn FROM h WHERE rn <= CASE source WHEN 'src1' THEN 5 WHEN 'src2' THEN 3 ELSE 2 END")
def quota_hash_select(spark, sf_dir):
    picked = sampling.quota_top(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", {"src1": 5, "src2": 3, "src3": 2}, key="doc_id")
    return picked.select("doc_id", "source", F.col("rn").cast("long").alias("rn"))


@query("SELECT doc_id, lang FROM documents ORDER BY sha256('42:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 50")
def hash_order_limit(spark, sf_dir):
    return sampling.hash_limit(table(spark, sf_dir, "documents").select("doc_id", "lang"), 50, key="doc_id")


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN rn <= greatest(1, round_even(n * 0.05, 0)) THEN 'validation' ELSE 'train' END AS split FROM r")
def hash_split_train_val(spark, sf_dir):
    return sampling.hash_split(table(spark, sf_dir, "documents").select("doc_id"), 0.05, key="doc_id").select("doc_id", "split")


_RATIOS = {"conv": 0.35, "code": 0.32, "math": 0.07, "poem": 0.1, "talk": 0.07, "news": 0.06, "tale": 0.03}
_VALUES = ", ".join(f"('{k}', {v})" for k, v in _RATIOS.items())


@query(f"WITH r(k, v) AS (VALUES {_VALUES}), t AS (SELECT count(*) AS n FROM documents), e AS (SELECT k, CAST(n * v AS DOUBLE) AS x, floor(CAST(n * v AS DOUBLE) + 1e-9) AS f, n FROM r, t), o AS (SELECT *, row_number() OVER (ORDER BY round(x - f, 9) DESC, k) AS rn, n - sum(f) OVER () AS rest FROM e) SELECT k, CAST(f + CASE WHEN rn <= rest THEN 1 ELSE 0 END AS BIGINT) AS n FROM o")
def largest_remainder_alloc(spark, sf_dir):
    total = table(spark, sf_dir, "documents").count()
    return spark.createDataFrame(list(sampling.allocation(total, _RATIOS).items()), "k string, n long")


def _quota(name: str, target: str, low: str, cap: str) -> str:
    """Of each stratum: its proportion rounded down within its bounds, and single units, ranked by their distance from it, up to the target."""
    return f"""{name}_t AS (SELECT *, {low} AS low, {cap} AS cap, {target} AS target, sum(n) OVER () AS whole FROM size),
{name}_i AS (SELECT *, CAST(target * n AS DOUBLE) / whole AS ideal, greatest(low, least(cap, CAST(floor(CAST(target * n AS DOUBLE) / whole) AS BIGINT))) AS start FROM {name}_t),
{name}_s AS (SELECT *, target - sum(start) OVER () AS need FROM {name}_i),
{name}_u AS (SELECT bucket, length_bucket, need, sign(need) AS sg, row_number() OVER (ORDER BY sign(need) * (ideal - (start + sign(need) * j)) DESC, CASE WHEN need > 0 THEN bucket END DESC, CASE WHEN need > 0 THEN length_bucket END DESC, bucket, length_bucket) AS r
  FROM (SELECT *, unnest(range(0, CASE WHEN need > 0 THEN cap - start WHEN need < 0 THEN start - low ELSE 0 END)) AS j FROM {name}_s)),
{name} AS (SELECT s.bucket, s.length_bucket, s.n, CAST(s.start + coalesce(u.more, 0) AS BIGINT) AS k FROM {name}_s s LEFT JOIN (SELECT bucket, length_bucket, sum(sg) AS more FROM {name}_u WHERE r <= abs(need) GROUP BY ALL) u ON u.bucket = s.bucket AND u.length_bucket = s.length_bucket)"""


_THIRD = "greatest(1, n // 3)"
_SETS = f"""size AS (SELECT bucket, length_bucket, count(*) AS n FROM ranked WHERE n_stratum >= 2 GROUP BY ALL),
{_quota('few', f'least(100, (SELECT sum({_THIRD}) FROM size))', '1', _THIRD)},
{_quota('many', '(SELECT least(400, sum(n - k)) FROM few)', '(SELECT f.k FROM few f WHERE f.bucket = size.bucket AND f.length_bucket = size.length_bucket)', 'n - (SELECT f.k FROM few f WHERE f.bucket = size.bucket AND f.length_bucket = size.length_bucket)')}"""


@query(f"WITH {ANNOTATED_SQL}, {_SETS}, x AS (SELECT r.*, list_filter([CASE WHEN rn <= many.k THEN 'full' END, CASE WHEN rn <= least(many.k, few.k) THEN 'clean' END, CASE WHEN rn > n_stratum - few.k THEN 'raw' END], lambda s: s IS NOT NULL) AS sets FROM ranked r JOIN few USING (bucket, length_bucket) JOIN many USING (bucket, length_bucket)) SELECT ord, bucket, length_bucket, score, array_to_string(sets, ',') AS sets FROM x WHERE len(sets) > 0")
def allocate_by_stratum(spark, sf_dir):
    """Full, clean and raw sets with quotas from the allocator."""
    return sampling.select_datasets(_usable(spark, sf_dir), STRATA, 400, 100, tie=F.col("k")).select("ord", *STRATA, "score", F.array_join("sets", ",").alias("sets"))


@query("SELECT * FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM documents) WHERE rn = 1")
def review_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang")
    n = rows.select("lang").distinct().count()
    return sampling.review_sample(rows, "lang", n, key="doc_id").select("doc_id", "lang", F.lit(1).cast("long").alias("rn"))


# the exponential key of a hash: -ln(u) / weight, u from its first 52 bits
_KEY = "-ln((CAST('0x' || substr(sha256({} || id), 1, 13) AS BIGINT) + 0.5) / 4503599627370496) / weight"


@query(f"WITH p AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_acctbal AS weight FROM customer WHERE c_acctbal > 0), d AS (SELECT id, weight FROM p ORDER BY {_KEY.format("'42:0:'")}, id LIMIT 32), r AS (SELECT *, row_number() OVER (ORDER BY id) AS rank FROM d) SELECT id, weight, pass, CAST(rank AS INTEGER) AS rank, copy FROM r, (SELECT unnest(range(1, 3))::INTEGER AS pass), (SELECT unnest(range(1, 5))::INTEGER AS copy)")
def weighted_sample_wor(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.greatest(F.lit(0.0), F.col("c_acctbal")).alias("weight"))
    return sampling.repeat_sampler(rows, 32, 4, 2).select("id", "weight", "pass", "rank", "copy")


@query(f"WITH p AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_acctbal AS weight FROM customer WHERE c_acctbal > 0), t AS (SELECT id, pass, {_KEY.format("'42:1:' || pass || ':'")} AS u FROM p, (SELECT unnest(range(0, CAST(ceil(320 / (SELECT count(*) FROM p)) AS BIGINT))) AS pass)), r AS (SELECT id, row_number() OVER (ORDER BY pass, u, id) - 1 AS nth FROM t) SELECT nth // 16 AS step, nth % 16 + 1 AS rank, id FROM r WHERE nth < 320")
def weighted_draws(spark, sf_dir):
    """Twenty steps of sixteen draws each under one refresh of the weights: one order, and a cursor over it."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_acctbal").alias("weight"))
    return sampling.draws(rows, 16, 20, refresh=1).select("step", "rank", "id")


@query("WITH e AS (SELECT source AS key, unnest(range(1, count(*) // 5 + 1)) AS copy FROM documents GROUP BY source) SELECT row_number() OVER (ORDER BY sha256('42:' || key || ':' || copy), key, copy) - 1 AS place, key FROM e")
def expanded_schedule(spark, sf_dir):
    """Every source as often as a fifth of its documents."""
    counts = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("key")).agg(F.floor(F.count("*") / 5).alias("n"))
    return sampling.expanded_schedule(counts)


@query("SELECT doc_id, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 4) AS BIGINT) AS chunk FROM documents")
def chunk_groups(spark, sf_dir):
    rows = running(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], ["doc_id"])
    return rows.select("doc_id", F.floor((F.col("rn") - 1) / 4).alias("chunk"))


@query("WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('1:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS place FROM documents WHERE source = 'src1'), b AS (SELECT doc_id AS other, row_number() OVER (ORDER BY sha256('2:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS place FROM documents WHERE source = 'src2') SELECT place, doc_id, other FROM a JOIN b USING (place)")
def paired_by_place(spark, sf_dir):
    from quillon.operators.membership import zipped

    docs = table(spark, sf_dir, "documents")
    side = lambda s, seed, name: running(docs.filter(F.col("source") == s).select(F.col("doc_id").alias(name)), [], [order_hash(seed, F.col(name)), name], name="rn").select(name, (F.col("rn") - 1).alias("place"))
    return zipped(side("src1", 1, "doc_id"), side("src2", 2, "other")).select("place", "doc_id", "other")


def _swaps(most: int, seed: int = 42) -> str:
    """The exchanges that a seeded shuffle makes in lists of up to `most`: (length, place, other place)."""
    out = []
    for n in range(2, most + 1):
        draw = random.Random(seed)
        out += [f"({n}, {i}, {draw._randbelow(i + 1)})" for i in reversed(range(1, n))]
    return ", ".join(out)


@query(
    f"""WITH RECURSIVE swap(n, i, j) AS (VALUES {_swaps(64)}), ids AS (SELECT list(item_id ORDER BY item_id) AS l, count(*) AS n FROM benchmark), s(i, n, l) AS (
  SELECT n - 1, n, l FROM ids
  UNION ALL SELECT s.i - 1, s.n, list_transform(range(1, s.n + 1), lambda k: CASE WHEN k = s.i + 1 THEN l[j + 1] WHEN k = j + 1 THEN l[s.i + 1] ELSE l[k] END) FROM s JOIN swap ON swap.n = s.n AND swap.i = s.i
) SELECT k - 1 AS place, l[k] AS item_id FROM (SELECT l, unnest(range(1, n + 1)) AS k FROM s WHERE i = 0)"""
)
def mt_shuffled_ids(spark, sf_dir):
    """The parity mode of the split, for an evaluation set's ids: the order of a seeded Mersenne Twister, by place."""
    ids = [r[0] for r in table(spark, sf_dir, "benchmark").select("item_id").collect()]
    return spark.createDataFrame(list(enumerate(sampling.shuffled_ids(ids))), "place long, item_id long")
