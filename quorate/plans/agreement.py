"""Queries on how raters agree, over lineitem as ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.functions.answers import overruled
from quorate.operators import agreement as A

from .stand_ins import RATERS, RATINGS_SQL, VALID_SQL, ratings

STATUSES = [f"status_{r}" for r in RATERS]
VERSIONS = [f"version_{r}" for r in RATERS]


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.valid(A.all_ok(ratings(spark, sf_dir), STATUSES), ["base", "second", *RATERS])


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.confusion(clean(spark, sf_dir), "base", RATERS)


def consensus_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = clean(spark, sf_dir)
    counts = A.confusion(df.withColumn("same", F.col("base") == F.col("second")), "base", RATERS, ["same"])
    total = counts.groupBy("rater").agg(F.sum("n").alias("_t"))
    zone = A.accuracy_kappa(counts.where("same").drop("same"))
    return zone.join(F.broadcast(total), "rater").select("rater", "n", A.ratio(F.col("n") * 100, F.col("_t")).alias("share"), "accuracy", "kappa")


#: Strata of the control sample and their shares of 40 rows.
QUOTAS = {"rule_against_consensus": 24, "rule_with_consensus": 8, "model_against_consensus": 8}


def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = clean(spark, sf_dir).where("base = second")
    rule, differs = overruled(F.col("other_fact"), F.col("sense")), F.col("r1") != F.col("base")
    stratum = F.when(rule & differs, "rule_against_consensus").when(rule, "rule_with_consensus").when(differs, "model_against_consensus")
    return df.withColumn("stratum", stratum).where("stratum IS NOT NULL")


def strata_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.stratified(strata(spark, sf_dir), "stratum", QUOTAS, F.concat_ws("-", "article_id", "line")).select("article_id", "line", "stratum", "base", "r1")


def grey_sample(spark: SparkSession, sf_dir: str, size: int = 100) -> DataFrame:
    grey = clean(spark, sf_dir).where("base <> second")
    n = grey.groupBy("base").agg(F.count("*").alias("_n"))
    total = n.agg(F.sum("_n").alias("_t"))
    share = F.bround(F.col("_n") * (F.least(F.lit(size), F.col("_t")) / F.col("_t")))
    quota = n.join(total).select(F.col("base").alias("_base"), F.least(F.col("_n"), F.greatest(F.lit(1), share)).cast("int").alias("_quota"))
    drawn = A.stratified(grey, "base", F.lit(size + 1), F.concat_ws("-", "article_id", "line"), rank="_rank", most=size + 1)
    return drawn.join(F.broadcast(quota), F.col("base") == F.col("_base")).where("_rank <= _quota").select("article_id", "line", "base", "second", *RATERS)


def class_distribution_by_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.version_coherence(ratings(spark, sf_dir), VERSIONS, "v4")


QUERIES = {
    "agreement_accuracy_kappa": lambda s, d: A.accuracy_kappa(counts(s, d)),
    "agreement_by_entity": lambda s, d: A.accuracy_kappa(A.confusion(clean(s, d), "base", RATERS, ["company_id"]), ["company_id"]),
    "confusion_matrix": lambda s, d: A.dense(counts(s, d)),
    "class_report": lambda s, d: A.class_report(counts(s, d)),
    "error_severity": lambda s, d: A.severity(counts(s, d)),
    "bias_direction": lambda s, d: A.bias(counts(s, d)),
    "note_distribution": lambda s, d: A.distribution(ratings(s, d), ["base", *RATERS]),
    "robustness_counts": lambda s, d: A.robustness(ratings(s, d), RATERS),
    "consensus_zone": consensus_zone,
    "grey_zone_follow": lambda s, d: A.grey_zone(clean(s, d), "base", "second", RATERS),
    "quantile_accuracy": lambda s, d: A.quantile_accuracy(clean(s, d), "nbocc", "base", RATERS),
    "correctness_correlation": lambda s, d: A.correctness_correlation(clean(s, d), "nbocc", "base", RATERS),
    "worst_entities": lambda s, d: A.worst_entities(clean(s, d), "company_id", "base", RATERS),
    "version_coherence": class_distribution_by_version,
    "all_ok_filter": lambda s, d: A.all_ok(ratings(s, d), STATUSES).select("article_id", "line", *RATERS),
    "control_strata": lambda s, d: strata(s, d).groupBy("stratum", "base").agg(F.count("*").alias("n")),
    "strata_sample": strata_sample,
    "grey_sample": grey_sample,
}

_KAPPA = """CAST(count(*) AS BIGINT) AS n, count(*) FILTER (WHERE ref = note) AS hits,
 CAST(""" + " + ".join(f"count(*) FILTER (WHERE ref = {k}) * count(*) FILTER (WHERE note = {k})" for k in (0, 1, 2)) + " AS BIGINT) AS ch"  # fmt: skip
_KAPPA_OUT = "n, CAST(hits AS DOUBLE) / n AS accuracy, CAST(n * hits - ch AS DOUBLE) / nullif(CAST(n * n - ch AS DOUBLE), 0) AS kappa"
_PCT = lambda cond, name: f"CAST(100 * count(*) FILTER (WHERE {cond}) AS DOUBLE) / count(*) AS {name}"
_STRATA = VALID_SQL + """, strata AS (SELECT *, CASE WHEN rule AND r1 <> base THEN 'rule_against_consensus' WHEN rule THEN 'rule_with_consensus' WHEN r1 <> base THEN 'model_against_consensus' END AS stratum
 FROM (SELECT *, coalesce(NOT other_fact, false) AND coalesce(sense, 'aucune') = 'aucune' AS rule FROM clean WHERE base = second))"""
_DIV = lambda a, b: f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0)"

ORACLE_SQL = {
    "agreement_accuracy_kappa": f"WITH {VALID_SQL} SELECT rater, {_KAPPA_OUT} FROM (SELECT rater, {_KAPPA} FROM votes GROUP BY rater)",
    "agreement_by_entity": f"WITH {VALID_SQL} SELECT company_id, rater, {_KAPPA_OUT} FROM (SELECT company_id, rater, {_KAPPA} FROM votes GROUP BY company_id, rater)",
    "confusion_matrix": f"WITH {VALID_SQL} SELECT r.rater, a.x AS ref, b.x AS note, (SELECT count(*) FROM votes v WHERE v.rater = r.rater AND v.ref = a.x AND v.note = b.x) AS n FROM (SELECT DISTINCT rater FROM votes) r, (VALUES (0), (1), (2)) a(x), (VALUES (0), (1), (2)) b(x)",
    "class_report": f"""WITH {VALID_SQL}, c AS (SELECT rater, k, count(*) FILTER (WHERE ref = k AND note = k) AS t, count(*) FILTER (WHERE note = k) AS p, count(*) FILTER (WHERE ref = k) AS s, count(*) AS n
 FROM votes, (VALUES (0), (1), (2)) x(k) GROUP BY rater, k), m AS (SELECT *, {_DIV('t', 'p')} AS pr, {_DIV('t', 's')} AS re, {_DIV('2 * t', '(p + s)')} AS f FROM c),
 w AS (SELECT a.rater, a.n, a.t + b.t + c.t AS t, a.s AS sa, b.s AS sb, c.s AS sc, a.pr AS pa, b.pr AS pb, c.pr AS pc, a.re AS ra, b.re AS rb, c.re AS rc, a.f AS fa, b.f AS fb, c.f AS fc
 FROM m a JOIN m b ON a.rater = b.rater AND a.k = 0 AND b.k = 1 JOIN m c ON a.rater = c.rater AND c.k = 2)
 SELECT rater, CAST(k AS VARCHAR) AS label, pr AS precision, re AS recall, f AS f1, s AS support FROM m
 UNION ALL SELECT rater, 'accuracy', CAST(t AS DOUBLE) / n, CAST(t AS DOUBLE) / n, CAST(t AS DOUBLE) / n, n FROM w
 UNION ALL SELECT rater, 'macro', (pa + pb + pc) / 3, (ra + rb + rc) / 3, (fa + fb + fc) / 3, n FROM w
 UNION ALL SELECT rater, 'weighted', (pa * sa + pb * sb + pc * sc) / n, (ra * sa + rb * sb + rc * sc) / n, (fa * sa + fb * sb + fc * sc) / n, n FROM w""",
    "error_severity": f"WITH {VALID_SQL} SELECT rater, count(*) AS n, {_PCT('note = ref', 'exact')}, {_PCT('abs(note - ref) = 1', 'adjacent')}, {_PCT('abs(note - ref) = 2', 'polar')} FROM votes GROUP BY rater",
    "bias_direction": f"WITH {VALID_SQL} SELECT rater, count(*) AS n, {_PCT('note < ref', 'under')}, {_PCT('note > ref', '\"over\"')} FROM votes GROUP BY rater",
    "note_distribution": f"WITH {RATINGS_SQL}, v AS (" + " UNION ALL ".join(f"SELECT '{r}' AS rater, {r} AS note FROM ratings" for r in ["base", *RATERS]) + f") SELECT rater, count(*) AS n, {_PCT('note = 0', 'note_0')}, {_PCT('note = 1', 'note_1')}, {_PCT('note = 2', 'note_2')} FROM v WHERE note IS NOT NULL GROUP BY rater",
    "robustness_counts": f"WITH {RATINGS_SQL} " + " UNION ALL ".join(f"SELECT '{r}' AS rater, count(*) FILTER (WHERE {r} NOT IN (0, 1, 2)) AS out_of_range, count(*) FILTER (WHERE {r} IS NULL) AS nulls FROM ratings" for r in RATERS),
    "consensus_zone": f"WITH {VALID_SQL}, t AS (SELECT rater AS tr, count(*) AS total FROM votes GROUP BY rater) SELECT rater, n, CAST(100 * n AS DOUBLE) / total AS share, CAST(hits AS DOUBLE) / n AS accuracy, CAST(n * hits - ch AS DOUBLE) / nullif(CAST(n * n - ch AS DOUBLE), 0) AS kappa FROM (SELECT rater, {_KAPPA} FROM votes WHERE ref = other GROUP BY rater) JOIN t ON rater = tr",
    "grey_zone_follow": f"WITH {VALID_SQL} SELECT rater, count(*) AS n, {_PCT('note = ref', 'follows_base')}, {_PCT('note = other', 'follows_second')} FROM votes WHERE ref <> other GROUP BY rater",
    "quantile_accuracy": f"""WITH {VALID_SQL}, e AS (SELECT quantile_cont(nbocc, 0.0) AS e0, quantile_cont(nbocc, 0.25) AS e1, quantile_cont(nbocc, 0.5) AS e2, quantile_cont(nbocc, 0.75) AS e3, quantile_cont(nbocc, 1.0) AS e4 FROM clean)
 SELECT CAST(greatest(1, (e0 < nbocc)::INT + (e1 < nbocc AND e1 <> e0)::INT + (e2 < nbocc AND e2 <> e1)::INT + (e3 < nbocc AND e3 <> e2)::INT + (e4 < nbocc AND e4 <> e3)::INT) AS INT) AS bin, rater, count(*) AS n,
 CAST(count(*) FILTER (WHERE ref = note) AS DOUBLE) / count(*) AS accuracy FROM votes, e GROUP BY 1, 2""",
    "correctness_correlation": f"""WITH {VALID_SQL}, s AS (SELECT rater, count(*) AS n, CAST(sum(nbocc) AS BIGINT) AS sx, count(*) FILTER (WHERE ref = note) AS sy, CAST(sum(nbocc * nbocc) AS BIGINT) AS sxx, CAST(coalesce(sum(nbocc) FILTER (WHERE ref = note), 0) AS BIGINT) AS sxy FROM votes GROUP BY rater)
 SELECT rater, n, round(CAST(n * sxy - sx * sy AS DOUBLE) / nullif(sqrt(CAST(n * sxx - sx * sx AS DOUBLE)) * sqrt(CAST(n * sy - sy * sy AS DOUBLE)), 0), 9) AS correlation FROM s""",
    "worst_entities": f"WITH {VALID_SQL} SELECT company_id, n, CAST(hits AS DOUBLE) / (n * 3) AS accuracy FROM (SELECT company_id, count(*) AS n, CAST(sum((r1 = base)::INT + (r2 = base)::INT + (r3 = base)::INT) AS BIGINT) AS hits FROM clean GROUP BY company_id HAVING count(*) >= 15) ORDER BY accuracy, company_id LIMIT 10",
    "version_coherence": f"WITH {RATINGS_SQL}, v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS version FROM ratings" for c in VERSIONS) + ') SELECT "column", version, count(*) AS n FROM v WHERE version IS DISTINCT FROM \'v4\' GROUP BY 1, 2',
    "all_ok_filter": f"WITH {RATINGS_SQL} SELECT article_id, line, r1, r2, r3 FROM ratings WHERE status_r1 = 'ok' AND status_r2 = 'ok' AND status_r3 = 'ok'",
    "control_strata": f"WITH {_STRATA} SELECT stratum, base, count(*) AS n FROM strata WHERE stratum IS NOT NULL GROUP BY 1, 2",
    "strata_sample": f"""WITH {_STRATA}, d AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(article_id || '-' || line)) AS k FROM strata WHERE stratum IS NOT NULL)
 SELECT article_id, line, stratum, base, r1 FROM d WHERE k <= CASE stratum WHEN 'rule_against_consensus' THEN 24 ELSE 8 END""",
    "grey_sample": f"""WITH {VALID_SQL}, g AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY md5(article_id || '-' || line)) AS k, count(*) OVER (PARTITION BY base) AS n, count(*) OVER () AS t FROM clean WHERE base <> second)
 SELECT article_id, line, base, second, r1, r2, r3 FROM g WHERE k <= least(n, greatest(1, round_even(n * (CAST(least(100, t) AS DOUBLE) / t), 0)))""",
}
