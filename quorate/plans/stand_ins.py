"""The driver's tables in the shapes that ratings have; each expression means the same to Spark and to the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.sources.shared import table

RATERS = ["r1", "r2", "r3"]

_RATINGS = [
    "l_orderkey AS article_id", "l_linenumber AS line", "l_suppkey AS company_id", "CAST(l_quantity AS INT) AS nbocc",
    "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS base", "CAST((l_orderkey + l_linenumber) % 3 AS INT) AS second",
    *[f"CASE WHEN l_partkey % {50 + k} = 0 THEN NULL WHEN l_partkey % {60 + k} = 0 THEN 9 ELSE CAST((l_partkey + {k} * l_linenumber) % 3 AS INT) END AS r{k}" for k in (1, 2, 3)],
    *[f"CASE WHEN (l_orderkey + {k}) % 11 = 0 THEN 'failed' WHEN (l_orderkey + {k}) % 13 = 0 THEN NULL ELSE 'ok' END AS status_r{k}" for k in (1, 2, 3)],
    *[f"CASE WHEN (l_linenumber + {k}) % 7 = 0 THEN NULL WHEN (l_linenumber + {k}) % 5 = 0 THEN 'v3' ELSE 'v4' END AS version_r{k}" for k in (1, 2, 3)],
    "CASE CAST(l_partkey % 3 AS INT) WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS other_fact", "CASE CAST(l_suppkey % 4 AS INT) WHEN 0 THEN NULL WHEN 2 THEN 'amelioree' ELSE 'aucune' END AS sense",
]
_FACTS = [
    "event_id", "user_id", "(CAST({k} AS INT) - 50) / CAST(10 AS DOUBLE) AS variation", "CASE CAST(event_id % 3 AS INT) WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS other_fact",
    "CASE CAST(event_id % 4 AS INT) WHEN 0 THEN NULL WHEN 2 THEN 'amelioree' ELSE 'aucune' END AS sense", "CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'haut' WHEN 1 THEN 'moyen' WHEN 2 THEN 'bas' END AS level",
    "CAST((event_id % 7) % 3 AS INT) AS note",
]
_LOG = [
    "CAST(event_id % 40 AS INT) AS article_id", "user_id AS company_id", "event_id", "ts",
    "CASE event_type WHEN 'signup' THEN 'not_evaluated' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'ok' ELSE 'submitted' END AS status",
    "CASE WHEN event_type = 'purchase' THEN CAST(event_id % 3 AS INT) END AS note", "CASE WHEN event_type = 'purchase' THEN concat('j', CAST(event_id AS {str})) END AS justification",
    "concat('v', CAST(3 + event_id % 2 AS {str})) AS version", "CASE WHEN event_type = 'purchase' THEN props END AS extraction",
]

RATINGS_SQL = f"ratings AS (SELECT {', '.join(_RATINGS)} FROM lineitem)"
NOTES_SQL = ", ".join(["base", "second", *RATERS])
VALID_SQL = (
    RATINGS_SQL + ", clean AS (SELECT * FROM ratings WHERE " + " AND ".join([f"status_{r} = 'ok'" for r in RATERS] + [f"{c} IN (0, 1, 2)" for c in ("base", "second", *RATERS)])
    + "), votes AS (" + " UNION ALL ".join(f"SELECT '{r}' AS rater, base AS ref, second AS other, {r} AS note, company_id, nbocc FROM clean" for r in RATERS) + ")"
)
FACTS_SQL = "facts AS (SELECT " + ", ".join(x.format(k="json_extract_string(props, '$.k')") for x in _FACTS) + " FROM events)"
LOG_SQL = "log AS (SELECT " + ", ".join(x.format(str="VARCHAR") for x in _LOG) + " FROM events)"


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*_RATINGS)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*[x.format(k="get_json_object(props, '$.k')") for x in _FACTS])


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*[x.format(str="STRING") for x in _LOG])


def inline(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A dimension of literals, without Python on executors; columns: 'name type, ...'."""
    types = [c.split() for c in columns.split(", ")]
    one = F.array(*[F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(r, types, strict=True)]) for r in rows])
    return spark.range(1).select(F.inline(one))


def values_sql(rows: list[tuple], name: str, columns: str) -> str:
    cell = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + ")"
