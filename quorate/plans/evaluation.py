"""Queries on evaluations: answers, rules, state, selection, reload, views, and the collecting stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.functions import answers as N
from quorate.functions.text import custom_id
from quorate.operators import raters, state
from quorate.operators import selection as S
from quorate.sources.shared import scratch, table
from quorate.streaming.collector import collect

from .stand_ins import FACTS_SQL, LOG_SQL, RATINGS_SQL, facts, inline, log, ratings, values_sql

#: Raw answers with what must come of them: status, note, justification, variation, other_fact, sense.
ANSWERS = [
    (0, '{"note_llm":2,"justification":"x"}', "ok", 2, "x", None, None, None),
    (1, '```json\n{"note_llm":1,"justification":"y"}\n```', "ok", 1, "y", None, None, None),
    (2, 'noise {"note_llm":0,"justification":"z"} tail', "ok", 0, "z", None, None, None),
    (3, '{"note_llm":2.0,"justification":"x"}', "ok", 2, "x", None, None, None),
    (4, '{"note_llm":"2","justification":"x"}', "ok", 2, "x", None, None, None),
    (5, '{"note_llm":true,"justification":"x"}', "ok", 1, "x", None, None, None),
    (6, '{"note_llm":2.5,"justification":"x"}', "failed", None, None, None, None, None),
    (7, '{"note_llm":3,"justification":"x"}', "failed", None, None, None, None, None),
    (8, '{"note_llm":1}', "failed", None, None, None, None, None),
    (9, '{"note_llm":1,"justification":3}', "failed", None, None, None, None, None),
    (10, "[]", "failed", None, None, None, None, None),
    (11, "2", "failed", None, None, None, None, None),
    (12, "", "failed", None, None, None, None, None),
    (13, '{"note_llm":1,"justif', "failed", None, None, None, None, None),
    (14, '{"note_llm":1,"justification":"v","variation_cours_pct":45.0,"autre_fait_concret":false,"reco_sens":" Amelioree "}', "ok", 1, "v", None, False, "amelioree"),
    (15, '{"note_llm":1,"justification":"v","variation_cours_pct":-7.5,"autre_fait_concret":null,"reco_sens":"inconnu"}', "ok", 1, "v", -7.5, None, None),
    (16, None, "failed", None, None, None, None, None),
]
THRESHOLDS = [(3.0,), (5.0,), (8.0,), (10.0,), (15.0,)]


def answer_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % len(ANSWERS)).cast("int").alias("k"))
    raw = inline(spark, [a[:2] for a in ANSWERS], "k int, raw string")
    return N.parsed(e.join(F.broadcast(raw), "k")).select("event_id", "status", "note", "justification", "variation", "other_fact", "sense")


def decided(df: DataFrame, threshold=N.THRESHOLD) -> DataFrame:
    return df.withColumn("final", N.final_note(F.col("note"), F.col("variation"), F.col("other_fact"), F.col("sense"), threshold))


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decided(facts(spark, sf_dir).join(F.broadcast(inline(spark, THRESHOLDS, "threshold double"))), F.col("threshold"))
    hist = [F.count_if(F.col("final.note") == k).alias(f"note_{k}") for k in N.NOTES]
    return d.groupBy("threshold").agg(*hist, F.count_if(F.col("final.note") != F.col("note")).alias("changed"))


def json_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = facts(spark, sf_dir).withColumn("extraction", N.facts_json(F.col("variation"), F.col("other_fact"), F.col("sense"), F.col("level")))
    e = F.from_json("extraction", "variation_cours_pct double, autre_fait_concret boolean, reco_sens string, reco_niveau string")
    return d.withColumn("e", e).select("event_id", "extraction", F.col("e.variation_cours_pct").alias("variation_back"), F.col("e.reco_sens").alias("sense_back"))


def broker_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = F.when(F.col("variation") > 1, "releve").when(F.col("variation") < -1, "abaisse").otherwise("inchange")
    move = F.element_at(F.array(F.lit("amelioree"), F.lit("maintenue"), F.lit("degradee")), F.col("note") + 1)
    d = facts(spark, sf_dir).select("event_id", target.alias("target"), move.alias("move"), "level")
    g = inline(spark, list(N.GRID), "g_target string, g_move string, g_level string, g_note int")
    hit = (F.col("target") == F.col("g_target")) & (F.col("move") == F.col("g_move")) & (F.col("g_level").isNull() | F.col("level").eqNullSafe(F.col("g_level")))
    note = F.when((F.col("move") == "maintenue") & (F.col("level") == "bas"), 0).otherwise(F.col("g_note"))
    return d.join(F.broadcast(g), hit, "left").select("event_id", "target", "move", "level", note.alias("note"))


def resume_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").selectExpr(*_PAIRS)
    return d.where(S.to_resume(F.col("status"), F.col("version"), "v4"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderkey % 5 <> 0")
    return o.select("o_orderkey", custom_id(F.col("o_orderkey"), F.col("o_custkey")).alias("custom_id"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0")
    return o.select(custom_id(F.col("o_orderkey"), F.col("o_custkey")).alias("custom_id"), F.lit("ok").alias("status"), (F.col("o_orderkey") % 3).cast("int").alias("note"))


def batch_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("batch", F.floor(F.col("o_orderkey") / 1000).cast("long"))
    n = {"succeeded": F.col("o_orderstatus") == "F", "processing": F.col("o_orderstatus") == "O", "errored": F.col("o_orderstatus") == "P"}
    one = o.groupBy("batch").agg(*[F.count_if(c).alias(k) for k, c in n.items()])
    return one.withColumn("ended", F.col("processing") == 0)


def reload_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of several files: those with a whole note in 0, 1, 2; the last file and line win."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(*_RELOAD)
    good = rows.where(F.col("note_text").rlike(r"^[+-]?[0-9]+$")).withColumn("note", F.col("note_text").try_cast("int")).where(F.col("note").isin(*N.NOTES))
    return state.last_write(good, ["article_id", "company_id"], F.struct("file", "line"), ["note"])


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custom ids of batches whose article is not there, or whose company is not."""
    p = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 2).alias("article_id"), (F.col("l_suppkey") + F.col("l_linenumber")).alias("company_id")).distinct()
    articles, companies = table(spark, sf_dir, "orders"), table(spark, sf_dir, "supplier")
    known = p.join(articles, p["article_id"] == articles["o_orderkey"], "left_semi").join(companies, p["company_id"] == companies["s_suppkey"], "left_semi")
    return p.join(known, ["article_id", "company_id"], "left_anti").select(custom_id(F.col("article_id"), F.col("company_id")).alias("custom_id"))


def entities_by_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, l, c = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "supplier"))
    return o.join(l, o["o_orderkey"] == l["l_orderkey"], "left").join(c, l["l_suppkey"] == c["s_suppkey"], "left").select("o_orderkey", "l_linenumber", "s_name", F.col("l_quantity").cast("long").alias("nbocc"))


def sectors_by_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return o.join(n, o["c_nationkey"] == n["n_nationkey"], "left").join(r, n["n_regionkey"] == r["r_regionkey"], "left").select("c_custkey", "n_name", "r_name")


def stub_rater(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(custom_id(F.col("conv_id"), F.col("turn")).alias("custom_id"), F.coalesce("role", F.lit("")).alias("company"), "text")
    return raters.rate(c, "sign", "v7").select("custom_id", "status", "note", "justification")


def streaming_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files of results arrive, one after the other; collecting again between and after adds nothing."""
    at = scratch(spark)
    line = F.to_json(F.struct(F.concat(F.lit("a"), F.col("event_id").cast("string"), F.lit("-c"), F.col("user_id").cast("string")).alias("custom_id"), F.struct(
        F.when(F.col("event_type") == "error", "errored").otherwise("succeeded").alias("type"),
        F.struct(F.array(F.struct(F.lit("text").alias("type"), F.concat(F.lit('{"note_llm":'), (F.col("event_id") % 4).cast("string"), F.lit(',"justification":"s"}')).alias("text"))).alias("content")).alias("message"),
    ).alias("result")))
    events = table(spark, sf_dir, "events")
    for half in (0, 1):
        events.where(F.col("event_id") % 2 == half).select(line.alias("value")).write.mode("append").text(f"{at}/results")
        for _ in range(2):
            collect(spark, f"{at}/results", f"{at}/log", f"{at}/checkpoint", "v4")
    return spark.read.parquet(f"{at}/log").select("custom_id", "status", "note", "problem")


_PAIRS = [
    "event_id AS article_id", "user_id AS company_id",
    "CASE event_type WHEN 'signup' THEN 'not_evaluated' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'submitted' WHEN 'purchase' THEN 'ok' END AS status",
    "CASE CAST(event_id % 3 AS INT) WHEN 1 THEN 'v3' WHEN 2 THEN 'v4' END AS version",
]
_RELOAD = [
    "CAST(l_orderkey % 500 AS INT) AS article_id", "CAST(l_suppkey % 20 AS INT) AS company_id", "l_orderkey AS file", "l_linenumber AS line",
    "CASE CAST((l_partkey + l_linenumber) % 9 AS INT) WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '2' WHEN 3 THEN '1.0' WHEN 4 THEN '3' WHEN 5 THEN '' WHEN 6 THEN '+1' WHEN 7 THEN NULL ELSE '-1' END AS note_text",
]


def remaining_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resume_selection(spark, sf_dir).agg(F.count("*").alias("remaining"))


def chunk_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.chunks(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey", "chunk")


QUERIES = {
    "answer_salvage": answer_salvage,
    "json_facts": json_facts,
    "rule_override": lambda s, d: decided(facts(s, d)).select("event_id", F.col("final.note").alias("final_note"), F.col("final.origin").alias("origin")),
    "threshold_sweep": threshold_sweep,
    "score_origin_counts": lambda s, d: decided(facts(s, d)).groupBy(F.col("final.origin").alias("origin")).agg(F.count("*").alias("n"), F.count_if(F.col("final.note") != F.col("note")).alias("changed")),
    "broker_grid": broker_grid,
    "resume_selection": resume_selection,
    "remaining_work": remaining_work,
    "per_entity_latest_n": lambda s, d: S.latest(table(s, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", [F.desc("o_orderkey")], 3),
    "random_n_per_entity": lambda s, d: S.latest(table(s, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", [F.md5(F.col("o_orderkey").cast("string"))], 2),
    "chunk_assignment": chunk_assignment,
    "state_current": lambda s, d: state.current(log(s, d), ["article_id", "company_id"], F.struct("ts", "event_id")),
    "collect_left_default": lambda s, d: state.collected(requests(s, d).select("custom_id"), results(s, d)).select("custom_id", "status", "note"),
    "not_submitted_anti": lambda s, d: state.not_submitted(requests(s, d), results(s, d)).select("o_orderkey", "custom_id"),
    "batch_progress": batch_progress,
    "orphan_ids": orphans,
    "reload_last_wins": reload_last_wins,
    "entities_by_article_view": entities_by_article,
    "sectors_by_article_view": sectors_by_article,
    "ok_notes_view": lambda s, d: ratings(s, d).where("status_r1 = 'ok'").select("article_id", "line", "company_id", "nbocc", "r1", "r2", "r3", "version_r1"),
    "progress_by_status": lambda s, d: ratings(s, d).groupBy(F.col("status_r1").alias("status"), F.col("version_r1").alias("version")).agg(F.count("*").alias("n")),
    "stub_rater": stub_rater,
    "streaming_collect": streaming_collect,
}

_RULE = "coalesce(NOT other_fact, false) AND coalesce(sense, 'aucune') = 'aucune'"
_FINAL = lambda limit: f"CASE WHEN NOT ({_RULE}) THEN note WHEN variation IS NULL OR abs(variation) < {limit} THEN 1 WHEN variation > 0 THEN 2 ELSE 0 END"
_REQ = "req AS (SELECT o_orderkey, 'a' || o_orderkey || '-c' || o_custkey AS custom_id FROM orders WHERE o_orderkey % 5 <> 0), res AS (SELECT 'a' || o_orderkey || '-c' || o_custkey AS custom_id, 'ok' AS status, CAST(o_orderkey % 3 AS INT) AS note FROM orders WHERE o_orderkey % 3 <> 0)"
_PAIRS_SQL = f"pairs AS (SELECT {', '.join(_PAIRS)} FROM events)"
_RESUME = "(status IS DISTINCT FROM 'ok' AND status IS DISTINCT FROM 'submitted') OR version IS DISTINCT FROM 'v4'"
_LAST = lambda value, among: f"(arg_max({{'v': {value}}}, k) FILTER (WHERE status IN ({among})))"
_ALL = "'ok', 'failed', 'not_evaluated'"

ORACLE_SQL = {
    "answer_salvage": f"WITH {values_sql(ANSWERS, 'a', 'k, raw, status, note, justification, variation, other_fact, sense')} SELECT event_id, status, CAST(note AS INT) AS note, justification, CAST(variation AS DOUBLE) AS variation, CAST(other_fact AS BOOLEAN) AS other_fact, sense FROM events JOIN a ON event_id % {len(ANSWERS)} = k",
    "json_facts": f"WITH {FACTS_SQL} SELECT event_id, CAST(to_json({{'variation_cours_pct': variation, 'autre_fait_concret': other_fact, 'reco_sens': sense, 'reco_niveau': level}}) AS VARCHAR) AS extraction, variation AS variation_back, sense AS sense_back FROM facts",
    "rule_override": f"WITH {FACTS_SQL} SELECT event_id, CAST({_FINAL('5.0')} AS INT) AS final_note, CASE WHEN {_RULE} THEN 'rule' ELSE 'model' END AS origin FROM facts",
    "threshold_sweep": f"WITH {FACTS_SQL}, f AS (SELECT t AS threshold, note, {_FINAL('t')} AS fin FROM facts, (VALUES (3.0::DOUBLE), (5.0::DOUBLE), (8.0::DOUBLE), (10.0::DOUBLE), (15.0::DOUBLE)) x(t)) SELECT threshold, count(*) FILTER (WHERE fin = 0) AS note_0, count(*) FILTER (WHERE fin = 1) AS note_1, count(*) FILTER (WHERE fin = 2) AS note_2, count(*) FILTER (WHERE fin <> note) AS changed FROM f GROUP BY threshold",
    "score_origin_counts": f"WITH {FACTS_SQL}, f AS (SELECT note, {_FINAL('5.0')} AS fin, CASE WHEN {_RULE} THEN 'rule' ELSE 'model' END AS origin FROM facts) SELECT origin, count(*) AS n, count(*) FILTER (WHERE fin <> note) AS changed FROM f GROUP BY origin",
    "broker_grid": f"""WITH {FACTS_SQL}, f AS (SELECT event_id, CASE WHEN variation > 1 THEN 'releve' WHEN variation < -1 THEN 'abaisse' ELSE 'inchange' END AS target, CASE note WHEN 0 THEN 'amelioree' WHEN 1 THEN 'maintenue' ELSE 'degradee' END AS move, level FROM facts)
 SELECT *, CASE WHEN move = 'amelioree' THEN 2 WHEN move = 'degradee' THEN CASE WHEN target = 'releve' THEN 1 ELSE 0 END WHEN level = 'bas' THEN 0 WHEN level = 'moyen' THEN 1 WHEN level = 'haut' THEN CASE WHEN target = 'releve' THEN 2 ELSE 1 END END AS note FROM f""",
    "resume_selection": f"WITH {_PAIRS_SQL} SELECT * FROM pairs WHERE {_RESUME}",
    "remaining_work": f"WITH {_PAIRS_SQL} SELECT count(*) AS remaining FROM pairs WHERE {_RESUME}",
    "per_entity_latest_n": "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k <= 3",
    "random_n_per_entity": "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY md5(o_orderkey::VARCHAR)) AS k FROM orders) WHERE k <= 2",
    "chunk_assignment": "SELECT o_custkey, o_orderkey, (row_number() OVER (ORDER BY o_custkey, o_orderkey DESC) - 1) // 1000 AS chunk FROM orders",
    "state_current": f"""WITH {LOG_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY article_id, company_id ORDER BY ts, event_id) AS k FROM log)
 SELECT article_id, company_id, arg_max(status, k) AS status, {_LAST("CASE WHEN status = 'ok' THEN note END", _ALL)}.v AS note, {_LAST("CASE WHEN status = 'ok' THEN justification END", _ALL)}.v AS justification,
 arg_max({{'v': CASE WHEN status <> 'not_evaluated' THEN version END}}, k).v AS version, {_LAST('extraction', "'ok'")}.v AS extraction FROM s GROUP BY article_id, company_id""",
    "collect_left_default": f"WITH {_REQ} SELECT custom_id, coalesce(status, 'failed') AS status, note FROM req LEFT JOIN res USING (custom_id)",
    "not_submitted_anti": f"WITH {_REQ} SELECT o_orderkey, custom_id FROM req WHERE custom_id NOT IN (SELECT custom_id FROM res)",
    "batch_progress": "SELECT CAST(o_orderkey // 1000 AS BIGINT) AS batch, count(*) FILTER (WHERE o_orderstatus = 'F') AS succeeded, count(*) FILTER (WHERE o_orderstatus = 'O') AS processing, count(*) FILTER (WHERE o_orderstatus = 'P') AS errored, count(*) FILTER (WHERE o_orderstatus = 'O') = 0 AS ended FROM orders GROUP BY 1",
    "orphan_ids": "WITH p AS (SELECT DISTINCT l_orderkey * 2 AS a, l_suppkey + l_linenumber AS c FROM lineitem) SELECT 'a' || a || '-c' || c AS custom_id FROM p WHERE a NOT IN (SELECT o_orderkey FROM orders) OR c NOT IN (SELECT s_suppkey FROM supplier)",
    "reload_last_wins": f"WITH r AS (SELECT {', '.join(_RELOAD)} FROM lineitem) SELECT article_id, company_id, CASE note_text WHEN '+1' THEN 1 ELSE CAST(note_text AS INT) END AS note FROM (SELECT *, row_number() OVER (PARTITION BY article_id, company_id ORDER BY file DESC, line DESC, CAST(replace(note_text, '+', '') AS INT) DESC) AS k FROM r WHERE note_text IN ('0', '1', '2', '+1')) WHERE k = 1",
    "entities_by_article_view": "SELECT o_orderkey, l_linenumber, s_name, CAST(l_quantity AS BIGINT) AS nbocc FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN supplier ON l_suppkey = s_suppkey",
    "sectors_by_article_view": "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
    "ok_notes_view": f"WITH {RATINGS_SQL} SELECT article_id, line, company_id, nbocc, r1, r2, r3, version_r1 FROM ratings WHERE status_r1 = 'ok'",
    "progress_by_status": f"WITH {RATINGS_SQL} SELECT status_r1 AS status, version_r1 AS version, count(*) AS n FROM ratings GROUP BY 1, 2",
    "stub_rater": "WITH c AS (SELECT 'a' || conv_id || '-c' || turn AS custom_id, CAST((coalesce(length(text), 0) + coalesce(length(role), 0)) % 4 AS INT) AS k FROM conversations) SELECT custom_id, CASE WHEN k < 3 THEN 'ok' ELSE 'failed' END AS status, CASE WHEN k < 3 THEN k END AS note, CASE WHEN k < 3 THEN 'v7' END AS justification FROM c",
    "streaming_collect": "SELECT 'a' || event_id || '-c' || user_id AS custom_id, CASE WHEN event_type <> 'error' AND event_id % 4 < 3 THEN 'ok' ELSE 'failed' END AS status, CASE WHEN event_type <> 'error' AND event_id % 4 < 3 THEN CAST(event_id % 4 AS INT) END AS note, CASE WHEN event_type = 'error' THEN 'errored' END AS problem FROM events",
}
