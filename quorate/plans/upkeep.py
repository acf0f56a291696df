"""Queries on what is kept up to date: counts after edits, the log as versions, the history of prompts, sentence ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.operators import boundaries, prompts, recount, state
from quorate.operators import mentions as M
from quorate.operators.snapshots import VersionedLog
from quorate.sources.shared import saved, scratch, table

from .stand_ins import LOG_SQL, inline, log

# Counts after edits of texts, terms and links.

TERMS_BEFORE = [(1, "the"), (1, "and"), (2, "die"), (2, "of the"), (3, "que"), (4, "les"), (5, "of")]
TERMS_AFTER = [(1, "the"), (1, "and"), (2, "die"), (3, "que"), (3, "los"), (4, "les"), (5, "of")]
_BEFORE = "SELECT doc_id, CASE CAST(doc_id % 9 AS INT) WHEN 0 THEN 'les les' WHEN 1 THEN NULL ELSE text END AS text FROM documents WHERE doc_id % 13 <> 0"
_AFTER = "SELECT doc_id, CASE CAST(doc_id % 11 AS INT) WHEN 0 THEN 'no company' ELSE text END AS text FROM documents"
_LINKS = "SELECT doc_id, CAST(1 + (doc_id + k) % 5 AS INT) AS company_id FROM documents, (VALUES (0), (1), (3)) v(k)"


def edited(spark: SparkSession, sf_dir: str) -> tuple[dict, dict]:
    """Texts, terms and links before and after: texts that come, go and change, terms that come and go, new links."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    ask = lambda sql: spark.sql(sql.replace("FROM documents", "FROM {d}"), d=documents)
    terms = lambda rows: inline(spark, rows, "company_id int, term string")
    links = ask(_LINKS)
    before = {"texts": ask(_BEFORE), "terms": terms(TERMS_BEFORE), "links": links.where("(doc_id + company_id) % 4 > 0")}
    return before, {"texts": ask(_AFTER), "terms": terms(TERMS_AFTER), "links": links}


def mention_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = edited(spark, sf_dir)
    known = saved(M.linked(M.count_alternation(before["texts"], before["terms"]), before["links"], ["doc_id", "company_id"]))
    return recount.recount(before, after, known)


def mention_reset_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of pairs once the classifier's notes are there and the recount has reset what it changed, to 0 too."""
    before, after = edited(spark, sf_dir)
    known = saved(M.linked(M.count_alternation(before["texts"], before["terms"]), before["links"], ["doc_id", "company_id"]))
    day = lambda d: F.lit(d).cast("date")
    first = state.counted_events(known.withColumn("nbocc", F.col("nbocc").cast("int")), day("2024-01-01")).withColumn("seq", F.lit(1))
    notes = known.select("doc_id", "company_id", F.lit("classified").alias("event"), F.lit(2).alias("note_tfidf"), F.lit(1).alias("note_targeted"), F.lit(2).alias("note_full"), day("2024-02-01").alias("date_estim"), F.lit(2).alias("seq"))
    again = state.counted_events(recount.recount(before, after, known).drop("was").withColumn("nbocc", F.col("nbocc").cast("int")), day("2024-03-01")).withColumn("seq", F.lit(3))
    return state.pair_state(first.unionByName(notes, allowMissingColumns=True).unionByName(again), ["doc_id", "company_id"], F.col("seq"))


# The log as versions.


def versioned(spark: SparkSession, sf_dir: str) -> VersionedLog:
    """Four deltas of the log's events, dealt by type, with compactions between them and after."""
    at = VersionedLog(spark, scratch(spark), ["article_id", "company_id"], "event_id")
    events = log(spark, sf_dir).drop("ts")
    for k in range(4):
        at.append(events.where(F.pmod(F.col("event_id"), F.lit(4)) == k))
        if k % 2:
            at.compact()
    return at


def state_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state as of the last version, and as of the first one, before any compaction."""
    at = versioned(spark, sf_dir)
    last = at.state().withColumn("as_of", F.lit("last"))
    return last.unionByName(at.state(1).withColumn("as_of", F.lit("first")))


# Prompts.

_EDITS = [
    "concat('v', CAST(n_nationkey % 4 AS {str})) AS version", "concat('Rate {{entreprise}} as in region ', CAST(n_regionkey AS {str}), ': {{article}}') AS template",
    "CAST('2024-01-01' AS TIMESTAMP) + n_nationkey * INTERVAL '1' DAY AS since",
]


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as evaluations in one of five versions, at times within and before the edits of nations as prompts."""
    edits = table(spark, sf_dir, "nation").selectExpr(*[x.format(str="STRING") for x in _EDITS])
    made = table(spark, sf_dir, "events").selectExpr("event_id", "concat('v', CAST(event_id % 5 AS STRING)) AS version", "CAST('2023-12-28' AS TIMESTAMP) + CAST(event_id % 30 AS INT) * INTERVAL '1' DAY + CAST(event_id % 24 AS INT) * INTERVAL '1' HOUR AS at")
    return prompts.as_of(made, prompts.history(edits))


def prompt_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluated(spark, sf_dir).select("event_id", "version", "template_md5", F.date_format("prompt_since", "yyyy-MM-dd").alias("prompt_since"))


# Sentence ends.


def corpus_abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = boundaries.abbreviations(boundaries.word_types(table(spark, sf_dir, "documents")))
    return found.select("type", "dotted", "plain", F.round("score", 6).alias("score"))


def corpus_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = saved(boundaries.abbreviations(boundaries.word_types(d)))
    return boundaries.sentences(d, known).select("doc_id", "pos", "n", F.md5("sentence").alias("sentence_md5"))


QUERIES = {
    "mention_increments": mention_increments,
    "mention_reset_state": mention_reset_state,
    "state_snapshots": state_snapshots,
    "prompt_history": prompt_history,
    "prompt_rewordings": lambda s, d: prompts.reworded(evaluated(s, d)),
    "corpus_abbreviations": corpus_abbreviations,
    "corpus_sentences": corpus_sentences,
}

_MARKED = lambda texts, name: rf"{name} AS (SELECT doc_id, regexp_replace(lower(text), '([\p{{L}}\p{{M}}\p{{N}}_]+)', chr(1) || '\1' || chr(2), 'g') AS t FROM ({texts}))"
_WORD = lambda *w: " || ' ' || ".join(f"chr(1) || '{x}' || chr(2)" for x in w)
# Terms of these companies cannot overlap, so that each is counted by itself.
_COUNT = lambda rows, name: ", ".join(f"({c}, {_WORD(*t.split())})" for c, t in rows)
_COUNTED = lambda texts, rows, name: f"{_MARKED(texts, name + '_m')}, {name} AS (SELECT doc_id, company_id, sum((length(t) - length(replace(t, term, ''))) // length(term)) AS nbocc FROM {name}_m, (VALUES {_COUNT(rows, name)}) v(company_id, term) WHERE t IS NOT NULL GROUP BY ALL)"
_INCREMENTS = f"""WITH {_COUNTED(_BEFORE, TERMS_BEFORE, 'o')}, {_COUNTED(_AFTER, TERMS_AFTER, 'a')}, links AS ({_LINKS}),
 was AS (SELECT doc_id, company_id, CAST(coalesce(nbocc, 0) AS BIGINT) AS was FROM links LEFT JOIN o USING (doc_id, company_id) WHERE (doc_id + company_id) % 4 > 0),
 now AS (SELECT doc_id, company_id, CAST(coalesce(nbocc, 0) AS BIGINT) AS nbocc FROM links LEFT JOIN a USING (doc_id, company_id)),
 changes AS (SELECT doc_id, company_id, nbocc, was FROM now LEFT JOIN was USING (doc_id, company_id) WHERE nbocc IS DISTINCT FROM was)"""
_STATE = """SELECT article_id, company_id, arg_max(status, event_id) AS status, (arg_max({{'v': CASE WHEN status NOT IN ('failed', 'not_evaluated') THEN note END}}, event_id) FILTER (WHERE status <> 'submitted')).v AS note,
 (arg_max({{'v': CASE WHEN status NOT IN ('failed', 'not_evaluated') THEN justification END}}, event_id) FILTER (WHERE status <> 'submitted')).v AS justification, (arg_max({{'v': CASE WHEN status <> 'not_evaluated' THEN version END}}, event_id)).v AS version,
 arg_max(extraction, event_id) FILTER (WHERE status = 'ok') AS extraction, '{name}' AS as_of FROM log {where} GROUP BY 1, 2"""
_AS_OF = f"""WITH edits AS (SELECT {', '.join(x.format(str='VARCHAR') for x in _EDITS)} FROM nation), lagged AS (SELECT *, lag(template) OVER (PARTITION BY version ORDER BY since) AS prior FROM edits),
 spans AS (SELECT version, md5(template) AS template_md5, since, lead(since) OVER (PARTITION BY version ORDER BY since) AS until FROM lagged WHERE template IS DISTINCT FROM prior),
 made AS (SELECT event_id, 'v' || (event_id % 5) AS version, TIMESTAMP '2023-12-28' + to_days(CAST(event_id % 30 AS INT)) + to_hours(event_id % 24) AS made_at FROM events),
 e AS (SELECT event_id, m.version, template_md5, strftime(since, '%Y-%m-%d') AS prompt_since FROM made m LEFT JOIN spans s ON m.version = s.version AND made_at >= since AND (until IS NULL OR made_at < until))"""
_BARE = r"regexp_replace(lower({x}), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}.]+$', '', 'g')"
_TYPES = rf"""t AS (SELECT {_BARE.format(x='x')} AS b FROM (SELECT unnest(string_split_regex(text, '[ \t\n\x0B\f\r]+')) AS x FROM documents WHERE text IS NOT NULL)),
 types AS (SELECT regexp_replace(b, '\.$', '') AS type, count(*) FILTER (WHERE ends_with(b, '.')) AS dotted, count(*) FILTER (WHERE NOT ends_with(b, '.')) AS plain FROM t GROUP BY 1 HAVING length(type) > 0),
 total AS (SELECT sum(dotted)::DOUBLE / sum(dotted + plain)::DOUBLE AS p FROM types),
 parts AS (SELECT *, length(type) - length(replace(type, '.', '')) AS dots, dotted::DOUBLE AS a, plain::DOUBLE AS b FROM types, total),
 scores AS (SELECT type, dotted, plain, -2 * (a * ln(p) + b * ln(1 - p) - a * ln(0.99::DOUBLE) - b * ln(1 - 0.99::DOUBLE)) * exp(dots - length(type)) * (dots + 1) * pow((length(type) - dots)::DOUBLE, -b) AS score FROM parts WHERE dotted > 0 AND regexp_matches(type, '\p{{L}}')),
 abbreviations AS (SELECT * FROM scores WHERE score >= 0.3)"""

ORACLE_SQL = {
    "mention_increments": f"{_INCREMENTS} SELECT * FROM changes",
    "mention_reset_state": f"""{_INCREMENTS}, pairs AS (SELECT doc_id, company_id, w.was, c.nbocc AS again FROM was w FULL JOIN changes c USING (doc_id, company_id))
 SELECT doc_id, company_id, CAST(coalesce(again, was) AS INT) AS nbocc, CASE WHEN again IS NULL THEN 2 ELSE 0 END AS note_tfidf, CASE WHEN was IS NOT NULL THEN 1 END AS note_targeted, CASE WHEN again IS NULL THEN 2 ELSE 0 END AS note_full, CASE WHEN again IS NULL THEN DATE '2024-02-01' ELSE DATE '2024-03-01' END AS date_estim FROM pairs""",
    "state_snapshots": f"WITH {LOG_SQL} {_STATE.format(name='last', where='')} UNION ALL {_STATE.format(name='first', where='WHERE event_id % 4 = 0')}",
    "prompt_history": f"{_AS_OF} SELECT * FROM e",
    "prompt_rewordings": f"{_AS_OF} SELECT version, count(DISTINCT template_md5) AS texts, count(*) AS evaluations FROM e WHERE template_md5 IS NOT NULL GROUP BY 1 HAVING count(DISTINCT template_md5) > 1",
    "corpus_abbreviations": f"WITH {_TYPES} SELECT type, dotted, plain, round(score, 6) AS score FROM abbreviations",
    "corpus_sentences": rf"""WITH {_TYPES}, p AS (SELECT doc_id, generate_subscripts(s, 1) AS i, unnest(s) AS p, unnest(s[2:] || [NULL]) AS q FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])([ \t\n\x0B\f\r])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS s FROM documents WHERE text IS NOT NULL)),
 l AS (SELECT *, regexp_replace({_BARE.format(x="list_last(string_split_regex(rtrim(p), '[ \t\n\x0B\f\r]+'))")}, '\.$', '') AS type FROM p),
 g AS (SELECT doc_id, i, p, ends_with(p, '.') AND (type IN (SELECT type FROM abbreviations) OR regexp_matches(type, '^\p{{L}}$') OR coalesce(regexp_matches(q, '^[ \t\n\x0B\f\r]+\p{{Ll}}'), false)) AS goes_on FROM l),
 k AS (SELECT *, coalesce(sum((NOT goes_on)::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM g),
 s AS (SELECT doc_id, k, regexp_replace(string_agg(p, '' ORDER BY i), '^[ \t\n\x0B\f\r]+', '') AS sentence FROM k GROUP BY ALL HAVING sentence <> '')
 SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS pos, CAST(count(*) OVER (PARTITION BY doc_id) AS INT) AS n, md5(sentence) AS sentence_md5 FROM s""",
}
