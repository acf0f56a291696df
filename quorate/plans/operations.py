"""Queries on what a run does: result files and their reload, the ledger of batches, classifiers, events of the log."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.config import EngineConfig
from quorate.functions.answers import final_note
from quorate.functions.text import custom_id
from quorate.operators import classify, raters, reload, state
from quorate.operators import mentions as M
from quorate.operators import selection as S
from quorate.operators.ledger import BatchFailed, Ledger
from quorate.sources import files
from quorate.sources.shared import file_system, scratch, table
from quorate.streaming import timed

from .stand_ins import FACTS_SQL, LOG_SQL, facts, inline, log

# Mentions on terms of several words, with other characters, that begin like another, or differ in case alone.

REAL_NAMES = [(1, "La"), (2, "of the"), (3, "mail2.example"), (4, "x&y"), (5, "By-NC"), (6, "Orre"), (7, "2."), (8, "The")]
REAL_ALIASES = [(1, "la de"), (1, "LA"), (2, "Of The"), (2, "the of"), (6, "orre orre"), (6, "orre"), (7, "2.0"), (8, "the"), (8, "und")]


def real_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.when(F.col("doc_id") % 7 == 0, F.lit(" X&Y, x&y.")).otherwise(F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("text", mark).alias("text"))


def real_terms(spark: SparkSession, fold: bool) -> DataFrame:
    return M.term_table(inline(spark, REAL_NAMES, "company_id int, name string"), inline(spark, REAL_ALIASES, "company_id int, alias string"), fold)


def alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as companies; the dictionary has customers as their aliases, under the name as it stands or nearly so."""
    n = table(spark, sf_dir, "nation")
    names = n.select(F.col("n_nationkey").alias("company_id"), F.col("n_name").alias("name"))
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    kind = F.col("c_custkey") % 4
    shown = F.when(kind == 0, F.col("n_name")).when(kind == 1, F.concat(F.lit(" "), F.lower("n_name"))).when(kind == 2, F.concat("n_name", F.lit("  "))).otherwise(F.concat("n_name", F.lit("x")))
    d = c.select(shown.alias("name"), F.col("c_name").alias("alias"))
    exact = M.own_aliases(names, d).withColumn("lookup", F.lit("exact"))
    return exact.unionByName(M.own_aliases(names, d, exact=False).withColumn("lookup", F.lit("folded")))


# Result files: written under several names, read back, reloaded.

_SHOWN = "CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN s_name WHEN 1 THEN concat('  ', lower(s_name)) ELSE 'Nobody' END"
_GOT = "CASE CAST(o_orderkey % 8 AS INT) WHEN 0 THEN '0' WHEN 1 THEN ' 1 ' WHEN 2 THEN '+2' WHEN 3 THEN '1.0' WHEN 4 THEN '3' WHEN 5 THEN '' WHEN 6 THEN '2' ELSE '-1' END"
_WHY = "concat('say \"', {key}, '\",', chr(10), 'line ', {file})"
#: Name of each file, which orders it has, and what it calls its note column.
FILES = [("mes_resultats_haiku_1.csv", 9, "note_llm"), ("resultat_qwen_v3_b.csv", 2, "note_llm"), ("resultats_haiku_V4 50%.csv", 1, "note_llm"), ("resultats_haiku_V4_2.csv", 3, "note_llm"), ("resultats_llm_2024.csv", 5, "note")]


def written_results(spark: SparkSession, sf_dir: str) -> str:
    """The result files of FILES, of orders as articles and suppliers as companies: each a folder that all tasks write."""
    at = f"{scratch(spark)} a b"
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    o = table(spark, sf_dir, "orders").join(s, F.col("o_orderkey") % 40 + 1 == F.col("s_suppkey"))
    for name, k, note in FILES:
        why = _WHY.format(key="CAST(o_orderkey AS STRING)", file=f"'{k}'")
        cells = ["CAST(o_orderkey AS STRING) AS article_id", f"{_SHOWN} AS entreprise", "'v4' AS prompt_version", "'ok' AS statut", f"{_GOT} AS {note}", f"{why} AS justification"]
        rows = o.where(F.col("o_orderkey") % k == 0).selectExpr(*(cells if k != 2 else cells[::-1]))
        rows.write.csv(f"{at}/{name}", header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return at


def judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    at = written_results(spark, sf_dir)
    paths = files.resolved(spark, [f"{at}/resultats_*.csv", f"{at}/*.csv", f"{at}/none_*.csv"])
    companies = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("company_id"), F.col("s_name").alias("name"))
    twice = companies.where("company_id = 5").withColumn("company_id", F.lit(1005).cast("long"))
    links = table(spark, sf_dir, "orders").where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("article_id"), (F.col("o_orderkey") % 40 + 1).alias("company_id"))
    return files.result_files(spark, paths), reload.judged(files.read_results(spark, paths), companies.unionByName(twice), links)


def reload_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reload.updates(judged(spark, sf_dir)[1])


def reload_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen, rows = judged(spark, sf_dir)
    rows = reload.outcomes(rows)
    dry = reload.tally(seen, rows, dry_run=True).select("file", F.col("updated").alias("would_update"))
    return reload.tally(seen, rows).join(dry, "file")


def results_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch(spark)
    c = table(spark, sf_dir, "conversations")
    text = F.concat(F.lit('a "quoted", '), F.coalesce("text", F.lit("")), F.lit("\nend "))
    cells = {"article_id": F.col("conv_id").cast("string"), "entreprise": F.col("turn").cast("string"), "justification": text, "note_llm": (F.col("conv_id") % 3).cast("string")}
    rows = c.select(*[cells.get(k, F.lit("v")).alias(k) for k in files.RESULT_COLUMNS])
    files.write_results(rows.where("CAST(article_id AS LONG) % 2 = 0"), f"{at}/r")
    files.write_results(rows.where("CAST(article_id AS LONG) % 2 = 1"), f"{at}/r")
    back = files.read_columns(spark, files.resolved(spark, [f"{at}/r/part-*"]), list(files.RESULT_COLUMNS), files.RESULT_COLUMNS)
    return back.select(F.col("article_id").cast("long").alias("conv_id"), F.col("entreprise").cast("long").alias("turn"), "note_llm", F.md5("justification").alias("why_md5"))


def alias_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch(spark)
    files.write_aliases(table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.concat(F.lit(" "), F.col("p_type")).alias("alias")), f"{at}/a")
    none = files.read_aliases(spark, f"{at}/missing.json")
    return files.read_aliases(spark, f"{at}/a").unionByName(none).groupBy("name").agg(F.count("*").alias("n"), F.min("alias").alias("first"), F.max("alias").alias("last"))


def request_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch(spark)
    c = table(spark, sf_dir, "conversations").select(custom_id(F.col("conv_id"), F.col("turn")).alias("custom_id"), F.coalesce("text", F.lit("")).alias("text"))
    files.write_requests(c, f"{at}/q")
    back = files.read_requests(spark, f"{at}/q", "custom_id string, text string")
    lines = back.select(F.to_json(F.struct(F.col("custom_id").alias("key"), F.struct(F.array(F.struct(F.struct(F.array(F.struct(F.substring("text", 1, 9).alias("text")), F.struct(F.lit("|").alias("text"))).alias("parts")).alias("content"))).alias("candidates")).alias("response"))).alias("value"))
    return files.read_chat_lines(lines).select("custom_id", "raw", "problem")


def dump_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two dumps, each with two tables, written from suppliers and nations; one table read from both."""
    at = scratch(spark)
    s = table(spark, sf_dir, "supplier")
    for half in (0, 1):
        rows = s.where(F.col("s_suppkey") % 2 == half).select(F.concat_ws("\t", F.col("s_suppkey").cast("string"), F.concat("s_name", F.lit("\\tTab\\\\")), F.when(F.col("s_nationkey") == 3, "\\N").otherwise(F.col("s_nationkey").cast("string"))).alias("v"), F.lit(1).alias("k"))
        other = table(spark, sf_dir, "nation").select(F.concat_ws("\t", F.col("n_nationkey").cast("string"), "n_name").alias("v"), F.lit(4).alias("k"))
        marks = inline(spark, [("SET x = 0;", -1), ("COPY public.suppliers (id, name, nation) FROM stdin;", 0), ("\\.", 2), ("COPY public.nations (id, name) FROM stdin;", 3), ("\\.", 5), ("SELECT 1;", 6)], "v string, k int")
        lines = rows.unionByName(other).unionByName(marks).repartitionByRange(1, "k").sortWithinPartitions("k")
        lines.select(F.col("v").alias("value")).write.text(f"{at}/dump{half}")
    return files.read_dump(spark, f"{at}/dump*/part-*", "suppliers", ["id", "name", "nation"])


# The ledger.


def arrow_frame(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    names = ("batch_id", "custom_id", "raw")
    return spark.createDataFrame(pa.table({n: pa.array((r[k] for r in rows), pa.string(), size=len(rows)) for k, n in enumerate(names)}))


class ScriptedRater:
    """A batch rater without a service: a chunk fails from `fails_at` on, statuses and results follow from the ids."""

    def __init__(self, fails_at: int | None = None, name: str = "b") -> None:
        self.calls, self.asked, self.fails_at, self.name = {}, {}, fails_at, name

    def submit(self, requests: list[dict], version: str, key: str) -> str:
        if len(self.calls) == self.fails_at:
            raise BatchFailed("quota")
        batch = f"{self.name}{len(self.calls) + 1}"
        self.asked[batch] = [r["custom_id"] for r in requests]
        self.calls[key] = (batch, self.asked[batch])
        return batch

    def sent(self, key: str) -> str | None:
        return self.calls.get(key, (None,))[0]

    def status(self, batch_id: str) -> str:
        k = int(batch_id.lstrip("bo"))
        if k == 2:
            raise BatchFailed("expired")
        return "in_progress" if k == 3 else "ended"

    def answers(self, batch_id: str) -> list[tuple[str, str, str]]:
        if batch_id == "b4":
            raise BatchFailed("not now")
        notes = [(i, int(i[1:].partition("-")[0]) % 5) for i in [*self.asked.get(batch_id, []), "a999999999999-c0"]]
        return [(batch_id, i, f'{{"note_llm":{k},"justification":"j"}}') for i, k in notes if k < 4]

    def results(self, spark: SparkSession, batch_id: str) -> DataFrame:
        return arrow_frame(spark, self.answers(batch_id)).drop("batch_id")

    def results_of(self, spark: SparkSession, batch_ids: list[str]) -> tuple[DataFrame, list[str]]:
        rows, had = [], []
        for batch in batch_ids:
            try:
                rows += self.answers(batch)
                had.append(batch)
            except BatchFailed:
                continue
        return arrow_frame(spark, rows), had

    def cancel(self, batch_id: str) -> None:
        if batch_id == "b5":
            raise BatchFailed("too late")


def submitted(spark: SparkSession, sf_dir: str, fails_at: int | None = None) -> tuple[Ledger, ScriptedRater]:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("article_id"), (F.col("o_orderkey") % 10).alias("company_id"))
    o = S.chunks(o.withColumn("one", F.lit(1)), "one", "article_id", EngineConfig().overlaid({"BATCH_TAILLE_MAX": "1000"}).batch_size)
    q = o.select(custom_id(F.col("article_id"), F.col("company_id")).alias("custom_id"), "article_id", "company_id", F.col("company_id").cast("string").alias("company"), F.lit("t").alias("text"), "chunk")
    ledger, rater = Ledger(spark, scratch(spark)), ScriptedRater(fails_at)
    ledger.submit(q, "scripted", rater, "v4")
    return ledger, rater


def ledger_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a refusal of the fourth chunk leaves; one of the first leaves nothing."""
    ledger, _ = submitted(spark, sf_dir, fails_at=3)
    empty, _ = submitted(spark, sf_dir, fails_at=0)
    rows = ledger.requests().join(ledger.batches(), "batch_id", "left").select("custom_id", "batch_id", "state")
    return rows.unionByName(empty.requests().select("custom_id", "batch_id", F.lit("none").alias("state")))


def ledger_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collecting twice: what ended is written once, a failed batch fails its requests, two batches wait on."""
    ledger, rater = submitted(spark, sf_dir)
    at = scratch(spark)
    if (ledger.collect(rater, at), ledger.collect(rater, at), ledger.waiting().count()) != (len(rater.calls) - 2, 0, 2):
        raise AssertionError("a batch was collected twice, or not at all")
    return spark.read.parquet(at).select("article_id", "batch_id", "status", "note", "version")


def ledger_cancel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches by what became of them, some collected, some cancelled, and how many requests are to be submitted again."""
    ledger, rater = submitted(spark, sf_dir)
    ledger.collect(rater, scratch(spark))
    ledger.cancel(rater)
    again = ledger.not_submitted().agg(F.lit("again").alias("state"), F.count("*").alias("requests"), F.lit(0).cast("long").alias("batches"))
    return ledger.report().groupBy("state").agg(F.sum("requests").alias("requests"), F.count("*").alias("batches")).unionByName(again)


def ledger_adopt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan batches from the rater's own lists: an id in two of them, some without an article, some malformed."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a"))
    one = F.when(F.col("a") % 50 == 0, F.concat(F.lit("x"), F.col("a").cast("string"))).otherwise(custom_id(F.col("a"), F.col("a") % 10))
    listed = o.select(F.lit("o1").alias("batch_id"), one.alias("custom_id"), F.lit(0).alias("ord")).unionAll(o.where("a % 3 = 0").select(F.lit("o2"), one, F.lit(1)))
    articles = o.where("a % 7 <> 0").select(F.col("a").alias("article_id"), (F.col("a") % 10).alias("company_id"), F.lit("c").alias("company"), F.lit("t").alias("text"))
    ledger = Ledger(spark, scratch(spark))
    ledger.adopt(listed, articles, "scripted", "v2")
    rows = ledger.requests().select("custom_id", "batch_id", F.lit("request").alias("kind"))
    rows = rows.unionByName(ledger.without_request().withColumn("kind", F.lit("no article")))
    count = F.concat_ws(" ", F.col("state"), F.col("requests").cast("string"), F.col("without_request").cast("string"))
    return rows.unionByName(ledger.report().select(count.alias("custom_id"), "batch_id", F.lit("batch").alias("kind")))


def timed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of orders as a stream: two of three requests have results, every other batch ends and fails what it owes."""
    at = scratch(spark)
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("b"), (F.col("o_custkey") % 50).cast("string")).alias("batch_id"), F.concat(F.lit("a"), F.col("o_orderkey").cast("string")).alias("custom_id"), (F.col("o_orderkey") % 3).cast("int").alias("k"), "o_custkey")
    none = lambda t: F.lit(None).cast(t)
    asked = o.select("batch_id", F.lit("submitted").alias("kind"), "custom_id", none("string").alias("status"), none("int").alias("note"))
    results = o.where("k > 0").select("batch_id", F.lit("result").alias("kind"), "custom_id", F.lit("ok").alias("status"), F.col("k").alias("note"))
    ends = o.where("o_custkey % 2 = 0").select("batch_id", F.lit("ended").alias("kind"), none("string").alias("custom_id"), none("string").alias("status"), none("int").alias("note")).distinct()
    asked.unionByName(results).unionByName(ends).write.json(f"{at}/in")
    stream = spark.readStream.schema(timed.EVENT).json(f"{at}/in")
    store = spark.conf.get(timed.STORE[0], None)
    try:
        timed.watch(stream, f"{at}/log", f"{at}/stream", EngineConfig(), once=True).awaitTermination()
    finally:
        if store:
            spark.conf.set(timed.STORE[0], store)
        else:
            spark.conf.unset(timed.STORE[0])
    return spark.read.schema(timed.OUTCOME).parquet(f"{at}/log")


# Classifiers, and events of counts, notes, reloads and new scores.


def classifier_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pair_id"), F.when(F.col("doc_id") % 3 == 0, "Que title").when(F.col("doc_id") % 3 == 1, "").alias("title"), F.col("text").alias("content"), F.lit("que").alias("name"))


def classifier_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classified(classifier_pairs(spark, sf_dir), "length").select("pair_id", "kind", "note_tfidf", "note_targeted", "note_full", F.md5("resume").alias("resume_md5"))


def comparison_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both classifiers' notes, written as a comparison file and read back."""
    at = scratch(spark)
    pairs = classifier_pairs(spark, sf_dir).withColumns({"article_id": F.col("pair_id"), "company_id": F.col("pair_id") % 3})
    files.write_results(classify.comparison(pairs, "length", "length"), at, files.COMPARISON_COLUMNS)
    back = files.read_columns(spark, files.resolved(spark, [f"{at}/part-*"]), list(files.COMPARISON_COLUMNS), files.COMPARISON_COLUMNS)
    whole = [k for k in files.COMPARISON_COLUMNS if k.startswith(("article", "company_id", "note", "divergence"))]
    return back.select(*[F.col(k).cast("long").alias(k) if k in whole else F.col(k) for k in files.COMPARISON_COLUMNS])


def classifier_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(custom_id(F.col("conv_id"), F.col("turn")).alias("id"), F.when(F.col("conv_id") % 9 == 0, " \n ").when(F.col("conv_id") % 9 > 1, F.col("text")).alias("text"))
    return classify.labelled(c, "text", "length").select("id", "label", "note", "confidence")


def classifier_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("conv_id % 9 < 2").select(custom_id(F.col("conv_id"), F.col("turn")).alias("id"), F.when(F.col("conv_id") % 9 == 0, " \n ").alias("text"))
    return classify.sentiment(c, "id", "text", "length")


def classifier_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with more than two mentions, the newest five of each company, unknown dates last."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("company_id"), "l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("nbocc"), F.when(F.col("l_orderkey") % 4 != 0, F.col("l_shipdate")).alias("published_at"))
    return S.latest(l.where(F.col("nbocc") >= EngineConfig().classifier_mentions), "company_id", [F.desc_nulls_last("published_at"), F.desc("l_orderkey"), F.desc("l_linenumber")], 5)


_PAIR_LOG = [
    "CAST(event_id % 60 AS INT) AS article_id", "user_id AS company_id", "event_id",
    "CASE WHEN event_id % 3 = 0 THEN 'counted' ELSE 'classified' END AS event", "CAST(event_id % 9 AS INT) AS n",
]


def pair_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").selectExpr(*_PAIR_LOG)
    counts = state.counted_events(e.where("event = 'counted'").select("article_id", "company_id", "event_id", F.col("n").alias("nbocc")), F.lit("2024-05-01").cast("date"))
    notes = e.where("event = 'classified'").select("article_id", "company_id", "event_id", (F.col("n") % 3).alias("note_tfidf"), F.when(F.col("n") % 2 == 0, classify.NOT_ASKED).otherwise(F.col("n") % 3).alias("note_targeted"), (F.col("n") % 2).alias("note_full"))
    events = counts.unionByName(classify.classified_events(notes, F.lit("2024-06-01").cast("date")), allowMissingColumns=True)
    return state.pair_state(events, ["article_id", "company_id"], F.col("event_id"))


def state_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of state_current with reloads (notes alone) and new scores of what changes, folded together."""
    base = log(spark, sf_dir).select("article_id", "company_id", "event_id", "status", "note", "justification", "version")
    again = base.where("event_id % 5 = 0").select("article_id", "company_id", (F.col("event_id") + 1_000_000).alias("event_id"), F.lit("reloaded").alias("status"), (F.col("event_id") % 3).cast("int").alias("note"), F.lit("r").alias("justification"), F.lit(None).cast("string").alias("version"))
    f = facts(spark, sf_dir).select(F.col("event_id").alias("fid"), "variation", "other_fact", "sense")
    pairs = base.where("event_id % 4 = 1 AND status = 'ok'").join(f, F.col("event_id") == F.col("fid"))
    scored = state.rescored_events(pairs, final_note(F.col("note"), F.col("variation"), F.col("other_fact"), F.col("sense")))
    scored = scored.select("article_id", "company_id", (F.col("event_id") + 2_000_000).alias("event_id"), "status", "note", F.lit(None).cast("string").alias("justification"), F.lit(None).cast("string").alias("version"))
    return state.current(base.unionByName(again).unionByName(scored), ["article_id", "company_id"], F.col("event_id"))


def random_long_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where(F.length("text") > 100).select("source", "doc_id")
    return S.latest(d, "source", [F.md5(F.col("doc_id").cast("string"))], 50)


def rescorable_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rescorable(log(spark, sf_dir), F.col("status"), F.col("extraction")).select("article_id", "company_id", "event_id", "note")


def work_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs a run takes: resuming, with resumption switched off, and without a target version."""
    p = log(spark, sf_dir)
    runs = {"resume": EngineConfig(version="v4"), "off": EngineConfig(version="v4").overlaid({"REPRENDRE": "False"}), "no version": EngineConfig()}
    out = [S.work(p, F.col("status"), F.col("version"), c.version, c.resume).agg(F.lit(k).alias("run"), F.count("*").alias("n")) for k, c in runs.items()]
    return out[0].unionAll(out[1]).unionAll(out[2])


def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ok, failed and filtered of a run over conversations, a pair with less than two mentions being filtered."""
    c = table(spark, sf_dir, "conversations").select(custom_id(F.col("conv_id"), F.col("turn")).alias("custom_id"), F.coalesce("role", F.lit("")).alias("company"), "text", (F.col("conv_id") % 4).alias("nbocc"))
    kept = c.where(F.col("nbocc") >= EngineConfig().least_mentions)
    rated = raters.rate(kept, "sign", "v7").select("status")
    return rated.unionAll(c.where(F.col("nbocc") < EngineConfig().least_mentions).select(F.lit("filtered"))).groupBy("status").agg(F.count("*").alias("n"))


def version_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("v"), (F.col("event_id") % 5).cast("string")).alias("version"), F.element_at(F.array(F.lit("bench_V2.csv"), F.lit("bench-v4.csv"), F.lit("bench.csv")), (F.col("event_id") % 3 + 1).cast("int")).alias("file"))
    return files.of_version(e, F.col("version"), F.col("file")).select("event_id", "version", "file")


QUERIES = {
    "mentions_of_phrases_sum": lambda s, d: M.count_sum(real_texts(s, d), real_terms(s, False)),
    "mentions_of_phrases_alternation": lambda s, d: M.count_alternation(real_texts(s, d), real_terms(s, True)),
    "alias_lookup": alias_lookup,
    "reload_notes": reload_notes,
    "reload_tally": reload_tally,
    "results_roundtrip": results_roundtrip,
    "alias_roundtrip": alias_roundtrip,
    "request_lines": request_lines,
    "dump_scan": dump_scan,
    "ledger_partial": ledger_partial,
    "ledger_collect": ledger_collect,
    "ledger_cancel": ledger_cancel,
    "ledger_adopt": ledger_adopt,
    "timed_batches": timed_batches,
    "classifier_notes": classifier_notes,
    "comparison_file": comparison_file,
    "classifier_labels": classifier_labels,
    "classifier_blanks": classifier_blanks,
    "classifier_worklist": classifier_worklist,
    "pair_state": pair_state,
    "state_after_changes": state_after_changes,
    "random_long_per_source": random_long_per_source,
    "rescorable_pairs": rescorable_pairs,
    "work_switches": work_switches,
    "run_totals": run_totals,
    "version_filter": version_filter,
}

_W = r"[\p{L}\p{M}\p{N}_]"
# Words between marks, so that a term with its marks is a plain string and needs no boundaries: chr(1) word chr(2).
_MARKED = rf"marked AS (SELECT doc_id, regexp_replace(lower(text || CASE WHEN doc_id % 7 = 0 THEN ' X&Y, x&y.' ELSE '' END), '({_W}+)', chr(1) || '\1' || chr(2), 'g') AS t FROM documents)"
_TERM = lambda *w: " || ".join(f"chr(1) || '{x}' || chr(2)" if x[0].isalnum() else f"'{x}'" for x in w)
_HITS = lambda text, *w: f"((length({text}) - length(replace({text}, {_TERM(*w)}, ''))) // length({_TERM(*w)}))"
_TWO = f"((length(t) - length(replace(t, {_TERM('2', '.')} || chr(1), ''))) // length({_TERM('2', '.')} || chr(1)))"
_EACH = {
    "la": _HITS("t", "la"), "la_de": _HITS("t", "la", " ", "de"), "of_the": _HITS("t", "of", " ", "the"), "the_of": _HITS("t", "the", " ", "of"), "mail": _HITS("t", "mail2", ".", "example"), "xy": _HITS("t", "x", "&", "y"), "nc": _HITS("t", "by", "-", "nc"),
    "orre": _HITS("t", "orre"), "orre2": _HITS("t", "orre", " ", "orre"), "two": _TWO, "two0": _HITS("t", "2", ".", "0"), "the": _HITS("t", "the"), "und": _HITS("t", "und"),
}
_COUNTED = f"WITH {_MARKED}, n AS (SELECT doc_id, t, {', '.join(f'{x} AS {k}' for k, x in _EACH.items())}, replace(t, {_TERM('la', ' ', 'de')}, '') AS no_la_de, replace(t, {_TERM('orre', ' ', 'orre')}, '') AS no_orre2, replace(t, {_TERM('2', '.', '0')}, '') AS no_two0 FROM marked)"
#: Without overlap, by the leftmost match; `of the of` has one of the two phrases.
_PHRASES = f"(SELECT count(*) FROM (SELECT unnest(regexp_extract_all(t, {_TERM('of', ' ', 'the')} || '|' || {_TERM('the', ' ', 'of')}))))"
_ROWS = lambda cells: " UNION ALL ".join(f"SELECT doc_id, {k} AS company_id, CAST({x} AS BIGINT) AS nbocc FROM n" for k, x in cells.items())
_JUDGED = f"""WITH f(file, k, ord, rater, usable) AS (VALUES ('resultats_haiku_V4 50%.csv', 1, 0, 'haiku', true), ('resultats_haiku_V4_2.csv', 3, 1, 'haiku', true), ('resultats_llm_2024.csv', 5, 2, 'lama', false), ('mes_resultats_haiku_1.csv', 9, 3, NULL, false), ('resultat_qwen_v3_b.csv', 2, 4, 'queen', true)),
 rows AS (SELECT f.*, o_orderkey AS a, o_orderkey % 40 + 1 AS c, o_orderkey % 3 AS shown, CASE o_orderkey % 8 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 6 THEN 2 END AS note, 'say "' || o_orderkey || '",' || chr(10) || 'line ' || k AS why
  FROM f JOIN orders ON o_orderkey % k = 0 JOIN supplier ON s_suppkey = o_orderkey % 40 + 1 WHERE usable),
 j AS (SELECT *, note IS NOT NULL AND shown < 2 AND c <> 5 AS would, note IS NOT NULL AND shown < 2 AND c <> 5 AND a % 5 <> 0 AS good FROM rows)"""
_REQ = "q AS (SELECT o_orderkey AS a, 'a' || o_orderkey || '-c' || (o_orderkey % 10) AS custom_id, 1 + (row_number() OVER (ORDER BY o_orderkey DESC) - 1) // 1000 AS b FROM orders)"
_FINAL = "CASE WHEN NOT (coalesce(NOT other_fact, false) AND coalesce(sense, 'aucune') = 'aucune') THEN note WHEN variation IS NULL OR abs(variation) < 5.0 THEN 1 WHEN variation > 0 THEN 2 ELSE 0 END"

ORACLE_SQL = {
    "mentions_of_phrases_sum": f"{_COUNTED} SELECT * FROM ({_ROWS({1: '2 * la + la_de', 2: '2 * of_the + the_of', 3: 'mail', 4: 'xy', 5: 'nc', 6: '2 * orre + orre2', 7: 'two + two0', 8: '2 * the + und'})}) WHERE nbocc > 0",
    "mentions_of_phrases_alternation": f"{_COUNTED} SELECT * FROM ({_ROWS({1: 'la_de + ' + _HITS('no_la_de', 'la'), 2: _PHRASES, 3: 'mail', 4: 'xy', 5: 'nc', 6: 'orre2 + ' + _HITS('no_orre2', 'orre'), 7: 'two0 + ' + _TWO.replace('(t', '(no_two0'), 8: 'the + und'})}) WHERE nbocc > 0",
    "alias_lookup": """WITH d AS (SELECT CASE c_custkey % 4 WHEN 0 THEN n_name WHEN 1 THEN ' ' || lower(n_name) WHEN 2 THEN n_name || '  ' ELSE n_name || 'x' END AS name, c_name AS alias FROM customer JOIN nation ON c_nationkey = n_nationkey)
 SELECT n_nationkey AS company_id, alias, 'exact' AS lookup FROM nation JOIN d ON n_name = d.name UNION ALL SELECT n_nationkey, alias, 'folded' FROM nation JOIN d ON upper(trim(n_name)) = upper(trim(d.name))""",
    "reload_notes": f"{_JUDGED} SELECT a AS article_id, c AS company_id, rater, CAST(arg_max(note, ord) AS INT) AS note, arg_max(why, ord) AS justification FROM j WHERE good GROUP BY 1, 2, 3",
    "reload_tally": f"{_JUDGED}, s AS (SELECT ord, count(*) AS r, count(*) FILTER (WHERE good) AS u, count(*) FILTER (WHERE would) AS w FROM j GROUP BY ord) SELECT file, coalesce(r, 0) AS \"read\", coalesce(u, 0) AS updated, CASE WHEN usable THEN coalesce(r - u, 0) ELSE 1 END AS skipped, coalesce(w, 0) AS would_update FROM f LEFT JOIN s USING (ord)",
    "results_roundtrip": "SELECT conv_id, turn, CAST(conv_id % 3 AS VARCHAR) AS note_llm, md5('a \"quoted\", ' || coalesce(text, '') || chr(10) || 'end ') AS why_md5 FROM conversations",
    "alias_roundtrip": "SELECT p_brand AS name, count(DISTINCT lower(trim(p_type))) AS n, min(lower(trim(p_type))) AS first, max(lower(trim(p_type))) AS last FROM part GROUP BY 1",
    "request_lines": "SELECT 'a' || conv_id || '-c' || turn AS custom_id, substring(coalesce(text, ''), 1, 9) || '|' AS raw, NULL::VARCHAR AS problem FROM conversations",
    "dump_scan": "SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name || chr(9) || 'Tab\\' AS name, CASE WHEN s_nationkey <> 3 THEN CAST(s_nationkey AS VARCHAR) END AS nation FROM supplier",
    "ledger_partial": f"WITH {_REQ} SELECT custom_id, CASE WHEN b <= 3 THEN 'b' || b END AS batch_id, CASE WHEN b <= 3 THEN 'submitted' END AS state FROM q",
    "ledger_collect": f"WITH {_REQ} SELECT a AS article_id, 'b' || b AS batch_id, CASE WHEN b <> 2 AND a % 5 < 3 THEN 'ok' ELSE 'failed' END AS status, CAST(CASE WHEN b <> 2 AND a % 5 < 3 THEN a % 5 END AS INT) AS note, 'v4' AS version FROM q WHERE b NOT IN (3, 4)",
    "ledger_cancel": f"""WITH {_REQ}, b AS (SELECT b, count(*) AS n FROM q GROUP BY b) SELECT CASE WHEN b IN (3, 4) THEN 'cancelled' WHEN b = 2 THEN 'failed' ELSE 'collected' END AS state, CAST(sum(CASE WHEN b NOT IN (3, 4) THEN n ELSE 0 END) AS BIGINT) AS requests, count(*) AS batches FROM b GROUP BY 1
 UNION ALL SELECT 'again', CAST(sum(n) AS BIGINT), 0 FROM b WHERE b IN (3, 4)""",
    "ledger_adopt": """WITH o AS (SELECT o_orderkey AS a, CASE WHEN o_orderkey % 50 = 0 THEN 'x' || o_orderkey ELSE 'a' || o_orderkey || '-c' || (o_orderkey % 10) END AS id FROM orders),
 r AS (SELECT id AS custom_id, CASE WHEN a % 3 = 0 THEN 'o2' ELSE 'o1' END AS batch_id FROM o WHERE a % 50 <> 0 AND a % 7 <> 0),
 l AS (SELECT id AS custom_id, x AS batch_id FROM o, (VALUES ('o1'), ('o2')) t(x) WHERE (a % 50 = 0 OR a % 7 = 0) AND (x = 'o1' OR a % 3 = 0))
 SELECT custom_id, batch_id, 'request' AS kind FROM r UNION ALL SELECT custom_id, batch_id, 'no article' FROM l
 UNION ALL SELECT 'submitted ' || (SELECT count(*) FROM r WHERE r.batch_id = x) || ' ' || (SELECT count(*) FROM l WHERE l.batch_id = x), x, 'batch' FROM (VALUES ('o1'), ('o2')) t(x)""",
    "timed_batches": "SELECT 'b' || (o_custkey % 50) AS batch_id, 'a' || o_orderkey AS custom_id, CASE WHEN o_orderkey % 3 > 0 THEN 'ok' ELSE 'failed' END AS status, CAST(CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 3 END AS INT) AS note, CASE WHEN o_orderkey % 3 > 0 THEN 'result' ELSE 'ended' END AS reason FROM orders WHERE o_orderkey % 3 > 0 OR o_custkey % 2 = 0",
    "classifier_labels": "WITH c AS (SELECT 'a' || conv_id || '-c' || turn AS id, coalesce(CASE WHEN conv_id % 9 = 0 THEN ' ' || chr(10) || ' ' WHEN conv_id % 9 > 1 THEN text END, '') AS t FROM conversations) SELECT id, CASE length(t) % 4 WHEN 0 THEN 'NEGATIVE' WHEN 1 THEN 'NEUTRAL' WHEN 2 THEN 'POSITIVE' ELSE 'OTHER' END AS label, CAST(CASE length(t) % 4 WHEN 0 THEN 0 WHEN 2 THEN 2 ELSE 1 END AS INT) AS note, (1 + length(t) % 7) / CAST(8 AS DOUBLE) AS confidence FROM c",
    "classifier_blanks": "SELECT 'a' || conv_id || '-c' || turn AS id, 'NEUTRAL' AS label, 1 AS note, CAST(1 AS DOUBLE) AS confidence FROM conversations WHERE conv_id % 9 < 2",
    "classifier_worklist": "WITH l AS (SELECT l_suppkey AS company_id, l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS nbocc, CASE WHEN l_orderkey % 4 <> 0 THEN l_shipdate END AS published_at FROM lineitem) SELECT company_id, l_orderkey, l_linenumber, nbocc, published_at FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY published_at DESC NULLS LAST, l_orderkey DESC, l_linenumber DESC) AS k FROM l WHERE nbocc > 2) WHERE k <= 5",
    "pair_state": f"""WITH e AS (SELECT {', '.join(_PAIR_LOG)} FROM events) SELECT article_id, company_id, arg_max(n, event_id) FILTER (WHERE event = 'counted') AS nbocc, arg_max(CASE WHEN event = 'counted' THEN 0 ELSE n % 3 END, event_id) AS note_tfidf,
 arg_max(CASE WHEN n % 2 = 0 THEN 9 ELSE n % 3 END, event_id) FILTER (WHERE event = 'classified') AS note_targeted, arg_max(CASE WHEN event = 'counted' THEN 0 ELSE n % 2 END, event_id) AS note_full,
 arg_max(CASE WHEN event = 'counted' THEN DATE '2024-05-01' ELSE DATE '2024-06-01' END, event_id) AS date_estim FROM e GROUP BY 1, 2""",
    "state_after_changes": f"""WITH {LOG_SQL}, {FACTS_SQL}, base AS (SELECT article_id, company_id, event_id, status, note, justification, version FROM log),
 all_ AS (SELECT * FROM base UNION ALL SELECT article_id, company_id, event_id + 1000000, 'reloaded', CAST(event_id % 3 AS INT), 'r', NULL FROM base WHERE event_id % 5 = 0
  UNION ALL SELECT article_id, company_id, b.event_id + 2000000, 'rescored', CAST(fin AS INT), NULL, NULL FROM base b JOIN (SELECT f.event_id AS fid, f.variation, f.other_fact, f.sense, l.note, {_FINAL.replace('note', 'l.note')} AS fin FROM facts f JOIN log l ON l.event_id = f.event_id) x ON fid = b.event_id WHERE b.event_id % 4 = 1 AND status = 'ok' AND fin IS DISTINCT FROM b.note)
 SELECT article_id, company_id, arg_max(status, event_id) FILTER (WHERE status NOT IN ('reloaded', 'rescored')) AS status, (arg_max({{'v': CASE WHEN status NOT IN ('failed', 'not_evaluated') THEN note END}}, event_id) FILTER (WHERE status <> 'submitted')).v AS note,
 (arg_max({{'v': CASE WHEN status NOT IN ('failed', 'not_evaluated') THEN justification END}}, event_id) FILTER (WHERE status NOT IN ('submitted', 'rescored'))).v AS justification,
 (arg_max({{'v': CASE WHEN status <> 'not_evaluated' THEN version END}}, event_id) FILTER (WHERE status NOT IN ('reloaded', 'rescored'))).v AS version FROM all_ GROUP BY 1, 2""",
    "random_long_per_source": "SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR)) AS k FROM documents WHERE length(text) > 100) WHERE k <= 50",
    "rescorable_pairs": f"WITH {LOG_SQL} SELECT article_id, company_id, event_id, note FROM log WHERE status = 'ok' AND extraction IS NOT NULL",
    "work_switches": f"WITH {LOG_SQL} SELECT 'resume' AS run, count(*) FILTER (WHERE status NOT IN ('ok', 'submitted') OR version <> 'v4') AS n FROM log UNION ALL SELECT 'off', count(*) FROM log UNION ALL SELECT 'no version', count(*) FROM log",
    "run_totals": "WITH c AS (SELECT conv_id % 4 AS nbocc, (coalesce(length(text), 0) + coalesce(length(role), 0)) % 4 AS k FROM conversations) SELECT CASE WHEN nbocc < 2 THEN 'filtered' WHEN k < 3 THEN 'ok' ELSE 'failed' END AS status, count(*) AS n FROM c GROUP BY 1",
    "version_filter": "WITH e AS (SELECT event_id, 'v' || (event_id % 5) AS version, CASE event_id % 3 WHEN 0 THEN 'bench_V2.csv' WHEN 1 THEN 'bench-v4.csv' ELSE 'bench.csv' END AS file FROM events) SELECT * FROM e WHERE file = 'bench.csv' OR (file = 'bench_V2.csv' AND version = 'v2') OR (file = 'bench-v4.csv' AND version = 'v4')",
}
