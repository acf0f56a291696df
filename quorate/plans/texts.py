"""Queries on texts: mentions, selection, sentences, windows, names and ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.functions import text as T
from quorate.operators import blocks, state
from quorate.operators import extraction as E
from quorate.operators import mentions as M
from quorate.operators import selection as S
from quorate.sources.files import rater_of_file, version_of_file
from quorate.sources.shared import table

from .stand_ins import inline, values_sql

COMPANIES = [(1, "The"), (2, "Der"), (3, "que"), (4, "Le"), (5, "of")]
ALIASES = [(1, "the"), (1, "and"), (2, "die"), (2, "und"), (2, "der"), (3, "Que"), (3, "los"), (4, "les"), (4, "à"), (9, "a")]
TEMPLATES = [("v1", "Rate {entreprise}: {article}"), ("v2", "{entreprise}? {article} -- {entreprise}")]


def terms(spark: SparkSession, fold: bool) -> DataFrame:
    return M.term_table(inline(spark, COMPANIES, "company_id int, name string"), inline(spark, ALIASES, "company_id int, alias string"), fold)


def with_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.joined(F.col("source"), F.col("text")).alias("text"))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.count_alternation(table(spark, sf_dir, "documents"), terms(spark, True))


def decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.linked(mentions(spark, sf_dir), links(spark, sf_dir), ["doc_id", "company_id"])
    return found.select("doc_id", "company_id", S.reason(F.col("nbocc")).alias("reason"), F.format_string("%-10d %-6d %6d", "doc_id", "company_id", "nbocc").alias("line"))


def article_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", T.row_hash(F.col("text"), F.col("lang")).alias("unique_hash"))
    return d.groupBy("unique_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


_ACCENTED = "translate({x}, 'AEOUN', 'ÁÈÔÜÑ')"
_FILE = "CASE CAST({k} % 8 AS INT) WHEN 0 THEN 'resultats_haiku_V4_#.csv' WHEN 1 THEN 'resultat_Qwen_v3.csv' WHEN 2 THEN 'resultats_llm_#.csv' WHEN 3 THEN 'RESULTATS_GEMINI_x-V#.csv' WHEN 4 THEN 'notes.csv' WHEN 5 THEN 'resultat_gpt_v#.csv' WHEN 6 THEN 'mes_resultats_haiku_#.csv' ELSE 'resultats_haiku2_#.csv' END"


def name_norm_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as companies, one of them under two names that fold to one, one under a name that another has too; looked
    up by what customers call them: with accents, in lower case, with spaces."""
    n = table(spark, sf_dir, "nation")
    names = n.selectExpr("n_nationkey AS company_id", "n_name AS name").unionAll(n.where("n_nationkey = 1").selectExpr("n_nationkey", f"concat(' ', lower({_ACCENTED.format(x='n_name')}))")).unionAll(n.where("n_nationkey = 3").selectExpr("n_nationkey - 1", "n_name"))
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    asked = c.selectExpr("c_custkey", f"CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN lower({_ACCENTED.format(x='n_name')}) WHEN 1 THEN concat('  ', n_name, ' ') WHEN 2 THEN replace(n_name, ' ', '   ') ELSE concat(n_name, '!') END AS entreprise")
    found = T.with_folded_name(asked, "entreprise", "key")
    return found.join(state.unambiguous(names.withColumn("key", T.folded_name("name")), "key", "company_id"), "key").select("c_custkey", "entreprise", "company_id")


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What names of files tell, for a file an order."""
    f = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"replace({_FILE.format(k='o_orderkey')}, '#', CAST(o_orderkey AS STRING)) AS file")
    return f.select("o_orderkey", "file", rater_of_file(F.col("file")).alias("rater"), version_of_file(F.col("file")).alias("version"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two companies for each document, whether it names them or not."""
    of = lambda k: (1 + (F.col("doc_id") + k) % 5).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(of(0), of(2))).alias("company_id"))


def custom_id_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.when(F.col("event_id") % 10 == 3, F.concat(F.lit("x"), F.col("event_id").cast("string"))).otherwise(T.custom_id(F.col("event_id"), F.col("user_id")))
    d = table(spark, sf_dir, "events").select(one.alias("custom_id"))
    return d.withColumn("p", T.custom_id_parts(F.col("custom_id"))).select("custom_id", "p.article_id", "p.company_id")


def prompt_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    t = inline(spark, TEMPLATES, "version string, template string")
    hashed = t.withColumn("template_md5", F.md5("template"))  # known by its content too, as templates may be edited in place
    return d.join(F.broadcast(hashed)).select("conv_id", "turn", "version", "template_md5", F.md5(T.prompt(F.col("template"), F.col("conv_id").cast("string"), F.col("text"))).alias("prompt_md5"))


def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), T.SPACE, -1), "")
    d = table(spark, sf_dir, "documents").select("doc_id", words.alias("w"))
    kinds = F.array(F.struct(F.lit("block").alias("kind"), T.windows(F.col("w"), 500, 500).alias("x")), F.struct(F.lit("overlap").alias("kind"), T.windows(F.col("w"), 512, 462).alias("x")))
    d = d.select("doc_id", F.inline(kinds)).select("doc_id", "kind", F.explode("x").alias("c"))
    return d.select("doc_id", "kind", F.col("c.start").cast("long").alias("start"), F.size("c.items").cast("long").alias("n"))


def token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks and windows of the tokens of a public tokenizer's file, with what a classifier would see of each."""
    import public_tokenizers

    runs = blocks.token_runs(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"))
    return runs.select("doc_id", "kind", F.col("start").cast("long").alias("start"), F.size("ids").cast("long").alias("n"), F.md5("text").alias("text_md5"))


def chunk_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = text_chunks(spark, sf_dir).where("kind = 'overlap'").withColumns({"note": (F.col("n") % 3).cast("int"), "confidence": (1 + F.col("start") % 7) / F.lit(8.0)})
    return E.pooled_note(c, "doc_id", "note", "confidence")


def prob_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.pooled_argmax(table(spark, sf_dir, "embeddings"), "label", "embedding", (1 + F.col("vec_id") % 4) / F.lit(4.0)).select("label", F.col("place").cast("int").alias("place"), "value")


def article_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "pages").select("page_id", F.lower("url").alias("title"), F.lower(F.coalesce("html", F.lit(""))).alias("body"))
    n = T.substring_count(F.col("body"), F.lit("script"))
    kind = F.when(F.contains("title", F.lit("/en")), F.when(n > 4, "dedicated").otherwise("dedicated_single")).otherwise("general")
    return d.select("page_id", n.alias("mentions"), kind.alias("kind"))


def note_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("quality"), F.col("toxic") * 2
    return table(spark, sf_dir, "labels").select("doc_id", F.abs(a - b).cast("int").alias("divergence"), F.bround((a + b) / F.lit(2.0)).cast("int").alias("composite"))


QUERIES = {
    "mention_count_sum": lambda s, d: M.count_sum(with_title(s, d), terms(s, False)),
    "mention_count_alternation": mentions,
    "eligible_pairs": lambda s, d: mentions(s, d).where("nbocc > 1"),
    "decision_log": decision_log,
    "text_lengths": lambda s, d: table(s, d, "documents").select("doc_id", F.length("text").cast("long").alias("chars"), T.word_count(F.col("text")).cast("long").alias("words")),
    "excerpt": lambda s, d: table(s, d, "documents").select("doc_id", T.excerpt(F.col("text")).alias("excerpt")),
    "article_hash_dedup": article_hash_dedup,
    "alias_norm": lambda s, d: table(s, d, "part").groupBy(F.lower("p_type").alias("alias_norm")).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set(F.lower("p_brand"))), ",").alias("brands")),
    "name_norm_lookup": name_norm_lookup,
    "custom_id_roundtrip": custom_id_roundtrip,
    "prompt_rendering": prompt_rendering,
    "file_names": file_names,
    "key_mask": lambda s, d: table(s, d, "supplier").select("s_suppkey", T.masked_key(F.col("s_name")).alias("masked")),
    "link_anchor": lambda s, d: table(s, d, "pages").select("page_id", T.anchor(F.col("url")).alias("link")),
    "tfidf_summary": lambda s, d: E.summary(table(s, d, "documents").select("doc_id", "text"), F.lit("que")),
    "sentence_scores": lambda s, d: E.sentence_scores(table(s, d, "documents")).select("doc_id", F.col("pos").cast("int").alias("pos"), F.round("score", 6).alias("score")),
    "target_context": lambda s, d: table(s, d, "documents").select("doc_id", E.context(F.col("text"), F.lit("Que")).alias("context")),
    "token_chunks": text_chunks,
    "token_blocks": token_blocks,
    "chunk_pooling": chunk_pooling,
    "prob_pooling": prob_pooling,
    "article_class": article_class,
    "note_divergence": note_divergence,
}

_WS = r"[ \t\n\x0B\f\r]+"
_DIMS = values_sql(COMPANIES, "companies", "company_id, name") + ", " + values_sql(ALIASES, "aliases", "company_id, alias")
_TOKENS = lambda text: rf"tokens AS (SELECT doc_id, unnest(string_split_regex(lower({text}), '[^\p{{L}}\p{{N}}_]+')) AS token FROM documents)"
_ALT = f"""{_DIMS}, {_TOKENS('text')}, terms AS (SELECT company_id, lower(name) AS term FROM companies UNION SELECT company_id, lower(alias) FROM aliases),
 mentions AS (SELECT doc_id, company_id, count(*) AS nbocc FROM tokens JOIN terms ON token = term GROUP BY 1, 2)"""
_SENT = rf"""sent AS (SELECT doc_id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS sentence, len(s) AS n FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?]){_WS}', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents))"""
_SCORE = rf"""{_SENT}, tf AS (SELECT doc_id, pos, n, term, count(*) AS tf FROM (SELECT doc_id, pos, n, unnest(regexp_extract_all(lower(sentence), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM sent) GROUP BY ALL),
 dfs AS (SELECT doc_id, term, count(*) AS df FROM tf GROUP BY 1, 2), w AS (SELECT doc_id, pos, tf * (ln((1.0::DOUBLE + n) / (1 + df)) + 1) AS w FROM tf JOIN dfs USING (doc_id, term)),
 sc AS (SELECT doc_id, pos, sum(w) / sqrt(sum(w * w)) AS score FROM w GROUP BY 1, 2), scored AS (SELECT sent.*, coalesce(score, 0.0) AS score FROM sent LEFT JOIN sc USING (doc_id, pos))"""
_CHUNKS = rf"""words AS (SELECT doc_id, len(list_filter_n) AS n FROM (SELECT doc_id, array_agg(x) FILTER (WHERE x <> '') AS list_filter_n FROM (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '{_WS}')) AS x FROM documents) GROUP BY doc_id)),
 chunks AS (SELECT doc_id, 'block' AS kind, unnest(range(0, n, 500)) AS start, n AS total, 500 AS size FROM words WHERE n > 0 UNION ALL SELECT doc_id, 'overlap', unnest(CASE WHEN n > 512 THEN range(0, n, 462) ELSE [0] END), n, 512 FROM words WHERE n > 0),
 c AS (SELECT doc_id, kind, CAST(start AS BIGINT) AS start, CAST(least(size, total - start) AS BIGINT) AS n FROM chunks)"""
_FOLD = lambda x: rf"trim(regexp_replace(upper(strip_accents(trim({x}))), '\s+', ' ', 'g'))"

ORACLE_SQL = {
    "mention_count_sum": f"WITH {_DIMS}, {_TOKENS('''coalesce(source, '') || ' ' || coalesce(text, '')''')}, terms AS (SELECT company_id, name AS term FROM companies UNION SELECT company_id, alias FROM aliases) SELECT doc_id, company_id, count(*) AS nbocc FROM tokens JOIN terms ON token = lower(term) GROUP BY 1, 2",
    "mention_count_alternation": f"WITH {_ALT} SELECT * FROM mentions",
    "eligible_pairs": f"WITH {_ALT} SELECT * FROM mentions WHERE nbocc > 1",
    "decision_log": f"WITH {_ALT}, links AS (SELECT doc_id, CAST(1 + (doc_id + k) % 5 AS INT) AS company_id FROM documents, (VALUES (0), (2)) v(k)) SELECT doc_id, company_id, CASE WHEN nbocc >= 2 THEN 'selected' WHEN nbocc = 1 THEN 'single mention' ELSE 'false positive' END AS reason, rpad(doc_id::VARCHAR, 10, ' ') || ' ' || rpad(company_id::VARCHAR, 6, ' ') || ' ' || lpad(nbocc::VARCHAR, 6, ' ') AS line FROM (SELECT doc_id, company_id, coalesce(nbocc, 0) AS nbocc FROM links LEFT JOIN mentions USING (doc_id, company_id))",
    "text_lengths": rf"SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(len(string_split_regex(trim(text), '{_WS}')) AS BIGINT) AS words FROM documents",
    "excerpt": "SELECT doc_id, replace(substring(text, 1, 200), chr(10), ' ') || '...' AS excerpt FROM documents",
    "article_hash_dedup": "SELECT md5(coalesce(text, '') || coalesce(lang, '')) AS unique_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
    "alias_norm": "SELECT lower(p_type) AS alias_norm, count(*) AS n, string_agg(DISTINCT lower(p_brand), ',' ORDER BY lower(p_brand)) AS brands FROM part GROUP BY 1",
    "name_norm_lookup": f"""WITH names AS (SELECT n_nationkey AS company_id, n_name AS name FROM nation UNION ALL SELECT n_nationkey, ' ' || lower({_ACCENTED.format(x='n_name')}) FROM nation WHERE n_nationkey = 1 UNION ALL SELECT n_nationkey - 1, n_name FROM nation WHERE n_nationkey = 3),
 asked AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN lower({_ACCENTED.format(x='n_name')}) WHEN 1 THEN '  ' || n_name || ' ' WHEN 2 THEN replace(n_name, ' ', '   ') ELSE n_name || '!' END AS entreprise FROM customer JOIN nation ON c_nationkey = n_nationkey),
 k AS (SELECT {_FOLD('name')} AS key, min(company_id) AS company_id FROM names WHERE company_id <> 0 GROUP BY 1 HAVING count(DISTINCT company_id) = 1) SELECT c_custkey, entreprise, company_id FROM asked JOIN k ON {_FOLD('entreprise')} = key""",
    "custom_id_roundtrip": "SELECT CASE WHEN event_id % 10 = 3 THEN 'x' || event_id ELSE 'a' || event_id || '-c' || user_id END AS custom_id, CASE WHEN event_id % 10 <> 3 THEN event_id END AS article_id, CASE WHEN event_id % 10 <> 3 THEN user_id END AS company_id FROM events",
    "prompt_rendering": "SELECT conv_id, turn, v.version, md5(CASE v.version WHEN 'v1' THEN 'Rate {entreprise}: {article}' ELSE '{entreprise}? {article} -- {entreprise}' END) AS template_md5, md5(CASE v.version WHEN 'v1' THEN 'Rate ' || conv_id || ': ' || coalesce(text, '') ELSE conv_id || '? ' || coalesce(text, '') || ' -- ' || conv_id END) AS prompt_md5 FROM conversations, (VALUES ('v1'), ('v2')) v(version)",
    "file_names": f"""SELECT o_orderkey, replace({_FILE.format(k='o_orderkey')}, '#', o_orderkey::VARCHAR) AS file, CASE o_orderkey % 8 WHEN 0 THEN 'haiku' WHEN 1 THEN 'queen' WHEN 2 THEN 'lama' WHEN 3 THEN 'gemini' END AS rater,
 CASE o_orderkey % 8 WHEN 0 THEN 'v4' WHEN 1 THEN 'v3' WHEN 3 THEN 'v' || o_orderkey WHEN 5 THEN 'v' || o_orderkey END AS version FROM orders""",
    "key_mask": "SELECT s_suppkey, substring(s_name, 1, 6) || '...' || right(s_name, 4) AS masked FROM supplier",
    "link_anchor": "SELECT page_id, CASE WHEN url <> '' THEN '<a href=\"' || url || '\">' || url || '</a>' ELSE '' END AS link FROM pages",
    "tfidf_summary": rf"""WITH {_SCORE}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(CASE WHEN contains(lower(sentence), 'que') THEN score * 2 ELSE score END, 9) DESC, pos DESC) AS k FROM scored WHERE n > 3)
 SELECT doc_id, string_agg(sentence, ' ' ORDER BY pos) AS summary FROM r WHERE k <= 3 GROUP BY doc_id UNION ALL SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM sent WHERE n <= 3)""",
    "sentence_scores": f"WITH {_SCORE} SELECT doc_id, CAST(pos AS INT) AS pos, round(score, 6) AS score FROM scored",
    "target_context": f"""WITH {_SENT}, h AS (SELECT *, contains(lower(sentence), 'que') AS hit FROM sent), k AS (SELECT *, max(hit::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near, max(hit::INT) OVER (PARTITION BY doc_id) AS any_hit FROM h)
 SELECT doc_id, string_agg(sentence, ' ' ORDER BY pos) AS context FROM k WHERE near = 1 OR (any_hit = 0 AND pos < 3) GROUP BY doc_id""",
    "token_chunks": f"WITH {_CHUNKS} SELECT * FROM c",
    "chunk_pooling": f"WITH {_CHUNKS}, p AS (SELECT doc_id, n % 3 AS note, (1 + start % 7) / CAST(8 AS DOUBLE) AS confidence FROM c WHERE kind = 'overlap') SELECT doc_id, CAST(round_even(sum(note * confidence) / sum(confidence), 0) AS INT) AS note, avg(confidence) AS confidence FROM p GROUP BY doc_id",
    "prob_pooling": """WITH x AS (SELECT label, (1 + vec_id % 4) / CAST(4 AS DOUBLE) AS w, generate_subscripts(embedding, 1) - 1 AS place, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), m AS (SELECT label, place, round(sum(x * w) / sum(w), 6) AS m FROM x GROUP BY 1, 2)
 SELECT label, CAST(place AS INT) AS place, m AS value FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY m DESC, place) AS k FROM m) WHERE k = 1""",
    "article_class": "WITH p AS (SELECT page_id, lower(url) AS title, CAST((length(b) - length(replace(b, 'script', ''))) / 6 AS INT) AS mentions FROM (SELECT page_id, url, lower(coalesce(html, '')) AS b FROM pages)) SELECT page_id, mentions, CASE WHEN contains(title, '/en') THEN CASE WHEN mentions > 4 THEN 'dedicated' ELSE 'dedicated_single' END ELSE 'general' END AS kind FROM p",
    "note_divergence": "SELECT doc_id, CAST(abs(quality - toxic * 2) AS INT) AS divergence, CAST(round_even((quality + toxic * 2) / CAST(2 AS DOUBLE), 0) AS INT) AS composite FROM labels",
}
