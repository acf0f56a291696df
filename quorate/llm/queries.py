"""The queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, divergence, fingerprints, importance, jaccard, language, media, mixing, packing, pii, secrets, sharding, suffixes
from .common import table


def conversation_records(turns: DataFrame) -> DataFrame:
    """conversations (rows by turn) as records of the layouts that fit them; null texts and roles become empty."""
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    c = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("t"))
    roles = F.concat_ws(",", F.transform("t", lambda x: x["role"]))
    text = lambda i: F.get("t", F.lit(i))["text"]
    pair, triple = roles == "user,assistant", roles == "system,user,assistant"
    known = F.forall("t", lambda x: x["role"].isin("user", "assistant"))
    share = F.transform("t", lambda x: F.struct(F.when(x["role"] == "user", F.lit("human")).otherwise(F.lit("gpt")).alias("from"), x["text"].alias("value")))
    plain = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    c = c.withColumns({"pair": pair, "triple": triple, "known": known})
    rest = ~F.col("pair") & ~F.col("triple")
    return c.select(
        "conv_id",
        F.when(F.col("triple"), text(0)).alias("system"),
        F.when(F.col("pair"), text(0)).alias("prompt"),
        F.when(F.col("pair"), text(1)).alias("response"),
        F.when(F.col("triple"), text(1)).alias("instruction"),
        F.when(F.col("triple"), text(2)).alias("output"),
        F.when(rest & F.col("known"), share).alias("conversations"),
        F.when(rest & ~F.col("known"), plain).alias("messages"),
    )


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "\\### Assistant: </turn> ok"
    extra = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(probe).alias("text")) for k, r in enumerate(("user", "assistant"))])))
    out = chat.format_chat(chat.canonical_turns(conversation_records(rows.unionByName(extra))))
    back = out.select("conv_id", "layout", "formatted", chat.read_chat(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "layout",
    )


OP1_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, regexp_replace(text, '<\|(\\*)(turn|text|end)\|>', '<|\\\1\2|>', 'g') AS esc,
         regexp_replace(role, '<\|(\\*)(turn|text|end)\|>', '<|\\\1\2|>', 'g') AS esc_role FROM c
), g AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
         sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum(length('<|turn|>' || esc_role || '<|text|>' || esc || '<|end|>' || chr(10)))::BIGINT AS formatted_chars,
         string_agg(role, ',' ORDER BY turn, role, text) AS roles,
         bool_and(role IN ('user', 'assistant')) AS known
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars,
       CASE WHEN roles = 'user,assistant' THEN 'prompt_response' WHEN roles = 'system,user,assistant' THEN 'instruction'
            WHEN known THEN 'from_value' ELSE 'messages' END AS layout
FROM g
"""


def op2_balanced_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op3_linear_grouping_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), keep_ids=False)


def op4_token_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents"), words=3, percent=90)


def op5_piecewise_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op6_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.detect(table(spark, sf_dir, "documents")))


def op9_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.identify(docs, keep=["doc_id"]).select("doc_id", "held_out", "lang_pred", "score")


def op7_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op8_wav_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(table(spark, sf_dir, "documents"), keep_media=False)


def op10_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)


def op11_count_cell_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), w AS (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), g AS (SELECT DISTINCT lang, source FROM d
), c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL
), k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT rid) >= 3
), v AS (SELECT lang, count(*) AS v, sum(total) AS size FROM k GROUP BY lang
), f AS (SELECT lang, source, term, total, coalesce(n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)
), z AS (SELECT lang, source, sum(n) AS size FROM f GROUP BY ALL
), p AS (
  SELECT f.*, 1 + (1000000000 * (n + 1)::HUGEINT) // (z.size + v.v)::HUGEINT AS p, 1 + (1000000000 * (total + 1)::HUGEINT) // (v.size + v.v)::HUGEINT AS q
  FROM f JOIN z USING (lang, source) JOIN v USING (lang)
), x AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p WHERE n > 0 AND p > q
), o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 200
"""


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: CRC-32 of a word: a table of the 256 bytes' remainders, then a byte at a time.
OP12_SQL = r"""
WITH m AS (
  SELECT list(x ORDER BY i) AS t FROM (SELECT i, list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS x FROM range(0, 256) r(i))
), d AS (
  SELECT doc_id, row_number() OVER () AS rid, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), b AS (SELECT translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark
), w AS (SELECT rid, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM d
), u AS (SELECT unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM b
), h AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM w UNION SELECT word FROM u)
), y AS (SELECT word, list_transform(range(0, length(x) // 2), lambda i: (strpos('0123456789ABCDEF', x[2 * i + 1]) * 16 + strpos('0123456789ABCDEF', x[2 * i + 2]) - 17)::BIGINT) AS bytes FROM h
), e AS (SELECT word, xor(list_reduce(bytes, lambda c, v: xor(c >> 8, t[xor(c & 255, v) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM y, m
), s AS (SELECT bucket, count(*) AS s FROM w JOIN e USING (word) GROUP BY 1
), t AS (SELECT bucket, count(*) AS t FROM u JOIN e USING (word) GROUP BY 1
), g AS (
  SELECT k AS bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * ((SELECT count(*) FROM w) + 10000))::DOUBLE / ((coalesce(s, 0) + 1) * ((SELECT count(*) FROM u) + 10000))::DOUBLE))::BIGINT AS gain
  FROM range(0, 10000) r(k) LEFT JOIN s ON s.bucket = k LEFT JOIN t ON t.bucket = k
), f AS (SELECT rid, count(*) AS n, sum(gain)::BIGINT AS weight FROM w JOIN e USING (word) JOIN g USING (bucket) GROUP BY 1
), l AS (SELECT doc_id, coalesce(n, 0) AS n, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN f USING (rid)
), z AS (SELECT doc_id, n, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM l
), o AS (SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id NULLS LAST, n) AS k, count(*) FILTER (WHERE n >= 20) OVER () * 10 // 100 AS drawn FROM z)
SELECT doc_id, n AS n_features, weight, score, CASE WHEN n >= 20 AND k <= drawn THEN k END AS rank FROM o
"""


def op13_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.find_secrets(table(spark, sf_dir, "documents")))


OP13_SQL = r"""
WITH pat(place, kind, pat) AS (VALUES (0, 'assign', '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  (1, 'access', 'AKIA[A-Z0-9]+'), (2, 'hex', '[0-9a-f]+'), (3, 'random', '[A-Za-z0-9+/_=-]+')
), d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), q AS (
  SELECT rid, 0 AS place, string_split_regex(text, (SELECT pat FROM pat WHERE place = 0)) AS gaps, regexp_extract_all(text, (SELECT pat FROM pat WHERE place = 0)) AS found FROM d
  UNION ALL SELECT rid, 1, string_split_regex(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT rid, 2, string_split_regex(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+') FROM d
  UNION ALL SELECT rid, 3, string_split_regex(text, '[A-Za-z0-9+/_=-]+'), regexp_extract_all(text, '[A-Za-z0-9+/_=-]+') FROM d
), u AS (SELECT rid, place, unnest(range(1, len(found) + 1)) AS pos, unnest(found) AS said, unnest(list_slice(gaps, 1, len(found))) AS gap FROM q
), p AS (SELECT rid, place, said, sum(length(gap) + length(said)) OVER (PARTITION BY rid, place ORDER BY pos)::BIGINT AS stop FROM u
), s AS (SELECT rid, place, stop - length(said) AS start, stop, CASE WHEN place = 0 THEN regexp_extract(said, (SELECT pat FROM pat WHERE place = 0), 2) ELSE said END AS value FROM p
), k AS (SELECT * FROM s WHERE length(value) >= CASE place WHEN 0 THEN 6 WHEN 1 THEN 20 WHEN 2 THEN 24 ELSE 16 END
), base AS (SELECT * FROM k WHERE place < 3
), cand AS (SELECT * FROM k WHERE place = 3 AND regexp_matches(value, '[A-Za-z]') AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = k.rid AND b.start < k.stop AND k.start < b.stop)
), texts AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL
), picked AS (SELECT text FROM texts ORDER BY md5(text) LIMIT 2000
), runs AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9+/_.=-]+')) AS value FROM picked
), words AS (SELECT 1 AS label, value FROM base UNION ALL SELECT 0, value FROM runs WHERE length(value) BETWEEN 3 AND 15
), pairs AS (SELECT label, value[i:i + 1] AS pair FROM (SELECT label, value, unnest(range(1, length(value))) AS i FROM words)
), seen AS (SELECT pair, count(*) FILTER (WHERE label = 1) AS n1, count(*) FILTER (WHERE label = 0) AS n0 FROM pairs GROUP BY 1
), letters AS (SELECT unnest(string_split('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-', '')) AS c
), every AS (SELECT a.c AS a, b.c AS b, a.c || b.c AS pair, coalesce(n1, 0) AS n1, coalesce(n0, 0) AS n0 FROM letters a, letters b LEFT JOIN seen ON seen.pair = a.c || b.c
), sums AS (SELECT pair, n1, n0, sum(n1) OVER (PARTITION BY a) AS a1, sum(n0) OVER (PARTITION BY a) AS a0, sum(n1) OVER (PARTITION BY b) AS b1, sum(n0) OVER (PARTITION BY b) AS b0, sum(n1) OVER () AS t1, sum(n0) OVER () AS t0 FROM every
), chances AS (SELECT pair, (n1 + 16 * ((b1 + 1)::DOUBLE / (t1 + 68)::DOUBLE)) / (a1 + 16)::DOUBLE AS p1, (n0 + 16 * ((b0 + 1)::DOUBLE / (t0 + 68)::DOUBLE)) / (a0 + 16)::DOUBLE AS p0 FROM sums
), model AS (SELECT pair, floor(1000 * ln(p1 / p0))::BIGINT AS gain FROM chances
), score AS (SELECT rid, start, stop, sum(gain) AS score FROM (SELECT rid, start, stop, value[i:i + 1] AS pair FROM (SELECT *, unnest(range(1, length(value))) AS i FROM cand)) JOIN model USING (pair) GROUP BY ALL
), every_span AS (SELECT rid, place, start, stop FROM base UNION ALL SELECT rid, 3, start, stop FROM score WHERE score >= 12000
), said AS (SELECT rid, place, start, kind || ':' || start || ':' || stop AS one FROM every_span JOIN pat USING (place)
), l AS (SELECT rid, count(*) FILTER (WHERE place = 0) AS n0, count(*) FILTER (WHERE place = 1) AS n1, count(*) FILTER (WHERE place = 2) AS n2,
  string_agg(one, ',' ORDER BY start, place) FILTER (WHERE place < 3) AS base, string_agg(one, ',' ORDER BY start, place) AS spans FROM said GROUP BY 1)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN l USING (rid)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_balanced_label_propagation": op2_balanced_label_propagation,
    "op3_linear_grouping_pack": op3_linear_grouping_pack,
    "op4_token_group_join": op4_token_group_join,
    "op5_piecewise_hash": op5_piecewise_hash,
    "op6_weak_pii": op6_weak_pii,
    "op7_sainte_lague_mix": op7_sainte_lague_mix,
    "op8_wav_features": op8_wav_features,
    "op9_cross_parsing": op9_cross_parsing,
    "op10_suffix_repeats": op10_suffix_repeats,
    "op11_count_cell_ranking": op11_count_cell_ranking,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_markov_secrets": op13_markov_secrets,
}
ORACLE_SQL: dict[str, str] = {"op1_chat_format": OP1_SQL, "op11_count_cell_ranking": OP11_SQL, "op12_importance_resampling": OP12_SQL, "op13_markov_secrets": OP13_SQL}
