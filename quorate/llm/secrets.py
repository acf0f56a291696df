"""Secrets: base patterns, and long tokens that look drawn at random rather than named.

Two Markov models of characters, of random strings and of ordinary identifiers, give each transition (a, b) the log of
P(b | a, random) / P(b | a, ordinary); a token's score is the sum over its transitions. Both are trained from samples that
the texts label themselves: random are the values that base patterns find, ordinary are short words of a bounded sample.

Everything is columns and joins. A text is cut at a pattern's matches, and a match begins where the lengths of what lies
before it end, which a window adds up over rows (row, kind, place): linear in the text, however many matches it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved

KINDS = ("assign", "access", "hex", "random")
#: Base patterns, fixed values; matches of the others go on to the end of the run, so only these that are long enough are
#: looked for, at the first character of a run.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{16,}", "hex": r"(?<![0-9a-f])[0-9a-f]{24,}", "random": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"}
#: What a text must have, cheaper to look for than the pattern.
GATES = {"assign": r"(?i:pass|secret|token|api)", "access": "AKIA", "hex": "[0-9a-f]{24}", "random": "[A-Za-z0-9+/_=-]{16}"}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
#: Short words of the alphabet, which no base pattern and no candidate can be.
ORDINARY = r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{3,15}(?![A-Za-z0-9+/_.=-])"


def _matches(text: Column, kind: str) -> Column:
    """array<struct<said, gap>>: the matches in order, and how many code points lie between each and the one before."""
    pattern = PATTERNS[kind]
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    both = F.filter(F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("said"), F.length(g).cast("long").alias("gap"))), lambda x: x["said"].isNotNull())
    return F.when(text.rlike(GATES[kind]), both).otherwise(F.array().cast("array<struct<said: string, gap: bigint>>")).alias(kind)


def matches(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, and a column of matches for each kind), as a written table; rid numbers the rows."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return saved(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", *[_matches(text, k) for k in KINDS]))


def placed(found: DataFrame) -> DataFrame:
    """(rid, kind, start, stop, value, is_base): base spans, and candidates that overlap none. value: what is secret in it."""
    each = F.array(*[F.struct(F.lit(i).alias("place"), F.col(k).alias("m")) for i, k in enumerate(KINDS)])
    rows = found.select("rid", F.inline(each)).select("rid", "place", F.posexplode("m").alias("pos", "x")).select("rid", "place", "pos", "x.said", "x.gap")
    before = Window.partitionBy("rid", "place").orderBy("pos")
    rows = rows.withColumn("stop", F.sum(F.col("gap") + F.length("said")).over(before)).withColumn("start", F.col("stop") - F.length("said"))
    value = F.when(F.col("place") == 0, F.regexp_extract("said", ASSIGN, 1)).otherwise(F.col("said"))
    rows = rows.withColumn("value", value).where((F.col("place") != 0) | (F.length("value") >= 6))
    base = F.col("place") < len(KINDS) - 1
    # Both look back, the second from the end: a frame up to the last row would be summed up anew for each row.
    order, back = Window.partitionBy("rid").orderBy("start", "place"), Window.partitionBy("rid").orderBy(F.desc("start"), F.desc("place"))
    left = F.max(F.when(base, F.col("stop"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    right = F.min(F.when(base, F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, -1))
    free = (F.coalesce(left, F.lit(-1)) <= F.col("start")) & (F.coalesce(right, F.col("stop")) >= F.col("stop"))
    letter = F.col("value").rlike("[A-Za-z]")  # numbers alone are no tokens
    rows = rows.withColumns({"is_base": base, "free": free}).where(F.col("is_base") | (F.col("free") & letter))
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("place") + 1)
    return saved(rows.select("rid", kind.alias("kind"), "place", "start", "stop", "value", "is_base"))


def _transitions(value: Column) -> Column:
    """Every two neighbouring characters."""
    return F.regexp_extract_all(value, F.lit(r"(?s)(?=(..))"), F.lit(1))


def ordinary_words(docs: DataFrame, sample_texts: int) -> DataFrame:
    """(value): short words, with repeats, of the sample_texts distinct texts whose md5 is smallest."""
    texts = docs.select(F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    last = texts.select(F.md5("text").alias("h")).distinct().orderBy("h").limit(sample_texts).agg(F.max("h")).first()[0]
    some = texts.where(F.md5("text") <= F.lit(last)).distinct()
    return some.select(F.explode(F.regexp_extract_all("text", F.lit(ORDINARY), F.lit(0))).alias("value"))


def model(random: DataFrame, ordinary: DataFrame, weight: int = 16) -> DataFrame:
    """(pair, gain): 1000 * the log-likelihood ratio of each transition, rounded down.

    random and ordinary have a column value. P(b | a) = (n(ab) + weight * P(b)) / (n(a) + weight), and P(b), how often b
    follows anything, has one added to each count: where a was not seen, b alone decides. All transitions within ALPHABET
    have a row: its size squared.
    """
    pairs = random.select(F.lit(1).alias("label"), F.explode(_transitions(F.col("value"))).alias("pair"))
    pairs = pairs.unionAll(ordinary.select(F.lit(0).alias("label"), F.explode(_transitions(F.col("value"))).alias("pair")))
    seen = pairs.groupBy("pair").agg(*[F.count_if(F.col("label") == k).alias(f"n{k}") for k in (0, 1)])
    letters = F.array(*[F.lit(c) for c in ALPHABET])
    every = random.sparkSession.range(1).select(F.explode(letters).alias("a")).select("a", F.explode(letters).alias("b")).withColumn("pair", F.concat("a", "b"))
    both = every.join(seen, "pair", "left").na.fill(0)

    def chance(n: str) -> Column:  # windows over the few rows of the model
        total = lambda *by: F.sum(n).over(Window.partitionBy(*by))
        follows = (total("b") + 1).cast("double") / (total() + len(ALPHABET)).cast("double")
        return (F.col(n) + weight * follows) / (total("a") + weight)

    return both.withColumns({"p1": chance("n1"), "p0": chance("n0")}).select("pair", F.floor(1000 * F.log(F.col("p1") / F.col("p0"))).alias("gain"))


def scored(spans: DataFrame, gains: DataFrame) -> DataFrame:
    """(rid, start, stop, score) of the candidates among spans."""
    pairs = spans.where(~F.col("is_base")).select("rid", "start", "stop", F.explode(_transitions(F.col("value"))).alias("pair"))
    # The model has a row for each transition of ALPHABET, whatever the data: small enough to go everywhere.
    return pairs.join(F.broadcast(gains), "pair").groupBy("rid", "start", "stop").agg(F.sum("gain").alias("score"))


def find_secrets(docs: DataFrame, threshold: int = 12_000, sample_texts: int = 2_000) -> DataFrame:
    """doc_id, base and spans (arrays of start, kind, stop; code points, end exclusive) for each row of docs.

    base: matches of the base patterns, leftmost and without overlap within a kind, those that are too short dropped. spans:
    these, and as `random` the tokens of 16 or more characters, with a letter, that overlap no base span and whose score is
    at least `threshold` (thousandths of a nat). Spans are by start, then in the order of KINDS. Ordinary words are learned
    from `sample_texts` distinct texts at most, random strings from all base spans; without any, transitions count as
    equally likely. Null or empty text: empty arrays. Repeated rows each get theirs. No rows: no rows.
    """
    found = matches(docs)
    spans = placed(found)
    gains = saved(model(spans.where("is_base").select("value"), ordinary_words(docs, sample_texts)))
    good = scored(spans, gains).where(F.col("score") >= threshold).select("rid", "start", "stop")
    kept = spans.where("is_base").select("rid", "start", "place", "kind", "stop", "is_base")
    more = good.select("rid", "start", F.lit(len(KINDS) - 1).alias("place"), F.lit(KINDS[-1]).alias("kind"), "stop", F.lit(False).alias("is_base"))
    one = F.sort_array(F.collect_list(F.struct("start", "place", "kind", "stop", "is_base"))).alias("all")  # of one text
    lists = kept.unionByName(more).groupBy("rid").agg(one)
    bare = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"))
    every = F.coalesce("all", F.array().cast("array<struct<start: bigint, place: int, kind: string, stop: bigint, is_base: boolean>>"))
    out = found.select("rid", "doc_id").join(lists, "rid", "left").select("doc_id", every.alias("all"))
    return out.select("doc_id", F.transform(F.filter("all", lambda s: s["is_base"]), bare).alias("base"), F.transform("all", bare).alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """find_secrets()'s rows as counts and digests: the form of the query."""
    say = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS[:-1]], F.sha2(say("base"), 256).alias("base_sha256"), say("spans").alias("spans"))
