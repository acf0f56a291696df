"""Sentence ends told from abbreviations by the corpus itself (after Kiss and Strunk, 2006, on unsupervised boundaries).

A type that nearly always has its period, more than chance explains, is an abbreviation: the log-likelihood ratio of that,
weighed by its length (abbreviations are short), its inner periods, and how often it stands without one. Counts are one
aggregation over the corpus; the few abbreviations are joined to the places where a text might be cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorate.sources.shared import saved

#: White space, what may stand around a word, and the least score of an abbreviation: fixed values of the method.
SPACE = r"[ \t\n\x0B\f\r]"
AROUND = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.]+$"
#: AROUND, of each word of a text.
AROUND_EACH = r"(?<![^ \t\n\x0B\f\r])[^\p{L}\p{N} \t\n\x0B\f\r]++|(?<=[\p{L}\p{N}.])[^\p{L}\p{N}. \t\n\x0B\f\r]++(?![^ \t\n\x0B\f\r])"
LEAST = 0.3
#: Share of a true abbreviation's occurrences that have the period.
CERTAIN = 0.99
#: Up to so many abbreviations are broadcast.
BROADCAST_ROWS = 100_000


def _bare(token: Column) -> Column:
    """Lower case, without what stands around the word; the period at its end stays."""
    return F.regexp_replace(F.lower(token), AROUND, "")


def _typed(bare: Column) -> Column:
    return F.regexp_replace(bare, r"\.$", "")


def word_types(docs: DataFrame, text: str = "text") -> DataFrame:
    """(type, dotted, plain): how often each word of the corpus has a period at its end, and how often not."""
    # What stands around words is taken off a whole text at once, not word by word.
    bare = F.regexp_replace(F.lower(text), AROUND_EACH, "")
    words = docs.where(F.col(text).isNotNull()).select(F.explode(F.split(bare, SPACE + "+")).alias("_b"))
    dot = F.endswith("_b", F.lit("."))
    words = words.select(F.when(dot, F.substring("_b", F.lit(1), F.length("_b") - 1)).otherwise(F.col("_b")).alias("type"), dot.alias("_dot"))
    counts = words.groupBy("type").agg(F.count_if("_dot").alias("dotted"), F.count_if(~F.col("_dot")).alias("plain"))
    return counts.where(F.length("type") > 0)


def abbreviations(types: DataFrame, least: float = LEAST) -> DataFrame:
    """(type, dotted, plain, score) of the types that have a letter and score at least `least`. types are written once, as
    they are read for their sums and for their scores."""
    types = saved(types)
    all_ = types.agg(F.sum(F.col("dotted") + F.col("plain")).alias("n"), F.sum("dotted").alias("d")).first()
    n, d = all_["n"] or 0, all_["d"] or 0
    if not d or d == n:
        return types.where("false").withColumn("score", F.lit(0.0))
    p, a, b = d / n, F.col("dotted").cast("double"), F.col("plain").cast("double")
    chance, certain = a * F.log(F.lit(p)) + b * F.log(F.lit(1 - p)), a * F.log(F.lit(CERTAIN)) + b * F.log(F.lit(1 - CERTAIN))
    inner = (F.length("type") - F.length(F.replace("type", F.lit("."), F.lit("")))).cast("double")
    rest = F.length("type") - inner
    score = -2 * (chance - certain) * F.exp(-rest) * (inner + 1) * F.pow(rest, -b)
    return types.where("dotted > 0").where(F.col("type").rlike(r"\p{L}")).withColumn("score", score).where(F.col("score") >= least)


def sentences(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, n, sentence): texts cut at white space after . ! or ?, but not after the period of a word in known (type),
    of a single letter, or where a small letter follows. Keys are unique. Null and blank texts have no sentence.

    The pieces of a text are numbered by a window over its rows and joined again where no sentence ends.
    """
    pieces = F.split(F.col(text), rf"(?<=[.!?])(?={SPACE})", -1)
    rows = docs.where(F.col(text).isNotNull()).select(key, pieces.alias("_p"))
    rows = rows.select(key, F.posexplode(F.arrays_zip("_p", F.slice("_p", 2, F.size("_p")).alias("_q"))).alias("_at", "_x")).select(key, "_at", "_x.*")
    # Only a piece that ends with a period can go on, and so only its last word is looked at, not the words before.
    dot = F.endswith("_p", F.lit("."))
    last = F.when(dot, _bare(F.element_at(F.split(F.substring_index("_p", " ", -1), SPACE + "+"), -1)))
    rows = rows.select(key, "_at", "_p", dot.alias("_dot"), _typed(last).alias("_type"), F.coalesce(F.col("_q").rlike(rf"^{SPACE}+\p{{Ll}}"), F.lit(False)).alias("_small"))
    few = known.select(F.col("type").alias("_known")).distinct()
    few = F.broadcast(few) if few.count() <= BROADCAST_ROWS else few
    rows = rows.join(few, F.col("_type") == F.col("_known"), "left")
    goes_on = F.col("_dot") & (F.col("_known").isNotNull() | F.col("_type").rlike(r"^\p{L}$") | F.col("_small"))
    order = Window.partitionBy(key).orderBy("_at")
    number = F.coalesce(F.sum((~goes_on).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("_at", "_p"))), lambda x: x["_p"])
    said = rows.withColumn("_k", number).groupBy(key, "_k").agg(F.regexp_replace(F.array_join(parts, ""), f"^{SPACE}+", "").alias("sentence")).where("sentence <> ''")
    whole = Window.partitionBy(key)
    return said.select(key, (F.row_number().over(whole.orderBy("_k")) - 1).alias("pos"), F.count("*").over(whole).cast("int").alias("n"), "sentence")
