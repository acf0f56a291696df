"""Entity mentions: word-bounded counts of names and aliases, found by token joins rather than document x entity pairs.

A term that is one word is counted among a text's tokens. Terms of several words, or with other characters, are joined by
position: with the runs of words that begin at each place of a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A dictionary of up to so many terms is broadcast; beyond, tokens are shuffled to it.
BROADCAST_TERMS = 20_000
NOT_WORD = r"(?U)\W+"
ONE_WORD = r"(?U)^\w+$"
#: Words of a term that are looked up at once, and what separates them in a key.
WIDTH = 4
BETWEEN = "\x01"


def term_table(entities: DataFrame, aliases: DataFrame, fold: bool) -> DataFrame:
    """(company_id, term): names and aliases, distinct; fold: equal but for case is one term (in lower case)."""
    one = (lambda c: F.lower(c)) if fold else (lambda c: c)
    both = entities.select("company_id", one(F.col("name")).alias("term")).unionByName(aliases.select("company_id", one(F.col("alias")).alias("term")))
    return both.where("length(term) > 0").distinct()


def own_aliases(entities: DataFrame, dictionary: DataFrame, exact: bool = True) -> DataFrame:
    """(company_id, alias) of a dictionary (name, alias): looked up by the name as it stands, or trimmed in upper case."""
    key = (lambda c: c) if exact else (lambda c: F.upper(F.trim(c)))
    d = dictionary.select(key(F.col("name")).alias("_name"), "alias")
    return entities.join(d, key(F.col("name")) == F.col("_name")).select("company_id", "alias")


def _tokens(text: str) -> Column:
    return F.split(F.lower(F.col(text)), NOT_WORD)


def _sized(terms: DataFrame) -> DataFrame:
    return F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms


def word_counts(docs: DataFrame, words: DataFrame, key: str, text: str) -> DataFrame:
    """(key, company_id, n) of one-word terms: tokens that equal them in lower case. Rows of one key add up."""
    terms = words.select("company_id", F.lower("term").alias("_token"))
    found = docs.select(key, F.explode(_tokens(text)).alias("_token")).join(_sized(terms), "_token")
    return found.groupBy(key, "company_id").agg(F.count("*").alias("n"))


def _units(value: Column) -> tuple[Column, Column]:
    """(words, what lies between them), lower case; the first or last word is '' where other characters are at that end."""
    low = F.lower(value)
    return F.split(low, NOT_WORD, -1), F.regexp_extract_all(low, F.lit(NOT_WORD), F.lit(0))


def term_blocks(terms: DataFrame, width: int) -> DataFrame:
    """Each term as runs of at most `width` words with what lies between, one run's last word being the next one's first:
    a row a run.

    Columns of terms, and _k (words of the term), _block, _words, _lead and _trail (whether any word may stand at its begin,
    at its end), _first and _key, by which texts are asked.
    """
    words, between = _units(F.col("term"))
    t = terms.withColumns({"_w": words, "_s": between}).withColumn("_k", F.size("_w"))
    t = t.withColumn("_block", F.explode(F.sequence(F.lit(0), _blocks(F.col("_k"), width) - 1)))
    at = F.col("_block") * (width - 1)
    t = t.withColumn("_words", F.least(F.lit(width), F.col("_k") - at))
    t = t.withColumns({"_own": F.slice("_w", at + 1, F.col("_words")), "_seps": F.slice("_s", at + 1, F.col("_words") - 1)})
    last = at + F.col("_words") == F.col("_k")
    lead, trail = (F.col("_block") == 0) & (F.get("_own", F.lit(0)) == ""), last & (F.get("_own", F.col("_words") - 1) == "")
    key = F.array_join(F.flatten(F.zip_with("_own", "_seps", lambda w, s: F.array(w, F.coalesce(s, F.lit(""))))), BETWEEN)
    first = F.when(lead, F.get("_seps", F.lit(0))).otherwise(F.get("_own", F.lit(0)))
    return t.withColumns({"_lead": lead, "_trail": trail, "_key": key, "_first": first}).drop("_w", "_s", "_own", "_seps")


def _blocks(words: Column, width: int) -> Column:
    return F.greatest(F.lit(1), F.ceil((words - 1) / (width - 1))).cast("int")


def occurrences(docs: DataFrame, terms: DataFrame, key: str, text: str) -> DataFrame:
    """(_row, key, company_id, term, start, end) of every place where a term stands between word bounds; case is ignored.

    Places are in half steps: word i of a text is 2i, what lies between it and the next is 2i + 1. Each position of a text
    has the next few words as columns; it is looked up by its first word whether any term begins so, then by its whole run
    of words, so terms that share a first word cost nothing each. Longer terms are found run by run, and must have them all
    in a row. No term is searched for in a text.
    """
    longest = terms.agg(F.max(F.size(_units(F.col("term"))[0]))).first()[0] or 1
    width = max(2, min(WIDTH, longest))
    blocks = term_blocks(terms, width)
    sized = F.broadcast if blocks.count() <= BROADCAST_TERMS else (lambda df: df)
    kinds = ["_words", "_lead", "_trail"]
    shapes = [tuple(r) for r in blocks.select(*kinds).distinct().orderBy(*kinds).collect()]  # 4 * width at most
    is_shape = lambda s: (F.col("_words") == s[0]) & (F.col("_lead") == s[1]) & (F.col("_trail") == s[2])
    blocks = blocks.withColumn("_shape", F.coalesce(*[F.when(is_shape(s), F.lit(i)) for i, s in enumerate(shapes)]))

    words, between = _units(F.col(text))
    rows = docs.select(key, F.monotonically_increasing_id().alias("_row"), words.alias("w0"), between.alias("s0"))
    tail = lambda c, j: F.slice(c, j + 1, F.greatest(F.size(c) - j, F.lit(0)))
    names = [f"{c}{j}" for j in range(width) for c in "ws"]
    rows = rows.select(key, "_row", "w0", "s0", *[tail(n[0] + "0", int(n[1:])).alias(n) for n in names[2:]])
    rows = rows.select(key, "_row", F.posexplode(F.arrays_zip(*names)).alias("_pos", "_u")).select(key, "_row", "_pos", "_u.*")

    # By the first word; or by what follows it, for terms before which any word may stand.
    looks = [F.struct(F.lit(lead).alias("_lead"), F.col("s0" if lead else "w0").alias("_first")) for lead in sorted({s[1] for s in shapes})]
    asked = rows.select("*", F.inline(F.array(*looks)))
    firsts = blocks.groupBy("_first", "_lead").agg(F.collect_set("_shape").alias("_shapes"))
    asked = asked.join(sized(firsts), ["_first", "_lead"]).select(key, "_row", "_pos", *names, F.explode("_shapes").alias("_shape"))

    def said(n: int, lead: bool, trail: bool) -> Column:
        parts = []
        for j in range(n):
            any_word = lead and j == 0 or trail and j == n - 1
            parts += [F.when(F.col(f"w{j}") != "", F.lit("")) if any_word else F.col(f"w{j}"), F.col(f"s{j}") if j < n - 1 else F.lit("")]
        return F.concat(*[x for p in parts for x in (F.lit(BETWEEN), p)][1:])  # null, and so equal to nothing, past the end

    keys = F.coalesce(*[F.when(F.col("_shape") == i, said(*s)) for i, s in enumerate(shapes)])
    asked = asked.select(key, "_row", "_pos", "_shape", keys.alias("_key"))
    found = asked.join(sized(blocks), ["_shape", "_key"]).withColumn("_at", F.col("_pos") - F.col("_block") * (width - 1))
    if longest > width:
        whole = found.groupBy("_row", key, "company_id", "term", "_k", "_at").agg(F.count("*").alias("_n"), F.bool_or("_lead").alias("_lead"), F.bool_or("_trail").alias("_trail"))
        found = whole.where(F.col("_n") == _blocks(F.col("_k"), width))
    start = 2 * F.col("_at") + F.col("_lead").cast("int")
    end = 2 * (F.col("_at") + F.col("_k") - 1) + (~F.col("_trail")).cast("int")
    return found.select("_row", key, "company_id", "term", start.cast("long").alias("start"), end.cast("long").alias("end"))


def chosen(found: DataFrame, by: list[str]) -> DataFrame:
    """(by, n): how many occurrences remain if, from the left, the first and of these the longest term is taken and what
    overlaps it is not. The occurrences of one text are one list."""
    order = F.sort_array(F.collect_list(F.struct("start", (-F.length("term")).alias("less"), "end")))
    take = lambda acc, x: F.when(x["start"] >= acc["upto"], F.struct(x["end"].alias("upto"), (acc["n"] + 1).alias("n"))).otherwise(acc)
    zero = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))
    return found.groupBy(*by).agg(order.alias("_all")).select(*by, F.aggregate("_all", zero, take)["n"].alias("n"))


def _added(counts: DataFrame, key: str) -> DataFrame:
    return counts.groupBy(key, "company_id").agg(F.sum("n").cast("long").alias("nbocc")).where("nbocc > 0")


def linked(counts: DataFrame, links: DataFrame, by: list[str]) -> DataFrame:
    """(by, nbocc) of every link, 0 where its text has no mention (any more); counts of other pairs are left out."""
    known = links.select(*by).distinct()
    return known.join(counts.select(*by, "nbocc"), by, "left").withColumn("nbocc", F.coalesce("nbocc", F.lit(0)).cast("long"))


def count_sum(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, company_id, nbocc): each term counted by itself, summed. Pairs without a mention have no row.

    Case is ignored, so terms that differ by case alone each count. Null texts have no mention; rows of one key add up.
    """
    docs = docs.select(key, text).where(F.col(text).isNotNull())
    one_word = F.col("term").rlike(ONE_WORD)
    counts = word_counts(docs, terms.where(one_word), key, text)
    longer = terms.where(~one_word).groupBy("company_id", F.lower("term").alias("term")).agg(F.count("*").alias("times"))
    if longer.limit(1).count():
        each = chosen(occurrences(docs, longer.drop("times"), key, text), ["_row", key, "company_id", "term"])
        each = each.join(_sized(longer), ["company_id", "term"])
        counts = counts.unionByName(each.select(key, "company_id", (F.col("n") * F.col("times")).alias("n")))
    return _added(counts, key)


def count_alternation(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, company_id, nbocc): matches without overlap of any term of the company, longer terms first.

    Case is ignored, and equal terms but for case count once. Null texts have no mention; rows of one key add up. A
    company whose terms are all single words is counted by tokens: such matches cannot overlap.
    """
    docs = docs.select(key, text).where(F.col(text).isNotNull())
    terms = terms.select("company_id", F.lower("term").alias("term")).distinct()
    companies = terms.groupBy("company_id").agg(F.bool_or(~F.col("term").rlike(ONE_WORD)).alias("_long")).where("_long").select("company_id")
    if not companies.limit(1).count():
        return _added(word_counts(docs, terms, key, text), key)
    plain = terms.join(companies, "company_id", "left_anti")
    found = occurrences(docs, terms.join(companies, "company_id", "left_semi"), key, text)
    counts = chosen(found, ["_row", key, "company_id"]).select(key, "company_id", "n")
    return _added(counts.unionByName(word_counts(docs, plain, key, text)), key)
