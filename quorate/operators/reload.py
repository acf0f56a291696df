"""Reload of notes from result files: rows are judged one by one, the last good one for a pair wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.functions.text import folded_name, with_folded_name
from quorate.operators.state import last_write, unambiguous
from quorate.sources.shared import saved

NOTES = (0, 1, 2)


def _clean(c: str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "\\x00", " "), r"(?U)^\s+|\s+$", "")


def _integer(text: Column, kind: str) -> Column:
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast(kind))


def judged(rows: DataFrame, companies: DataFrame, links: DataFrame) -> DataFrame:
    """rows (of read_results) with article_id, company_id, note, justification and outcome.

    outcome: `empty` (no article, company or note), `no number`, `no note` (not 0, 1, 2), `no company` (unknown, or a name
    that several companies have once case, accents and spaces are dropped), `no link` (the pair is not in links), `updated`.
    companies: company_id, name; links: article_id, company_id. The rows are written once, as their names are folded first.
    """
    rows = saved(rows.select("file", "file_ord", "row_ord", "rater", "article_id", "entreprise", "note_llm", "justification"))
    a, e, n = _clean("article_id"), _clean("entreprise"), _clean("note_llm")
    base = rows.withColumns({"_a": a, "_e": e, "_n": n, "justification": _clean("justification")})
    base = base.withColumns({"article_id": _integer(F.col("_a"), "long"), "note": _integer(F.col("_n"), "int")})
    base = with_folded_name(base, "_e", "_key")
    index = unambiguous(companies.withColumn("_k", folded_name("name")), "_k", "company_id")
    base = base.join(index, base["_key"] == index["_k"], "left")
    pairs = links.select(F.col("article_id").alias("_la"), F.col("company_id").alias("_lc")).distinct().withColumn("_there", F.lit(True))
    base = base.join(pairs, (base["article_id"] == pairs["_la"]) & (base["company_id"] == pairs["_lc"]), "left")
    outcome = (
        F.when((F.col("_a") == "") | (F.col("_e") == "") | (F.col("_n") == ""), "empty")
        .when(F.col("article_id").isNull() | F.col("note").isNull(), "no number")
        .when(~F.col("note").isin(*NOTES), "no note")
        .when(F.col("company_id").isNull(), "no company")
        .when(F.col("_there").isNull(), "no link")
        .otherwise("updated")
    )
    return base.withColumn("outcome", outcome).select("file", "file_ord", "row_ord", "rater", "article_id", "company_id", "note", "justification", "outcome")


def updates(rows: DataFrame) -> DataFrame:
    """(article_id, company_id, rater, note, justification): of the good rows for a pair and rater, the last one."""
    return last_write(rows.where("outcome = 'updated'"), ["article_id", "company_id", "rater"], F.struct("file_ord", "row_ord"), ["note", "justification"])


def outcomes(rows: DataFrame) -> DataFrame:
    """(file_ord, outcome, n) of rows of judged, written: a few rows a file, of which any tally can be made."""
    return saved(rows.groupBy("file_ord", "outcome").agg(F.count("*").alias("n")))


def tally(files: DataFrame, rows: DataFrame, dry_run: bool = False) -> DataFrame:
    """(file, read, updated, skipped) of each file. A file that is not usable counts as one that is skipped; a dry run
    counts rows without a link as updated. rows: of judged, or their outcomes."""
    good = ["updated", "no link"] if dry_run else ["updated"]
    n = F.col("n") if "n" in rows.columns else F.lit(1)
    done = F.sum(F.when(F.col("outcome").isin(*good), n).otherwise(0))
    per = rows.groupBy("file_ord").agg(F.sum(n).alias("read"), done.alias("updated"), (F.sum(n) - done).alias("skipped"))
    zero = lambda c, other=0: F.coalesce(c, F.lit(other)).cast("long").alias(c)
    return files.join(per, "file_ord", "left").select("file", zero("read"), zero("updated"), F.when(F.col("usable"), F.coalesce("skipped", F.lit(0))).otherwise(1).cast("long").alias("skipped"))
