"""Column functions over text: lengths, excerpts, keys, sentences, windows of tokens."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quorate.sources.shared import saved

#: White space as Java's \s has it.
SPACE = r"[ \t\n\x0B\f\r]+"


def word_count(text: Column) -> Column:
    """Parts between runs of white space, after spaces (only spaces) at the ends go; '' counts 1, null stays null."""
    return F.when(text.isNotNull(), F.size(F.split(F.trim(text), SPACE, -1)))


def excerpt(text: Column, n: int = 200, suffix: str = "...") -> Column:
    """The first n characters on one line, and the suffix."""
    return F.concat(F.replace(F.substring(text, 1, n), F.lit("\n"), F.lit(" ")), F.lit(suffix))


def joined(*parts: Column) -> Column:
    """Parts with a space between them; null parts count as empty."""
    return F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts])


def row_hash(*parts: Column) -> Column:
    """md5 of the parts run together; null parts count as empty."""
    return F.md5(F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


@F.pandas_udf(StringType())
def folded_name(names: pd.Series) -> pd.Series:
    """Upper case, without accents, single spaces; null stays null. For dimensions: Spark has no decomposition of its own."""

    def fold(x):
        if x is None:
            return None
        plain = unicodedata.normalize("NFD", x.replace("\x00", " ").strip().upper())
        return " ".join("".join(c for c in plain if not unicodedata.combining(c)).split())

    return names.map(fold, na_action="ignore")


def with_folded_name(rows: DataFrame, name: str, folded: str, broadcast_rows: int = 200_000) -> DataFrame:
    """rows with column folded: each distinct name is folded once, then joined back. A null name has a null fold."""
    names = rows.select(F.col(name).alias("_name")).distinct().where("_name IS NOT NULL")
    names = saved(names.withColumn(folded, folded_name("_name")))
    names = F.broadcast(names) if names.count() <= broadcast_rows else names
    return rows.join(names, F.col(name) == F.col("_name"), "left").drop("_name")


def custom_id(article: Column, company: Column) -> Column:
    return F.concat(F.lit("a"), article.cast("string"), F.lit("-c"), company.cast("string"))


def custom_id_parts(value: Column) -> Column:
    """struct<article_id, company_id>, null where the id is malformed."""
    at = lambda k: F.regexp_extract(value, r"^a(\d+)-c(\d+)$", k).try_cast("long")
    return F.when(value.rlike(r"^a\d+-c\d+$"), F.struct(at(1).alias("article_id"), at(2).alias("company_id")))


def masked_key(key: Column) -> Column:
    """First 6 and last 4 characters."""
    return F.concat(F.substring(key, 1, 6), F.lit("..."), F.right(key, F.lit(4)))


def sentences(text: Column) -> Column:
    """Sentences: cuts at white space after . ! or ?"""
    return F.split(text, r"(?<=[.!?])\s+", -1)


def windows(items: Column, size: int, stride: int) -> Column:
    """Runs of `size` items, one every `stride`; runs at the end may be shorter. What fits into one run is one run; no
    items: no runs."""
    n = F.size(items)
    last = F.when(n > size, n - 1).otherwise(0)
    starts = F.when(n > 0, F.sequence(F.lit(0), last, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(items, s + 1, F.lit(size)).alias("items")))


def substring_count(text: Column, part: Column) -> Column:
    """Occurrences without overlap of a plain substring; an empty or null part gives 0."""
    cut = F.length(text) - F.length(F.replace(text, part, F.lit("")))
    return F.coalesce(F.when(F.length(part) > 0, F.floor(cut / F.length(part))), F.lit(0)).cast("int")


def anchor(link: Column) -> Column:
    """An HTML link, empty where there is none."""
    return F.when(F.length(link) > 0, F.concat(F.lit('<a href="'), link, F.lit('">'), link, F.lit("</a>"))).otherwise(F.lit(""))


def prompt(template: Column, company: Column, article: Column) -> Column:
    """Template with {entreprise} and {article} filled in; what company and article contain is never filled in again.

    The template is cut at its {article} marks first, so only its own pieces take the company, and the article joins them.
    """
    sides = F.transform(F.split(template, r"\{article\}", -1), lambda s: F.replace(s, F.lit("{entreprise}"), company))
    return F.aggregate(F.slice(sides, F.lit(2), F.greatest(F.size(sides) - 1, F.lit(0))), F.get(sides, F.lit(0)), lambda a, s: F.concat(a, article, s))
