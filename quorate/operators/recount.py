"""Counts of mentions kept up to date: only what an edit of texts, terms or links can have changed is counted again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorate.operators.mentions import count_alternation, linked
from quorate.sources.shared import saved


def _signature(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, _sign): the same for the same rows of a key, in whatever order."""
    one = F.xxhash64(F.col(text)).cast("decimal(38,0)")
    return texts.groupBy(key).agg(F.struct(F.count("*").alias("n"), F.sum(one).alias("h"), F.count(text).alias("t")).alias("_sign"))


def changed_keys(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """Keys whose texts are not the same rows in both; keys that only one of them has, too."""
    a, b = _signature(old, key, text), _signature(new, key, text).withColumnRenamed("_sign", "_new")
    return a.join(b, key, "full").where(~F.col("_sign").eqNullSafe(F.col("_new"))).select(key)


def changed_companies(old: DataFrame, new: DataFrame) -> DataFrame:
    """Companies that have gained or lost a term."""
    both = [x.select("company_id", "term").distinct() for x in (old, new)]
    return both[0].exceptAll(both[1]).unionAll(both[1].exceptAll(both[0])).select("company_id").distinct()


def recount(old: dict[str, DataFrame], new: dict[str, DataFrame], counts: DataFrame, key: str = "doc_id", text: str = "text", count: Callable = count_alternation) -> DataFrame:
    """(key, company_id, nbocc, was): links whose count is another now, with what it was (null: not known yet).

    old and new have `texts` (key, text), `terms` (company_id, term) and `links` (key, company_id); counts (key, company_id,
    nbocc) is what was known of the old links. Changed texts are counted with all terms, unchanged texts with the terms of
    changed companies, and with those of new links. A link without a mention (any more) counts 0. Links that are gone give
    no row. Applied to counts, the rows make what counting all of new from the start would give.
    """
    by = [key, "company_id"]
    links, terms, texts = new["links"].select(*by).distinct(), new["terms"], new["texts"].select(key, text)
    keys = saved(changed_keys(old["texts"], texts, key, text))
    companies = saved(changed_companies(old["terms"], terms))
    fresh = links.join(old["links"].select(*by).distinct(), by, "left_anti")
    fresh = saved(fresh.join(keys, key, "left_anti").join(companies, "company_id", "left_anti"))

    edited, same = texts.join(keys, key, "left_semi"), texts.join(keys, key, "left_anti")
    parts = [count(edited, terms, key, text), count(same, terms.join(companies, "company_id", "left_semi"), key, text)]
    asked = count(same.join(fresh.select(key).distinct(), key, "left_semi"), terms.join(fresh.select("company_id").distinct(), "company_id", "left_semi"), key, text)
    parts.append(asked.join(fresh, by, "left_semi"))
    affected = links.join(keys, key, "left_semi").unionByName(links.join(companies, "company_id", "left_semi")).unionByName(fresh)
    found = linked(parts[0].unionByName(parts[1]).unionByName(parts[2]), affected, by)
    known = counts.select(*by, F.col("nbocc").cast("long").alias("was"))
    return found.join(known, by, "left").where(~F.col("nbocc").eqNullSafe(F.col("was")))


def applied(counts: DataFrame, links: DataFrame, changes: DataFrame, by: list[str]) -> DataFrame:
    """(by, nbocc) of all links once the changes are made."""
    out = links.select(*by).distinct().join(counts.select(*by, F.col("nbocc").alias("_old")), by, "left")
    out = out.join(changes.select(*by, F.col("nbocc").alias("_new")), by, "left")
    return out.select(*by, F.coalesce("_new", "_old").cast("long").alias("nbocc"))
