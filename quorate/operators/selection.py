"""Which pairs to rate: eligibility, resumption, limits, chunks, reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorate.sources.shared import saved


def to_resume(status: Column, version: Column, target: str) -> Column:
    """Neither ok nor submitted in the target version; nulls count as neither."""
    return (~status.eqNullSafe("ok") & ~status.eqNullSafe("submitted")) | ~version.eqNullSafe(target)


def work(pairs: DataFrame, status: Column, version: Column, target: str | None, resume: bool = True) -> DataFrame:
    """The pairs to rate: with `resume` and a target version those still to do, else all."""
    return pairs.where(to_resume(status, version, target)) if resume and target else pairs


def rescorable(pairs: DataFrame, status: Column, extraction: Column) -> DataFrame:
    """Pairs whose stored facts can be scored again: rated ok, facts present."""
    return pairs.where(F.coalesce(status == "ok", F.lit(False)) & extraction.isNotNull())


def latest(df: DataFrame, by: str, newest: list, n: int) -> DataFrame:
    """The first n rows of each key in the order `newest`; the window limit works before the shuffle too."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*newest))).where(F.col("_r") <= n).drop("_r")


def reason(nbocc: Column, least: int = 2) -> Column:
    return F.when(nbocc >= least, F.lit("selected")).when(nbocc == 1, F.lit("single mention")).otherwise(F.lit("false positive"))


def running_sum(df: DataFrame, order: list, value: str, name: str) -> DataFrame:
    """Adds the sum of `value` over the rows before, in `order` (distinct); no task has more than a range of the rows.

    Rows are range-partitioned and written; what comes before a range is a sum over one row a range.
    """
    ranged = saved(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy("_range").agg(F.sum(value).alias("_t"))
    over = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", F.coalesce(F.sum("_t").over(over), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_off") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_range", "_off")


def positions(df: DataFrame, key: str, number: str, width: int = 50_000, name: str = "position") -> DataFrame:
    """Adds each row's place from 0 in the order (key, number descending), numbers being distinct within a key.

    Rows are numbered inside ranges of `width` numbers of a key, so no key is one task; what comes before a range is a
    running sum over the counts of ranges, which is itself dealt out by ranges of (key, range).
    """
    df = df.withColumn("_b", F.floor(-F.col(number) / F.lit(width)))
    counts = df.groupBy(key, "_b").agg(F.count("*").alias("_n"))
    ranges = running_sum(counts, [F.col(key), F.col("_b")], "_n", "_o").drop("_n")
    inside = Window.partitionBy(key, "_b").orderBy(F.desc(number))
    return df.join(ranges, [key, "_b"]).withColumn(name, F.col("_o") + F.row_number().over(inside) - 1).drop("_b", "_o")


def chunks(df: DataFrame, key: str, number: str, size: int = 1000) -> DataFrame:
    """Adds chunk: runs of `size` rows in the order (key, number descending)."""
    return positions(df, key, number).withColumn("chunk", F.floor(F.col("position") / size).cast("long"))
