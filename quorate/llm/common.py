"""Shared helpers: reading tables, cutting lineage in the shared folder, distributed ranks, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorate.sources.shared import saved, table

__all__ = ["begin", "components", "give_back", "kept", "lean", "literal_rows", "ranked", "saved", "table"]

#: The whole range of white space that separates words.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
#: Bytes of an Arrow batch on its way to a Python worker: it is held on both sides, beside what a task makes of it.
BATCH_BYTES = 4 << 20

#: What a worker keeps between tasks, as (module whose task made it, how to drop it), and the module at work.
_KEPT: list[tuple[str, Callable]] = []
_AT_WORK = [""]


def lean(run: Callable) -> Callable:
    """run for mapInArrow, giving what its task freed back to the system: Python workers serve many tasks, one after the
    other, and would else keep the most memory that any of them took. Tables that tasks keep for the next one (kept) go
    when a task of another module comes. Batches are of BATCH_BYTES where the session names no size: that setting stays
    in the session, as plans are run after this returns."""
    spark, owner = SparkSession.active(), run.__module__
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def lean_run(batches):
        begin(owner)
        yield from run(batches)
        give_back()

    return lean_run


def begin(owner: str) -> None:
    _AT_WORK[0] = owner
    for made_by, drop in [k for k in _KEPT if k[0] != owner]:
        drop()
        _KEPT.remove((made_by, drop))


def kept(drop: Callable) -> None:
    _KEPT.append((_AT_WORK[0], drop))


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def ranked(df: DataFrame, by: list[str], bucket: Column, order: list[str], name: str = "rank") -> DataFrame:
    """Adds the row's rank from 0 within `by`, in the order (bucket, order), without one task for a whole group.

    Rows are numbered inside (by, bucket); what smaller buckets of the same group hold is added from a table of counts.
    """
    df = df.withColumn("_b", bucket)
    counts = df.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)],
        F.col("_b").alias("_kb"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
    )
    on = [df[c].eqNullSafe(offsets[f"_k{i}"]) for i, c in enumerate(by)] + [df["_b"] == offsets["_kb"]]
    inside = Window.partitionBy(*by, "_b").orderBy(*order)
    numbered = df.join(offsets, on, "inner")
    numbered = numbered.withColumn(name, F.col("_off") + F.row_number().over(inside) - 1)
    return numbered.drop("_b", "_kb", "_off", *[f"_k{i}" for i in range(len(by))])


def literal_rows(spark: SparkSession, rows: list[dict], types: dict[str, str]) -> DataFrame:
    """A small table of driver values (its size is bounded by the caller) as a literal, without Python on executors."""
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(t).alias(c) for c, t in types.items()])
    cells = F.array(*[F.struct(*[F.lit(r[c]).cast(t).alias(c) for c, t in types.items()]) for r in rows])
    return spark.range(1).select(F.inline(cells))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is the smallest node it is connected to.

    Large-star and small-star steps: each node points its neighbours at the smallest one it sees. The number of edges
    never grows, and a round of both steps at least halves the depth; every round is a written table.
    """
    edges = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        new = saved(small.where("a <> b").distinct())
        moved = new.join(edges, ["a", "b"], "left_anti").limit(1).count() + edges.join(new, ["a", "b"], "left_anti").limit(1).count()
        edges = new
        if not moved:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)
