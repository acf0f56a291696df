"""How raters agree: everything derives from counts of (group, rater, reference note, note), one shuffle of few rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorate.operators.selection import running_sum

NOTES = (0, 1, 2)


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def whole(column: str) -> Column:
    """A count as a decimal, so that products of large counts stay exact."""
    return F.col(column).cast("decimal(38,0)")


def valid(df: DataFrame, notes: list[str]) -> DataFrame:
    """Rows whose every note is 0, 1 or 2."""
    return df.where(reduce(lambda x, y: x & y, [F.coalesce(F.col(c).isin(*NOTES), F.lit(False)) for c in notes]))


def all_ok(df: DataFrame, statuses: list[str]) -> DataFrame:
    """Rows whose every status is ok; null is not."""
    return df.where(reduce(lambda x, y: x & y, [F.coalesce(F.col(c) == "ok", F.lit(False)) for c in statuses]))


def unpivot(df: DataFrame, keep: list[str], columns: list[str], name: str = "rater", value: str = "note") -> DataFrame:
    return df.unpivot(keep, columns, name, value)


def confusion(df: DataFrame, reference: str, raters: list[str], by: list[str] | None = None) -> DataFrame:
    """(by..., rater, ref, note, n): the counts that all metrics share."""
    by = by or []
    long = df.withColumnRenamed(reference, "ref").unpivot([*by, "ref"], raters, "rater", "note")
    return long.groupBy(*by, "rater", "ref", "note").agg(F.count("*").alias("n"))


def accuracy_kappa(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, accuracy and Cohen's kappa; kappa is null where chance agreement is certain. Integer sums, one division."""
    by = [*(by or []), "rater"]
    total = [F.sum(F.when(F.col("ref") == F.col("note"), F.col("n")).otherwise(0)).alias("hits"), F.sum("n").alias("n")]
    for k in NOTES:
        total += [F.sum(F.when(F.col("ref") == k, F.col("n")).otherwise(0)).alias(f"r{k}"), F.sum(F.when(F.col("note") == k, F.col("n")).otherwise(0)).alias(f"c{k}")]
    one = counts.groupBy(*by).agg(*total)
    chance = reduce(lambda a, b: a + b, [whole(f"r{k}") * whole(f"c{k}") for k in NOTES])
    n = whole("n")
    return one.select(*by, "n", ratio(F.col("hits"), F.col("n")).alias("accuracy"), ratio(n * whole("hits") - chance, n * n - chance).alias("kappa"))


def dense(counts: DataFrame) -> DataFrame:
    """All 9 cells of each rater, absent ones 0."""
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("ref"), F.lit(b).alias("note")) for a in NOTES for b in NOTES])).alias("cell")
    grid = counts.select("rater").distinct().select("rater", cells).select("rater", "cell.*")
    return grid.join(counts, ["rater", "ref", "note"], "left").select("rater", "ref", "note", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def class_report(counts: DataFrame) -> DataFrame:
    """(rater, label, precision, recall, f1, support) for 0, 1, 2, accuracy, macro, weighted; x/0 counts as 0."""
    sums = [F.sum("n").alias("n")]
    for k in NOTES:
        for name, cond in ((f"t{k}", (F.col("ref") == k) & (F.col("note") == k)), (f"p{k}", F.col("note") == k), (f"s{k}", F.col("ref") == k)):
            sums.append(F.sum(F.when(cond, F.col("n")).otherwise(0)).alias(name))
    one = counts.groupBy("rater").agg(*sums)
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    p = {k: zero(ratio(F.col(f"t{k}"), F.col(f"p{k}"))) for k in NOTES}
    r = {k: zero(ratio(F.col(f"t{k}"), F.col(f"s{k}"))) for k in NOTES}
    f = {k: zero(ratio(2 * F.col(f"t{k}"), F.col(f"p{k}") + F.col(f"s{k}"))) for k in NOTES}
    hits = F.col("t0") + F.col("t1") + F.col("t2")
    row = lambda label, a, b, c, s: F.struct(F.lit(label).alias("label"), a.alias("precision"), b.alias("recall"), c.alias("f1"), s.cast("long").alias("support"))
    rows = [row(str(k), p[k], r[k], f[k], F.col(f"s{k}")) for k in NOTES]
    rows.append(row("accuracy", *[ratio(hits, F.col("n"))] * 3, F.col("n")))
    rows.append(row("macro", *[(m[0] + m[1] + m[2]) / 3 for m in (p, r, f)], F.col("n")))
    rows.append(row("weighted", *[ratio(m[0] * F.col("s0") + m[1] * F.col("s1") + m[2] * F.col("s2"), F.col("n")) for m in (p, r, f)], F.col("n")))
    return one.select("rater", F.inline(F.array(*rows)))


def shares(counts: DataFrame, **conditions: Column) -> DataFrame:
    """Percent of each rater's counts for which each condition holds."""
    sums = [F.sum(F.when(c, F.col("n")).otherwise(0)).alias(f"_{name}") for name, c in conditions.items()]
    one = counts.groupBy("rater").agg(F.sum("n").alias("n"), *sums)
    return one.select("rater", "n", *[ratio(F.col(f"_{name}") * 100, F.col("n")).alias(name) for name in conditions])


def severity(counts: DataFrame) -> DataFrame:
    gap = F.abs(F.col("note") - F.col("ref"))
    return shares(counts, exact=gap == 0, adjacent=gap == 1, polar=gap == 2)


def bias(counts: DataFrame) -> DataFrame:
    return shares(counts, under=F.col("note") < F.col("ref"), over=F.col("note") > F.col("ref"))


def distribution(df: DataFrame, raters: list[str]) -> DataFrame:
    """Percent of each note among a rater's notes that are not null; absent notes 0."""
    return shares(df.unpivot([], raters, "rater", "note").where("note IS NOT NULL").groupBy("rater", "note").agg(F.count("*").alias("n")), **{f"note_{k}": F.col("note") == k for k in NOTES})


def robustness(df: DataFrame, raters: list[str]) -> DataFrame:
    """Before any cleaning: notes out of range, and nulls."""
    return df.unpivot([], raters, "rater", "note").groupBy("rater").agg(
        F.count_if(F.col("note").isNotNull() & ~F.col("note").isin(*NOTES)).alias("out_of_range"),
        F.count_if(F.col("note").isNull()).alias("nulls"),
    )


def grey_zone(df: DataFrame, baseline: str, second: str, raters: list[str]) -> DataFrame:
    """Where the two references differ: percent of a rater's notes that follow either."""
    long = df.where(F.col(baseline) != F.col(second)).withColumnsRenamed({baseline: "ref", second: "other"}).unpivot(["ref", "other"], raters, "rater", "note")
    counts = long.groupBy("rater", "ref", "other", "note").agg(F.count("*").alias("n"))
    return shares(counts, follows_base=F.col("note") == F.col("ref"), follows_second=F.col("note") == F.col("other"))


def quantile_edges(df: DataFrame, x: str, q: int) -> DataFrame:
    """One row `edges`: the distinct quantiles k / q of x, interpolated between neighbours; nulls do not count.

    From counts by value and a running sum that is dealt out by ranges of values; only the values at the ranks that are
    wanted, at most 2 * (q + 1), come together.
    """
    counts = df.where(F.col(x).isNotNull()).groupBy(F.col(x).alias("_v")).agg(F.count("*").alias("_n"))
    placed = running_sum(counts, [F.col("_v")], "_n", "_low")
    total = counts.agg(F.sum("_n").alias("_t"))
    wanted = total.select(F.explode(F.array(*[F.lit(k / q) for k in range(q + 1)])).alias("_q"), "_t").select("_q", (F.col("_q") * (F.col("_t") - 1)).alias("_at"))
    ends = wanted.select("_q", "_at", F.explode(F.array(F.floor("_at"), F.ceil("_at"))).alias("_rank"))
    hit = placed.join(F.broadcast(ends), (F.col("_low") <= F.col("_rank")) & (F.col("_rank") < F.col("_low") + F.col("_n")))
    one = hit.groupBy("_q", "_at").agg(F.min("_v").cast("double").alias("_a"), F.max("_v").cast("double").alias("_z"))
    part = F.col("_at") - F.floor("_at")
    edge = one.select("_q", ((1 - part) * F.col("_a") + part * F.col("_z")).alias("_e"))
    return edge.agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("_q", "_e"))), lambda s: s["_e"])).alias("_edges"))


def quantile_accuracy(df: DataFrame, x: str, reference: str, raters: list[str], q: int = 4) -> DataFrame:
    """Accuracy by quantile bin (lo, hi] of x, the lowest value included; equal edges fall together."""
    edges = quantile_edges(df, x, q)
    binned = df.join(F.broadcast(edges)).withColumn("bin", F.greatest(F.size(F.filter("_edges", lambda e: e < F.col(x))), F.lit(1)))
    counts = confusion(binned, reference, raters, ["bin"])
    return counts.groupBy("bin", "rater").agg(F.sum("n").alias("n"), ratio(F.sum(F.when(F.col("ref") == F.col("note"), F.col("n")).otherwise(0)), F.sum("n")).alias("accuracy"))


def correctness_correlation(df: DataFrame, x: str, reference: str, raters: list[str]) -> DataFrame:
    """Pearson correlation of being right with x; null where either is constant. x is an integer: the sums are exact,
    made in decimals from counts by (rater, x)."""
    long = df.withColumnRenamed(reference, "ref").unpivot(["ref", x], raters, "rater", "note")
    counts = long.groupBy("rater", F.col(x).cast("long").alias("_x")).agg(F.count("*").alias("_n"), F.count_if(F.col("ref") == F.col("note")).alias("_h"))
    v, k, h = whole("_x"), whole("_n"), whole("_h")
    s = counts.groupBy("rater").agg(F.sum("_n").alias("n"), F.sum(v * k).alias("sx"), F.sum("_h").alias("sy"), F.sum(v * v * k).alias("sxx"), F.sum(v * h).alias("sxy"))
    n, sx, sy, sxx, sxy = (whole(c) for c in ("n", "sx", "sy", "sxx", "sxy"))
    top, vx, vy = n * sxy - sx * sy, n * sxx - sx * sx, n * sy - sy * sy
    return s.select("rater", "n", F.round(F.try_divide(top.cast("double"), F.sqrt(vx.cast("double")) * F.sqrt(vy.cast("double"))), 9).alias("correlation"))


def worst_entities(df: DataFrame, entity: str, reference: str, raters: list[str], least: int = 15, k: int = 10) -> DataFrame:
    """The k entities of at least `least` rows whose mean accuracy over the raters is lowest."""
    hits = reduce(lambda a, b: a + b, [(F.col(r) == F.col(reference)).cast("long") for r in raters])
    one = df.groupBy(entity).agg(F.count("*").alias("n"), F.sum(hits).alias("hits")).where(F.col("n") >= least)
    return one.select(entity, "n", ratio(F.col("hits"), F.col("n") * len(raters)).alias("accuracy")).orderBy("accuracy", entity).limit(k)


def version_coherence(df: DataFrame, versions: list[str], target: str) -> DataFrame:
    """Values other than the target, null among them, of each version column, with their counts."""
    return df.unpivot([], versions, "column", "version").where(~F.col("version").eqNullSafe(target)).groupBy("column", "version").agg(F.count("*").alias("n"))


def stratified(df: DataFrame, stratum: str, quota: dict[str, int] | Column, key: Column, rank: str | None = None, most: int | None = None) -> DataFrame:
    """`quota` rows of each stratum (all, if it has fewer) in the order of md5(key): reruns agree.

    `most` is the largest quota: a literal, so that tasks drop what they can before the shuffle. rank: the name of a
    column to keep the place in.
    """
    if not isinstance(quota, Column):
        most = max(quota.values())
        quota = F.element_at(F.create_map(*[F.lit(x) for kv in quota.items() for x in kv]), F.col(stratum))
    order = Window.partitionBy(stratum).orderBy("_draw")
    drawn = df.withColumn("_draw", F.md5(key.cast("string"))).withColumn("_place", F.row_number().over(order))
    drawn = drawn if most is None else drawn.where(F.col("_place") <= most)
    drawn = drawn.where(F.col("_place") <= quota).drop("_draw")
    return drawn.withColumnRenamed("_place", rank) if rank else drawn.drop("_place")
