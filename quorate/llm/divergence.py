"""Source divergence: how the words of a source differ from those of its language and of the language's other sources.

Count-cell ranking. What a term adds to a divergence depends on its counts alone, so terms with equal counts are one cell:
f is evaluated a cell, cells with equal values are merged and ranked by how many terms they hold, and only cells that
reach into the ranks asked for are expanded to their terms.

1. Tasks count terms by (lang, source) in their own rows; one shuffle by (lang, term) gives each term its counts by source.
2. Terms with equal counts in every source are one vector with a multiplicity.
3. `term`: vectors give cells (source, count, count in lang). Of these the values that come first are taken, each task
   giving at most `top` of them, then the terms of their cells, again at most `top` a task.
4. `pair`: for sources g and o, the terms with counts in both come from the vectors, those with counts in one from the cells
   of one source, those with none are what is left of V; the first correct the others, so no term is counted twice.
"""

from __future__ import annotations

import re
from collections import Counter
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lean, saved

#: A term's bytes once A-Z are lower case: ASCII letters and whatever is not ASCII.
TERM, BREAK = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[^a-z\x80-\xff]")
SLICE, HELD = 1 << 20, 200_000
BILLION = 1_000_000_000
#: Up to so many cells are broadcast to the terms; beyond, cells and terms are shuffled.
BROADCAST_ROWS = 200_000


def terms_of(raw: bytes):
    """The terms of a text in UTF-8, in lists: long texts are cut between terms."""
    at = 0
    while at < len(raw):
        end = len(raw)
        if end - at > SLICE and (cut := BREAK.search(raw, at + SLICE)):
            end = cut.start()
        yield TERM.findall(raw[at:end])
        at = end


def _counted(docs: DataFrame, held_terms: int) -> DataFrame:
    """(lang, source, term, n, docs): counts of occurrences and of rows, summed as far as a task's memory allows."""
    names, types = ["lang", "source", "term", "n", "docs"], [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def told(held):
        for (lang, source), (n, rows) in held.items():
            terms = list(n)
            for a in range(0, len(terms), 10_000):
                own = terms[a : a + 10_000]
                text = pa.array(own, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), types[0]), pa.array([source] * len(own), types[1]), text, pa.array([n[t] for t in own], types[3]), pa.array([rows[t] for t in own], types[4])], names)

    def run(batches):
        held: dict = {}
        for batch in batches:
            for lang, source, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                n, rows = held.setdefault((lang, source), (Counter(), Counter()))
                own: set[bytes] = set()
                for found in terms_of(raw.lower()):  # of bytes: A-Z alone
                    n.update(found)
                    own.update(found)
                rows.update(own)
            if sum(len(n) for n, _ in held.values()) > held_terms:
                yield from told(held)
                held = {}
        yield from told(held)

    empty = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*empty).mapInArrow(lean(run), "lang string, source string, term string, n long, docs long")


def _share(count: Column, total: Column, terms: Column, smooth: int) -> Column:
    """1 + floor(10**9 * (count + smooth) / (total + smooth * terms)), exact: products are decimals."""
    over = (count + smooth).cast("decimal(20,0)") * F.lit(Decimal(BILLION))
    return 1 + F.call_function("div", over, (total + smooth * terms).cast("decimal(20,0)"))


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def divergences(docs: DataFrame, least: int = 3, smooth: int = 1, top: int = 200, held_terms: int = HELD) -> DataFrame:
    """lang, source, part, item, value, rank, for docs with lang, source and text (null ones count as empty).

    Kept terms of a lang are those in at least `least` of its rows. p of a kept term, in a group (lang, source) or a whole
    lang, is 1 + floor(10**9 * (count + smooth) / (N + smooth * V)), N being the sum of counts there and V the number of
    kept terms; f = floor((p - q)**2 / q). `pair`: each other source of the lang, with f summed over the kept terms (q the
    other's p; 0 without kept terms). `term`: kept terms that the group has, with p above the lang's q, up to rank `top`.
    Ranks go from 1 by value descending, then item ascending in UTF-8. Repeated rows count each; a group has its rows even
    where none of its texts has a term. Counts may go up to 9 * 10**18 in a lang. No rows: no rows. Other columns are
    not read.
    """
    counted = _counted(docs, held_terms).repartition("lang", "term")
    by_source = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    one = F.sort_array(F.collect_list(F.struct("source", "n"))).alias("by")  # a source has one entry
    terms = saved(by_source.groupBy("lang", "term").agg(one, F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs"))
    vectors = saved(terms.groupBy("lang", "by", "total").agg(F.count("*").alias("m")))
    entries = vectors.select("lang", "total", "m", F.inline("by"))
    cells = saved(entries.groupBy("lang", "source", "n", "total").agg(F.sum("m").alias("m")))

    group = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    sizes = cells.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("m")).alias("size"), F.sum("m").alias("own"))
    langs = vectors.groupBy("lang").agg(F.sum(F.col("total") * F.col("m")).alias("lang_size"), F.sum("m").alias("v"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("size", "own", "lang_size", "v")}
    groups = saved(group.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").withColumns(zero))
    return _terms(terms, cells, groups, smooth, top).unionByName(_pairs(vectors, cells, groups, smooth))


def _terms(terms: DataFrame, cells: DataFrame, groups: DataFrame, smooth: int, top: int) -> DataFrame:
    p, q = _share(F.col("n"), F.col("size"), F.col("v"), smooth), _share(F.col("total"), F.col("lang_size"), F.col("v"), smooth)
    valued = cells.join(groups, ["lang", "source"]).withColumns({"p": p, "q": q}).where("p > q")
    valued = valued.select("lang", "source", "n", "total", "m", _f(F.col("p"), F.col("q")).alias("value"))
    values = valued.groupBy("lang", "source", "value").agg(F.sum("m").alias("m"))
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    # Every value stands for a term at least, so the first `top` values are enough; each task gives no more than these.
    values = values.withColumn("k", F.row_number().over(first)).where(F.col("k") <= top)
    values = values.withColumn("before", F.coalesce(F.sum("m").over(first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("before") < top)
    reach = saved(valued.drop("m").join(values.select("lang", "source", "value", "before"), ["lang", "source", "value"]))
    reach = F.broadcast(reach) if reach.count() <= BROADCAST_ROWS else reach
    found = terms.select("lang", "term", "total", F.inline("by")).join(reach, ["lang", "source", "n", "total"])
    place = F.row_number().over(Window.partitionBy("lang", "source", "value").orderBy("term"))
    found = found.withColumn("k", place).where(F.col("k") <= top).withColumn("rank", (F.col("before") + F.col("k")).cast("int"))
    return found.where(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def _pairs(vectors: DataFrame, cells: DataFrame, groups: DataFrame, smooth: int) -> DataFrame:
    share = lambda n, size: _share(n, size, F.col("v"), smooth)
    none = groups.where("v > 0").withColumn("p0", share(F.lit(0), F.col("size")))
    # What a lang's sources have: the size of each and its p for a term that it does not have. One entry a source.
    known = none.groupBy("lang", "v").agg(F.map_from_entries(F.collect_list(F.struct("source", F.struct("size", "p0")))).alias("of"))
    entry = lambda x: F.struct(x["source"].alias("source"), share(x["n"], F.col("of")[x["source"]]["size"]).alias("p"), F.col("of")[x["source"]]["p0"].alias("p0"))
    rows = vectors.join(known, "lang").select("lang", "m", F.transform("by", entry).alias("by"))
    both = rows.select("lang", "m", "by", F.explode("by").alias("g")).select("lang", "m", "g", F.explode("by").alias("o")).where("g.source <> o.source")
    g, g0, o, o0 = F.col("g.p"), F.col("g.p0"), F.col("o.p"), F.col("o.p0")
    both = both.select("lang", F.col("g.source").alias("source"), F.col("o.source").alias("item"), (F.col("m") * (_f(g, o) - _f(g, o0) - _f(g0, o) + _f(g0, o0))).alias("x"))

    single = cells.groupBy("lang", "source", "n").agg(F.sum("m").alias("m")).join(none, ["lang", "source"])
    single = single.select("lang", F.col("source").alias("has"), "m", share(F.col("n"), F.col("size")).alias("p"), F.col("p0").alias("own0"))
    other = none.select("lang", F.col("source").alias("other"), "p0")
    sides = single.join(other, "lang").where("has <> other")
    # A term of `has` alone: as the group against the other, and as the other against the group.
    ways = F.inline(F.array(
        F.struct(F.col("has").alias("source"), F.col("other").alias("item"), (F.col("m") * (_f(F.col("p"), F.col("p0")) - _f(F.col("own0"), F.col("p0")))).alias("x")),
        F.struct(F.col("other").alias("source"), F.col("has").alias("item"), (F.col("m") * (_f(F.col("p0"), F.col("p")) - _f(F.col("p0"), F.col("own0")))).alias("x")),
    ))
    a = none.select("lang", "source", "v", F.col("p0").alias("a0"))
    nothing = a.join(none.select("lang", F.col("source").alias("item"), F.col("p0").alias("b0")), "lang").where("source <> item")
    nothing = nothing.select("lang", "source", "item", (F.col("v") * _f(F.col("a0"), F.col("b0"))).alias("x"))
    summed = both.unionByName(sides.select("lang", ways)).unionByName(nothing).groupBy("lang", "source", "item").agg(F.sum("x").alias("value"))

    # Sources of langs without kept terms differ by 0.
    bare = groups.where("v = 0").select("lang", "source")
    bare = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return summed.unionByName(bare).select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))


def brute_force(rows: list[tuple], least: int = 3, smooth: int = 1, top: int = 200) -> set[tuple]:
    """The same rows from (lang, source, text), term by term; for tests."""
    lower = {x: x + 32 for x in range(65, 91)}
    docs = [(a or "", b or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower))) for a, b, t in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        often = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in often.items() if n >= least)
        sources = sorted({d[1] for d in own})
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2] if often[t] >= least) for s in sources}
        whole = sum(counts.values(), Counter())
        p = lambda c, t: 1 + BILLION * (c[t] + smooth) // (sum(c.values()) + smooth * len(kept))
        shares, q = {s: {t: p(counts[s], t) for t in kept} for s in sources}, {t: p(whole, t) for t in kept}
        f = lambda x, y: (x - y) ** 2 // y
        ranked = lambda items: [(i, v, k + 1) for k, (i, v) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode())))]
        for s in sources:
            pairs = [(o, sum(f(shares[s][t], shares[o][t]) for t in kept)) for o in sources if o != s]
            said = [(t, f(shares[s][t], q[t])) for t in kept if counts[s][t] and shares[s][t] > q[t]]
            out |= {(lang, s, "pair", *x) for x in ranked(pairs)} | {(lang, s, "term", *x) for x in ranked(said)[:top]}
    return out
