"""Mixing sources to target weights: Sainte-Laguë quotas of equal-word blocks, then blocks from a seeded order."""

from __future__ import annotations

import hashlib
import heapq
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, literal_rows, saved


def targets(sizes: list[int], weights: list[float], share: float = 1.5, cap: float = 2.0) -> list[float]:
    """share of all sizes by weight; what exceeds cap times a source's size goes to the others by weight, until none does."""
    left, open_ = share * sum(sizes), [i for i in range(len(sizes))]
    out = [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total > cap * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = cap * sizes[i]
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def sainte_lague(votes: list[float], seats: int) -> list[int]:
    """The index that gets each seat, in order of the quotients votes / (2 * seats so far + 1); ties: the lower index.

    Its first k entries are the apportionment of k seats, so cutting it into runs gives the quota of each shard.
    """
    heap = [(-v, i, 0) for i, v in enumerate(votes) if v > 0]
    heapq.heapify(heap)
    order = []
    while heap and len(order) < seats:
        _, i, k = heapq.heappop(heap)
        order.append(i)
        heapq.heappush(heap, (-votes[i] / (2 * k + 3), i, k + 1))
    return order


def quotas(words: list[int], blocks: int, shards: int) -> list[list[int]]:
    """For each source, how many of its blocks go to each shard; what it gives is cut into so many equal blocks.

    Highest quotients deal the blocks, and their order is cut into runs, one a shard. Sources that get fewer than four
    blocks a shard are dealt again among themselves in smaller blocks, down to a word. Each dealing leaves at most a
    quarter of the words to the next, as a source has 256 blocks (or four a shard, times four) on the average.
    """
    out = [[0] * shards for _ in words]
    few, small = 4 * shards, [i for i, n in enumerate(words) if n > 0]
    while small:
        total = sum(words[i] for i in small)
        block = max(1, total // max(blocks, max(256, 4 * few) * len(small)))
        order = sainte_lague([words[i] for i in small], round(total / block))
        for i in small:
            out[i] = [0] * shards
        for s in range(shards):
            for i in order[len(order) * s // shards : len(order) * (s + 1) // shards]:
                out[small[i]][s] += 1
        small = [i for i in small if sum(out[i]) < few] if block > 1 else []
    return out


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, blocks: int = 6144, shards: int = 16, seed: int = 5, rank_rows: int = 50_000, broadcast_sources: int = 10_000) -> DataFrame:
    """Adds to docs: size, source_size, target, taken, shard, in place of columns of these names.

    Sources weigh weights[0], weights[1], ... in the order of their code points, null last, repeating. The words of a
    source are one stream, its documents in an order that seed and doc_id give. It gives its target, to the word: whole
    passes over the stream and, for the rest, a run from a seeded start. What it gives is cut into blocks of equal
    words, which are dealt to shards by the highest quotients (quotas). taken counts the document's words in all blocks
    (at most cap times size); shard is where its first block goes (null where nothing is taken).

    What the driver holds is one row a source and `blocks` seats (at least 256 a source). Null text: size 0. Empty
    table or no words: targets and taken are 0. Rows of one (source, doc_id), null ids among them, are dealt by their
    text; equal rows follow each other.
    """
    mine = ["size", "source_size", "target", "taken", "shard"]
    base = docs.drop(*mine).withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    slim = saved(base.select("source", "doc_id", "size", F.xxhash64("doc_id", F.coalesce("text", F.lit("")), F.lit(seed)).alias("_h")))
    rows = slim.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()  # one row a source
    rows = sorted(rows, key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["n"] for r in rows]
    want = targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], share, cap)
    give = [min(round(w), int(cap * n)) for w, n in zip(want, sizes, strict=True)]
    facts = []
    for i, (r, dealt) in enumerate(zip(rows, quotas(give, blocks, shards), strict=True)):
        start = int(hashlib.sha256(f"{seed}:{r['source']}".encode()).hexdigest()[:12], 16) % max(1, sizes[i])
        full, rest = divmod(give[i], sizes[i]) if sizes[i] else (0, 0)
        ends = ",".join(map(str, accumulate(dealt)))
        facts.append({"_s": r["source"], "source_size": sizes[i], "target": want[i], "_give": give[i], "_full": full, "_rest": rest, "_start": start, "_blocks": sum(dealt), "_ends": ends})
    small = literal_rows(docs.sparkSession, facts, {"_s": "string", "source_size": "long", "target": "double", "_give": "long", "_full": "long", "_rest": "long", "_start": "long", "_blocks": "long", "_ends": "string"})
    if len(facts) <= broadcast_sources:
        small = F.broadcast(small)

    pieces = max(64, max((r["rows"] for r in rows), default=0) // rank_rows + 1)
    slim = slim.withColumn("_b", F.pmod(F.xxhash64("_h"), F.lit(pieces)).cast("int"))
    sums = slim.groupBy("source", "_b").agg(F.sum("size").alias("_n"))
    before = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("_os"), F.col("_b").alias("_ob"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("source", "_b").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = slim.join(offsets, slim["source"].eqNullSafe(offsets["_os"]) & (slim["_b"] == offsets["_ob"]))
    at = at.withColumn("_a", F.col("_off") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    at = at.join(small, at["source"].eqNullSafe(small["_s"]))

    # The run [start, start + rest) of words may wrap round the end of the stream.
    a, z, size, start = F.col("_a"), F.col("_a") + F.col("size"), F.col("source_size"), F.col("_start")
    over = lambda lo, hi: F.greatest(F.lit(0), F.least(z, hi) - F.greatest(a, lo))
    end = start + F.col("_rest")
    taken = F.col("_full") * F.col("size") + over(start, F.least(end, size)) + over(F.lit(0), end - size)
    # The place of the document's first word among those given, and that of its block.
    first = F.when(F.col("_full") > 0, a).when(z <= start, a + size - start).otherwise(F.greatest(a - start, F.lit(0)))
    at = at.withColumn("_first", first)
    place = F.expr("_first * _blocks div greatest(_give, 1)")
    shard = F.size(F.filter(F.split("_ends", ","), lambda e: e.cast("long") <= place))
    at = at.withColumns({"taken": taken, "shard": F.when(taken > 0, F.least(shard, F.lit(shards - 1)))})
    return at.select("source", "doc_id", *mine)
