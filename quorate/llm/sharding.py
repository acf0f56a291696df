"""Balanced label propagation: linked documents move to their neighbours' shard under quotas; counts end one apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ranked, saved


def _at(values: list, index: Column, kind: str) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), index + 1)


def _admitted(asks: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], float]:
    """The share of each (from, to) that may move: into no shard more than its room and what leaves it."""
    flow = {k: float(n) for k, n in asks.items()}
    for _ in range(500):
        settled = True
        for j in range(len(room)):
            into = sum(x for (_, b), x in flow.items() if b == j)
            most = max(0.0, room[j] + sum(x for (a, _), x in flow.items() if a == j))
            if into > most * 1.001 + 0.5:
                settled = False
                for k in flow:
                    flow[k] *= most / into if k[1] == j else 1.0
        if settled:
            break
    return {k: flow[k] / n for k, n in asks.items()}


def _most() -> Column:
    """Of a group's counts by shard (_n), the shard with the largest; of equal ones, one that a hash decides."""
    return F.max(F.struct("_n", F.xxhash64("hub", "shard").alias("tie"), "shard"))["shard"]


def _settled(state: DataFrame, quota: list[int], pieces: int) -> DataFrame:
    """state after a last round, in which the rows that are not with most of their group go there by rank, as far as the
    shard holds them beside its settled rows, whoever else is there; with loose: whether a row may be moved again, as it has
    no group or has not come to it. Groups larger than a shard are settled where they are."""
    linked, shards = state.where("hub IS NOT NULL"), len(quota)
    most = linked.groupBy("hub", "shard").agg(F.count("*").alias("_n")).groupBy("hub").agg(_most().alias("most"))
    marked = saved(linked.join(most, "hub").withColumn("stray", (F.col("most") != F.col("shard")) & (F.col("copies") <= quota[0])))
    settled = {r["shard"]: r["n"] for r in marked.where("NOT stray").groupBy("shard").agg(F.count("*").alias("n")).collect()}  # a row a shard
    room = [max(0, quota[j] - settled.get(j, 0)) for j in range(shards)]
    strays = ranked(marked.where("stray"), ["most"], F.pmod(F.xxhash64("hub"), F.lit(pieces)), ["hub", "id", "uid"], "_r")
    strays = strays.withColumn("loose", F.col("_r") >= _at(room, F.col("most"), "long"))
    strays = strays.withColumn("shard", F.when(F.col("loose"), F.col("shard")).otherwise(F.col("most")))
    own = state.columns
    out = marked.where("NOT stray").select(*own, F.lit(False).alias("loose")).unionAll(strays.select(*own, "loose"))
    return saved(out.unionAll(state.where("hub IS NULL").select(*own, F.lit(True).alias("loose"))))


def shard_documents(docs: DataFrame, shards: int = 24, rounds: int = 16, seed: int = 11, rank_rows: int = 100_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs (repeated rows each get a slot).

    Links: equal texts. A group of equal texts is one hub with its members as leaves, so that a member's neighbours by
    shard are the hub's counts by shard, and no pairs are made. Each round, members outside the shard that holds most
    of their group propose to move there. Proposals are counted by pair of shards, and of each pair that share is
    admitted with which no shard takes in more than its room and what leaves it. Small groups move as one; a group of
    more than a quarter of a shard moves in part, and goes on to the next shard when the first is full. Rounds end when
    nothing proposes to move, or no round of the last three has brought more linked rows to most of their group; 16 at
    most. A last round admits by rank, and exactly: see _settled(). Rows without links, or that have not come to their
    group, are the ballast: the last step moves them (then others) from shards above their quota to those below.

    The law is `rows`: counts differ by at most one. size: UTF-8 bytes of the text plus 8 (null: 8). Null texts are
    linked with nothing. No rows: no rows. Other columns are not returned.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    base = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.unhex(F.md5(text))).alias("g"),
    )
    base = base.withColumn("uid", F.monotonically_increasing_id())
    # Id and text decide where a row goes (its number, where it has no id), however the table is dealt out.
    base = saved(base.withColumn("id", F.coalesce("doc_id", "uid")))
    n = base.count()
    quota = [n // shards + (j < n % shards) for j in range(shards)]
    # Written, so that the join by text is between two plain shuffles and Spark can split a large group's rows.
    copies = saved(base.where("g IS NOT NULL").groupBy("g").agg(F.count("*").alias("copies")).where("copies > 1").select(F.col("g").alias("hub"), "copies"))
    state = base.join(copies, base["g"] == copies["hub"], "left").drop("g")
    start = F.xxhash64("id", "text_crc32", "size", F.lit(seed))
    state = saved(state.withColumn("shard", F.pmod(start, F.lit(shards)).cast("int")))

    left: list[int] = []
    for k in range(rounds):
        linked = state.where("hub IS NOT NULL")
        held = linked.groupBy("hub", "shard", "copies").agg(F.count("*").alias("_n"))
        top = _most()
        # One row a shard: what linked rows it has, and how many of them have more of their group elsewhere.
        most = held.groupBy("hub").agg(top.alias("most"))
        facts = held.join(most, "hub").groupBy("shard").agg(F.sum("_n").alias("load"), F.sum(F.when((F.col("most") != F.col("shard")) & (F.col("copies") <= quota[0]), F.col("_n")).otherwise(0)).alias("strays"))
        facts = {r["shard"]: (r["load"], r["strays"]) for r in facts.collect()}
        left.append(sum(s for _, s in facts.values()))
        if len(left) > 3 and min(left[-3:]) >= min(left[:-3]):
            break
        room = [quota[j] - facts.get(j, (0, 0))[0] for j in range(shards)]
        open_ = [room[j] + facts.get(j, (0, 0))[1] > quota[j] // 100 for j in range(shards)]
        best = held.where(_at(open_, F.col("shard"), "boolean")).groupBy("hub").agg(top.alias("best"))
        asked = linked.join(best, "hub", "left")
        asked = asked.withColumn("moves", F.coalesce((F.col("best") != F.col("shard")) & _at(open_, F.col("shard"), "boolean"), F.lit(False)))
        asks = {(r["shard"], r["best"]): r["n"] for r in asked.where("moves").groupBy("shard", "best").agg(F.count("*").alias("n")).collect()}  # shards ** 2 rows at most
        if not asks:
            break
        shares = _admitted(asks, room)
        share = _at([shares.get((i, j), 0.0) for i in range(shards) for j in range(shards)], F.col("shard") * shards + F.col("best"), "double")
        # A group moves as one, unless it is so large that it must move in part.
        luck = F.when(F.col("copies") * 4 > quota[0], F.xxhash64("id", F.lit(seed + k))).otherwise(F.xxhash64("hub", F.lit(seed + k)))
        admitted = F.col("moves") & (F.pmod(luck, F.lit(1 << 20)) / float(1 << 20) < share)
        moved = asked.withColumn("shard", F.when(admitted, F.col("best")).otherwise(F.col("shard")))
        state = saved(moved.select(*state.columns).unionAll(state.where("hub IS NULL")))

    pieces = max(16, n // (shards * rank_rows) + 1)
    state = _settled(state, quota, pieces)
    # A group lies together, unless it is too large for one bucket: no bucket has more than rank_rows of one.
    part = F.when(F.col("hub").isNotNull(), F.pmod(F.xxhash64("id"), F.ceil(F.col("copies") / rank_rows)))
    bucket = F.when(F.col("loose"), F.lit(pieces)).otherwise(F.lit(0)) + F.pmod(F.xxhash64(F.coalesce(F.hex("hub"), F.col("id").cast("string")), part), F.lit(pieces))
    placed = ranked(state, ["shard"], bucket, ["hub", "id", "uid"])
    count = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    over, lows, starts, gone, free = [], [], [], 0, 0
    for j in range(shards):
        c = count.get(j, 0)
        over.append(gone)
        gone += max(0, c - quota[j])
        if c < quota[j]:
            lows.append(j)
            starts.append(free)
            free += quota[j] - c
    # The lookups are columns of their own: inside one select, a lambda would take the new `shard` for the old one.
    shard, rank = F.col("shard"), F.col("rank")
    placed = placed.withColumn("out", rank >= _at(quota, shard, "long"))
    placed = placed.withColumn("k", _at(over, shard, "long") + rank - _at(quota, shard, "long"))
    if lows:
        placed = placed.withColumn("which", F.size(F.filter(F.array(*[F.lit(s).cast("long") for s in starts]), lambda s: s <= F.col("k"))) - 1)
        base = [count.get(j, 0) - s for j, s in zip(lows, starts, strict=True)]
        placed = placed.withColumns({
            "to": F.when(F.col("out"), _at(lows, F.col("which"), "int")).otherwise(shard),
            "slot": F.when(F.col("out"), _at(base, F.col("which"), "long") + F.col("k")).otherwise(rank),
        })
    else:
        placed = placed.withColumns({"to": shard, "slot": rank})
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("to").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
