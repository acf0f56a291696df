"""Best-fit packing by linear grouping: plans over counts of lengths, then actual documents in place of them.

Lengths are at most `capacity`, so their histogram has a bounded size, and so has the plan that the driver makes from
it. Documents take their places in the plan by their rank among those of the same length, so no row goes to the driver
and no length, however frequent, to one task.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorate.functions.tokens import encoders, token_ids

from .common import kept, lean, ranked, saved

END_ID = 2


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: the first takes what whole pieces leave."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *[(a, capacity) for a in range(first, n, capacity)]]


def pieces(docs: DataFrame, path: str, capacity: int, keep_ids: bool) -> DataFrame:
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * keep_ids]
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def run(batches):
        kept(encoders.cache_clear)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part, rows = batch.slice(lo, 256), []
                texts = [t or "" for t in part.column(1).to_pylist()]
                for i, ids in zip(part.column(0).to_pylist(), token_ids(texts, path), strict=True):
                    all_ids = np.array([*ids, END_ID], "<u4")
                    for k, (a, n) in enumerate(cut(len(all_ids), capacity)):
                        own = all_ids[a : a + n]
                        rows.append((i, k, a, n, zlib.crc32(own.tobytes()), *[own.astype(np.int32)] * keep_ids))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return docs.select("doc_id", "text").mapInArrow(lean(run), kind)


def configurations(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Few-size configurations for sizes with counts: ({size: uses}, times), until all counts are used.

    Each starts with the largest size left and fills the rest of the sequence as far as the sizes left can (a bounded
    subset sum over bits, larger sizes first); it is used as often as its scarcest size allows, which uses that up.
    """
    left = {s: n for s, n in sorted(counts.items(), reverse=True) if n}
    out = []
    while left:
        first = next(iter(left))
        room = capacity - first
        reach, seen = 1, []
        for s, n in left.items():
            if s > room:
                continue
            before = reach
            for _ in range(min(n - (s == first), room // s)):
                grown = reach | (reach << s) & ((1 << (room + 1)) - 1)
                if grown == reach:
                    break
                reach = grown
            seen.append((s, before))
            if reach >> room & 1:
                break
        total = reach.bit_length() - 1
        use = {first: 1}
        for s, before in reversed(seen):
            while not before >> total & 1:
                use[s] = use.get(s, 0) + 1
                total -= s
        times = min(left[s] // u for s, u in use.items())
        out.append((use, times))
        for s, u in use.items():
            left[s] -= u * times
            if not left[s]:
                del left[s]
    return out


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Configurations, as above, of best fit decreasing: the fullest sequence that has room takes the next size.

    Sequences with equal room and contents are filled together. A sequence just filled is the fullest there is, so it
    takes the same size as often as it fits.
    """
    open_: dict[int, list[tuple[dict[int, int], int]]] = {}
    for s in sorted(counts, reverse=True):
        left = counts[s]
        while left:
            room = min((r for r in open_ if r >= s), default=None)
            use, n = open_[room].pop() if room else ({}, left)
            if room and not open_[room]:
                del open_[room]
            room = room or capacity
            each = min(room // s, left)
            times = min(n, left // each)
            if n > times and use:
                open_.setdefault(room, []).append((use, n - times))
            open_.setdefault(room - each * s, []).append(({**use, s: each}, times))
            left -= each * times
    return [x for same in open_.values() for x in same]


class Places:
    """Runs of ranks of each key, each with where they go: key -> (low ranks, payload rows)."""

    def __init__(self) -> None:
        self.runs: dict[int, list[tuple[int, ...]]] = {}

    def add(self, key: int, low: int, *payload: int) -> None:
        self.runs.setdefault(key, []).append((low, *payload))

    def frozen(self) -> dict[int, np.ndarray]:
        return {k: np.array(sorted(v), np.int64) for k, v in self.runs.items()}


def look_up(table: dict[int, np.ndarray], key: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each (key, rank) the run it falls in: rows of (low, payload...)."""
    width = next(iter(table.values())).shape[1] if table else 1
    out = np.zeros((len(key), width), np.int64)
    for k in np.unique(key):
        mine = key == k
        runs = table[int(k)]
        out[mine] = runs[np.searchsorted(runs[:, 0], rank[mine], side="right") - 1]
    return out


def grouped(counts: dict[int, int], groups: int) -> tuple[Places, dict[int, int], dict[int, int]]:
    """(lengths -> groups, size of each group, members of each group).

    Lengths in descending order are dealt to groups of equal cardinality, and each group counts as its largest length;
    where there are no more lengths than groups, each length is a group, and nothing is rounded.
    """
    by_length, size, members = Places(), {}, {}
    if len(counts) <= groups:
        for g, s in enumerate(sorted(counts, reverse=True)):
            by_length.add(s, 0, g, 0)
            size[g], members[g] = s, counts[s]
        return by_length, size, members
    each = max(1, -(-sum(counts.values()) // groups))
    g, held = -1, each
    for s in sorted(counts, reverse=True):
        done = 0
        while done < counts[s]:
            if held == each:
                g, held = g + 1, 0
                size[g] = s
            n = min(counts[s] - done, each - held)
            by_length.add(s, done, g, held)
            done, held = done + n, held + n
            members[g] = held
    return by_length, size, members


def plan_large(counts: dict[int, int], capacity: int, groups: int, tiny: dict[int, int] | None = None) -> tuple[dict, dict, int]:
    """(lengths -> groups, groups -> sequences, number of sequences).

    Of the configurations by subset sums and by best fit, those are taken that need fewer sequences, with what the lengths
    in tiny, best-fit into their rooms, leave over.
    """
    by_length, size, members = grouped(counts, groups)
    by_size: dict[int, list[int]] = {}
    for k, s in size.items():
        by_size.setdefault(s, []).append(k)
    # Groups that count as the same size share its places, one after the other.
    pool = {s: sum(members[k] for k in ks) for s, ks in by_size.items()}
    of_group, shift = {}, {}
    for s, ks in by_size.items():
        at = 0
        for k in ks:
            of_group[k], shift[k] = s, at
            at += members[k]
    lengths = Places()
    for s, runs in by_length.runs.items():
        for low, k, held in runs:
            lengths.add(s, low, of_group[k], shift[k] + held)

    def needs(plan: list) -> int:
        rooms: dict[int, int] = {}
        for use, times in plan:
            room = capacity - sum(s * u for s, u in use.items())
            rooms[room] = rooms.get(room, 0) + times
        rest = plan_small(tiny or {}, rooms, capacity)[1]
        return sum(n for _, n in plan) + sum(n for _, n in best_fit(rest, capacity))

    places, used, sequence = Places(), dict.fromkeys(pool, 0), 0
    for use, times in min((configurations(pool, capacity), best_fit(pool, capacity)), key=needs):
        for s, u in use.items():
            places.add(s, used[s], sequence, u)
            used[s] += u * times
        sequence += times
    return lengths.frozen(), places.frozen(), sequence


def plan_small(counts: dict[int, int], residuals: dict[int, int], capacity: int) -> tuple[dict, dict[int, int]]:
    """Best fit of small lengths, largest first, into sequences known by their room: (length -> (room, index), rest)."""
    bins = {r: [(r, 0, n)] for r, n in residuals.items() if n}
    places, rest = Places(), {}
    for s in sorted(counts, reverse=True):
        done = 0
        while done < counts[s]:
            fits = [r for r in bins if r >= s]
            if not fits:
                rest[s] = counts[s] - done
                places.add(s, done, -1, 0)
                break
            r = min(fits)
            room, lo, hi = bins[r].pop()
            if not bins[r]:
                del bins[r]
            n = min(hi - lo, counts[s] - done)
            places.add(s, done, room, lo)
            if n < hi - lo:
                bins.setdefault(r, []).append((room, lo + n, hi))
            bins.setdefault(r - s, []).append((room, lo, lo + n))
            done += n
    return places.frozen(), rest


def pack(docs: DataFrame, path: str, capacity: int = 1024, small: int = 64, groups: int = 1024, keep_ids: bool = True, rank_rows: int = 20_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset for each piece of each row of docs.

    A row's tokens are the ids of its text (null: none) and END_ID. Longer than capacity: cut, the first piece taking
    what whole pieces leave. Pieces longer than `small` are planned by linear grouping: groups of equal cardinality
    count as their largest length (each length is a group of its own where there are no more than `groups`), configurations
    of these few sizes are made over the counts, and actual pieces are substituted. Pieces up to `small` go best-fit into the room that the actual pieces leave; any rest is planned as
    the large ones are. Ties take any order; repeated rows are packed each. Empty table: no rows.
    """
    own = pieces(docs, path, capacity, keep_ids)
    own = slim = own if keep_ids else saved(own)
    if keep_ids:
        # The ids stay where they are written; the plan works on a number for each piece.
        own = saved(own.withColumn("uid", F.monotonically_increasing_id()))
        slim = own.select("uid", "length")
    ties = ["uid"] if keep_ids else ["doc_id", "piece", "ids_crc32"]
    counts = {r["length"]: r["n"] for r in slim.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows
    parts = max(64, max(counts.values(), default=0) // rank_rows + 1)
    items = ranked(slim, ["length"], F.pmod(F.xxhash64(*ties), F.lit(parts)), ties)
    tiny = {s: n for s, n in counts.items() if s <= small}
    lengths, places, n_large = plan_large({s: n for s, n in counts.items() if s > small}, capacity, groups, tiny)

    @F.pandas_udf("long")
    def place_large(length: pd.Series, rank: pd.Series) -> pd.Series:
        pool = look_up(lengths, length.to_numpy(), rank.to_numpy())
        size, at = pool[:, 1], pool[:, 2] + rank.to_numpy() - pool[:, 0]
        run = look_up(places, size, at)
        return pd.Series(run[:, 1] + (at - run[:, 0]) // run[:, 2])

    large = items.where(F.col("length") > small).withColumn("sequence_id", place_large("length", "rank")).drop("rank")
    if not tiny:
        placed = large
    else:
        large = saved(large)
        room = large.groupBy("sequence_id").agg((F.lit(capacity) - F.sum("length")).alias("room")).where("room > 0")
        room = saved(room)
        residuals = {r["room"]: r["n"] for r in room.groupBy("room").agg(F.count("*").alias("n")).collect()}  # capacity rows
        spots, rest = plan_small(tiny, residuals, capacity)
        rest_lengths, rest_places, _ = plan_large(rest, capacity, max(1, len(rest)) * 64)

        @F.pandas_udf("struct<room: long, spot: long, late: long>")
        def place_small(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
            run = look_up(spots, length.to_numpy(), rank.to_numpy())
            at = rank.to_numpy() - run[:, 0]
            late = np.full(len(at), -1, np.int64)
            over = run[:, 1] < 0
            if over.any():
                pool = look_up(rest_lengths, length.to_numpy()[over], at[over])
                index = pool[:, 2] + at[over] - pool[:, 0]
                last = look_up(rest_places, pool[:, 1], index)
                late[over] = n_large + last[:, 1] + (index - last[:, 0]) // last[:, 2]
            return pd.DataFrame({"room": run[:, 1], "spot": run[:, 2] + at, "late": late})

        little = items.where(F.col("length") <= small).withColumn("to", place_small("length", "rank")).drop("rank")
        open_ = ranked(room, ["room"], F.pmod(F.xxhash64("sequence_id"), F.lit(max(64, max(residuals.values(), default=0) // rank_rows + 1))), ["sequence_id"], "spot")
        open_ = open_.select(F.col("room").alias("_room"), F.col("spot").alias("_spot"), "sequence_id")
        little = little.join(open_, (F.col("to.room") == F.col("_room")) & (F.col("to.spot") == F.col("_spot")), "left")
        little = little.withColumn("sequence_id", F.when(F.col("to.late") >= 0, F.col("to.late")).otherwise(F.col("sequence_id"))).select(*large.columns)
        placed = large.unionByName(little)
    before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), *ties).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
    return own.join(placed.drop("length"), "uid").drop("uid") if keep_ids else placed

