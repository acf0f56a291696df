"""N-gram Jaccard join through a token-group matrix; the answer is classes, so no set of all pairs is ever made.

1. Equal sets are one entity from the start, known by a hash of the set.
2. For every entity, the tokens that any other entity has too are counted: the overlap with the union of all others.
   An entity whose overlap is below the threshold times its size links with nothing and is dropped; most are. Tokens go
   in packed blocks to buckets of their hash; those that a sample shows to be frequent are known to be shared, and are
   counted where they are met, so no bucket gets a token that a share of all documents has.
3. The rest is parted into groups of similar documents, of at most `group` members each: under one key are those whose
   rarest tokens lead there (with sets at the threshold, the rarest tokens of a set and its partner must meet). The
   matrix has, for each token, the groups it leads to; a document asks the groups that its own rarest tokens lead to.
   Each group's token union is stored.
4. A query's overlap with a stored union bounds its overlap with any member; only groups that can reach the threshold are
   opened: then members meet the queries that may open their group, and are compared exactly.
5. The first group of each key stands for the key: everything that leads there asks it, and it is the only one unless a
   key has more than `group` members. Of a larger key, the other members are then grouped by the classes that have come
   of it; a group that is wholly of a query's own class has nothing to tell it and is not asked. So a cluster of near
   copies, however large, costs each of its members one group.
6. What links there are give classes; a forest that connects the same documents stands for all links.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import components, give_back, lean, ranked, saved

SLICE, PACK_TOKENS = 1 << 20, 750_000
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
ORDERED = [0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x2127599BF4325C37, 0x9E3779B97F4A7C15]


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit tokens, sizes): the sorted distinct shingles of k words of each text, one text after the other.

    A-Z count as a-z. Fewer than k words: the whole sequence is one shingle. No words: none.
    """
    data = LOWER[np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)]
    space = IS_SPACE[data]
    begin = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    starts = np.cumsum([1, *[len(t) + 1 for t in texts]])
    bounds = np.searchsorted(begin, starts)
    words = np.diff(bounds)
    h = hashing.words(data, begin, end, SLICE)
    made, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(texts)), words)
    if len(h) >= k:
        n = len(h) - k + 1
        made = np.zeros(n, np.uint64)
        for j in range(k):
            made += hashing.mix(h[j : j + n] + np.uint64(ORDERED[j % 8])) * np.uint64(ORDERED[(j + 3) % 8] | 1)
        whole = doc[:n] == doc[k - 1 :]
        made, owner = hashing.mix(made[whole]), doc[:n][whole]
    short = np.flatnonzero((words > 0) & (words < k))
    if len(short):
        extra = []
        for i in short:
            x = words[i : i + 1].astype(np.uint64)
            for w in h[bounds[i] : bounds[i + 1]]:
                x = hashing.mix(x * np.full(1, ORDERED[0], np.uint64) + w)
            extra.append(x[0])
        made, owner = np.concatenate([made, np.array(extra, np.uint64)]), np.concatenate([owner, short])
    order = np.argsort(made)
    order = order[np.argsort(owner[order].astype(np.int32), kind="stable")]
    made, owner = made[order], owner[order]
    if len(made):
        new = np.concatenate([[True], (made[1:] != made[:-1]) | (owner[1:] != owner[:-1])])
        made, owner = made[new], owner[new]
    return made, np.bincount(owner, minlength=len(texts))


def set_hashes(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One 64-bit word a set, that depends on its members alone."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(hashing.mix(tokens ^ np.uint64(ORDERED[4])))])
    ends = np.cumsum(sizes)
    return hashing.mix(total[ends] - total[ends - sizes] + sizes.astype(np.uint64) * np.uint64(ORDERED[5])).view(np.int64)


def _each_set(column, k: int, most: int = SLICE):
    """(first row, texts' set sizes, tokens, set hashes) for runs of rows of an Arrow column of strings."""
    for at in range(0, len(column), 512):
        raw = [t or b"" for t in column.slice(at, 512).cast(pa.binary()).to_pylist()]
        for a, z in hashing.slices([len(t) for t in raw], most):
            tokens, sizes = shingle_sets(raw[a:z], k)
            yield at + a, sizes, tokens, set_hashes(tokens, sizes)


#: Distinct texts in the sample that tells frequent tokens, how many of them must have a token, and tokens kept.
SAMPLE, FREQUENT, MOST_FREQUENT = 4096, 8, 1 << 20


def _frequent(docs: DataFrame, k: int) -> np.ndarray:
    """Sorted tokens that at least FREQUENT different sets of a sample of about SAMPLE texts have.

    A token that is frequent but not found here is counted in its bucket like any other: the answer is the same.
    """
    rows = docs.count()
    some = docs.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("text"), F.lit(max(1, rows // SAMPLE))) == 0))

    def run(batches):
        for batch in batches:
            for _, sizes, tokens, ent in _each_set(batch.column(0), k):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ent, sizes)), pa.array(tokens.view(np.int64))], ["ent", "token"])

    pairs = some.select("text").mapInArrow(lean(run), "ent long, token long").distinct()
    often = pairs.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "token").limit(MOST_FREQUENT)
    return np.sort(often.select("token").toArrow().column("token").to_numpy().view(np.uint64))


def _in(tokens: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(tokens), bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, tokens), len(sorted_set) - 1)] == tokens


def _sizes(docs: DataFrame, k: int, frequent) -> DataFrame:
    """(doc_id, n: size of the set, ent: its hash, common: how many of its tokens are frequent)."""

    def run(batches):
        for batch in batches:
            for a, sizes, tokens, ent in _each_set(batch.column(1), k):
                common = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[_in(tokens, frequent.value)], minlength=len(sizes))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(sizes)), pa.array(sizes), pa.array(ent, mask=sizes == 0), pa.array(common)], ["doc_id", "n", "ent", "common"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n long, ent long, common long")


def _packed(docs: DataFrame, k: int, least: int, bits: int, frequent) -> DataFrame:
    """Rows (bucket, tokens, ents, counts): for runs of texts, the distinct sets' tokens in each bucket, 40 bits each;
    without the frequent ones."""

    def pack(parts: list[tuple]) -> pa.RecordBatch | None:
        sizes, tokens, ent = (np.concatenate(c) for c in zip(*parts, strict=True))
        first = np.zeros(len(sizes), bool)
        first[np.unique(ent, return_index=True)[1]] = True
        keep = first & (sizes >= least)
        if not keep.any():
            return None
        t = tokens[np.repeat(keep, sizes)]
        owner = np.repeat(np.arange(keep.sum(), dtype=np.int32), sizes[keep])
        ids = ent[keep]
        rare = ~_in(t, frequent.value)
        t, owner = t[rare], owner[rare]
        if not len(t):
            return None
        bucket = (t >> np.uint64(64 - bits)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        bucket, t, owner = bucket[order], t[order], owner[order]
        code = (t << np.uint64(bits)) >> np.uint64(24)
        low, high = code.astype(np.uint32), (code >> np.uint64(32)).astype(np.uint8)
        present, edges = np.unique(bucket, return_index=True)
        edges, rows = np.append(edges, len(bucket)), []
        for i, b in enumerate(present.tolist()):
            x, y = edges[i], edges[i + 1]
            who, count = np.unique(owner[x:y], return_counts=True)
            rows.append((b, low[x:y].tobytes() + high[x:y].tobytes(), ids[who].tobytes(), count.astype(np.uint32).tobytes()))
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "tokens", "ents", "counts"])

    def run(batches):
        for batch in batches:
            parts, held = [], 0
            for _, *part in _each_set(batch.column(1), k):
                parts.append(part)
                held += len(part[1])
                if held >= PACK_TOKENS:
                    if (out := pack(parts)) is not None:
                        yield out
                    parts, held = [], 0
            if parts and (out := pack(parts)) is not None:
                yield out

    return docs.select("doc_id", "text").mapInArrow(lean(run), "bucket int, tokens binary, ents binary, counts binary")


def _shared(block: pa.Table) -> pa.Table:
    """For one bucket: (ent, number of its tokens here that another entity has too)."""
    code, ents, owner, at = [], [], [], 0
    for tokens, who, counts in zip(*[block.column(c).to_pylist() for c in ("tokens", "ents", "counts")], strict=True):
        n = len(tokens) // 5
        code.append(np.frombuffer(tokens, np.uint32, n).astype(np.uint64) | np.frombuffer(tokens, np.uint8, n, 4 * n).astype(np.uint64) << np.uint64(32))
        ids = np.frombuffer(who, np.int64)
        owner.append(np.repeat(np.arange(at, at + len(ids), dtype=np.int32), np.frombuffer(counts, np.uint32)))
        ents.append(ids)
        at += len(ids)
    ids, back = np.unique(np.concatenate(ents), return_inverse=True)
    code, owner = np.concatenate(code), back.astype(np.int32)[np.concatenate(owner)]
    order = np.argsort(code)
    code, owner = code[order], owner[order]
    edge = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    low, high = np.minimum.reduceat(owner, edge), np.maximum.reduceat(owner, edge)
    size = np.diff(np.append(edge, len(code)))
    many = np.repeat(low != high, size)
    group = np.repeat(np.arange(len(edge)), size)[many]
    pair = np.unique(group.astype(np.int64) * len(ids) + owner[many])
    count = np.bincount(pair % len(ids), minlength=len(ids))
    hit = np.flatnonzero(count)
    out = pa.table({"ent": pa.array(ids[hit]), "shared": pa.array(count[hit].astype(np.int64))})
    del code, owner, order, group, many, pair, back
    give_back()
    return out


def _token_rows(docs: DataFrame, k: int) -> DataFrame:
    """docs with columns ent, text -> (ent, n, tokens) of the rows whose set is still the one that ent names."""

    def run(batches):
        for batch in batches:
            want = batch.column(0).to_numpy(zero_copy_only=False)
            for a, sizes, tokens, ent in _each_set(batch.column(1), k):
                ends = np.cumsum(sizes)
                rows = [(int(e), int(n), tokens[z - n : z].view(np.int64)) for e, n, z, w in zip(ent, sizes, ends, want[a : a + len(sizes)], strict=True) if e == w]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["ent", "n", "tokens"])

    return docs.select("ent", "text").mapInArrow(lean(run), "ent long, n long, tokens array<long>")


def _lists(table: pa.Table, column: str) -> np.ndarray:
    """The values of a column of lists, one after the other."""
    return table.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _union(members: pa.Table) -> pa.Table:
    """The group's token union; of at most `group` sets."""
    whole = np.unique(_lists(members, "tokens"))
    return pa.table({"key": members.column("key")[:1], "part": members.column("part")[:1], "union": pa.array([whole], pa.list_(pa.int64()))})


def _may_open(percent: int):
    """Queries against one group's union: those whose overlap with it can reach the threshold."""

    def run(union: pa.Table, queries: pa.Table) -> pa.Table:
        if not union.num_rows or not queries.num_rows:
            return queries.slice(0, 0)
        n = queries.column("n").to_numpy()
        row = np.repeat(np.arange(len(n)), n)
        hit = _in(_lists(queries, "tokens"), _lists(union.slice(0, 1), "union"))
        return queries.filter(pa.array(100 * np.bincount(row[hit], minlength=len(n)) >= percent * n))

    return run


def _compare(percent: int, budget: int = 1 << 21):
    """Queries against the members of one group that they may open: (ent, root), a forest of the links."""

    def run(members: pa.Table, queries: pa.Table) -> pa.Table:
        if not members.num_rows or not queries.num_rows:
            return pa.table({"ent": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        sizes, many = members.column("n").to_numpy(), members.num_rows
        held = _lists(members, "tokens")
        holder = np.repeat(np.arange(many), sizes)
        order = np.argsort(held, kind="stable")
        held, holder = held[order], holder[order]
        union, first = np.unique(held, return_index=True)
        first = np.append(first, len(held))
        own, root = members.column("ent").to_numpy(), np.arange(many)
        q_ent, q_n = queries.column("ent").to_numpy(), queries.column("n").to_numpy()
        tokens, row = _lists(queries, "tokens"), np.repeat(np.arange(len(q_n)), q_n)
        at = np.minimum(np.searchsorted(union, tokens), len(union) - 1)
        hit = union[at] == tokens
        at, row = at[hit], row[hit]
        work = np.cumsum(np.bincount(row, first[at + 1] - first[at], minlength=len(q_n)))
        linked, a = [], 0
        while a < len(q_n):
            z = max(a + 1, int(np.searchsorted(work, (work[a - 1] if a else 0) + budget, side="right")))
            lo, hi = np.searchsorted(row, [a, z])
            n, count = q_n[a:z], first[at[lo:hi] + 1] - first[at[lo:hi]]
            within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            cell = np.repeat((row[lo:hi] - a) * many, count) + holder[np.repeat(first[at[lo:hi]], count) + within]
            both = np.bincount(cell, minlength=(z - a) * many).reshape(z - a, many)
            link = (100 * both >= percent * (n[:, None] + sizes[None, :] - both)) & (q_ent[a:z, None] != own[None, :])
            for i in np.flatnonzero(link.any(1)):
                found = np.unique(root[link[i]])
                if len(found) > 1:
                    root[np.isin(root, found)] = found[0]
                linked.append((a + i, np.flatnonzero(link[i])[0]))
            a = z
        who, to = np.array([i for i, _ in linked], np.int64), np.array([m for _, m in linked], np.int64)
        ent, top = np.concatenate([q_ent[who], own]), np.concatenate([own[root[to]], own[root]])
        return pa.table({"ent": ent[ent != top], "root": top[ent != top]})

    return run


def _meet(tokens: DataFrame, groups: DataFrame, asked: DataFrame, percent: int) -> DataFrame:
    """(ent, root): a forest of the links between queries and the members of the groups they ask.

    groups (ent, key, part): the members; asked (ent, key, part): each query with each group once.
    """
    keys, slotted = ["key", "part"], ["key", "part", "slot"]
    # No task has more than about 400 queries: busy groups are met in several slots.
    busy = saved(asked.groupBy(*keys).agg(F.ceil(F.count("*") / 400).cast("int").alias("slots")))
    members = groups.join(busy, keys).join(tokens, "ent").select(*keys, "slots", "ent", "n", "tokens")
    unions = saved(members.select(*keys, "tokens").groupBy(*keys).applyInArrow(_union, "key long, part long, union array<long>"))
    asks = asked.join(busy, keys).withColumn("slot", F.pmod(F.xxhash64("ent"), F.col("slots")).cast("int")).join(tokens, "ent").select(*slotted, "ent", "n", "tokens")
    each = unions.join(busy, keys).select(*keys, F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), "union")
    shape = "key long, part long, slot int, ent long, n long, tokens array<long>"
    may = saved(each.groupBy(*slotted).cogroup(asks.groupBy(*slotted)).applyInArrow(_may_open(percent), shape))
    opened = saved(may.groupBy(*slotted).agg(F.count("*").alias("queries")).select(*[F.col(c).alias(f"_{c}") for c in slotted]))
    open_members = members.drop("slots").join(opened, (F.col("key") == F.col("_key")) & (F.col("part") == F.col("_part")))
    open_members = open_members.select("key", "part", F.col("_slot").alias("slot"), "ent", "n", "tokens")
    return saved(open_members.groupBy(*slotted).cogroup(may.groupBy(*slotted)).applyInArrow(_compare(percent), "ent long, root long"))


def jaccard_classes(docs: DataFrame, words: int = 5, percent: int = 80, group: int = 256, bucket_tokens: int = 1_000_000, broadcast_rows: int = 500_000) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs.

    Two rows link when 100 * intersection >= percent * union of their sets of word shingles (1 to 99 percent);
    component_id is the smallest doc_id reachable. Rows without words have size 0 and their own id; null ids take part
    but are never the smallest. Repeated rows each get theirs. Sets are compared by 64-bit hashes of their shingles.
    Other columns are not returned. No rows: no rows.
    """
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(_frequent(docs, words))  # at most MOST_FREQUENT tokens of 8 bytes
    sets = saved(_sizes(docs, words, frequent))
    ents = sets.where("ent IS NOT NULL").groupBy("ent").agg(F.max("n").alias("n"), F.min("doc_id").alias("low"), F.max("common").alias("common"))
    ents = saved(ents)
    least = next(n for n in range(1, 101) if 100 * n >= percent * (n + 1))
    total = ents.where(F.col("n") >= least).agg(F.sum("n")).first()[0] or 0
    found = None
    if total:
        bits = min(20, max(7, (total // bucket_tokens).bit_length()))
        shared = _packed(docs, words, least, bits, frequent).groupBy("bucket").applyInArrow(_shared, "ent long, shared long")
        shared = shared.groupBy("ent").agg(F.sum("shared").alias("shared"))
        met = ents.where(F.col("n") >= least).join(shared, "ent", "left").withColumn("met", F.coalesce("shared", F.lit(0)) + F.col("common"))
        alive = saved(met.where(F.col("met") * 100 >= F.col("n") * percent).select("ent", "n", "low"))
        found = _links(docs, alive, words, percent, group, broadcast_rows) if alive.limit(1).count() else None
    if found is None:
        roots = ents.select("ent", F.col("low").alias("component"))
    else:
        comp = components(found.select(F.col("ent").alias("a"), F.col("root").alias("b")))
        grown = ents.join(comp, ents["ent"] == comp["node"], "left").drop("node")
        low = grown.where("root IS NOT NULL").groupBy("root").agg(F.min("low").alias("least"))
        roots = grown.join(low, "root", "left").select("ent", F.coalesce("least", "low").alias("component"))
    out = sets.join(roots, "ent", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("ent").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def _links(docs: DataFrame, alive: DataFrame, words: int, percent: int, group: int, broadcast_rows: int) -> DataFrame:
    """(ent, root): a forest that connects the entities in alive as their links do."""
    few, count = alive.select("low", "ent"), alive.count()
    few = F.broadcast(few) if count <= broadcast_rows else few
    own = docs.select("doc_id", "text").join(few, F.col("doc_id").eqNullSafe(F.col("low")))
    tokens = saved(_token_rows(own, words).dropDuplicates(["ent"]))

    # Written counts, so that joins by token are between two plain shuffles and Spark can split a frequent token's rows.
    flat = tokens.select("ent", "n", F.explode("tokens").alias("token"))
    often = saved(flat.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"))
    rare = flat.join(often, "token", "left").groupBy("ent", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "token"))).alias("t"))
    most = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("long") + 1
    heads = rare.select("ent", F.explode(F.filter(F.slice("t", F.lit(1), most.cast("int")), lambda x: x["df"] > 1)).alias("x"))
    heads = saved(heads.select("ent", F.col("x.token").alias("token")))
    meets = saved(heads.groupBy("token").agg(F.min("ent").alias("first"), F.count("*").alias("_n")).where("_n > 1").select("token", "first"))
    keyed = saved(heads.join(meets, "token"))

    home = keyed.groupBy("ent").agg(F.min("first").alias("key"))
    home = saved(ranked(home, ["key"], F.pmod(F.xxhash64("ent"), F.lit(max(16, count // 20_000))), ["ent"]))
    lead = saved(keyed.select("ent", "token").join(home, "ent"))
    # The first group of each key. Of two documents that are both in one, only the one with the larger key asks.
    matrix = saved(lead.where(F.col("rank") < group).select("token", F.col("key").alias("to")).distinct())
    asked = lead.join(matrix, "token").where((F.col("rank") >= group) | (F.col("to") <= F.col("key")))
    asked = asked.select("ent", F.col("to").alias("key"), F.lit(0).cast("long").alias("part")).distinct()
    first = home.where(F.col("rank") < group).select("ent", "key", F.lit(0).cast("long").alias("part"))
    found = _meet(tokens, first, asked, percent)
    rest = home.where(F.col("rank") >= group).select("ent", "key")
    if not rest.limit(1).count():
        return found

    # The others have met all that is in a first group; what is left is among themselves, where classes differ.
    comp = components(found.select(F.col("ent").alias("a"), F.col("root").alias("b")))
    rest = saved(rest.join(comp, rest["ent"] == comp["node"], "left").select("ent", "key", F.coalesce("root", "ent").alias("class")))
    placed = saved(_placed(rest, group, count))
    # only: the class of a group that has no other; null for a mixed one.
    kinds = placed.groupBy("key", "part").agg(F.when(F.min("class") == F.max("class"), F.min("class")).alias("only"))
    placed = saved(placed.join(kinds, ["key", "part"]))
    lead = saved(keyed.select("ent", "token").join(placed, "ent"))
    matrix = saved(lead.groupBy("token", "key", "only").agg(F.collect_set("part").alias("parts")).select("token", F.col("key").alias("to"), F.col("only").alias("of"), "parts"))
    asked = lead.join(matrix, "token").where(F.col("of").isNull() | (F.col("of") != F.col("class")))
    asked = asked.select("ent", "key", "part", "to", F.explode("parts").alias("at")).where((F.col("to") < F.col("key")) | (F.col("to") == F.col("key")) & (F.col("at") <= F.col("part")))
    asked = saved(asked.select("ent", F.col("to").alias("key"), F.col("at").alias("part")).distinct())
    if not asked.limit(1).count():
        return found
    return saved(found.unionAll(_meet(tokens, placed.select("ent", "key", "part"), asked, percent)))


def _placed(rest: DataFrame, group: int, count: int) -> DataFrame:
    """rest (ent, key, class) with part: groups of `group` rows of a key, in which classes lie one after the other.

    A class that is larger than a group has buckets of its own, up to 64 of a group's size or as many of 20 000 rows as it
    needs; so of its groups only the first and the last can have rows of other classes. Smaller classes share buckets.
    """
    split = F.greatest(F.ceil(F.count("*") / 20_000), F.least(F.lit(64), F.ceil(F.count("*") / group)))
    spread = rest.join(rest.groupBy("key", "class").agg(split.alias("split")), ["key", "class"])
    alone = F.col("split") > 1
    bucket = F.struct(
        F.pmod(F.xxhash64("class"), F.lit(max(16, count // 20_000))).alias("base"),
        alone.alias("alone"),
        F.when(alone, F.col("class")).otherwise(0).alias("own"),
        F.when(alone, F.pmod(F.xxhash64("ent"), F.col("split"))).otherwise(0).alias("sub"),
    )
    placed = ranked(spread, ["key"], bucket, ["class", "ent"]).withColumn("part", F.floor(F.col("rank") / group).cast("long"))
    return placed.select("ent", "key", "class", "part")


def brute_force(rows: list[tuple[int, str | None]], words: int, percent: int) -> dict[int, tuple[int, int]]:
    """doc_id -> (n_shingles, component_id) by comparing all pairs; for tests."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))} if w else set()
    low = {i: i for i in sets}
    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = low[i], low[j]
                if a != b:
                    low = {k: min(a, b) if v in (a, b) else v for k, v in low.items()}
    return {i: (len(sets[i]), low[i]) for i in ids}
