"""Context-triggered piecewise hashing: rolling-hash boundaries, a character a chunk, likeness by edit distance."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import literal_rows, saved

ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
WINDOW, LENGTH = 7, 64
M = 0x9E3779B97F4A7C15 | 1
M_INVERSE = pow(M, -1, 1 << 64)
SLICE_BYTES = 1 << 21


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _ends(data: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
    """(places from `at` on, for SLICE_BYTES, where a chunk may end, how often 2 divides the hash there)."""
    low = max(0, at - WINDOW + 1)
    part = data[low : at + SLICE_BYTES].astype(np.uint32) + np.uint32(1)
    roll = np.zeros(len(part), np.uint32)
    for k in range(WINDOW):
        roll[k:] += part[: len(part) - k] * np.uint32(pow(0x01000193, k + 1, 1 << 32))
    roll = roll[at - low :]
    roll ^= roll >> 15
    roll = roll * np.uint32(0x2C1B3C6D)
    roll ^= roll >> 13
    hit = np.flatnonzero(roll % np.uint32(3) == 0)
    value = roll[hit]
    level = np.zeros(len(hit), np.uint8)
    for k in range(1, 31):
        deep = (value & np.uint32((1 << k) - 1)) == 0
        if not deep.any():
            break
        level[deep] = k
    return hit + at, level


def _chunks(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each chunk, sum of (byte + 1) * M**place, places from its begin on; for long texts, of which no sums over all
    bytes are held."""
    out, step = np.zeros(len(ends), np.uint64), 1 << 18
    power = _powers(M, step)
    for i, (a, z) in enumerate(zip(begins.tolist(), ends.tolist(), strict=True)):
        for at in range(a, z, step):
            part = data[at : min(z, at + step)].astype(np.uint64) + np.uint64(1)
            out[i] += (part * power[: len(part)]).sum() * np.uint64(pow(M, at - a, 1 << 64))
    return out


def fingerprint_all(texts: list[bytes]) -> list[tuple[int, bytes, bytes]]:
    """(block size, signature, signature at twice the block size) of each text.

    A chunk ends where the hash of the last 7 bytes, plus 1, is a multiple of the block size, 3 * 2**k; its character
    is 6 bits of a hash of the whole chunk. The block size is the smallest at which 64 characters would be expected to
    suffice, then halved until there are at least 32 characters or it is 3. A 64th character covers all that is left.
    The empty text has empty signatures.
    """
    gap = bytes(WINDOW)
    data = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)
    sizes = np.array([len(t) for t in texts])
    starts = np.concatenate([[0], np.cumsum(sizes + WINDOW)[:-1]]).astype(np.int64) + WINDOW
    found = [_ends(data, at) for at in range(0, len(data), SLICE_BYTES)]
    hit, level = (np.concatenate(c) for c in zip(*found, strict=True))
    lo, hi = np.searchsorted(hit, starts), np.searchsorted(hit, starts + sizes)
    long = len(data) > 2 * SLICE_BYTES
    if not long:
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(M, len(data)), out=prefix[1:])
        unshift = _powers(M_INVERSE, len(data) + 1)

    def signature(at: np.ndarray, a: int, z: int, most: int) -> bytes:
        if z == a:
            return b""
        ends = at[: most - 1] + 1
        ends = ends if len(ends) and ends[-1] == z else np.append(ends, z)
        begins = np.concatenate([[a], ends[:-1]])
        h = _chunks(data, begins, ends) if long else (prefix[ends] - prefix[begins]) * unshift[begins]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return ALPHABET[(h >> np.uint64(58)).astype(np.int64)].tobytes()

    out = []
    for i, n in enumerate(sizes.tolist()):
        a = int(starts[i])
        at, lev = hit[lo[i] : hi[i]], level[lo[i] : hi[i]]
        k = 0
        while (3 << k) * LENGTH < n:
            k += 1
        have = np.cumsum(np.bincount(lev, minlength=k + 2)[::-1])[::-1]
        while k and have[k] < LENGTH // 2 - 1:
            k -= 1
        out.append((3 << k, signature(at[lev >= k], a, a + n, LENGTH), signature(at[lev > k], a, a + n, LENGTH)))
    return out


def edit_distances(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Levenshtein distances of pairs of strings of at most 64 bytes, bit-parallel over one word a pair."""
    n = len(left)
    la, lb = np.array([len(x) for x in left], np.int64), np.array([len(x) for x in right], np.int64)
    a = np.frombuffer(b"".join(x.ljust(LENGTH, b"\0") for x in left), np.uint8).reshape(n, LENGTH)
    b = np.frombuffer(b"".join(x.ljust(LENGTH, b"\0") for x in right), np.uint8).reshape(n, LENGTH)
    rows, one = np.arange(n), np.uint64(1)
    match = np.zeros((n, 128), np.uint64)
    for i in range(int(la.max(initial=0))):
        match[rows, a[:, i]] |= np.where(i < la, one << np.uint64(i), np.uint64(0))
    up, down, score = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64), la.copy()
    last = np.maximum(la - 1, 0).astype(np.uint64)
    for j in range(int(lb.max(initial=0))):
        on = j < lb
        eq = match[rows, b[:, j]]
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | ~(xh | up), up & xh
        score += np.where(on, ((ph >> last) & one).astype(np.int64) - ((mh >> last) & one).astype(np.int64), 0)
        ph, mh = (ph << one) | one, mh << one
        up, down = np.where(on, mh | ~(xv | ph), up), np.where(on, ph & xv, down)
    return np.where(la == 0, lb, score)


def likeness(left: list[tuple], right: list[tuple]) -> np.ndarray:
    """1 - distance / longer length of the signatures at the block size that both have; 0 where they have none."""
    a, b, fit = [], [], []
    for (x, x1, x2), (y, y1, y2) in zip(left, right, strict=True):
        u, v = (x1, y1) if x == y else (x1, y2) if x == 2 * y else (x2, y1) if 2 * x == y else (b"", b"")
        a.append(u)
        b.append(v)
        fit.append(x == y or bool(u or v))
    longer = np.array([max(len(u), len(v), 1) for u, v in zip(a, b, strict=True)])
    return np.where(fit, 1 - edit_distances(a, b) / longer, 0.0)


def _show(f: tuple) -> str:
    return f"{f[0]}:{f[1].decode()}:{f[2].decode()}"


FIELDS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
KIND = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(ids: list, texts: list[str], nexts: list[str]) -> list[tuple]:
    edited = []
    for t, u in zip(texts, nexts, strict=True):
        k = len(t) // 3
        edited.append((t[: len(t) - k] + u[:k]).encode())
    own, new, follow = fingerprint_all([t.encode() for t in texts]), fingerprint_all(edited), None
    follow = own[1:] + fingerprint_all([nexts[-1].encode()])
    for i, u in enumerate(nexts[:-1]):
        if u is not texts[i + 1] and u != texts[i + 1]:
            follow[i] = fingerprint_all([u.encode()])[0]
    near, far = likeness(own, new).tolist(), likeness(own, follow).tolist()
    return [(i, len(t), hashlib.sha256(e).hexdigest(), _show(f), _show(g), x, y) for i, t, e, f, g, x, y in zip(ids, texts, edited, own, new, near, far, strict=True)]


def _table(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _windows(ids: list, texts: list[str]):
    """Runs of rows of about SLICE_BYTES, each with the text of the row after it."""
    a, size = 0, 0
    for i, t in enumerate(texts[:-1]):
        size += len(t)
        if size >= SLICE_BYTES or i == len(texts) - 2:
            yield ids[a : i + 1], texts[a : i + 1], texts[a + 1 : i + 2]
            a, size = i + 1, 0


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and the likeness to that and to the next document's.

    The next document is the next in descending doc_id (null ids last, repeated ids by text; after the last: the
    first). Texts are range-partitioned by doc_id once and read in order; the last row of each partition waits for the
    first of the following one. These (two rows a partition, so their number follows the partitions) are paired on the
    driver by id alone and their texts read again. Null text: empty. No rows: no rows.
    """
    spark = docs.sparkSession
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = [F.desc_nulls_last("doc_id"), F.asc("text")]

    def run(batches):
        ids, texts, first = [], [], True
        for batch in batches:
            ids += batch.column(0).to_pylist()
            texts += batch.column(1).to_pylist()
            head, at = first, 0
            for i, t, u in _windows(ids, texts):
                rows = [(*r, head and k == 0, False) for k, r in enumerate(_compare(i, t, u))]
                head = False
                at += len(i)
                yield _table(rows, [*FIELDS, "is_first", "waits"], [*TYPES, pa.bool_(), pa.bool_()])
            first = first and at == 0 and not ids
            first, ids, texts = head if ids else first, ids[at:], texts[at:]
        if ids:
            yield _table([(ids[0], *[None] * 6, first, True)], [*FIELDS, "is_first", "waits"], [*TYPES, pa.bool_(), pa.bool_()])

    done = saved(text.repartitionByRange("doc_id").sortWithinPartitions(*order).mapInArrow(run, KIND + ", is_first boolean, waits boolean"))
    down = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)
    ends = done.where("is_first OR waits").select("doc_id", "is_first", "waits").collect()  # two rows a partition
    firsts = sorted((r for r in ends if r["is_first"]), key=down, reverse=True)
    waits = sorted((r for r in ends if r["waits"]), key=down, reverse=True)
    if not waits:
        return done.select(*FIELDS)
    pairs = [{"a": w["doc_id"], "b": firsts[(k + 1) % len(firsts)]["doc_id"]} for k, w in enumerate(waits)]
    known = [i for p in pairs for i in p.values() if i is not None]
    ends_of = text.where(F.col("doc_id").isin(known) | F.col("doc_id").isNull() & F.lit(len(known) < 2 * len(pairs)))
    ends_of = saved(ends_of.groupBy("doc_id").agg(F.min("text").alias("low"), F.max("text").alias("high")))
    near = literal_rows(spark, pairs, {"a": "long", "b": "long"})
    a, b = ends_of.alias("x"), ends_of.alias("y")
    rest = near.join(a, F.col("a").eqNullSafe(F.col("x.doc_id"))).join(b, F.col("b").eqNullSafe(F.col("y.doc_id"))).select("a", F.col("x.high").alias("t"), F.col("y.low").alias("u"))

    def finish(batches):
        for batch in batches:
            for i, t, u in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                yield _table(_compare([i], [t], [u]), FIELDS, TYPES)

    return done.where("NOT waits").select(*FIELDS).unionByName(rest.mapInArrow(finish, KIND))
