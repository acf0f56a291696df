"""Suffix-array removal of repeated byte strings, over suffixes sampled where the content itself says.

A full suffix array holds every position of every text; its sort keys alone are a hundred times the corpus. Here each
string of `length` bytes has one anchor: the position in it whose next 32 bytes have the smallest hash (the leftmost of
equals). It depends on the string alone, so equal strings have equal anchors at the same place in them, and only
anchored suffixes need to be sorted: about one position in 35.

1. Which suffixes need sorting: (lead, reach) of every anchor, as 64-bit hashes of its leading 32 bytes and of all bytes
   that strings with this anchor can reach, meet in buckets by lead. A lead that has only one reach in the corpus needs no
   sorting: the later ones of equal reaches repeat as a whole. Of several reaches, the first of each goes on.
2. Their bytes are fetched. Splitters sampled from their leading bytes range-partition the suffixes; equal leads meet in
   one range. In its range, each is sorted by multikey quicksort, forwards from the anchor and backwards before it.
   Comparing neighbours gives how much they share on either side, and so, for each distance of a string's start before
   the anchor, which strings are equal; all but the earliest repeat. Whole bytes are compared.
3. A lead with more than `hot_reaches` of them (a passage that many documents share) would fill a range. Its strings are
   cut out and dealt by their own hash instead, of equal ones only the earliest of each held block: comparison across
   the blocks finds the rest.
4. Each document's repeated string starts give the bytes to remove.

Exact copies of an earlier document are settled by their hash alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import saved

GRAM = 32
SLICE = 1 << 21
#: Strings whose keys a map task holds to find the earliest of equal ones.
HELD = 1 << 20
#: What is known of an anchor before its neighbours are: all its strings repeat; they are to be compared.
DONE, OPEN, LEAD_REACHES = 1, 2, 8
NONE = np.uint64(2**64 - 1)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of x[i : i + w] for each i (n - w + 1 values), by minima running both ways inside blocks of w."""
    n = len(x)
    padded = np.append(x, np.full(-n % w, NONE, np.uint64)).reshape(-1, w)
    right = np.minimum.accumulate(padded, axis=1).ravel()
    left = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[: n - w + 1], right[w - 1 : n])


def anchors(texts: list[bytes], length: int):
    """For all strings of `length` bytes of the texts: their anchors, as arrays (text, position, first start, last
    start, leading hash, hash of the reach). First and last start: of the strings that have this anchor."""
    empty = np.zeros(0, np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < length:
        return empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    prefix = hashing.prefix_sums(data)
    inverse = hashing.powers(hashing.M_INVERSE, len(prefix))
    lead = hashing.mix((prefix[GRAM:] - prefix[:-GRAM]) * inverse[: len(data) - GRAM + 1])
    key = (lead & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(lead), dtype=np.uint64)
    at = (sliding_min(key, length - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)[: len(at)]
    begin = np.arange(len(at))
    whole = begin + length <= (starts + sizes)[doc]
    at, doc, begin = at[whole], doc[whole], begin[whole]
    if not len(at):
        return empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]))
    last = np.append(new[1:], len(at)) - 1
    d, m, a, z = doc[new], at[new], begin[new], begin[last]
    # The reach is all bytes of the strings with this anchor, and where they stand relative to it.
    reach = hashing.ranges(prefix, a, z + length)
    reach = hashing.mix(reach + ((m - a) * 512 + (z - m + 256)).astype(np.uint64) * np.uint64(hashing.M))
    s = starts[d]
    return d, m - s, a - s, z - s, lead[m], reach


def long_anchors(raw: bytes, length: int, most: int) -> tuple[np.ndarray, ...]:
    """anchors() of one text, whose strings are looked at `most` at a time; what it returns is the same.

    An anchor with strings on both sides of a cut comes from both: its reach is that of all of them.
    """
    out: list[list[np.ndarray]] = []
    for at in range(0, max(1, len(raw) - length + 1), most):
        _, m, a, z, lead, reach = anchors([raw[at : at + most + length - 1]], length)
        m, a, z = m + at, a + at, z + at
        if out and len(m) and len(out[-1][0]) and out[-1][0][-1] == m[0]:
            m0, a0, z0 = int(m[0]), int(out[-1][1][-1]), int(z[0])
            part = np.frombuffer(raw[a0 : z0 + length], np.uint8)
            whole = hashing.ranges(hashing.prefix_sums(part), np.array([0]), np.array([len(part)]))
            reach[0] = hashing.mix(whole + np.array([(m0 - a0) * 512 + (z0 - m0 + 256)], np.int64).astype(np.uint64) * np.uint64(hashing.M))[0]
            a[0] = a0
            out[-1] = [c[:-1] for c in out[-1]]
        out.append([m, a, z, lead, reach])
    m, a, z, lead, reach = (np.concatenate(c) for c in zip(*out, strict=True))
    return np.zeros(len(m), np.int64), m, a, z, lead, reach


def _raw(column) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _packed(docs: DataFrame, length: int, bits: int) -> DataFrame:
    """Rows (bucket, kind, docs, hashes, counts, records): for runs of texts, the anchors of each bucket, packed.

    Of equal reaches inside a run of texts, those after the first are already known to repeat: they are DONE. Of a lead
    with more than LEAD_REACHES reaches in the run, the further ones are OPEN: the first ones tell the lead's bucket that
    there are several. Both kinds need no neighbour and are dealt by document, so a passage that many documents share
    fills no bucket.
    """

    def run(batches):
        for batch in batches:
            ids, null = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            dh = batch.column(1).to_numpy()
            raw = _raw(batch.column(2))
            for x, y in hashing.slices([len(t) for t in raw], 8 * SLICE):
                # In order of (doc_id, null last, text), each text once.
                order = sorted(range(x, y), key=lambda i: (null[i], ids[i], dh[i]))
                seen, own = set(), []
                for i in order:
                    if dh[i] not in seen:
                        seen.add(dh[i])
                        own.append(i)
                parts = []
                for a, z in hashing.slices([len(raw[i]) for i in own], SLICE):
                    long = z == a + 1 and len(raw[own[a]]) > 2 * SLICE
                    d, *rest = long_anchors(raw[own[a]], length, SLICE) if long else anchors([raw[i] for i in own[a:z]], length)
                    parts.append((d + a, *rest))
                d, m, first, last, lead, reach = (np.concatenate(c) for c in zip(*parts, strict=True))
                if not len(d):
                    continue
                bucket = (lead >> np.uint64(64 - bits)).astype(np.int64)
                order = np.lexsort((np.arange(len(d)), reach, lead))
                new = np.concatenate([[True], (lead[order][1:] != lead[order][:-1]) | (reach[order][1:] != reach[order][:-1])])
                # The how-manieth reach of its lead each of the sorted anchors has.
                new_lead = np.concatenate([[True], lead[order][1:] != lead[order][:-1]])
                nth = np.cumsum(new)
                nth -= nth[np.flatnonzero(new_lead)][np.cumsum(new_lead) - 1]
                kind = np.zeros(len(d), np.int64)
                kind[order[nth >= LEAD_REACHES]] = OPEN
                kind[order[~new]] = DONE
                spread = (dh[np.array(own)[d]].astype(np.int64).view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
                bucket = np.where(kind > 0, spread, bucket) * 3 + kind
                order = np.argsort(bucket, kind="stable")
                present, edges = np.unique(bucket[order], return_index=True)
                edges = np.append(edges, len(order))
                own = np.array(own)
                rows = []
                for k, b in enumerate(present.tolist()):
                    o = order[edges[k] : edges[k + 1]]
                    which, count = np.unique(d[o], return_counts=True)
                    code = np.empty(len(o), RECORD)
                    code["lead"], code["reach"] = lead[o], reach[o]
                    code["at"], code["before"], code["after"] = m[o], m[o] - first[o], last[o] - first[o]
                    rows.append((b // 3, b % 3, np.where(null[own[which]], 2**63 - 1, ids[own[which]]).astype(np.int64).tobytes(), dh[own[which]].tobytes(), count.astype(np.uint32).tobytes(), code.tobytes()))
                kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "kind", "docs", "hashes", "counts", "records"])

    return docs.select("doc_id", "dh", "text").mapInArrow(run, "bucket int, kind int, docs binary, hashes binary, counts binary, records binary")


RECORD = np.dtype([("lead", "<u8"), ("reach", "<u8"), ("at", "<u4"), ("before", "u1"), ("after", "u1")])
STARTS = "doc_id long, dh long, open boolean, low long, high long, anchor long, lead long"


def _unpack(block: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, dh, code = [], [], []
    for d, h, c, r in zip(*[block.column(c).to_pylist() for c in ("docs", "hashes", "counts", "records")], strict=True):
        n = np.frombuffer(c, np.uint32)
        ids.append(np.repeat(np.frombuffer(d, np.int64), n))
        dh.append(np.repeat(np.frombuffer(h, np.int64), n))
        code.append(np.frombuffer(r, RECORD))
    return np.concatenate(ids), np.concatenate(dh), np.concatenate(code)


def _out(ids, dh, code, open_) -> pa.Table:
    at = code["at"].astype(np.int64)
    low = at - code["before"]
    return pa.table({"doc_id": ids, "dh": dh, "open": np.full(len(ids), open_), "low": low, "high": low + code["after"], "anchor": at, "lead": code["lead"].astype(np.uint64).view(np.int64)})


def _neighbours(block: pa.Table) -> pa.Table:
    """One bucket of suffixes: starts that repeat (open: false), and suffixes whose bytes are needed (open: true)."""
    said = []
    for kind in (DONE, OPEN):
        settled = block.filter(pc.equal(block.column("kind"), kind))
        if settled.num_rows:
            said.append(_out(*_unpack(settled), kind == OPEN))
    block = block.filter(pc.equal(block.column("kind"), 0))
    if not block.num_rows:
        return pa.concat_tables(said)
    ids, dh, code = _unpack(block)
    order = np.lexsort((code["at"], dh, ids, code["reach"], code["lead"]))
    ids, dh, code = ids[order], dh[order], code[order]
    lead, reach, at = code["lead"], code["reach"], code["at"]
    new_lead = np.concatenate([[True], lead[1:] != lead[:-1]])
    new = new_lead | np.concatenate([[True], reach[1:] != reach[:-1]])
    # A row that comes twice in the table is no earlier place of itself.
    twin = ~new & np.concatenate([[False], (ids[1:] == ids[:-1]) & (dh[1:] == dh[:-1]) & (at[1:] == at[:-1])])
    kinds = np.bincount(np.cumsum(new_lead) - 1, weights=new)
    several = kinds[np.cumsum(new_lead) - 1] > 1
    again = ~new & ~twin
    return pa.concat_tables([*said, _out(ids[again], dh[again], code[again], False), _out(ids[new & several], dh[new & several], code[new & several], True)])


def _reaches(rows: DataFrame, length: int) -> DataFrame:
    """Rows (doc_id, dh, text, spots: array of low, high, anchor, lead) -> a row for each spot, with its reach's bytes."""
    kind = "doc_id long, dh long, low long, high long, anchor long, lead long, reach binary"
    names = ["low", "high", "anchor", "lead"]

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                spots = part.column(3)
                owner = np.repeat(np.arange(part.num_rows), pc.list_value_length(spots).to_numpy())
                cells = [spots.flatten().field(c) for c in names]
                raw = _raw(part.column(2))
                reach = [raw[i][x : z + length] for i, x, z in zip(owner.tolist(), cells[0].to_pylist(), cells[1].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), part.column(1).take(pa.array(owner)), *cells, pa.array(reach, pa.binary())], ["doc_id", "dh", *names, "reach"])

    return rows.mapInArrow(run, kind)


def multikey_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of byte strings given as rows of big-endian words, and how many bytes each shares with the one before.

    Multikey quicksort, a word of eight bytes at a time: strings are parted by their first word, and only runs of equal
    ones go on to the next. The first string shares 0.
    """
    n, width = words.shape
    order, tied = np.arange(n), np.ones(n, bool)
    tied[:1] = False
    shared = np.full(n, 8 * width)
    shared[:1] = 0
    for j in range(width):
        live = np.flatnonzero(tied | np.append(tied[1:], False))
        if not len(live):
            break
        run = np.cumsum(~tied)[live]
        key = words[order[live], j]
        by = np.lexsort((key, run))
        order[live], key = order[live][by], key[by]
        differs = tied[live[1:]] & (key[1:] != key[:-1])
        cut = live[1:][differs]
        bits = (key[1:] ^ key[:-1])[differs]
        shared[cut] = 8 * j + sum((bits < np.uint64(1 << k)).astype(np.int64) for k in range(8, 64, 8))
        tied[cut] = False
    return order, shared


def _words(flat: np.ndarray, at: np.ndarray, size: np.ndarray, step: int, most: int) -> np.ndarray:
    """Rows of big-endian words: `size` bytes of flat from each `at`, forwards or backwards, and zeros up to `most`."""
    width = -(-most // 8) * 8
    out = np.zeros((len(at), width), np.uint8)
    for a in range(0, len(at), 1 << 14):
        k = np.arange(width)
        there = k < size[a : a + (1 << 14), None]
        place = at[a : a + (1 << 14), None] + step * k
        out[a : a + (1 << 14)] = np.where(there, flat[np.where(there, place, 0)], 0)
    return out.view(">u8").astype(np.uint64)


def repeated_strings(ids, dh, low, high, anchor, reach: pa.Array, length: int) -> tuple[np.ndarray, ...]:
    """Of suffixes with all others of their leads: (doc_id, dh, low, high) of the runs of starts whose string repeats."""
    order = np.lexsort((anchor, dh, ids))
    twin = np.concatenate([[False], (ids[order][1:] == ids[order][:-1]) & (dh[order][1:] == dh[order][:-1]) & (anchor[order][1:] == anchor[order][:-1])])
    order = order[~twin]
    ids, dh, low, high, anchor, reach = ids[order], dh[order], low[order], high[order], anchor[order], reach.take(pa.array(order))
    edges = np.frombuffer(reach.buffers()[1], np.int32)[reach.offset : reach.offset + len(reach) + 1].astype(np.int64)
    flat = np.frombuffer(reach.buffers()[2], np.uint8)
    n, far = len(ids), length - GRAM
    at = edges[:-1] + anchor - low
    forward, shared_after = multikey_order(_words(flat, at, edges[1:] - at, 1, length))
    backward, shared_before = multikey_order(_words(flat, at - 1, anchor - low, -1, far))
    again = np.zeros((n, far + 3), bool)
    after, before = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(far + 1):
        # Strings that start d before the anchor are equal if the d bytes before it and the length - d from it on are.
        own = np.flatnonzero((anchor - high <= d) & (d <= anchor - low))
        if len(own) > 1:
            after[forward] = np.cumsum(shared_after < length - d)
            before[backward] = np.cumsum(shared_before < d)
            key = after[own] * (n + 1) + before[own]
            by = np.argsort(key, kind="stable")  # equal ones stay in the order of the corpus
            again[own[by[1:][key[by][1:] == key[by][:-1]]], far + 1 - d] = True
    change = np.diff(again.astype(np.int8), axis=1)
    row, first = np.nonzero(change == 1)
    last = np.nonzero(change == -1)[1] - 1
    # Column far + 1 - d is the start anchor - d; a change stands one before its column.
    return ids[row], dh[row], anchor[row] - far + first, anchor[row] - far + last


def _sorted_ranges(reaches: DataFrame, length: int) -> DataFrame:
    """One range of suffixes at a time: the runs of string starts that repeat."""

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if parts:
            t = pa.Table.from_batches(parts).combine_chunks()
            cells = [t.column(c).to_numpy() for c in ("doc_id", "dh", "low", "high", "anchor")]
            yield from _ranges(*repeated_strings(*cells, t.column("reach").combine_chunks(), length)).to_batches()

    return reaches.mapInArrow(run, RUNS)


def _runs(ids, dh, start):
    """Arrays (doc_id, dh, low, high) of the runs of consecutive starts in each text."""
    order = np.lexsort((start, dh, ids))
    ids, dh, start = ids[order], dh[order], start[order]
    if not len(ids):
        return ids, dh, start, start
    cut = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (dh[1:] != dh[:-1]) | (start[1:] != start[:-1] + 1)]))
    return ids[cut], dh[cut], start[cut], start[np.append(cut[1:], len(ids)) - 1]


def _again(key, ids, dh, start) -> tuple[np.ndarray, np.ndarray]:
    """The order of (key, place in the corpus), each place once, and which strings in that order equal the one before."""
    order = np.lexsort((start, dh, ids, key))
    same = lambda x: x[order][1:] == x[order][:-1]
    order = order[np.concatenate([[True], ~(same(key) & same(ids) & same(dh) & same(start))])]
    return order, np.concatenate([[False], key[order][1:] == key[order][:-1]])


def _string_keys(reaches: list[bytes], low: np.ndarray, high: np.ndarray, anchor: np.ndarray, length: int):
    """For all strings of the reaches: arrays (reach, start, key)."""
    leads = [hashlib.blake2b(r[m : m + GRAM], digest_size=8).digest() for r, m in zip(reaches, (anchor - low).tolist(), strict=True)]
    lead = np.frombuffer(b"".join(leads), ">u8").astype(np.uint64)
    sizes = np.array([len(r) for r in reaches])
    begin = np.cumsum(sizes) - sizes
    prefix = hashing.prefix_sums(np.frombuffer(b"".join(reaches), np.uint8))
    n = high - low + 1
    row = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    h = hashing.ranges(prefix, begin[row] + step, begin[row] + step + length)
    distance = ((anchor - low)[row] - step + 512).astype(np.uint64)
    return row, low[row] + step, hashing.mix(h ^ hashing.mix(lead[row] + distance * np.uint64(hashing.M)))


def _keys(rows: DataFrame, length: int, bits: int) -> DataFrame:
    """Rows of _reaches -> (bucket, docs, hashes, counts, starts, keys): of equal strings that are held at once, the
    earliest goes to the bucket of its key; the others are repeats and go as runs (no keys; starts: low and high), dealt
    by text. However many texts share a string, its bucket gets it once for each HELD strings."""
    names = ["bucket", "docs", "hashes", "counts", "starts", "keys"]
    kinds = (pa.int32(), *[pa.binary()] * 5)

    def flush(held):
        ids, dh, start, key = (np.concatenate(c) for c in zip(*held, strict=True))
        order, again = _again(key, ids, dh, start)
        rows = []
        i, h, a, z = _runs(*(x[order[again]] for x in (ids, dh, start)))
        if len(i):
            rows.append((int(h[:1].view(np.uint64)[0] >> np.uint64(64 - bits)), i.tobytes(), h.tobytes(), b"", np.stack([a, z]).astype(np.int64).tobytes(), b""))
        # In order of (bucket, text), so that a text is named once.
        o = order[~again]
        bucket = (key[o] >> np.uint64(64 - bits)).astype(np.int64)
        by = np.lexsort((start[o], dh[o], ids[o], bucket))
        o, bucket = o[by], bucket[by]
        present, edges = np.unique(bucket, return_index=True)
        edges = np.append(edges, len(o))
        for k, b in enumerate(present.tolist()):
            x = o[edges[k] : edges[k + 1]]
            new = np.flatnonzero(np.concatenate([[True], (ids[x][1:] != ids[x][:-1]) | (dh[x][1:] != dh[x][:-1])]))
            count = np.diff(np.append(new, len(x))).astype(np.uint32)
            rows.append((b, ids[x][new].tobytes(), dh[x][new].tobytes(), count.tobytes(), start[x].astype(np.uint32).tobytes(), key[x].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            ids, dh, low, high, anchor = (batch.column(k).to_numpy() for k in range(5))
            raw = batch.column(6).to_pylist()
            for a, z in hashing.slices([len(r) for r in raw], SLICE):
                row, start, key = _string_keys(raw[a:z], low[a:z], high[a:z], anchor[a:z], length)
                held.append((ids[a:z][row], dh[a:z][row], start, key))
                n += len(key)
                if n >= HELD:
                    yield flush(held)
                    held, n = [], 0
        if n:
            yield flush(held)

    return rows.mapInArrow(run, "bucket int, docs binary, hashes binary, counts binary, starts binary, keys binary")


RUNS = "doc_id long, dh long, low long, high long"


def _ranges(ids, dh, low, high) -> pa.Table:
    return pa.table({"doc_id": ids, "dh": dh, "low": low, "high": high})


def _compare(block: pa.Table) -> pa.Table:
    """One bucket of keys: the starts of strings that equal an earlier one, and the runs that are known."""
    whole = pc.equal(pc.binary_length(block.column("keys")), 0)
    said = [_ranges(np.frombuffer(d, np.int64), np.frombuffer(h, np.int64), *np.frombuffer(s, np.int64).reshape(2, -1)) for d, h, s in zip(*[block.filter(whole).column(c).to_pylist() for c in ("docs", "hashes", "starts")], strict=True)]
    block = block.filter(pc.invert(whole))
    if not block.num_rows:
        return pa.concat_tables(said)
    ids, dh, start, key = [], [], [], []
    for d, h, c, s, k in zip(*[block.column(c).to_pylist() for c in ("docs", "hashes", "counts", "starts", "keys")], strict=True):
        n = np.frombuffer(c, np.uint32)
        ids.append(np.repeat(np.frombuffer(d, np.int64), n))
        dh.append(np.repeat(np.frombuffer(h, np.int64), n))
        start.append(np.frombuffer(s, np.uint32).astype(np.int64))
        key.append(np.frombuffer(k, np.uint64))
    ids, dh, start, key = (np.concatenate(c) for c in (ids, dh, start, key))
    order, again = _again(key, ids, dh, start)
    return pa.concat_tables([*said, _ranges(*_runs(*(x[order[again]] for x in (ids, dh, start))))])


def _remove(rows: DataFrame, length: int, keep_text: bool) -> DataFrame:
    """Rows (uid, text, starts: array of low, high) -> what is left of each text."""
    kind = "uid long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text

    def run(batches):
        for batch in batches:
            out = []
            for uid, t, lists in zip(batch.column(0).to_pylist(), _raw(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                kept, end, removed, spans = [], 0, 0, 0
                runs: list[list[int]] = []
                for s in sorted((s["low"], s["high"] + length) for s in lists):
                    if runs and s[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s[1])
                    else:
                        runs.append(list(s))
                for a, z in runs:
                    kept.append(t[end:a])
                    removed, spans, end = removed + z - a, spans + 1, z
                left = b"".join([*kept, t[end:]])
                out.append((uid, removed, spans, hashlib.sha256(left).hexdigest(), *[left] * keep_text))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * keep_text]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["uid", "n_removed", "n_spans", "kept_sha256", "kept"][: 4 + keep_text])

    return rows.mapInArrow(run, kind)


def remove_repeats(docs: DataFrame, length: int = 100, keep_text: bool = True, bucket_anchors: int = 100_000, range_suffixes: int = 100_000, hot_reaches: int = 100_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with keep_text, kept (binary: a cut may part a character).

    A byte goes if a string of `length` bytes (64 to 200) over it also starts earlier: in a smaller doc_id (null ids
    come last, rows of equal ids by their text's hash, equal rows in some order), or earlier in the same text. Strings
    do not cross documents and are judged on the input. Null text: empty. No rows: no rows. Other columns are not
    returned. Where a reach equals another as a whole, or its lead is hot, 64-bit hashes of either are compared; all
    other strings are compared by their bytes.
    """
    if not 64 <= length <= 200:
        raise ValueError("length must be from 64 to 200")
    spark = docs.sparkSession
    raw = F.coalesce("text", F.lit("")).cast("binary")
    base = docs.select("doc_id", F.xxhash64(raw).alias("dh"), F.md5(raw).alias("md5"), F.octet_length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("sha"))
    base = saved(base.withColumn("uid", F.monotonically_increasing_id()))
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "uid")
    # Joined by row number, not by text: copies of one text, however many, come to no one task.
    first = base.groupBy("md5").agg(F.min(order)["uid"].alias("first")).select("first")
    base = saved(base.join(first, base["uid"] == first["first"], "left").withColumn("again", F.col("first").isNull()).drop("first", "md5"))
    total = base.where("NOT again").agg(F.sum("n_bytes")).first()[0] or 0
    bits = min(20, max(7, (total // 35 // bucket_anchors).bit_length()))

    texts = docs.select("doc_id", F.xxhash64(raw).alias("dh"), "text")
    met = saved(_packed(texts, length, bits).groupBy("bucket").applyInArrow(_neighbours, STARTS))
    done = met.where("NOT open").select("doc_id", "dh", "low", "high")
    own = base.where("NOT again").select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), F.col("dh").alias("own_dh"), "uid")
    keyed = texts.select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc_id"), "dh", "text").where(F.octet_length("text") >= length)

    spot = F.struct("low", "high", "anchor", "lead")
    wanted = met.where("open").groupBy(F.col("doc_id").alias("id"), F.col("dh").alias("own_dh")).agg(F.collect_set(spot).alias("spots"))
    fetched = keyed.join(wanted, (F.col("doc_id") == F.col("id")) & (F.col("dh") == F.col("own_dh"))).select("doc_id", "dh", "text", "spots")
    reaches = saved(_reaches(fetched, length))
    per_lead = reaches.groupBy("lead").agg(F.count("*").alias("n"))
    hot = saved(per_lead.where(F.col("n") > hot_reaches).select("lead"))  # at most one lead for each hot_reaches suffixes
    cold = reaches
    if hot.limit(1).count():
        cold = reaches.join(hot, "lead", "left_anti").select(*reaches.columns)
        hot_strings = _keys(reaches.join(hot, "lead", "left_semi").select(*reaches.columns), length, bits)
        done = done.unionAll(hot_strings.groupBy("bucket").applyInArrow(_compare, RUNS))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), reaches.count() // range_suffixes + 1)
    leading = F.expr(f"substring(reach, cast(anchor - low as int) + 1, {GRAM})")
    edges = _sorted_ranges(cold.repartitionByRange(ranges, leading), length)

    runs = done.unionAll(edges).groupBy(F.col("doc_id").alias("id"), F.col("dh").alias("own_dh")).agg(F.collect_set(F.struct("low", "high")).alias("starts"))
    runs = saved(own.join(runs, ["id", "own_dh"]))
    cut = keyed.join(runs, (F.col("doc_id") == F.col("id")) & (F.col("dh") == F.col("own_dh"))).select("uid", "text", "starts")
    cut = saved(_remove(cut, length, keep_text).dropDuplicates(["uid"]))
    left = base.join(cut, "uid", "left")
    whole = F.col("again") & (F.col("n_bytes") >= length)
    out = {
        "n_removed": F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))),
        "n_spans": F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long"),
        "kept_sha256": F.when(whole, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", "sha")),
    }
    if not keep_text:
        return left.select("doc_id", "n_bytes", *[c.alias(k) for k, c in out.items()])
    unchanged = docs.select("doc_id", F.xxhash64(raw).alias("dh"), raw.alias("raw")).dropDuplicates(["doc_id", "dh"])
    left = left.join(unchanged, left["doc_id"].eqNullSafe(unchanged["doc_id"]) & (left["dh"] == unchanged["dh"])).select(left["*"], "raw")
    return left.select("doc_id", "n_bytes", *[c.alias(k) for k, c in out.items()], F.when(whole, F.lit(b"")).otherwise(F.coalesce("kept", "raw")).alias("kept"))


def brute_force(rows: list[tuple[int, str | None]], length: int) -> dict[int, tuple[int, int, int, str]]:
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256), by a set of all strings; for tests."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        spans = sum(1 for p, g in enumerate(gone) if g and not (p and gone[p - 1]))
        left = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(left).hexdigest())
    return out
