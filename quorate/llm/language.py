"""Language ID by cross-parsing: the language whose labelled text parses a document into the fewest phrases."""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import hashing
from .common import kept, lean

#: Characters that are parsed side by side with others; a text's segments are joined afterwards.
SEGMENT = 2048
#: Characters a step of parsing holds with four languages; with more, fewer.
SLICE = 1 << 21


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


@lru_cache(maxsize=1)
def letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point, whether it is a letter, and the code point of its lower case (itself if that is longer)."""
    kept(letters.cache_clear)
    n = sys.maxunicode + 1
    is_letter, low = np.zeros(n, bool), np.arange(n, dtype=np.uint32)
    for i in range(n):
        c = chr(i)
        if c.isalpha():
            is_letter[i] = True
            if len(x := c.lower()) == 1:
                low[i] = ord(x)
    return is_letter, low


def sample(docs: DataFrame, documents: int = 48, longest: int = 4_000) -> dict[str, str]:
    """The labelled text each language is learned from: the whole texts of `documents` rows that are not held out, chosen by
    a hash among those of up to `longest` characters (of a language that has only longer ones, the shortest). The number of
    languages bounds the sample; its size does not grow with the table. Rows may repeat and doc_ids may be null: each row
    counts once for each different (doc_id, text)."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0) & ~F.coalesce(held_out(), F.lit(False)))
    size = F.greatest(F.length("text"), F.lit(longest)).alias("_n")
    known = known.select("lang", "doc_id", "text", F.xxhash64("text").alias("_t"), size)
    order = Window.partitionBy("lang").orderBy("_n", F.xxhash64("doc_id"), "doc_id", "_t")
    ids = known.select("lang", "doc_id", "_t", "_n").withColumn("k", F.dense_rank().over(order)).where(F.col("k") <= documents)
    ids = ids.where((F.col("_n") == longest) | (F.col("k") == 1)).distinct()
    ids = ids.select(F.col("lang").alias("_l"), F.col("doc_id").alias("_d"), F.col("_t").alias("_h"), "k")
    # `documents` rows a language: broadcast, so that no text is shuffled to find them.
    found = known.join(F.broadcast(ids), (F.col("lang") == F.col("_l")) & F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_h")))
    rows = found.groupBy("lang", "k").agg(F.min("text").alias("text")).collect()  # `documents` rows a language
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["k"])):
        out.setdefault(r["lang"], []).append(r["text"])
    return {k: "\n".join(v) for k, v in out.items()}


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """The moves (code -> state) of each state of the automaton of all substrings. State 0: root."""
    step: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in codes:
        cur = len(step)
        step.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if size[p] + 1 == size[q]:
                link[cur] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return step


def displaced(step: list[dict[int, int]], alphabet: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, owner, target): state s moves with c to target[base[s] + c] if owner[base[s] + c] is s; else it has no move.

    Rows of moves are laid over each other where they don't meet, so the arrays have about as many cells as there are
    moves, whatever the alphabet. Rows of several moves are laid first, the others fill the gaps.
    """
    moves = sum(map(len, step))
    base = np.zeros(len(step), np.int32)
    owner, target = np.full(2 * moves + 2 * alphabet, -1, np.int32), np.zeros(2 * moves + 2 * alphabet, np.int32)
    used = bytearray(len(owner))
    many = sorted((s for s in range(len(step)) if len(step[s]) > 1), key=lambda s: -len(step[s]))
    low = 0
    for s in many:
        codes = list(step[s])
        at, tried = low, 0
        while any(used[at + c] for c in codes):
            at, tried = at + 1, tried + 1
        if tried > 64:
            low += tried // 2
        base[s] = at
        for c in codes:
            used[at + c] = 1
    gaps = (i for i in range(alphabet, len(used)) if not used[i])
    for s in range(len(step)):
        if len(step[s]) == 1:
            (c,) = step[s]
            i = next(gaps)
            used[i] = 1
            base[s] = i - c
    for s, own in enumerate(step):
        for c, t in own.items():
            owner[base[s] + c], target[base[s] + c] = s, t
    # A state without moves points to where no state owns anything.
    base[[s for s in range(len(step)) if not step[s]]] = len(owner) - alphabet
    return base, owner, target


class Model:
    """Automata of all languages, one after the other in the same arrays. Code 0: a letter no language has; 1: any
    non-letter; every letter of the learned texts has a code of its own."""

    def __init__(self, texts: dict[str, str]):
        is_letter, low = letters()
        self.langs = sorted(texts)
        points = {k: low[np.frombuffer(t.encode("utf-32-le"), np.uint32)] for k, t in texts.items()}
        seen = np.unique(np.concatenate([*points.values(), np.zeros(0, np.uint32)]))
        seen = seen[is_letter[seen]]
        self.seen, self.alphabet = seen.astype(np.int64), len(seen) + 2
        lookup = _lookup(self.seen)[0]
        tables, self.ends, self.norm, states, cells = [], [], [], 0, 0
        start = []
        for k in self.langs:
            c = _squeezed(lookup[points[k]]).tolist()
            # The last state is where a letter leads that the language lacks, and where texts begin: it has no moves.
            step = [*suffix_automaton(c), {}]
            base, owner, target = displaced(step, self.alphabet)
            tables.append((base + cells, np.where(owner < 0, -1, owner + states), target + states))
            first = np.full(self.alphabet, states + len(step) - 1, np.int64)
            for x, t in step[0].items():
                first[x] = t + states
            start.append(first)
            self.ends.append(states + len(step) - 1)
            self.norm.append(float(np.log2(len(c) + 2)))
            states, cells = states + len(base), cells + len(owner)
        self.base, self.owner, self.target = (np.concatenate(x).astype(np.int32) if tables else np.zeros(0, np.int32) for x in (zip(*tables, strict=True) if tables else ((), (), ())))
        self.start = np.array(start, np.int32).reshape(len(self.langs), self.alphabet)

    def _step(self, state: np.ndarray, codes: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and where a phrase breaks; start: where codes lead from the root."""
        at = self.base.take(state) + codes
        miss = self.owner.take(at) != state
        return np.where(miss, start, self.target.take(at)), miss

    def _first_parse(self, codes: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(breaks by step, language and column, last states), all columns from a text's beginning; longest first."""
        state = np.repeat(np.array(self.ends, np.int32)[:, None], len(live), axis=1)
        breaks = np.zeros((len(codes), *state.shape), bool)
        for j, n in enumerate(np.searchsorted(-live, -np.arange(len(codes)), side="left").tolist()):
            c = codes[j, :n]
            state[:, :n], breaks[j, :, :n] = self._step(state[:, :n], c, self.start.take(c, axis=1))
        return breaks, state

    def _parse_again(self, codes: np.ndarray, live: np.ndarray, lang: np.ndarray, column: np.ndarray, state: np.ndarray, known: np.ndarray):
        """Parses column[i] with language lang[i] from state[i] up to the first break that it shares with the earlier parse
        `known`, as they are one from there: (breaks by step and i, last states, the step they met at, or -1)."""
        breaks, state, met = np.zeros(known.shape, bool), state.copy(), np.full(len(column), -1)
        on = np.arange(len(column))
        for j in range(len(codes)):
            on = on[(met[on] < 0) & (live[column[on]] > j)]
            if not len(on):
                break
            c = codes[j, column[on]]
            state[on], miss = self._step(state[on], c, self.start[lang[on], c])
            breaks[j, on] = miss
            met[on[miss & known[j, on]]] = j
        return breaks, state, met

    def phrases(self, docs: list[np.ndarray]) -> np.ndarray:
        """Number of phrases of each document (arrays of codes) by language.

        Each phrase is the longest match with the learned text from where the last one ended. Texts are cut into
        segments that are parsed side by side, as if each began a phrase; then each is parsed again from the state in
        which the segment before it ended, up to the first phrase that begins in both parses.
        """
        out = np.zeros((len(docs), len(self.langs)), np.int64)
        parts = [(i, d[a : a + SEGMENT], a > 0) for i, d in enumerate(docs) for a in range(0, len(d), SEGMENT)]
        if not parts or not self.langs:
            return out
        n, many = len(parts), len(self.langs)
        order = sorted(range(n), key=lambda k: -len(parts[k][1]))
        place = {k: c for c, k in enumerate(order)}
        live = np.array([len(parts[k][1]) for k in order])
        owner = np.array([parts[k][0] for k in order])
        before = np.array([place[k - 1] if parts[k][2] else -1 for k in order])
        codes = np.zeros((int(live[0]), n), parts[0][1].dtype)
        for c, k in enumerate(order):
            codes[: live[c], c] = parts[k][1]
        breaks, state = self._first_parse(codes, live)
        # Cell lang * n + column.
        breaks, state = breaks.reshape(len(codes), many * n), state.reshape(many * n)
        lang, column = np.repeat(np.arange(many), n), np.tile(np.arange(n), many)
        follows = np.flatnonzero(before[column] >= 0)
        previous = lang[follows] * n + before[column[follows]]
        entered = np.full(len(follows), -1, np.int32)
        count = breaks.sum(0)
        while len(follows):
            # Segments whose entry state has changed since they were parsed.
            now = np.flatnonzero(entered != state[previous])
            if not len(now):
                break
            again, entered[now] = follows[now], state[previous[now]]
            known = breaks[:, again]
            new, last, met = self._parse_again(codes, live, lang[again], column[again], entered[now], known)
            kept = np.where((met >= 0) & (np.arange(len(codes))[:, None] > met), known, new)
            breaks[:, again], count[again] = kept, kept.sum(0)
            state[again] = np.where(met >= 0, state[again], last)
        np.add.at(out, (owner[column], lang), count)
        return out


def _squeezed(codes: np.ndarray) -> np.ndarray:
    """Runs of non-letters count once."""
    return codes[~((codes == 1) & (np.concatenate([[0], codes[:-1]]) == 1))]


def _lookup(seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code of each code point, and whether it is a letter."""
    is_letter, low = letters()
    small = np.zeros(len(low), np.uint32 if len(seen) > 65_000 else np.uint16)
    small[seen] = np.arange(2, len(seen) + 2)
    return np.where(is_letter, small[low], 1).astype(small.dtype), is_letter


def identify(docs: DataFrame, keep: list[str] | None = None, documents: int = 48, longest: int = 4_000) -> DataFrame:
    """Adds held_out, lang_pred, score and phrase_chars (mean characters of a phrase) to docs, replacing such columns;
    `keep` names the columns of docs to return (all).

    Learned from text and lang of documents that are not held out (a bounded sample, see sample()). A document's text
    alone decides its prediction: the phrases of its whole text, each the longest match with the learned text, times log2
    of the learned text's length, are compared; the fewest win, ties go to the first name. score is the second fewest over the sum of the two fewest (1 with one
    language). `und` with score 0: null text, no letter, or nothing learned. Null doc_id: not held out. Repeated rows
    each get theirs; no rows: no rows; columns of docs with other names are kept. What is broadcast is the automata of
    the sample: about 20 bytes a learned character and language.
    """
    have = [c for c in docs.columns if c not in ("held_out", "lang_pred", "score", "phrase_chars")]
    model = Model(sample(docs, documents, longest))
    known = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    keep = have if keep is None else keep
    at, back = have.index("text"), [have.index(c) for c in keep]
    base = docs.select(*have)

    def run(batches):
        m = known.value
        codes, is_letter = _lookup(m.seen)
        for batch in batches:
            lengths = pc.utf8_length(batch.column(at)).fill_null(0).to_pylist()
            # A step has a cell for each language and each character of its longest segment.
            for lo, hi in hashing.slices([max(n, SEGMENT) for n in lengths], SLICE * 4 // max(4, len(m.langs))):
                part = batch.slice(lo, hi - lo)
                arrays, live = [], []
                for i, t in enumerate(part.column(at).to_pylist()):
                    if t and m.langs:
                        p = np.frombuffer(t.encode("utf-32-le"), np.uint32)
                        if is_letter[p].any():
                            arrays.append(_squeezed(codes[p]))
                            live.append(i)
                count = m.phrases(arrays)
                pred, score, mean = ["und"] * part.num_rows, [0.0] * part.num_rows, [0.0] * part.num_rows
                if live:
                    cost = count * np.array(m.norm)
                    best = cost.argmin(1)
                    low = np.sort(cost, axis=1)
                    share = low[:, 1] / (low[:, 0] + low[:, 1]) if cost.shape[1] > 1 else np.ones(len(live))
                    for k, i in enumerate(live):
                        pred[i], score[i], mean[i] = m.langs[best[k]], float(share[k]), len(arrays[k]) / int(count[k, best[k]])
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in back], pa.array(pred), pa.array(score), pa.array(mean)], [*keep, "lang_pred", "score", "phrase_chars"])

    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("phrase_chars", "double")
    return base.mapInArrow(lean(run), schema).withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
