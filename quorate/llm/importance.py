"""Resampling by importance: documents whose hashed n-grams are more usual in a target than in the corpus are drawn first.

Arrow kernels do the text work of a batch: ascii_lower, split_pattern_regex and list_flatten give its words,
dictionary_encode gives each a number, shifted numbers form n-grams, distinct (n-gram, word) pairs are hashed by CRC-32
once each, and gains are taken by bucket and summed by document. Counts of features by bucket, a table of fixed size, are
all that the driver gets. Ranks among the drawn come from counts by score and places among equal scores.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorate.operators.selection import running_sum

from .common import lean, saved

#: What separates words, once A-Z are lower case.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SLICE = 1 << 20


def _end_of_word(text: str, at: int) -> int:
    """The first place from `at` on that is between words."""
    while at < len(text) and (text[at] > "\x7f" or text[at].isalnum()):
        at += 1
    return at


def runs(texts: pa.Array, n: int):
    """(rows, texts, known) of at most about SLICE characters, in order: texts of one run are of different rows.

    A longer text comes in several runs; each but the first begins with the `known` last n - 1 words of what came before.
    """
    sizes, at = pc.binary_length(texts).to_numpy(zero_copy_only=False), 0
    while at < len(texts):
        end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), SLICE, side="right")))
        if sizes[at] <= SLICE:
            yield np.arange(at, end), texts.slice(at, end - at), 0
        else:
            whole, a, before = texts[at].as_py(), 0, []
            while a < len(whole):
                z = _end_of_word(whole, min(len(whole), a + SLICE))
                part = pa.array([" ".join([*before, whole[a:z]])], pa.string())
                yield np.array([at]), part, len(before)
                before = [w for w in pc.split_pattern_regex(pc.ascii_lower(part.slice(0, 1)), SEPARATOR)[0].as_py() if w][1 - n :] if n > 1 else []
                a = z
            end = at + 1
        at = end


def features(texts: pa.Array, n: int, buckets: int, known: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of words of each text, text of each feature, bucket of each feature); features are runs of 1 to n words, of
    which those that end in the first `known` words of a text are not meant."""
    parts = pc.split_pattern_regex(pc.ascii_lower(texts), SEPARATOR)
    word, row = pc.list_flatten(parts), pc.list_parent_indices(parts)
    some = pc.greater(pc.binary_length(word), 0)
    coded, row = word.filter(some).dictionary_encode(), row.filter(some).to_numpy()
    code = coded.indices.to_numpy().astype(np.int64)
    said = coded.dictionary.cast(pa.binary()).to_pylist()
    words = np.bincount(row, minlength=len(texts))
    place = np.arange(len(row)) - np.repeat(np.cumsum(words) - words, words)  # in its text
    owners, found = [], []
    crc = np.array([zlib.crc32(w) for w in said], np.int64)
    gram = code  # at i: number of the run of g words that begins there
    for g in range(1, n + 1):
        if g > 1:
            whole = len(row) - g + 1
            if whole <= 0:
                break
            pair = gram[:whole] * len(said) + code[g - 1 :]
            distinct, gram = np.unique(pair, return_inverse=True)
            head, tail = np.divmod(distinct, len(said))
            crc = np.array([zlib.crc32(b" " + said[t], int(c)) for t, c in zip(tail.tolist(), crc[head].tolist(), strict=True)], np.int64)
        last = slice(g - 1, None)
        good = (row[: len(gram)] == row[last]) & (place[last] >= known)
        owners.append(row[last][good])
        found.append(crc[gram[good]] % buckets)
    return words - np.minimum(words, known), np.concatenate(owners), np.concatenate(found)


def bucket_counts(texts: DataFrame, n: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, part, known in runs(batch.column(0).fill_null(""), n):
                total += np.bincount(features(part, n, buckets, known)[2], minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(total[hit])], ["bucket", "n"])

    rows = texts.select("text").mapInArrow(lean(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # a row a bucket
    out = np.zeros(buckets, np.int64)
    out[[r["bucket"] for r in rows]] = [r["n"] for r in rows]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(share in the target / share in the source)) of each bucket, one feature being added to each."""
    k, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    one = lambda s, t: math.floor(1000 * math.log(float((t + 1) * (s_all + k)) / float((s + 1) * (t_all + k))))
    return np.array([one(s, t) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def luck(seed: int, doc_id: int | None) -> int:
    """Gumbel noise of a document, in thousandths; a null id draws as an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, seed: int = 2024, least_words: int = 20, percent: int = 10) -> DataFrame:
    """doc_id, n_features, weight, score, rank for each row of docs (doc_id, text); target has text.

    Features are runs of 1 to n words, with repeats. weight: the sum of the gains of its features' buckets; score: weight
    plus noise that doc_id and seed decide. Of the N rows with at least `least_words` words, the floor(N * percent / 100)
    with the highest scores are drawn and ranked from 1, ties to the smaller doc_id (null last, then fewer features).
    Null or empty text: no features, weight 0, never drawn unless least_words is 0. Repeated rows are ranked each. No rows:
    no rows. An empty target has equal shares. Other columns are not returned.
    """
    worth = docs.sparkSession.sparkContext.broadcast(gains(bucket_counts(docs, n, buckets), bucket_counts(target, n, buckets)))

    def run(batches):
        names = ["doc_id", "n_words", "n_features", "weight", "score"]
        for batch in batches:
            rows = batch.num_rows
            words, count, weight = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            for at, part, known in runs(batch.column(1).fill_null(""), n):
                own, row, bucket = features(part, n, buckets, known)
                order = np.argsort(row, kind="stable")
                total = np.concatenate([[0], np.cumsum(worth.value[bucket[order]])])
                ends = np.cumsum(np.bincount(row, minlength=len(part)))
                starts = np.concatenate([[0], ends[:-1]])
                words[at] += own
                count[at] += ends - starts
                weight[at] += total[ends] - total[starts]
            noise = np.array([luck(seed, i) for i in batch.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in (words, count, weight, weight + noise)]], names)

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, n_words long, n_features long, weight long, score long")
    scored = saved(scored)
    good = F.col("n_words") >= least_words
    counts = saved(scored.where(good).groupBy("score").agg(F.count("*").alias("n")))
    drawn = (counts.agg(F.sum("n")).first()[0] or 0) * percent // 100
    edges = running_sum(counts, [F.desc("score")], "n", "before").where(F.col("before") < drawn)
    edges = edges.select(F.col("score").alias("_score"), "before")
    met = scored.join(edges, good & (F.col("score") == F.col("_score")), "left")
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features"))
    first = met.where("before IS NOT NULL").withColumn("rank", F.col("before") + place)
    first = first.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = met.where("before IS NULL").withColumn("rank", F.lit(None).cast("long"))
    return first.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
